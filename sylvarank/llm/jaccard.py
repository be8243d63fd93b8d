"""Exact Jaccard join of documents on word shingles, in the metric space of sets.

One minus the Jaccard similarity is a metric on finite sets.  The join goes
through two levels of pivots.

Documents are the pivots of the first level: a bounded sample, thinned until no
two are within the radius.  Every document's distance to every pivot is measured
while its shingles are made.  A document within the radius of its nearest pivot
lies in that pivot's Voronoi cell and is linked with it, so all of a cell is
connected; one within twice the radius of a pivot lies in the window of its
cell, as by the triangle inequality no other document can link with a member.  A
member stays in the join only if a document of another component lies in the
window at a distance that differs from its own by no more than the radius; this
settles large groups of copies without a shuffle.

Nearly all other pairs of documents are at distance 1, where document pivots
cannot tell them apart.  So the second level has single shingles as pivots,
which are at distance 1 - 1 / n of the documents that have them and 1 of all
others.  A document's nearest pivots are its own shingles, all at one distance;
ties are broken by a common order that puts frequent shingles last, and a
document is replicated to the regions of its first ``n - ceil(t n) + 1``
shingles, the window that any two linked documents share.  Inside a region
documents are pivots again: each document is measured against one, regions whose
documents are connected are done, and the others recurse with more pivots, from
which the triangle inequality keeps away all pairs whose distances to a common
pivot differ by more than the radius.  In the region of the first shingle that
two documents share, neither can share more than it has from there on.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_few, stage, tidy, unstage

WIDTH = 5
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Shingles are numbers of this many bits, and stored in as many bytes.
BITS, BYTES = 48, 6


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def shingle_set(text: str | None, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle, a text without words none.

    ASCII letters are lower-cased, words are what ASCII white space separates.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(n, WIDTH)
    h = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        h = h * M1 + ids[j : n - width + 1 + j]
        h ^= h >> np.uint64(32)
    h = (h ^ (h >> np.uint64(30))) * M2
    h = (h ^ (h >> np.uint64(27))) * M3
    h = (h ^ (h >> np.uint64(31))) >> np.uint64(64 - BITS)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def packed(s: np.ndarray) -> bytes:
    return s.view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // BYTES, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, BYTES)
    return out.view(np.uint64).ravel()


def sketch(s: np.ndarray) -> list[int]:
    """A bitmap with one bit for each element: 1024 bits, doubled until they are twice the elements."""
    bits = np.zeros(max(1024, 1 << (2 * len(s) - 1).bit_length()), bool)
    bits[s & np.uint64(len(bits) - 1)] = True
    return np.packbits(bits).view(np.int64).tolist()


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def linked(common, total, percent: int):
    """Whether sets with so many common elements and so many in all reach the similarity."""
    return 100 * common >= percent * (total - common)


class _Members:
    """A set of shingles that answers fast which elements of others are in it."""

    def __init__(self, keys: np.ndarray, bits: int = 21):
        self.keys, self.shift = keys, np.uint64(BITS - bits)
        self.bitmap = np.zeros(1 << bits, bool)
        self.bitmap[keys >> self.shift] = True

    def find(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``s`` of elements that are in the set, and their places in ``keys``."""
        maybe = np.flatnonzero(self.bitmap[s >> self.shift])
        if not len(maybe):
            return maybe, maybe
        at = np.minimum(np.searchsorted(self.keys, s[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == s[maybe]
        return maybe[hit], at[hit]


class Pivots:
    """Sampled documents as pivots, no two of them linked, with an index of their shingles."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self._index(sets)
        kept: list[int] = []
        for k, s in enumerate(sets):
            common = self.common(s)
            if len(s) and not any(linked(int(common[j]), len(s) + len(sets[j]), percent) for j in kept):
                kept.append(k)
        self._index([sets[k] for k in kept])

    def _index(self, sets: list[np.ndarray]) -> None:
        keys = np.concatenate([*sets, np.zeros(0, np.uint64)])
        of = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        order = np.argsort(keys, kind="stable")
        self.of, self.sizes = of[order], np.asarray([len(s) for s in sets], np.int64)
        unique, self.starts, self.counts = np.unique(keys[order], return_index=True, return_counts=True)
        self.members = _Members(unique) if len(unique) else None

    def common(self, s: np.ndarray) -> np.ndarray:
        """How many elements of ``s`` each pivot has."""
        if self.members is None:
            return np.zeros(len(self.sizes), np.int64)
        _, at = self.members.find(s)
        n = self.counts[at]
        rows = np.repeat(self.starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.of[rows], minlength=len(self.sizes))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def sample_pivots(rows: DataFrame, percent: int, count: int = 512, longest: int = 16_384) -> Pivots:
    """Of the ``count`` ids of smallest hash, the documents of at most ``longest`` bytes: 8 MB of texts at most."""
    ids = rows.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(count).distinct().withColumnRenamed("doc_id", "id")
    texts = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("id"), "left_semi").where(F.octet_length("text") <= longest).limit(2 * count)
    hashes = _Hashes()
    return Pivots([shingle_set(r["text"], hashes) for r in texts.select("text").collect()] if 2 * percent > 100 else [], percent)


FACTS = "doc_id long, n long, hi long, lo long, shingles binary, sketch array<long>, cell int, cell_d double, links array<int>, near array<int>, near_d array<double>, shingle long, times long"


def _facts(rows: DataFrame, pivots: Pivots, percent: int) -> DataFrame:
    """A row per document, and the shingles that a task meets often.

    ``doc_id, n, hi, lo``: id, size and digest of the set.  The first row of a
    task with some set also has its ``shingles`` and their ``sketch``, its ``cell`` (the nearest
    pivot, if linked) and the distance, the other ``links`` with pivots, and the
    pivots ``near`` it: within twice the radius but not linked.
    """
    sent = rows.sparkSession.sparkContext.broadcast(pivots)
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64())}[k]) for n, k in (c.split(" ") for c in FACTS.split(", "))])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hashes = sent.value, _Hashes()
        out, size, seen, pending, held = [], 0, set(), [], 0
        often_h, often_n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def merge() -> None:
            nonlocal often_h, often_n, pending, held
            h, n = np.unique(np.concatenate(pending) if pending else np.zeros(0, np.uint64), return_counts=True)
            h, n = np.concatenate([often_h, h[n > 1]]), np.concatenate([often_n, n[n > 1]])
            often_h, at = np.unique(h, return_inverse=True)
            often_n = np.bincount(at, n, len(often_h)).astype(np.int64)
            pending, held = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal out, size
            got = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, size = [], 0
            return got

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                s = shingle_set(text.as_py(), hashes)
                raw = packed(s)
                key = blake2b(raw, digest_size=16).digest()
                hi, lo = np.frombuffer(key, np.int64).tolist()
                doc = doc.as_py()
                if key in seen or doc is None or not len(s):
                    out.append((doc, len(s), hi, lo, *[None] * 9))
                else:
                    seen.add(key)
                    pending.append(s)
                    held += len(s)
                    common = own.common(s)
                    near = np.flatnonzero(linked(common, len(s) + own.sizes, 2 * percent - 100) & (common > 0))
                    cell = cell_d = links = None
                    distance = np.zeros(0)
                    if len(near):
                        total = len(s) + own.sizes[near]
                        distance, inside = 1 - common[near] / (total - common[near]), linked(common[near], total, percent)
                        mine, near, distance, own_d = near[inside], near[~inside], distance[~inside], distance[inside]
                        if len(mine):
                            first = int(np.argmin(own_d))
                            cell, cell_d, links = int(mine[first]), float(own_d[first]), np.delete(mine, first).tolist()
                    out.append((doc, len(s), hi, lo, raw, sketch(s), cell, cell_d, links, near.tolist(), distance.tolist(), None, None))
                    size += len(raw) + len(s)
                    if held > 400_000:
                        merge()
                if len(out) >= 10_000 or size > 2_000_000:
                    yield flush()
        if out:
            yield flush()
        merge()
        top = np.argsort(-often_n, kind="stable")[:131_072]
        if len(top):
            none = [pa.nulls(len(top), f.type) for f in list(schema)[:-2]]
            yield pa.RecordBatch.from_arrays([*none, pa.array(often_h[top].view(np.int64)), pa.array(often_n[top])], schema=schema)

    return rows.mapInArrow(tidy(emit), FACTS)


def _pivot_roots(facts: DataFrame, pivots: Pivots, percent: int) -> tuple[list[int], list[float]]:
    """Of each pivot the least pivot it is connected with, and the distance of the nearest document of another component in its window.

    The driver gets a row per pair of pivots at most.
    """
    k = len(pivots.sizes)
    root, reach = list(range(k)), [float("inf")] * k

    def top(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for r in facts.where("size(links) > 0").select("cell", F.explode("links").alias("link")).distinct().collect():
        a, b = sorted((top(r["cell"]), top(r["link"])))
        root[b] = a
    root = [top(x) for x in range(k)]
    window = facts.where("size(near) > 0").select("cell", F.explode(F.arrays_zip("near", "near_d")).alias("x"))
    for r in window.groupBy("cell", F.col("x.near").alias("near")).agg(F.min("x.near_d").alias("d")).collect():
        if r["cell"] is None or root[r["cell"]] != root[r["near"]]:
            reach[r["near"]] = min(reach[r["near"]], r["d"])
    return root, reach


def _per_pivot(column: str, values: list, kind: str):
    """The entry of a pivot in a list with one value for each; null for no pivot."""
    return F.element_at(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col(column) + 1)


PARTS = "part int, keys binary, docs binary, sizes binary, rest binary"
REGIONS = "shingle long, doc_id long, n int, rest int"


def _prefixes(carriers: DataFrame, heavy: np.ndarray, percent: int, parts: int) -> DataFrame:
    """The regions of each document as packed columns, dealt to ``parts`` by shingle.

    Of each row ``keys`` has the shingle, ``docs`` the document, ``sizes`` the
    size of its set and ``rest`` how many of its shingles come from this one on
    in the common order.  Rows of frequent shingles are in negative parts, which
    say nothing of the shingle.

    ``heavy``: frequent shingles, the most frequent last.
    """
    by_hash = np.argsort(heavy)
    sent = carriers.sparkSession.sparkContext.broadcast((heavy[by_hash], by_hash))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = sent.value
        members = _Members(known) if len(known) else None
        keys, ids, sizes, rares, held, turn = [], [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal turn
            lengths, n = [len(x) for x in keys], np.asarray(sizes, np.int32)
            key, doc, size = np.concatenate(keys), np.repeat(np.asarray(ids, np.int64), lengths), np.repeat(n, lengths)
            at = np.concatenate([np.arange(m, dtype=np.int32) for m in lengths])
            rest, often = size - at, at >= np.repeat(np.asarray(rares, np.int32), lengths)
            part = (key % np.uint64(parts)).astype(np.int32)
            part[often] = -1 - (doc[often] + turn) % parts
            turn += 1
            order = np.argsort(part, kind="stable")
            part, cells = part[order], [x[order] for x in (key, doc, size, rest)]
            starts = np.flatnonzero(np.diff(part, prepend=part[0] - 1))
            stops = np.append(starts[1:], len(part))
            columns = [[packed(cells[0][a:b]) for a, b in zip(starts, stops)], *([c[a:b].tobytes() for a, b in zip(starts, stops)] for c in cells[1:])]
            return pa.RecordBatch.from_arrays([pa.array(part[starts]), *(pa.array(c, pa.binary()) for c in columns)], [c.split(" ")[0] for c in PARTS.split(", ")])

        for batch in batches:
            for doc, raw in zip(batch.column(0), batch.column(1)):
                s = unpacked(raw.as_py())
                p, few, at = prefix_length(len(s), percent), np.zeros(0, np.int64), np.zeros(0, np.int64)
                if members is not None:
                    few, at = members.find(s)
                rare = np.delete(s, few) if len(few) else s
                rares.append(len(rare))
                if len(rare) < p:
                    rare = np.concatenate([rare, s[few[np.argsort(place[at])]][: p - len(rare)]])
                keys.append(rare[:p])
                ids.append(doc.as_py())
                sizes.append(len(s))
                held += p
                if held > 400_000:
                    yield flush()
                    keys, ids, sizes, rares, held = [], [], [], [], 0
        if keys:
            yield flush()

    return carriers.select("doc_id", "shingles").mapInArrow(tidy(emit), PARTS)


def _shared(prefixes: DataFrame, percent: int, near: int = 8) -> DataFrame:
    """The region rows whose shingle another document has, but for those that none can link with.

    A part has all rows of its shingles.  A row is compared with the ``near``
    rows on either side of it by shingle, and kept unchecked where its shingle
    has more.  Frequent shingles are kept as they are.
    """
    names = [c.split(" ")[0] for c in REGIONS.split(", ")]

    def keep(table: pa.Table) -> pa.Table:
        raw = [b"".join(c.to_pylist()) for c in table.columns[1:]]
        key, doc, n, rest = unpacked(raw[0]), *(np.frombuffer(r, t) for r, t in zip(raw[1:], (np.int64, np.int32, np.int32)))
        if table.column(0)[0].as_py() >= 0 and len(key):
            order = np.argsort(key, kind="stable")
            key, doc, n, rest = key[order], doc[order], n[order], rest[order]
            on = np.zeros(len(key), bool)
            for k in range(1, near + 1):
                i = np.flatnonzero(key[k:] == key[:-k]) if len(key) > k else np.zeros(0, np.int64)
                if not len(i):
                    break
                j = i + k
                fit = ((100 + percent) * np.minimum(rest[i], rest[j]).astype(np.int64) >= percent * (n[i].astype(np.int64) + n[j])) & (doc[i] != doc[j])
                on[i[fit]] = on[j[fit]] = True
            starts = np.flatnonzero(np.diff(key, prepend=key[0] + np.uint64(1)))
            many = np.repeat(np.diff(np.append(starts, len(key))) > near + 1, np.diff(np.append(starts, len(key))))
            key, doc, n, rest = (c[on | many] for c in (key, doc, n, rest))
        return pa.Table.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(n), pa.array(rest)], names=names)

    return prefixes.groupBy("part").applyInArrow(keep, REGIONS)


def connected(edges: DataFrame, what: str = "labels") -> DataFrame:
    """``node, label``: the least node of each component of the edges ``a, b``.

    Least labels go along edges, then labels take their label's label, until
    nothing changes; a path of n nodes takes about log n rounds.  Sums over a
    node's edges are partial, and joins on a node have one row per node on the
    other side, so nodes with very many edges are split.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), what)
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(seen, "node").select("node", "label", F.least("label", "near").alias("next"))
        up = moved.select(F.col("node").alias("next"), F.col("next").alias("above"))
        jumped = stage(moved.join(up, "next").select("node", F.col("label").alias("was"), "above"), what)
        labels = jumped.select("node", F.col("above").alias("label"))
        if jumped.where("was <> above").isEmpty():
            return labels


def _relabel(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``doc_id, first, label`` after the components that ``links`` (``x, p``) join become one."""
    ends = links.join(nodes.select(F.col("doc_id").alias("x"), F.col("label").alias("a")), "x").join(nodes.select(F.col("doc_id").alias("p"), F.col("label").alias("b")), "p").where("a <> b").select("a", "b")
    ends = stage(ends.distinct(), "links")
    if ends.isEmpty():
        return nodes
    merged = connected(ends).withColumnRenamed("label", "to")
    return stage(nodes.join(merged, nodes["label"] == merged["node"], "left").select("doc_id", "first", F.coalesce("to", "label").alias("label")), "nodes")


def _possible(pairs: DataFrame, carriers: DataFrame, percent: int, most: int) -> DataFrame:
    """``x, p, possible``: whether the sketches of a pair leave it open that the two are linked.

    A bit that only one of two sketches has stands for an element, at least,
    that only that set has; so many elements at most are common.  Of a longer
    sketch, as many parts as make the length of the shorter one are laid on top
    of each other.
    """
    small = carriers.select("doc_id", F.col("n").cast("long").alias("n"), "sketch")
    of_x, of_p = (small.select(F.col("doc_id").alias(c), F.col("n").alias(f"{c}n"), F.col("sketch").alias(f"{c}s")) for c in "xp")
    ends = broadcast_if_few(stage(pairs.select("p").distinct(), "ends"), most)
    both = of_x.join(broadcast_if_few(pairs.select("x", "p"), most), "x").join(of_p.join(ends, "p", "left_semi"), "p")
    fold = lambda a, n: F.aggregate(F.sequence(F.lit(0), (F.size(a) / n).cast("int") - 1), F.array_repeat(F.lit(0).cast("long"), n), lambda t, k: F.zip_with(t, F.slice(a, k * n + 1, n), lambda u, v: u.bitwiseOR(v)))
    n = F.least(F.size("xs"), F.size("ps"))
    both = both.withColumns({c: F.when(F.size(c) > n, fold(F.col(c), n)).otherwise(F.col(c)) for c in ("xs", "ps")})
    only = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: F.bit_count(u.bitwiseAND(F.bitwise_not(v)))), F.lit(0).cast("long"), lambda t, k: t + k)
    most_common = F.least(F.col("xn") - only("xs", "ps"), F.col("pn") - only("ps", "xs"))
    return stage(both.select("x", "p", ((100 + percent) * most_common >= percent * (F.col("xn") + F.col("pn"))).alias("possible")), "possible")


def _measured(pairs: DataFrame, carriers: DataFrame, percent: int, most: int = 300_000) -> DataFrame:
    """``x, p, distance, linked`` of the pairs, from their whole sets; no distance where the sketches rule a link out.

    Sets are read where they lie: pairs, if there are at most ``most``, go to
    them, so that of each pair only one set is moved to the other.
    """
    told = _possible(pairs, carriers, percent, most)
    pairs, sets = told.where("possible"), carriers.select("doc_id", "shingles")
    asked = broadcast_if_few(pairs.select("x", "p"), most)
    ends = broadcast_if_few(stage(pairs.select("p").distinct(), "ends"), most)
    with_x = sets.select(F.col("doc_id").alias("x"), F.col("shingles").alias("sx")).join(asked, "x")
    both = with_x.join(sets.select(F.col("doc_id").alias("p"), F.col("shingles").alias("sp")).join(ends, "p", "left_semi"), "p")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, total, last, right = [], [], None, np.zeros(0, np.uint64)
            for sx, p, sp in zip(batch.column(2), batch.column(1).to_pylist(), batch.column(3)):
                if p != last:
                    last, right = p, unpacked(sp.as_py())
                left = unpacked(sx.as_py())
                few, many = (left, right) if len(left) < len(right) else (right, left)
                at = np.searchsorted(many, few)
                common.append(int((many[np.minimum(at, len(many) - 1)] == few).sum()))
                total.append(len(left) + len(right))
            i, t = np.asarray(common, np.int64), np.asarray(total, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(1 - i / np.maximum(t - i, 1)), pa.array(linked(i, t, percent))], ["x", "p", "distance", "linked"])

    exact = both.select("x", "p", "sx", "sp").mapInArrow(tidy(compare), "x long, p long, distance double, linked boolean")
    return stage(exact.unionByName(told.where("not possible").select("x", "p", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("linked"))), "distances")


def jaccard_components(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", heavy_limit: int = 262_144, pivots: int = 512, rows_per_part: int = 500_000) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per document, exact.

    Documents link when their sets' similarity is at least ``percent`` / 100;
    ``component_id`` is the smallest id that links lead to.  Texts without words
    (null and empty ones too) have no shingles and are alone; rows without an id
    have no component.  Rows that repeat an id are one document.  Shingles are
    compared by 48-bit hashes, sets by 128 bits.

    ``heavy_limit`` bounds the list of frequent shingles that is sent to the
    tasks (2 MB), ``pivots`` the sampled documents (4 MB of shingles at most).
    Both only set what is compared when, not what is found.
    """
    rows = _rows(docs, id_col, text_col)
    sample = sample_pivots(rows, percent, pivots)
    facts = stage(_facts(rows, sample, percent), "facts")
    often = facts.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "shingle").limit(heavy_limit).select("shingle").toArrow()
    heavy = often.column(0).to_numpy()[::-1].astype(np.int64).view(np.uint64)
    holds = F.when(F.col("near").isNotNull(), F.col("doc_id"))  # rows that have their set
    info = facts.where("shingle is null").select("doc_id", "n", "hi", "lo", "cell", holds.alias("holder"))
    root, reach = _pivot_roots(facts, sample, percent)
    classes = stage(info.where("n > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.min("holder").alias("holder"), F.max(_per_pivot("cell", root, "int")).alias("root")), "classes")
    least = classes.where("root is not null").groupBy("root").agg(F.min("rep").alias("least"))  # a row per pivot at most
    classes = stage(classes.join(F.broadcast(least), "root", "left").select("hi", "lo", "holder", F.coalesce("least", "rep").alias("label")), "classes")
    spare = F.col("own").isNotNull() & (F.col("own") != F.col("holder"))
    members = info.where("n > 0 and doc_id is not null").select("doc_id", "n", "hi", "lo", F.col("holder").alias("own")).join(classes, ["hi", "lo"]).select("doc_id", "n", "label", spare.alias("spare"))
    alone = info.where("n = 0 or doc_id is null").select("doc_id", "n", F.lit(None).cast("long").alias("label"), F.lit(False).alias("spare"))
    members = stage(members.unionByName(alone), "members")

    # members of a cell whose window holds no other component near enough are done
    active = F.col("cell").isNull() | (_per_pivot("cell", reach, "double") <= F.col("cell_d") + (1 - percent / 100) + 1e-9)
    carriers = facts.where(F.col("shingles").isNotNull() & active).select("doc_id", "n", "shingles", "sketch")
    size = carriers.agg(F.coalesce(F.sum(F.col("n") * (100 - percent) / 100 + 1), F.lit(0.0)).alias("s")).first()["s"]
    labels = stage(members.where("label is not null").groupBy("doc_id").agg(F.min("label").alias("first"), F.max("label").alias("last"), F.min("spare").alias("spare")), "labels")
    # of equal sets that several tasks met, one goes on; an id of several texts does, as it links them
    copies = broadcast_if_few(labels.where("spare and first = last").select(F.col("doc_id").alias("copy")), 1_000_000)
    ones = carriers.join(copies, F.col("doc_id") == F.col("copy"), "left_anti")
    mine = ones.select("doc_id").distinct()
    nodes = stage(labels.join(mine, "doc_id", "left_semi").select("doc_id", "first", F.col("first").alias("label")), "nodes")

    prefixes = stage(_shared(_prefixes(ones, heavy, percent, max(32, int(size) // rows_per_part)), percent), "prefixes")
    pivot = F.min(F.struct(F.xxhash64("doc_id").alias("turn"), F.col("doc_id").alias("p"), F.col("n").alias("pn"), F.col("rest").alias("pr")))
    shared = stage(prefixes.groupBy("shingle").agg(F.count("*").alias("times"), F.min("n").alias("least"), pivot.alias("m")).where("times > 1").select("shingle", "least", "m.p", "m.pn", "m.pr"), "shared")
    regions = prefixes.join(shared, "shingle").select("shingle", F.col("doc_id").alias("x"), F.col("n").alias("xn"), F.col("rest").alias("xr"), "p", "pn", "pr", "least")
    # a document stays in a region if what it has from there on can be enough for its least possible partner
    partner = F.greatest(F.col("least").cast("double"), F.col("xn") * percent / 100)
    regions = stage(regions.where(F.col("xr") * (100 + percent) >= percent * (F.col("xn") + partner) - 1e-6), "regions")
    unstage(prefixes)
    unstage(shared)

    # in the region of their first common shingle, two documents can share no more than what either has left
    room = (100 + percent) * F.least("xr", "pr").cast("long") >= percent * (F.col("xn") + F.col("pn")).cast("long")
    of_x, of_p = (nodes.select(F.col("doc_id").alias(c), F.col("label").alias(f"{c}l")) for c in "xp")
    # one shuffle by x serves both sums; a document has a row per shingle of its prefix at most
    cells = regions.where((F.col("x") != F.col("p")) & room).select("x", "p").repartition("x").groupBy("x", "p").agg(F.count("*").alias("times"))
    nearest = cells.groupBy("x").agg(F.max(F.struct("times", "p")).alias("m")).select("x", F.col("m.p").alias("p"))
    nearest = stage(nearest.join(of_x, "x").join(of_p, "p").where("xl <> pl").select("x", "p"), "cells")
    known = _measured(nearest, carriers, percent)
    nodes = _relabel(nodes, known.where("linked"))

    many, live, old = 8, regions.select("shingle", "x", "xn", "xr"), regions
    while True:
        labelled = live.join(nodes.select(F.col("doc_id").alias("x"), F.col("label").alias("xl")), "x")
        mixed = labelled.groupBy("shingle").agg(F.min("xl").alias("a"), F.max("xl").alias("b"), F.min("xn").alias("least")).where("a <> b").select("shingle", "least")
        live = labelled.join(mixed, "shingle").where(F.col("xr") * (100 + percent) >= percent * (F.col("xn") + F.greatest(F.col("least").cast("double"), F.col("xn") * percent / 100)) - 1e-6)
        live = stage(live.drop("least").withColumn("turn", F.xxhash64("x")), "live")
        unstage(old)
        old = live
        if live.isEmpty():
            break
        order = Window.partitionBy("shingle").orderBy("turn", "x")
        pivots_ = stage(live.withColumn("k", F.row_number().over(order)).where(F.col("k") <= many).select("shingle", F.col("x").alias("p"), F.col("xn").alias("pn"), F.col("xr").alias("pr"), F.col("xl").alias("pl"), F.col("turn").alias("pt")), "pivots")
        later = (F.col("turn") > F.col("pt")) | ((F.col("turn") == F.col("pt")) & (F.col("x") > F.col("p")))
        pairs = live.join(pivots_, "shingle").where(room & later & (F.col("xl") != F.col("pl"))).select("x", "p").distinct()
        pairs = pairs.join(known.select("x", "p"), ["x", "p"], "left_anti").join(known.select(F.col("p").alias("x"), F.col("x").alias("p")), ["x", "p"], "left_anti")
        pairs = stage(pairs, "pairs")
        if not pairs.isEmpty():
            # a common pivot whose distances differ by more than the radius keeps two documents apart
            from_x = known.select("x", F.col("p").alias("q"), F.col("distance").alias("dx"))
            from_p = known.select(F.col("x").alias("p"), F.col("p").alias("q"), F.col("distance").alias("dp"))
            apart = pairs.join(from_x, "x").join(from_p, ["p", "q"]).where(F.abs(F.col("dx") - F.col("dp")) > 1 - percent / 100 + 1e-9).select("x", "p").distinct()
            new = _measured(stage(pairs.join(apart, ["x", "p"], "left_anti"), "near"), carriers, percent)
            known = stage(known.union(new), "known")
            nodes = _relabel(nodes, new.where("linked"))
        done = pivots_.select("shingle", F.col("p").alias("x"))
        live = live.select("shingle", "x", "xn", "xr").join(done, ["shingle", "x"], "left_anti")
        many *= 8
    unstage(facts)
    moved = broadcast_if_few(stage(nodes.where("first <> label").groupBy(F.col("first").alias("label")).agg(F.min("label").alias("to")), "moved"), 1_000_000)
    out = members.join(moved, "label", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("to", "label", "doc_id").alias("component_id"))
