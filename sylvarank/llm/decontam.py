"""Benchmark decontamination: rare n-gram seeds and Smith-Waterman alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

MATCH, MISMATCH, GAP = 2, -1, -1
HITS = "doc_id long, item_id long, score long, similarity double, first_word long, last_word long"


def plain(word: str) -> str:
    """Lower case, without what is neither letter nor digit at either end."""
    word = word.lower()
    if word.isalnum():
        return word
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b]


def words_of(text: str | None) -> list[str]:
    return [w for w in map(plain, (text or "").split()) if w]


class _Ids(dict):
    """Word as it stands in a text -> id; 0: not in any item, -1: no word."""

    def __init__(self, ids: dict[str, int]):
        self.ids = ids

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        bare = plain(word)
        got = self[word] = self.ids.get(bare, 0) if bare else -1
        return got

    def words(self, text: str) -> np.ndarray:
        parts = text.split()
        out = np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))
        return out[out >= 0] if (out < 0).any() else out


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment: its score, and the end in ``text``.

    One array operation per row: the run of gaps within a row is a running
    maximum after the slope of the gap cost is taken out.
    """
    slope = np.arange(len(text) + 1, dtype=np.int64) * -GAP
    row, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for w in item:
        step = np.maximum(row[1:] + GAP, row[:-1] + np.where(text == w, MATCH, MISMATCH) if w else row[:-1] + MISMATCH)
        row = np.concatenate([[0], np.maximum(step, 0)])
        row = np.maximum.accumulate(row + slope) - slope
        top = int(row.max())
        if top > best:
            best, end = top, int(row.argmax())
    return best, end


class Items:
    """Benchmark items as word ids, with their n-grams as numbers."""

    def __init__(self, rows: list[tuple[int, str | None]], n: int):
        self.n = n
        self.vocabulary: dict[str, int] = {}
        self.items = [(i, np.asarray([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(t)], np.int64)) for i, t in rows]
        self.items = [(i, w) for i, w in self.items if len(w)]
        self.base = len(self.vocabulary) + 1
        grams, item, at = [], [], []
        for k, (_, w) in enumerate(self.items):
            g = self.grams(w)
            grams.append(g)
            item.append(np.full(len(g), k))
            at.append(np.arange(len(g)))
        self.gram, self.of, self.at = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (grams, item, at))
        self.all = np.unique(self.gram)

    def grams(self, words: np.ndarray) -> np.ndarray:
        """Numbers of the n-grams, with wrap-around; -1 where a word is in no item.  Texts of fewer words have none."""
        k = len(words) - self.n + 1
        if k <= 0:
            return np.zeros(0, np.int64)
        out, known = np.zeros(k, np.int64), np.ones(k, bool)
        for j in range(self.n):
            part = words[j : j + k]
            out = out * self.base + part
            known &= part > 0
        return np.where(known, np.abs(out), -1)


def _texts(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[tuple[int, np.ndarray]]:
    ids = _Ids(items.vocabulary)
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                yield doc, ids.words(text)


def gram_counts(docs: DataFrame, items: Items) -> dict[int, int]:
    """In how many documents each n-gram of the items occurs, over all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        seen = np.zeros(len(own.all), np.int64)
        for _, words in _texts(batches, own):
            g = own.grams(words)
            g = g[g >= 0]
            if len(g) and len(own.all):
                k = np.minimum(np.searchsorted(own.all, g), len(own.all) - 1)
                seen[np.unique(k[own.all[k] == g])] += 1
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(own.all[there]), "n": pa.array(seen[there])})

    got = docs.mapInArrow(tidy(count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in got.collect()}


def rare_seeds(items: Items, counts: dict[int, int], factor: float = 4.0, floor: int = 16) -> np.ndarray:
    """Which of the items' n-grams are seeds.

    Rare is meant relative to the item: an n-gram counts when it occurs in at
    most ``factor`` times as many documents as the item's lower quartile does,
    and ``floor`` more.  So an item that leaked into very many documents keeps
    its seeds, and a run of common words in it is none.
    """
    df = np.asarray([counts.get(int(g), 0) for g in items.gram], np.float64)
    keep = np.zeros(len(df), bool)
    for k in range(len(items.items)):
        own = np.flatnonzero(items.of == k)
        if len(own):
            keep[own] = df[own] <= factor * np.quantile(df[own], 0.25) + floor
    return keep


def find_alignments(words: np.ndarray, items: Items, seeds: tuple[np.ndarray, ...], least: float) -> list[tuple[int, int, float, int, int]]:
    """``item, score, similarity, first, last`` of the items that a text holds."""
    gram, of, at, firsts = seeds
    g = items.grams(words)
    pos = np.flatnonzero(g >= 0)
    if not len(pos) or not len(gram):
        return []
    unique = gram[firsts]
    k = np.minimum(np.searchsorted(unique, g[pos]), len(unique) - 1)
    hit = unique[k] == g[pos]
    pos, k = pos[hit], k[hit]
    if not len(pos):
        return []
    ends = np.append(firsts[1:], len(gram))
    n = (ends - firsts)[k]
    rows = np.repeat(firsts[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    where, item, diagonal = np.repeat(pos, n), of[rows], np.repeat(pos, n) - at[rows]
    order = np.lexsort((diagonal, item))
    where, item, diagonal = where[order], item[order], diagonal[order]
    size = np.asarray([len(w) for _, w in items.items])[item]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > 8 + size[1:] // 4)
    found: dict[int, tuple[int, int, int]] = {}
    starts = np.flatnonzero(new)
    for a, b in zip(starts, np.append(starts[1:], len(item))):
        k, m = int(item[a]), int(size[a])
        pad = 8 + m // 4
        low, high = max(0, int(diagonal[a]) - pad), min(len(words), int(diagonal[b - 1]) + m + pad)
        score, end = align(items.items[k][1], words[low:high])
        if score > found.get(k, (0,))[0]:
            found[k] = (score, low, low + end)
    out = []
    for k, (score, low, end) in sorted(found.items()):
        own = items.items[k][1]
        if score >= least * MATCH * len(own):
            _, back = align(own[::-1], words[low:end][::-1])
            out.append((k, score, score / (MATCH * len(own)), end - back, end - 1))
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, words_per_block: int) -> Iterator[list[tuple[int, str]]]:
    block, n = [], 0
    for row in benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(item_col, text_col).toLocalIterator():
        block.append((row[0], row[1]))
        n += len(row[1].split())
        if n >= words_per_block:
            yield block
            block, n = [], 0
    if block:
        yield block


def _seeded(rows: DataFrame, benchmark: DataFrame, n: int, words_per_block: int, item_col: str, item_text_col: str) -> Iterator[Broadcast]:
    """The items of each block with their seeds, sent to the tasks."""
    for block in _blocks(benchmark, item_col, item_text_col, words_per_block):
        items = Items(block, n)
        keep = rare_seeds(items, gram_counts(rows, items))
        order = np.lexsort((items.at[keep], items.of[keep], items.gram[keep]))
        gram, of, at = items.gram[keep][order], items.of[keep][order], items.at[keep][order]
        yield rows.sparkSession.sparkContext.broadcast((items, (gram, of, at, np.unique(gram, return_index=True)[1])))


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.4, words_per_block: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item it holds a copy of, edited ones included: ``HITS``.

    Words are compared in lower case without punctuation around them.  Every
    seed shared by a document and an item leads to an alignment of the item with
    the words around it (match 2, mismatch and gap -1); ``similarity`` is the
    score over that of the whole item against itself, and counts from ``least``
    on.  ``first_word, last_word`` is the aligned part of the document.

    The items are a query set that all rows are held against: they are sent to
    the tasks in blocks of at most ``words_per_block`` words, so what is sent is
    bounded.  Documents are scanned twice per block, first to count n-grams over
    all of them, and never shuffled.  Items shorter than ``n`` words have no
    n-grams and are not looked for.  Null and empty texts, items and ids match
    nothing; repeated rows are reported each; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    spark, out = docs.sparkSession, None
    for sent in _seeded(rows, benchmark, n, words_per_block, item_col, item_text_col):

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items, seeds = sent.value
            kinds = {"long": pa.int64(), "double": pa.float64()}
            found = [(doc, items.items[k][0], *rest) for doc, words in _texts(batches, items) for k, *rest in find_alignments(words, items, seeds, least)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[h.split(" ")[1]]) for c, h in zip(zip(*found), HITS.split(", "))], [h.split(" ")[0] for h in HITS.split(", ")])

        part = rows.mapInArrow(tidy(score), HITS)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], HITS)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.4, words_per_block: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item, found as by ``contaminated``.

    Rows are aligned and kept or dropped in one pass per block of items, so
    texts are not shuffled.  Each row is judged by its own text; rows without an
    id or a text stay.
    """
    place, ids = docs.columns.index(text_col), docs.columns.index(id_col)
    rows, out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null"), docs
    for sent in _seeded(rows, benchmark, n, words_per_block, item_col, item_text_col):

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items, seeds = sent.value
            known = _Ids(items.vocabulary)
            for batch in batches:
                clean = [doc is None or not text or not find_alignments(known.words(text), items, seeds, least) for doc, text in zip(batch.column(ids).to_pylist(), batch.column(place).to_pylist())]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(tidy(keep), docs.schema)
    return out
