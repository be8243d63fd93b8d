"""Toxicity: a bidirectional gated recurrent network over words and their characters."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, sampled_texts, tidy

WINDOW, STRIDE = 64, 48
HIDDEN, WORD, CHAR = 8, 8, 8
WORD_BUCKETS, CHAR_BUCKETS = 1 << 16, 1 << 14
INPUT = WORD + CHAR + 2
#: Words that are prepared at a time while training, to keep the driver small.
PART = 10_000
EDGES = ".,;:!?|\"'()[]{}<>-*_"


def split_words(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def word_buckets(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.strip(EDGES).encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words)) % WORD_BUCKETS


def char_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character trigrams of words between edge marks, and each one's word."""
    bare = [w.strip(EDGES) for w in words]
    lengths = np.fromiter(map(len, bare), np.int64, len(bare)) + 2
    ends = np.cumsum(lengths)
    points = np.full(int(ends[-1]) if len(bare) else 0, 0x110000, np.uint64)
    inside = np.ones(len(points), bool)
    inside[ends - 1] = inside[ends - lengths] = False
    points[inside] = np.frombuffer("".join(bare).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(bare)), lengths)
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = (points[:-2] * np.uint64(0x9E3779B1) + points[1:-1]) * np.uint64(0x85EBCA77) + points[2:] * np.uint64(0xC2B2AE3D)
    h ^= h >> np.uint64(31)
    whole = of[:-2] == of[2:]
    return (h[whole] % np.uint64(CHAR_BUCKETS)).astype(np.int64), of[:-2][whole]


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """How much likelier a bucket is in toxic documents; 0 where that is little or unsure."""
    ratio = max(n_toxic, 1) / max(n_clean, 1)
    out = np.log((toxic + 2) / (clean * ratio + 2))
    return np.where(np.abs(out) < 0.8, 0, np.clip(out, -4, 4)).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Parameters.  ``p`` holds what is trained, the odds are fixed inputs."""

    word_odds: np.ndarray
    char_odds: np.ndarray
    prior: float
    constant: bool = False
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(word_odds: np.ndarray, char_odds: np.ndarray, prior: float, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        n = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        p = {"E": n(WORD_BUCKETS, WORD, scale=0.05), "C": n(CHAR_BUCKETS, CHAR, scale=0.05), "v": n(2 * HIDDEN, scale=0.1), "o": n(2 * HIDDEN, scale=0.3), "b": np.zeros(1, np.float32)}
        for d in "fb":
            p |= {f"W{d}": n(INPUT, 3 * HIDDEN, scale=0.3), f"U{d}": n(HIDDEN, 3 * HIDDEN, scale=0.3), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        return Network(word_odds, char_odds, prior, p=p)

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """One row per word: word vector, mean trigram vector, and the two odds."""
        w = word_buckets(words)
        g, of = char_buckets(words)
        n = np.maximum(np.bincount(of, minlength=len(words)), 1).astype(np.float32)
        x = np.zeros((len(words), INPUT), np.float32)
        x[:, :WORD] = self.p["E"][w]
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        if len(g):
            x[of[starts], WORD : WORD + CHAR] = np.add.reduceat(self.p["C"][g], starts, axis=0) / n[of[starts], None]
            x[of[starts], -1] = np.maximum.reduceat(self.char_odds[g], starts)
        x[:, -2] = self.word_odds[w]
        return x, (w, g, of, n)

    def forward(self, x: dict[str, np.ndarray], index: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows.  ``x``: projected inputs per direction, row 0 for none; ``index``: windows x words."""
        count, steps = index.shape
        there = index > 0
        ragged = not there.all()
        states = np.empty((steps, count, 2 * HIDDEN), np.float32)
        for k, d in enumerate("fb"):
            h, u, rows = np.zeros((count, HIDDEN), np.float32), self.p[f"U{d}"], x[d]
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                a, m = rows[index[:, t]], h @ u
                zr = a[:, : 2 * HIDDEN] + m[:, : 2 * HIDDEN]
                np.negative(zr, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                z, r, mn = zr[:, :HIDDEN], zr[:, HIDDEN:], m[:, 2 * HIDDEN :]
                n = np.tanh(a[:, 2 * HIDDEN :] + r * mn)
                new = n + z * (h - n)
                if ragged:
                    new = np.where(there[:, t, None], new, h)
                if keep is not None:
                    keep.append((d, t, h, z, r, n, mn))
                h = states[t, :, k * HIDDEN : (k + 1) * HIDDEN] = new
        s = states @ self.p["v"]
        if ragged:
            s = np.where(there.T, s, -1e9)
        s = np.exp(s - s.max(0))
        s /= s.sum(0)
        pooled = np.einsum("tb,tbh->bh", s, states)
        if keep is not None:
            keep.append((states, s, pooled))
        return pooled @ self.p["o"] + self.p["b"][0]

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: np.concatenate([np.zeros((1, 3 * HIDDEN), np.float32), x @ self.p[f"W{d}"] + self.p[f"c{d}"]]) for d in "fb"}

    def gradients(self, words: list[str], index: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[dict, float]:
        """Of the weighted cross-entropy; back through attention, both recurrences and the inputs."""
        x, (w, g, of, n_chars) = self.inputs(words)
        keep: list = []
        logit = self.forward(self.project(x), index, keep)
        states, s, pooled = keep.pop()
        q = sigmoid(logit)
        dl = ((q - label) * weight).astype(np.float32)
        grad = {"o": pooled.T @ dl, "b": np.asarray([dl.sum()], np.float32)}
        dp = dl[:, None] * self.p["o"]
        ds = np.einsum("bh,tbh->tb", dp, states)
        ds = s * (ds - (s * ds).sum(0))
        grad["v"] = np.einsum("tb,tbh->h", ds, states)
        dstates = s[:, :, None] * dp + ds[:, :, None] * self.p["v"]
        there, dx = index > 0, np.zeros_like(x)
        flat_order = np.argsort(index.T.ravel(), kind="stable")
        flat = index.T.ravel()[flat_order]
        first = np.flatnonzero(np.diff(flat, prepend=-1))
        for k, d in enumerate("fb"):
            u = self.p[f"U{d}"]
            du, dh = np.zeros_like(u), np.zeros((len(index), HIDDEN), np.float32)
            da = np.zeros((index.shape[1], len(index), 3 * HIDDEN), np.float32)
            for d_, t, h, z, r, n, mn in reversed([y for y in keep if y[0] == d]):
                dh = dh + dstates[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                on = there[:, t, None]
                live, passed = np.where(on, dh, 0), np.where(on, 0, dh)
                dn = live * (1 - z) * (1 - n * n)
                dz = live * (h - n) * z * (1 - z)
                dr = dn * mn * r * (1 - r)
                da[t] = np.concatenate([dz, dr, dn], 1)
                dm = np.concatenate([dz, dr, dn * r], 1)
                du += h.T @ dm
                dh = passed + live * z + dm @ u.T
            sums = np.add.reduceat(da.reshape(-1, 3 * HIDDEN)[flat_order], first, axis=0)
            rows = flat[first]
            sums, rows = sums[rows > 0], rows[rows > 0] - 1
            grad[f"U{d}"], grad[f"W{d}"], grad[f"c{d}"] = du, x[rows].T @ sums, sums.sum(0)
            dx[rows] += sums @ self.p[f"W{d}"].T
        grad["E"], grad["C"] = np.zeros_like(self.p["E"]), np.zeros_like(self.p["C"])
        np.add.at(grad["E"], w, dx[:, :WORD])
        if len(g):
            np.add.at(grad["C"], g, dx[of, WORD : WORD + CHAR] / n_chars[of, None])
        loss = float((weight * (np.logaddexp(0, logit) - label * logit)).sum())
        return grad, loss


def window_starts(words: int) -> range | list[int]:
    """First words of all overlapping windows; the last one ends with the text."""
    if words <= WINDOW:
        return [0]
    return [*range(0, words - WINDOW, STRIDE), words - WINDOW]


def windows(flat: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Windows x WINDOW of row numbers (0: none), and the document of each window."""
    starts, ends, of, at = [], [], [], 0
    for k, n in enumerate(sizes):
        if n:
            s = window_starts(n)
            starts += [at + x for x in s]
            ends += [at + n] * len(s)
            of += [k] * len(s)
        at += n
    cells = np.asarray(starts, np.int32)[:, None] + np.arange(WINDOW, dtype=np.int32)
    past = cells >= np.asarray(ends, np.int32)[:, None]
    np.minimum(cells, max(len(flat) - 1, 0), out=cells)
    cells = flat[cells].astype(np.int32, copy=False)
    cells[past] = 0
    return cells, np.asarray(of, np.int64)


def fit(rows: list[tuple[str, int]], rounds: int = 5, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Network:
    """Trains on labelled texts; each round, every text stands for its most suspicious window.

    The first round takes the windows with the greatest word odds, later ones
    those that the network itself scores highest, as at prediction; so clean
    texts give the hardest of their windows and scores are fit to the maximum.
    """
    vocabulary: dict[str, int] = {}
    cells, sizes = array("i"), []
    for text, _ in rows:
        words = split_words(text)
        sizes.append(len(words))
        cells.extend(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words)
    flat, names = np.frombuffer(cells, np.int32) if cells else np.zeros(0, np.int32), list(vocabulary)
    del vocabulary
    label = np.asarray([y for _, y in rows], np.float32)
    n_toxic, n_clean = int(label.sum()), int((1 - label).sum())
    buckets = np.concatenate([[0], word_buckets(names)]).astype(np.int32)
    grams, counts = [np.zeros(0, np.int16)], [np.zeros(1, np.int64)]
    for at in range(0, len(names), PART):
        g, of = char_buckets(names[at : at + PART])
        grams.append(g.astype(np.int16))
        counts.append(np.bincount(of, minlength=len(names[at : at + PART])))
    grams, counts = np.concatenate(grams), np.concatenate(counts)
    ends = np.cumsum(counts)
    word_n, char_n = np.zeros((2, WORD_BUCKETS)), np.zeros((2, CHAR_BUCKETS))
    at = 0
    for size, y in zip(sizes, label.astype(int)):
        once = np.unique(flat[at : at + size])
        at += size
        n = counts[once]
        word_n[y, np.unique(buckets[once])] += 1
        char_n[y, np.unique(grams[np.repeat(ends[once] - np.cumsum(n), n) + np.arange(n.sum())])] += 1
    odds = log_odds(word_n[1], word_n[0], n_toxic, n_clean)
    net = Network.fresh(odds, log_odds(char_n[1], char_n[0], n_toxic, n_clean), 0.5)
    if not n_toxic or not n_clean:
        net.constant, net.prior = True, float(n_toxic > 0)
        return net
    index, of = windows(flat, sizes)
    word_score = odds[buckets]
    word_score[0] = 0
    score = np.concatenate([np.sort(word_score[index[a : a + 1024]], axis=1)[:, -4:].sum(1) for a in range(0, len(index), 1024)] or [np.zeros(0)])
    r, moment, step = np.random.default_rng(seed), {}, 0
    weight = np.where(label > 0, 0.5 / n_toxic, 0.5 / n_clean) * len(label)
    for turn in range(rounds):
        order = np.lexsort((score, of))
        top = order[np.flatnonzero(np.diff(of[order], append=-1))]
        picked = top if turn else np.concatenate([top, r.choice(len(of), min(len(of), len(top)), replace=False)])
        picked = picked[(label[of[picked]] == 0) | np.isin(picked, top)]
        if turn:  # every window of a clean text that looks toxic
            picked = np.union1d(picked, np.flatnonzero((label[of] == 0) & (score > -1)))
        picked = r.permutation(picked)
        for at in range(0, len(picked), batch):
            rows_ = picked[at : at + batch]
            used, local = np.unique(index[rows_], return_inverse=True)
            local = local.reshape(len(rows_), WINDOW)
            if used[0] > 0:
                local, used = local + 1, np.concatenate([[0], used])
            grad, _ = net.gradients([names[u - 1] for u in used[1:]], local, label[of[rows_]], weight[of[rows_]] / len(rows_))
            step += 1
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / max(size, 1e-9))
                m, v = moment.get(k, (0.0, 0.0))
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                moment[k] = (m, v)
                net.p[k] = (net.p[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        if turn < rounds - 1:
            x = {d: np.zeros((len(names) + 1, 3 * HIDDEN), np.float16) for d in "fb"}  # only ranks windows
            for a in range(0, len(names), PART):
                part = net.project(net.inputs(names[a : a + PART])[0])
                for d in "fb":
                    x[d][a + 1 : a + 1 + PART] = part[d][1:]
            score = np.concatenate([net.forward(x, index[a : a + 1024]) for a in range(0, len(index), 1024)])
            del x
    net.prior = 0.05
    return net


def learn_toxicity(docs: DataFrame, labels: DataFrame, training, per_label: int = 2000, most_bytes: int = 24_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network:
    """Fits the network to at most ``per_label`` labelled documents of each label.

    The sample is those with the smallest id hashes among the labels that
    ``training`` admits; it is picked from the labels alone, and only its texts
    are read, whole, until those of a label reach ``most_bytes``.  Null labels,
    ids and texts are left out.
    """
    known = labels.where(training & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    picked = labelled_sample(known, "id", "y", per_label)
    rows = sampled_texts(docs, picked, most_bytes, id_col, text_col).select("id", "text", "y").collect()
    return fit([(r[1], int(r[2] > 0)) for r in sorted(rows, key=lambda r: (r[0], r[1]))])


class Scorer:
    """Scores batches of texts; a task keeps the projected inputs of the words it has met."""

    def __init__(self, net: Network, keep: int = 60_000, block: int = 1024):
        self.net, self.keep, self.block = net, keep, block
        self.known: dict[str, int] = {}
        self.tables = {d: np.zeros((4096, 3 * HIDDEN), np.float32) for d in "fb"}

    def scores(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text its score and its number of windows."""
        own, tables = self.net, self.tables
        if len(self.known) > self.keep:
            self.known = {}
        known = self.known
        fresh = list(dict.fromkeys(w for t in texts for w in t if w not in known))
        if fresh:
            at = len(known) + 1
            got = own.project(own.inputs(fresh)[0])
            for d in "fb":
                if at + len(fresh) > len(tables[d]):
                    tables[d] = np.concatenate([tables[d][:at], np.zeros((max(len(tables[d]), len(fresh)), 3 * HIDDEN), np.float32)])
                tables[d][at : at + len(fresh)] = got[d][1:]
            known.update(zip(fresh, range(at, at + len(fresh))))
        sizes = [len(t) for t in texts]
        best, n = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64)
        if sum(sizes):
            index, of = windows(np.fromiter((known[w] for t in texts for w in t), np.int64, sum(sizes)), sizes)
            short = (index[:, -1] == 0).astype(int)
            for part in (np.flatnonzero(short == 0), np.flatnonzero(short)):
                for a in range(0, len(part), self.block):
                    rows = part[a : a + self.block]
                    np.maximum.at(best, of[rows], own.forward(tables, index[rows]))
            n = np.bincount(of, minlength=len(texts))
        if own.constant:
            return np.full(len(texts), own.prior), n
        return np.where(n > 0, sigmoid(np.where(n > 0, best, 0)), own.prior), n

    def runs(self, batch: pa.RecordBatch, place: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``start, stop, scores, windows`` of runs of rows of a batch that hold a bounded number of words."""
        start, texts, held, column = 0, [], 0, batch.column(place)
        for k in range(batch.num_rows):
            texts.append(split_words(column[k].as_py()))
            held += len(texts[-1]) + 8
            if held > 2 * self.block * STRIDE or k == batch.num_rows - 1:
                yield start, k + 1, *self.scores(texts)
                start, texts, held = k + 1, [], 0


def score_toxicity(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, windows``: the highest probability over all overlapping windows of the whole text.

    Null, empty and blank texts get a fixed low score and no windows.  Rows keep
    their multiplicity; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            for a, b, value, n in scorer.runs(batch, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(value), pa.array(n)], ["doc_id", "score", "windows"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(score), "doc_id long, score double, windows long")


def drop_toxic(docs: DataFrame, net: Network, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text scores ``least`` or more; every other row and column stays as it is.

    Rows are scored and kept or dropped in one pass, so texts are not shuffled.
    Each row is judged by its own text, rows without an id or with an id that
    others have too.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            for a, b, value, _ in scorer.runs(batch, place):
                yield batch.slice(a, b - a).filter(pa.array(value < least))

    return docs.mapInArrow(tidy(keep), docs.schema)
