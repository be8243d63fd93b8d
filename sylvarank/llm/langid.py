"""Language identification: each document as a mixture of languages."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, sampled_texts, tidy

ORDERS = (1, 2, 3, 4)
EDGE = 0x110000


def word_grams(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of all words, and the word each belongs to.

    A word is its lower-case characters between two edge marks; n-grams of all
    ``ORDERS`` that hold a letter of the word count.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    points = np.full(int(ends[-1]) if len(words) else 0, EDGE, np.uint64)
    inside = np.ones(len(points), bool)
    inside[ends - 1] = False
    inside[ends - lengths] = False
    points[inside] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(words)), lengths)
    grams, owner = [], []
    for n in ORDERS:
        k = len(points) - n + 1
        if k <= 0:
            continue
        h = np.full(k, n, np.uint64)
        for j in range(n):
            h = (h ^ points[j : j + k]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        whole = of[:k] == of[n - 1 :]
        if n == 1:
            whole &= inside
        grams.append((h[whole] % np.uint64(buckets)).astype(np.int64))
        owner.append(of[:k][whole])
    return (np.concatenate(grams), np.concatenate(owner)) if grams else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def letters(text: str) -> list[str]:
    """Lower-case words with at least one letter, without punctuation around them."""
    return [w for w in (x.strip(".,;:!?|\"'()[]{}<>-") for x in text.lower().split()) if w and (w.isalpha() or any(map(str.isalpha, w)))]


@dataclass
class Languages:
    """Log probabilities of n-gram buckets for each language."""

    names: list[str]
    table: np.ndarray  # buckets x languages

    def words(self, words: list[str]) -> np.ndarray:
        grams, owner = word_grams(words, len(self.table))
        out = np.zeros((len(words), len(self.names)))
        for k in range(len(self.names)):
            out[:, k] = np.bincount(owner, self.table[grams, k], len(words))
        return out


def fit_languages(rows: list[tuple[str, str]], buckets: int = 1 << 16, smooth: float = 0.2) -> Languages:
    names = sorted({lang for lang, _ in rows})
    counts = np.zeros((buckets, len(names)))
    for k, name in enumerate(names):
        words: Counter[str] = Counter()
        for lang, text in rows:
            if lang == name:
                words.update(letters(text))
        if words:
            grams, owner = word_grams(list(words), buckets)
            counts[:, k] = np.bincount(grams, np.fromiter(words.values(), float, len(words))[owner], buckets)
    return Languages(names, np.log((counts + smooth) / (counts.sum(0) + smooth * buckets)))


def learn_languages(docs: DataFrame, training, per_language: int = 1500, most_bytes: int = 12_000_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Languages:
    """Fits n-gram models on at most ``per_language`` documents of each language.

    The sample is the documents with the smallest id hashes among the rows that
    ``training`` admits and that have a language, an id and a text; ids are
    picked before texts are read, and texts are read whole until those of a
    language reach ``most_bytes``.
    """
    rows = docs.where(training & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    picked = labelled_sample(rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("y")), "id", "y", per_language)
    got = sampled_texts(rows, picked, most_bytes, id_col, text_col).select("y", "text").collect()
    return fit_languages([(r[0], r[1]) for r in got])


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of the rows between edges; every part has a row at least."""
    return np.add.reduceat(values, edges[:-1], axis=0)


def mixture(scores: np.ndarray, edges: np.ndarray, allowed: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation of language proportions, for many documents at once.

    ``scores`` has each word's log likelihood per language, ``edges`` the first
    word of each document, ``allowed`` which languages a document may have.
    Returns the proportions and the documents' log likelihoods.
    """
    top = scores.max(1, keepdims=True)
    like = np.exp(scores - top)
    sizes = np.diff(edges)
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(rounds):
        joint = like * np.repeat(share, sizes, axis=0)
        joint /= np.maximum(joint.sum(1, keepdims=True), 1e-300)
        share = _sums(joint, edges) / sizes[:, None]
    total = _sums(np.log(np.maximum((like * np.repeat(share, sizes, axis=0)).sum(1), 1e-300)) + top[:, 0], edges)
    return share, total


def identify(scores: np.ndarray, edges: np.ndarray, cost: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Proportions under the language set of best penalised likelihood, and that set's size.

    Sets are the 1, 2, ... most likely languages of the full mixture; a further
    language costs ``cost`` times half the logarithm of the number of words.  A
    document whose full mixture gains no more than one such cost over its best
    single language needs no further sets, as none can gain more than the full one.
    """
    docs, n = len(edges) - 1, scores.shape[1]
    single = _sums(scores, edges)
    best = single.argmax(1)
    out = np.zeros((docs, n))
    out[np.arange(docs), best] = 1
    size = np.ones(docs, np.int64)
    if n == 1 or not docs:
        return out, size
    share, full = mixture(scores, edges, np.ones((docs, n)))
    penalty = cost * 0.5 * np.log(np.diff(edges) + 1.0)
    value = single[np.arange(docs), best]
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
    mixed = np.flatnonzero(full - value > penalty)
    for k in range(2, n + 1):
        mixed = mixed[full[mixed] - (k - 1) * penalty[mixed] > value[mixed]]
        if not len(mixed):
            break
        rows = np.concatenate([np.arange(edges[d], edges[d + 1]) for d in mixed])
        part = np.concatenate([[0], np.cumsum(np.diff(edges)[mixed])])
        got, total = mixture(scores[rows], part, (rank[mixed] < k).astype(float), 20)
        gain = total - (k - 1) * penalty[mixed]
        win = gain > value[mixed]
        out[mixed[win]], value[mixed[win]], size[mixed[win]] = got[win], gain[win], k
    return out, size


def predict_languages(docs: DataFrame, model: Languages, id_col: str = "doc_id", text_col: str = "text", keep: int = 300_000, block_words: int = 200_000) -> DataFrame:
    """``doc_id, lang_pred, score, languages, mixture``: one row per document.

    Every word of the whole text counts; word likelihoods are kept per task
    worker, up to ``keep`` words.  Null texts and texts without a letter are
    ``und`` with score 0 and no mixture.  ``languages`` is the size of the
    selected set, ``score`` the proportion of the predicted language.  With no
    language learned every document is ``und``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.int32()), ("mixture", pa.list_(pa.float64()))])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        known: dict[str, int] = {}
        table = np.zeros((1024, len(own.names)))

        def emit(ids: list[int], texts: list[list[str]]) -> pa.RecordBatch:
            nonlocal table, known
            if len(known) > keep:
                known = {}
            fresh = list(dict.fromkeys(w for t in texts for w in t if w not in known))
            if fresh:
                at = len(known)
                if at + len(fresh) > len(table):
                    table = np.concatenate([table[:at], np.zeros((max(len(table), len(fresh)), table.shape[1]))])
                kept = [w.strip(".,;:!?|\"'()[]{}<>-") for w in fresh]
                there = np.fromiter((any(map(str.isalpha, w)) for w in kept), bool, len(kept))
                rows = np.full((len(fresh), table.shape[1]), np.nan)
                if there.any():
                    rows[there] = own.words([w for w, ok in zip(kept, there) if ok])
                table[at : at + len(fresh)] = rows
                known.update(zip(fresh, range(at, at + len(fresh))))
            sizes = [len(t) for t in texts]
            index = np.fromiter((known[w] for t in texts for w in t), np.int64, sum(sizes))
            scores = table[index]
            word = ~np.isnan(scores[:, 0]) if scores.shape[1] else np.zeros(len(scores), bool)
            of = np.repeat(np.arange(len(ids)), sizes)[word]
            counts = np.bincount(of, minlength=len(ids))
            there = np.flatnonzero(counts)
            lang, score, size, mix = ["und"] * len(ids), [0.0] * len(ids), [0] * len(ids), [None] * len(ids)
            if len(there):
                shares, sets = identify(scores[word], np.concatenate([[0], np.cumsum(counts[there])]))
                for d, row, top, k in zip(there.tolist(), shares.tolist(), shares.argmax(1).tolist(), sets.tolist()):
                    lang[d], score[d], size[d], mix[d] = own.names[top], min(1.0, row[top]), k, row
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, lang, score, size, mix), schema)], schema=schema)

        ids, texts, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc)
                texts.append(text.lower().split() if text else [])
                held += len(texts[-1])
                if held > block_words or len(ids) > 20_000:
                    yield emit(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield emit(ids, texts)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(predict), "doc_id long, lang_pred string, score double, languages int, mixture array<double>")
