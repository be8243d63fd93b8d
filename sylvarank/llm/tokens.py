"""Token ids of whole texts by a public tokenizer, and exact length histograms."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, tidy


class ChunkEncoder:
    """Encodes texts piecewise: what lies between blanks is encoded once and kept.

    The tokenizer's pre-tokenizer never joins text across white space, and the
    strings of its added tokens hold none, so the ids of a text are those of its
    blank-separated chunks, one after the other.
    A plain word (letters up to U+00FF, one full stop or comma after it at most)
    is one pre-token, so its lower-case letters go to the model straight away.
    """

    def __init__(self, path: str, keep: int = 150_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        if any(c.isspace() for t in self.tokenizer.get_added_tokens_decoder().values() for c in t.content):
            raise ValueError("added tokens with white space need whole texts")
        self.marked = any(t.endswith("</w>") for t in self.tokenizer.get_vocab())
        self.keep = keep
        self.known: dict[str, bytes] = {"": b""}
        #: Byte-level models name the bytes of a word by printable letters; letters up to U+00FF take at most two.
        own = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: own.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x100)} if self.marked else {}

    def _encode(self, chunks: list[str]) -> None:
        got = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        self.known.update((c, array("I", e.ids).tobytes()) for c, e in zip(chunks, got))

    def _learn(self, chunks: list[str]) -> None:
        known, word, other = self.known, self.tokenizer.model.tokenize, []
        for tail in ".,":
            if tail not in known:
                self._encode([tail])
        for c in chunks:
            tail = c[-1] if c[-1] in ".," else ""
            core = c[:-1] if tail else c
            if self.marked and core.isalpha() and (core.isascii() or max(core) <= "ÿ"):
                low = core.lower()
                ids = known.get(low)
                if ids is None:
                    ids = known[low] = array("I", [t.id for t in word(low if low.isascii() else low.translate(self.letters))]).tobytes()
                known[c] = ids + known[tail] if tail else ids
            else:
                other.append(c)
        if other:
            self._encode(other)

    def encode(self, text: str | None) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit numbers; none for null."""
        if not text:
            return b""
        chunks = text.replace("\n", " ").split(" ")
        known = self.known
        try:
            return b"".join(map(known.__getitem__, chunks))
        except KeyError:
            if len(known) > self.keep:
                known.clear()
                known[""] = b""
            self._learn([c for c in dict.fromkeys(chunks) if c not in known])
            return b"".join(map(known.__getitem__, chunks))


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder per Python worker and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def token_lengths(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``length, documents`` summed within each task: one row per length and task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(vocabulary), {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n = len(enc.encode(text)) // 4
                seen[n] = seen.get(n, 0) + 1
        yield pa.RecordBatch.from_pydict({"length": pa.array(list(seen), pa.int64()), "documents": pa.array(list(seen.values()), pa.int64())})

    return docs.select(text_col).mapInArrow(tidy(count), "length long, documents long")


def token_histogram(docs: DataFrame, vocabulary: str, text_col: str = "text", block: int = 1024) -> DataFrame:
    """Exact histogram of encoded lengths with the sums that answer every context limit.

    One row per length that occurs: ``length, documents, tokens`` (of that
    length), ``documents_from, tokens_from`` (suffix sums: that length or
    longer), ``total_documents, total_tokens``, ``quantile`` (share of documents
    that are not longer) and ``truncated_tokens``, what is left of the corpus
    when every document is cut to ``length`` tokens.

    Null and empty texts have length 0.  Repeated rows count each.  An empty
    table gives no rows.  The suffix sums run inside blocks of ``block`` lengths
    and over the blocks, so no task gets all lengths.
    """
    counted = stage(token_lengths(docs, vocabulary, text_col).groupBy("length").agg(F.sum("documents").alias("documents")), "lengths")  # read twice
    hist = counted.withColumn("tokens", F.col("length") * F.col("documents")).withColumn("block", F.floor(F.col("length") / block))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = (
        hist.groupBy("block").agg(F.sum("documents").alias("d"), F.sum("tokens").alias("t"))
        .select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"), F.sum("d").over(every).alias("total_documents"), F.sum("t").over(every).alias("total_tokens"))
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        hist.join(blocks, "block")
        .withColumn("documents_from", F.sum("documents").over(inside) + F.col("d_later"))
        .withColumn("tokens_from", F.sum("tokens").over(inside) + F.col("t_later"))
        .select(
            "length", "documents", "tokens", "documents_from", "tokens_from", "total_documents", "total_tokens",
            ((F.col("total_documents") - F.col("documents_from") + F.col("documents")) / F.col("total_documents")).alias("quantile"),
            (F.col("total_tokens") - F.col("tokens_from") + F.col("documents_from") * F.col("length")).alias("truncated_tokens"),
        )
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: tokens left when every document is cut to ``limit`` tokens."""
    return histogram.agg(F.coalesce(F.sum(F.least("length", F.lit(limit)) * F.col("documents")), F.lit(0)).alias("truncated_tokens"))


def length_quantile(histogram: DataFrame, share: float) -> DataFrame:
    """One row: the shortest length that at least ``share`` of the documents do not exceed."""
    return histogram.where(F.col("quantile") >= share).agg(F.min("length").alias("length"))
