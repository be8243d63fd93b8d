"""Substring deduplication by content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_few, fresh_name, stage, tidy

#: Bytes that the cut decision sees: the gear hash shifts older ones out of the bits that are tested.
WINDOW = 16
LEAST, MOST = 24, 4096
BUFFER = 1 << 20


def gear_table() -> np.ndarray:
    """256 numbers of 32 bits from a multiplicative rule."""
    x = (np.arange(256, dtype=np.uint64) + 1) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = gear_table()


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash over the last WINDOW bytes at each position, by doubling."""
    h, width = GEAR[data], 1
    while width < WINDOW:
        older = np.zeros_like(h)
        older[width:] = h[:-width] << np.uint32(width)
        h, width = h + older, 2 * width
    return h


def candidates(data: np.ndarray) -> np.ndarray:
    """Positions before which a cut may lie.

    Before white space one in four is taken, elsewhere, for scripts without
    blanks, one in 512 that starts a character.  Only the bytes before count.
    """
    h = np.empty(len(data), np.uint32)
    h[:1] = 0
    h[1:] = rolling(data)[:-1]
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    return np.flatnonzero((blank & ((h >> np.uint32(13)) & np.uint32(3) == 0)) | (((data & 0xC0) != 0x80) & (((h >> np.uint32(7)) & np.uint32(0x1FF)) == 0x155)))


def cut_points(marks: list[int], start: int, end: int, raw: bytes) -> list[int]:
    """The chunk ends of a text that lies at ``start..end`` of ``raw``."""
    out, last = [], start
    for m in [*marks, end]:
        while m - last > MOST:  # nothing to cut at for long: the next character after MOST bytes
            last += MOST
            while last < m and raw[last] & 0xC0 == 0x80:
                last += 1
            out.append(last)
        if m - last >= LEAST and m < end:
            out.append(m)
            last = m
    if end > last:
        out.append(end)
    return out


def chunk_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, start, length, words, hi, lo``: chunks with 128 bits of digest, without surrounding blanks.

    ``start`` and ``length`` are bytes of the UTF-8 text; ``text_key`` is the
    text's 64-bit hash, which tells rows that share an id apart.  Null, empty
    and blank texts have no chunks, and rows without an id none either.
    """

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(ids: list[int], keys: list[int], texts: list[bytes]) -> pa.RecordBatch:
            raw = b"".join(texts)
            data = np.frombuffer(raw, np.uint8)
            marks = candidates(data)
            edges = np.cumsum([0] + [len(t) for t in texts])
            split = np.searchsorted(marks, edges)
            marks = marks.tolist()
            blank = (data == 32) | ((data >= 9) & (data <= 13))
            begins = ~blank
            begins[1:] &= blank[:-1]
            begins[edges[:-1][edges[:-1] < len(data)]] = ~blank[edges[:-1][edges[:-1] < len(data)]]
            heads = np.concatenate([[0], np.cumsum(begins)])
            docs_, of, starts, ends, digests = [], [], [], [], []
            for k, doc in enumerate(ids):
                at = int(edges[k])
                for end in cut_points(marks[split[k] : split[k + 1]], at, int(edges[k + 1]), raw):
                    piece = raw[at:end].strip()
                    if piece:
                        docs_.append(doc)
                        of.append(keys[k])
                        starts.append(at)
                        ends.append(end)
                        digests.append(blake2b(piece, digest_size=16).digest())
                    at = end
            s, e = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
            first = edges[np.searchsorted(edges, s, "right") - 1]
            two = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(of, pa.int64()), pa.array((s - first).astype(np.int32)), pa.array((e - s).astype(np.int32)), pa.array((heads[e] - heads[s]).astype(np.int32)), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())], ["doc_id", "text_key", "start", "length", "words", "hi", "lo"])

        ids, keys, texts, held = [], [], [], 0
        for batch in batches:
            for doc, text, key in zip(*(c.to_pylist() for c in batch.columns)):
                if doc is not None and text:
                    ids.append(doc)
                    keys.append(key)
                    texts.append(text.encode())
                    held += len(texts[-1])
                    if held > BUFFER:
                        yield emit(ids, keys, texts)
                        ids, keys, texts, held = [], [], [], 0
        if ids:
            yield emit(ids, keys, texts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    return rows.mapInArrow(tidy(chunk), "doc_id long, text_key long, start int, length int, words int, hi long, lo long")


def repeated_passages(docs: DataFrame, least_words: int = 15, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages that an earlier document has: ``doc_id, start, length, words, first_doc_id, kept_in, text_key``.

    A chunk belongs to the document with the smallest id that has it; elsewhere
    it is a repeat.  Adjacent repeats join to a passage, which counts from
    ``least_words`` words on (a passage of over 50 words holds some 15 words or
    more of whole chunks wherever it was put).  ``kept_in`` lists the documents
    that keep its chunks, ``first_doc_id`` is the least of them.  What repeats
    only within one document stays, and rows with one id are one document.  Rows that
    repeat an id and a text give their passages once; rows with one id and
    different texts each their own, told apart by ``text_key``.

    Digests are counted with partial sums, so a chunk that very many documents
    share is one row per task; the join that finds the repeats gets at most one
    row per digest on one side.  Both sides carry digests, never texts.
    """
    chunks = chunk_texts(docs, id_col, text_col)
    owners = chunks.groupBy("hi", "lo").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").drop("last")
    owners = stage(owners, "chunk-owners")  # the join below gets its own exchange, whose hot digests can be split
    repeats = chunks.join(owners, ["hi", "lo"]).where("doc_id > owner").select("doc_id", "text_key", "start", "length", "words", "owner")
    order = Window.partitionBy("doc_id", "text_key").orderBy("start", "length")
    before = F.max(F.col("start") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = repeats.dropDuplicates(["doc_id", "text_key", "start"]).withColumn("opens", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    runs = opens.withColumn("run", F.sum("opens").over(order))
    found = runs.groupBy("doc_id", "text_key", "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"), F.sum("words").alias("words"), F.sort_array(F.collect_set("owner")).alias("kept_in"))
    return found.where(F.col("words") >= least_words).select("doc_id", "start", (F.col("end") - F.col("start")).alias("length"), F.col("words").cast("int").alias("words"), F.element_at("kept_in", 1).alias("first_doc_id"), "kept_in", "text_key")


def remove_spans(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for start, length in sorted(spans):
        out.append(raw[at:start])
        at = max(at, start + length)
    return b"".join([*out, raw[at:]])


def drop_repeats(docs: DataFrame, least_words: int = 15, id_col: str = "doc_id", text_col: str = "text", most: int = 300_000) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text_col``; other columns stay as they are.

    A document of which nothing but blanks is left goes; one without repeats is
    returned unchanged, null and empty texts and rows without an id included.
    Passages are found by id and text, so rows that share an id but not a text
    lose nothing of each other's.

    The places to cut are joined to the texts: sent to the tasks if they are of
    at most ``most`` documents (some 40 MB), by a shuffle of the texts otherwise.
    """
    found = repeated_passages(docs, least_words, id_col, text_col).select("doc_id", "text_key", F.struct("start", "length").alias("span"))
    spans = stage(found.groupBy("doc_id", "text_key").agg(F.collect_list("span").alias(fresh_name(docs, "spans"))), "spans")
    schema = docs.schema
    place = [f.name for f in schema].index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = batch.column(place).to_pylist(), []
            for k, spans_ in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                keep.append(True)
                if spans_:
                    texts[k] = remove_spans(texts[k].encode(), [(s["start"], s["length"]) for s in spans_]).decode()
                    keep[-1] = bool(texts[k].strip())
            columns = [pa.array(texts, batch.schema.field(place).type) if i == place else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema]).filter(pa.array(keep, pa.bool_()))

    here = (docs[id_col].cast("long") == spans["doc_id"]) & (F.xxhash64(docs[text_col]) == spans["text_key"])
    joined = docs.join(broadcast_if_few(spans, most), here, "left").select(*(docs[c] for c in docs.columns), spans[spans.columns[-1]])
    return joined.mapInArrow(tidy(cut), schema)
