"""Shared pieces: table access, durable staging, bounded labelled samples."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a batch that goes to a Python worker.  By rows alone a batch of long texts would have no bound.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"
#: Rows that a scan decodes at a time; whole texts and sets make some megabytes of them.
DECODED, DECODED_ROWS, DECODED_DEFAULT = "spark.sql.parquet.columnarReaderBatchSize", "512", "4096"
#: Bytes of a row group of staged tables, which a task buffers before it writes them and reads at once.
ROW_GROUP = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds what is decoded and sent to a Python worker at a time, unless the session says something else."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, BATCH_BYTES)
    if spark.conf.get(DECODED) == DECODED_DEFAULT:
        spark.conf.set(DECODED, DECODED_ROWS)


def give_back() -> None:
    """Returns memory that is free in this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a C library that has it
        pass


def tidy(walk: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``walk``, after whose end the worker gives its free memory back; workers live on for later tasks."""

    @wraps(walk)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from walk(batches)
        give_back()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share (``spark.checkpoint.dir``).

    Only a session without that setting that runs in one JVM falls back to a
    temporary folder; on a cluster a missing setting is an error.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = os.path.join(tempfile.gettempdir(), "sylvarank-shared")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/sylvarank/{what}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    The written files survive lost executors, and values that depend on a task
    (partition numbers, ranks in a partition) are fixed once they are written.
    Shuffle files of the write are of no use after it and go at once.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, what)
    small_batches(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def id_filter(ids: DataFrame, bits: int = 24) -> bytes:
    """A Bloom filter of one hash: a bitmap of ``2**bits`` bits, 2 MB whatever the number of ids.

    Spark sums it by words of 64 bits, so the driver gets at most ``2**bits / 64``
    rows.  A full filter lets everything pass, which costs work, not results.
    """
    place = F.pmod(F.xxhash64(ids.columns[0]), F.lit(1 << bits))
    words = ids.select(place.alias("at")).select(F.expr("at div 64").alias("w"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros((1 << bits) // 64, np.int64)
    for r in words.toLocalIterator():
        out[r["w"]] = r["b"]
    return out.tobytes()


def filter_place(id_col: str, bits: int = 24):
    return F.pmod(F.xxhash64(id_col), F.lit(1 << bits))


def passes(bitmap: bytes, places: np.ndarray) -> np.ndarray:
    words = np.frombuffer(bitmap, np.int64)
    return (words[places >> 6] >> (places & 63)) & 1 == 1


def labelled_sample(rows: DataFrame, id_col: str, label_col: str, per_label: int) -> DataFrame:
    """At most ``per_label`` ids of each label, those with the smallest id hash.

    The bound makes what a driver-side fit sees independent of the corpus; the
    rank limit is pushed below the shuffle, so a label that holds most rows
    sends only ``per_label`` of them per task.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(label_col).orderBy(F.xxhash64(id_col), F.col(id_col))
    rank = fresh_name(rows, "rank")
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= per_label).drop(rank)


def sampled_texts(docs: DataFrame, picked: DataFrame, most_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """``id, y, text``: whole texts of the sample ``id, y``, of each label in order of the id hash until ``most_bytes`` are reached.

    Sample rows are found by a broadcast join, so only their texts are moved.
    """
    from pyspark.sql import Window

    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(picked), texts["doc"] == picked["id"]).select("id", "y", "text")
    order = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("upto", F.sum(F.octet_length("text")).over(order)).where(F.col("upto") <= most_bytes).drop("upto")


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (stem, *(f"{stem}_{k}" for k in range(len(taken) + 1))) if n.lower() not in taken)


def broadcast_if_few(rows: DataFrame, most: int) -> DataFrame:
    """A staged table with a broadcast hint if it has at most ``most`` rows; else the planner's join."""
    return F.broadcast(rows) if rows.count() <= most else rows


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", most: int = 1_000_000) -> DataFrame:
    """``docs`` without the rows whose id is in the one column of ``ids``; rows without an id stay.

    Up to ``most`` ids are sent to the tasks (8 MB), so that no text is shuffled;
    more are joined by a shuffle.
    """
    name = fresh_name(docs, "gone")
    gone = stage(ids.select(F.col(ids.columns[0]).cast("long").alias(name)).where(F.col(name).isNotNull()).distinct(), "ids")
    return docs.join(broadcast_if_few(gone, most), docs[id_col].cast("long") == gone[name], "left_anti")


def remainder(id_col: str, mod: int):
    """crc32 of the id as text, modulo ``mod``: the folds of the contracts."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod
