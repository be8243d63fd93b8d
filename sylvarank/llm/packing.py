"""Best-fit-decreasing packing of token sequences into fixed windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .tokens import encoder


class CapacityTree:
    """Segment tree over the remaining capacities 0..capacity of open bins."""

    def __init__(self, capacity: int):
        self.base = 1 << (capacity + 1).bit_length()
        self.any = [False] * (2 * self.base)

    def set(self, remaining: int, there: bool) -> None:
        i = self.base + remaining
        self.any[i] = there
        while i > 1:
            i //= 2
            now = self.any[2 * i] or self.any[2 * i + 1]
            if now == self.any[i]:
                break
            self.any[i] = now

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of an open bin that still holds ``length``."""
        i = self.base + length
        if self.any[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.base
            i //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Packs ``histogram[length]`` pieces of each length; returns a plan in runs.

    A run ``(length, rank, n, bin, per_bin, offset)`` says: the ``n`` pieces of
    this length from ``rank`` on go, ``per_bin`` to each, into the bins from
    ``bin`` on, the first of a bin at ``offset``.  Bins with equal remaining
    capacity are interchangeable, so the tree holds runs of bins, not bins: each
    length opens at most two runs and splits at most one, and a bin meets fewer
    than ``sqrt(2 * capacity)`` different lengths, so the plan's size is bounded
    by the capacity alone, whatever the number of pieces.
    """
    tree, open_runs, fresh, plan = CapacityTree(capacity), {}, 0, []

    def put(remaining: int, start: int, bins: int) -> None:
        if bins and remaining:
            open_runs.setdefault(remaining, []).append((start, bins))
            tree.set(remaining, True)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, start, bins = capacity, fresh, -(-left // (capacity // length))
                fresh += bins
            else:
                start, bins = open_runs[remaining].pop()
                if not open_runs[remaining]:
                    tree.set(remaining, False)
            per_bin, offset = remaining // length, capacity - remaining
            full = min(bins, left // per_bin)
            if full:
                plan.append((length, rank, full * per_bin, start, per_bin, offset))
                rank, left = rank + full * per_bin, left - full * per_bin
                put(remaining - per_bin * length, start, full)
            if full < bins:
                if left:  # fewer than per_bin, the last of this length
                    plan.append((length, rank, left, start + full, left, offset))
                    put(remaining - left * length, start + full, 1)
                    left, full = 0, full + 1
                put(remaining, start + full, bins - full)
    return plan


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids, each with its rank among equal lengths of its task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary), np.asarray([end_id], "<u4").tobytes()
        task, ranks, width = TaskContext.get().partitionId(), [0] * (capacity + 1), 4 * capacity
        for batch in batches:
            ids, rows = batch.column(0), ([], [], [], [], [], [])
            source = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                raw = enc.encode(text) + end
                for piece, at in enumerate(range(0, len(raw), width)):
                    part = raw[at : at + width]
                    n = len(part) // 4
                    source.append(k)
                    for column, value in zip(rows, (piece, at // 4, n, zlib.crc32(part), task, ranks[n])):
                        column.append(value)
                    ranks[n] += 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "task_rank"]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(source, pa.int64())), *(pa.array(c, kind) for c, kind in zip(rows, kinds))], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, task_rank long"
    )


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: one row per piece.

    A document is its ids and ``end_id``; only longer ones than ``capacity`` are
    cut.  A null or empty text is the end id alone.  Repeated rows and rows
    without an id are packed like any other; an empty table gives no rows.

    Texts are read once and never shuffled.  The plan needs only how many pieces
    have each length, at most ``capacity`` numbers; a piece finds its place by
    its rank among the pieces of its length, which is its rank within its task
    plus what earlier tasks have.  Task ranks are fixed by staging the pieces.
    """
    pieces = stage(token_pieces(docs, vocabulary, capacity, end_id, id_col, text_col), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = np.asarray(best_fit_decreasing(histogram, capacity), np.int64).reshape(-1, 6)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    sent = docs.sparkSession.sparkContext.broadcast(plan)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = sent.value
        span = int((runs[:, 1] + runs[:, 2]).max()) + 1 if len(runs) else 1
        keys = runs[:, 0] * span + runs[:, 1]
        for pdf in frames:
            rank = (pdf["base"] + pdf["task_rank"]).to_numpy()
            run = runs[np.searchsorted(keys, pdf["length"].to_numpy() * span + rank, "right") - 1]
            at = rank - run[:, 1]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "piece": pdf["piece"], "start": pdf["start"], "length": pdf["length"], "ids_crc32": pdf["ids_crc32"],
                "sequence_id": run[:, 3] + at // run[:, 4], "offset": run[:, 5] + at % run[:, 4] * run[:, 0],
            })

    return pieces.join(bases, ["task", "length"]).mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
