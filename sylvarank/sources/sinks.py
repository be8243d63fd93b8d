"""Sinks: resumable appends, sorted exports with digests, request lines and provenance."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(cases: DataFrame, done: DataFrame, id_col: str = "query_id", start: int = 0, limit: int | None = None, order_col: str | None = None) -> DataFrame:
    """Cases that are still to do: ``limit`` counts cases considered from ``start`` on, those done before included."""
    at = F.col(order_col) if order_col else None
    if at is not None:
        cases = cases.where((at > start) & ((at <= start + limit) if limit is not None else F.lit(True)))
    return cases.join(done.select(id_col).distinct(), id_col, "left_anti")


def append_records(records: DataFrame, path: str, resume: bool = False) -> None:
    """JSON lines; without ``resume`` an existing output is an error, with it done ids are left out."""
    if not resume:
        records.write.mode("errorifexists").json(path)
        return
    try:
        done = records.sparkSession.read.schema("query_id string").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = records.sparkSession.createDataFrame([], "query_id string")
    twice = done.groupBy("query_id").count().where("count > 1 or query_id is null").limit(1).collect()
    if twice:
        raise ValueError(f"the output holds {twice[0]['query_id']} twice or a line without an id")
    records.join(done, "query_id", "left_anti").write.mode("append").json(path)


def request_lines(candidates: DataFrame, query_col: str = "query_id", text_col: str = "text", name_col: str = "name", order_col: str = "rank") -> DataFrame:
    """``query_id, line``: query, text without tabs and line ends, and the candidates joined by commas in their order."""
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order_col, name_col))), lambda x: x[name_col].cast("string")), ",")
    rows = candidates.groupBy(query_col).agg(F.first(text_col).alias("_t"), names.alias("_n"))
    return rows.select(F.col(query_col).alias("query_id"), F.concat_ws("\t", F.col(query_col).cast("string"), F.translate("_t", "\t\n\r", "   "), "_n").alias("line"))


def export_sorted(df: DataFrame, path: str, order_col: str = "name") -> None:
    """Compressed JSON lines in the order of a column."""
    df.orderBy(order_col).write.mode("errorifexists").json(path, compression="gzip")


def write_index(postings: DataFrame, path: str) -> None:
    """Postings by token: range-partitioned and sorted, so that lookups prune files."""
    postings.repartitionByRange("token").sortWithinPartitions("token", "name").write.mode("overwrite").parquet(path)


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def write_atomically(path: str, value: dict) -> str:
    """JSON with sorted keys by way of a temporary file, and its digest beside it."""
    text = json.dumps(value, sort_keys=True, indent=2)
    for name, body in ((path, text), (f"{path}.sha256", hashlib.sha256(text.encode()).hexdigest())):
        with open(f"{name}.tmp", "w") as f:
            f.write(body)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{name}.tmp", name)
    return hashlib.sha256(text.encode()).hexdigest()


def expect_counts(df: DataFrame, expected: dict[str, int]) -> dict[str, int]:
    """Counts of the conditions given as SQL; raises where one differs."""
    got = df.agg(*(F.count_if(F.expr(c)).alias(f"c{i}") for i, c in enumerate(expected))).first()
    found = {c: got[i] for i, c in enumerate(expected)}
    if found != expected:
        raise ValueError(f"counts {found}, not {expected}")
    return found
