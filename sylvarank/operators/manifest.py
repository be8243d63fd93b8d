"""Dataset building: occurrence matching, exclusions, coverage, backfill and canonical JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def occurrences(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Numbers the rows that share a key from 0 in scan order."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)


def match_occurrences(current: DataFrame, legacy: DataFrame, key: list[str], order: list[str], legacy_id: str) -> DataFrame:
    """Current rows with the legacy id of the same key and occurrence, null without one."""
    left = occurrences(current, key, order)
    right = occurrences(legacy, key, [legacy_id]).select(*key, "occurrence", F.col(legacy_id).alias("legacy_id"))
    return left.join(right, [*key, "occurrence"], "left")


def never_matched(legacy: DataFrame, current: DataFrame, key: list[str], order: list[str], legacy_id: str) -> DataFrame:
    """Legacy rows whose key and occurrence no current row has."""
    return occurrences(legacy, key, [legacy_id]).join(occurrences(current, key, order).select(*key, "occurrence"), [*key, "occurrence"], "left_anti")


def with_reasons(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """``reasons``: names of the conditions that hold; rows without any are kept ones."""
    return rows.withColumn("reasons", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in reasons.items()))))


def reason_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def coverage(rows: DataFrame, key: str, sets: dict[str, DataFrame]) -> DataFrame:
    """A flag per named set of keys; no row is lost or doubled."""
    for name, known in sets.items():
        keys = known.select(F.col(known.columns[0]).alias("_k")).distinct().withColumn("_f", F.lit(True))
        rows = rows.join(keys, F.col(key) == F.col("_k"), "left").withColumn(name, F.coalesce("_f", F.lit(False))).drop("_k", "_f")
    return rows


def build_manifest(current: DataFrame, legacy: DataFrame, key: list[str], row_id: str, label: str, state: str, node_count: str, names: dict[str, DataFrame], prefix: str = "test-b") -> tuple[DataFrame, DataFrame]:
    """The kept rows of a data set, and the excluded ones with their reasons.

    ``current`` and ``legacy`` have the columns ``key`` (a row's place in its
    source), ``row_id``, ``label``, ``state`` (canonical JSON) and
    ``node_count`` (null where the state is no expression).  A current row
    stands for the legacy row of the same place and occurrence; legacy rows that
    none stands for are filled in from their own payload.  A kept row is named
    after its legacy row and says in which of the ``names`` its label is.
    Labels are trimmed; a row without legacy row, label or readable state is
    excluded with every reason that holds.
    """
    own = [*key, row_id, label, state, node_count]
    here = match_occurrences(current.select(*own), legacy, key, [row_id], row_id).withColumn("payload_source", F.lit("current"))
    filled = never_matched(legacy.select(*own), current, key, [row_id], row_id).withColumn("legacy_id", F.col(row_id)).withColumn("payload_source", F.lit("legacy"))
    rows = here.unionByName(filled).withColumn(label, F.nullif(F.trim(F.coalesce(label, F.lit(""))), F.lit("")))
    rows = with_reasons(rows, {"no_legacy_row": F.col("legacy_id").isNull(), "no_label": F.col(label).isNull(), "no_expression": F.col(node_count).isNull()})
    kept = coverage(rows.where(F.size("reasons") == 0), label, names)
    everywhere = F.lit(True)
    for n in names:
        everywhere = everywhere & F.col(n)
    kept = kept.select(F.concat(F.lit(f"{prefix}-"), F.col("legacy_id").cast("string")).alias("query_id"), F.col(row_id).alias("source_id"), "legacy_id", "payload_source", F.col(label).alias("label"), F.col(state).alias("state"), F.col(node_count).alias("node_count"), *names, F.when(~everywhere, F.lit("target_not_in_corpus")).alias("availability_reason"))
    return kept, rows.where(F.size("reasons") > 0).select(F.col(row_id).alias("source_id"), F.col(label).alias("label"), "reasons")


def duplicate_pairs(rows: DataFrame, *columns: str) -> DataFrame:
    """One row ``total, distinct, repeated`` of column tuples, compared by digest."""
    told = F.sha2(F.to_json(F.struct(*columns)), 256)
    return rows.agg(F.count("*").alias("total"), F.count_distinct(told).alias("distinct_pairs")).withColumn("repeated", F.col("total") - F.col("distinct_pairs"))


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON with sorted keys and no spaces; null for what is no JSON."""

    def one(x):
        try:
            return None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return text.map(one)


def object_or_text(column: str) -> Column:
    """JSON text of an object, whether given as such or as a string that holds it; else null."""
    inner = F.get_json_object(F.concat(F.lit('{"x":'), F.col(column), F.lit("}")), "$.x")
    return F.when(F.trim(column).startswith("{"), F.col(column)).when(F.trim(inner).startswith("{"), inner)


def row_key(uri: str, start: str, end: str) -> Column:
    """Typed key of a source range; raises where a part is missing."""
    parts = [F.col(uri), *(F.col(f"{p}.{c}") for p in (start, end) for c in ("line", "column"))]
    missing = parts[0].isNull()
    for p in parts[1:]:
        missing = missing | p.isNull()
    return F.when(missing, F.raise_error(F.lit("a row key has no value")).cast("string")).otherwise(F.concat_ws("|", *(p.cast("string") for p in parts)))
