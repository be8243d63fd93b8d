"""Readers: driver tables, JSON lines, tab-separated text and position-aligned files, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERY_CASES = T.StructType([
    T.StructField("query_id", T.StringType()), T.StructField("benchmark", T.StringType()), T.StructField("target", T.StringType()),
    T.StructField("expression_json", T.StringType()), T.StructField("expression_text", T.StringType()), T.StructField("query_text", T.StringType()), T.StructField("line_number", T.LongType()),
])
CLEAN_QUERIES = "query_id string, target string, clean_text string"
SCORES = "struct<name:string,wl:double,teds:double,jaccard:double,collapse_match:double,final:double,rank:int,dense:double,bm25:double>"
RUN_RECORDS = f"query_id string, benchmark string, target string, final_rank int, exception string, top_k array<{SCORES}>, target_scores {SCORES}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asserted(df: DataFrame, wrong, message: str) -> DataFrame:
    """Raises ``message`` when a row meets ``wrong``; the check is part of the plan."""
    return df.where(F.when(wrong, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_number, value`` of a text file, counted from 1 in file order.

    A file is read whole by one task; benchmark files are of a few hundred lines.
    """
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split(F.regexp_replace("value", "\\r?\\n$", ""), "\\r?\\n")).alias("at", "value")).select((F.col("at") + 1).cast("long").alias("line_number"), "value")


def read_json_cases(spark: SparkSession, path: str) -> DataFrame:
    """Query cases from JSON lines, each with its line number."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    fields = T.StructType([f for f in QUERY_CASES if f.name != "line_number"])
    return lines.select("line_number", F.from_json("value", fields, {"mode": "FAILFAST"}).alias("x")).select("x.*", "line_number")


def read_aligned_cases(spark: SparkSession, expressions: str, names: str, prefix: str = "test-a") -> DataFrame:
    """Two files read line by line side by side; blank lines and unequal lengths raise."""
    left, right = numbered_lines(spark, expressions), numbered_lines(spark, names)
    both = left.withColumnRenamed("value", "expression_text").join(right.withColumnRenamed("value", "target"), "line_number", "full")
    wrong = F.col("expression_text").isNull() | F.col("target").isNull() | (F.trim("expression_text") == "") | (F.trim("target") == "")
    return asserted(both, wrong, "the files differ in length or have a blank line").select(F.format_string(f"{prefix}-%03d", F.col("line_number")).alias("query_id"), F.trim("target").alias("target"), F.trim("expression_text").alias("expression_text"), "line_number")


def read_clean_queries(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, target, clean_text`` from JSON lines; rows without text are left out."""
    return spark.read.schema(CLEAN_QUERIES).json(path).where("query_id is not null and trim(clean_text) <> ''")


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """``name, clean_text`` from tab-separated lines; only the first tab separates."""
    parts = spark.read.text(path).select(F.split("value", "\t", 2).alias("p")).where(F.size("p") == 2)
    return parts.select(F.col("p")[0].alias("name"), F.trim(F.col("p")[1]).alias("clean_text")).where("clean_text <> ''")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_RECORDS).json(path)


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, name, applicable``: 1 is true, 0 false, else null; lines of fewer than three fields are skipped, the last of a pair counts."""
    rows = numbered_lines(spark, path).select("line_number", F.split("value", "\t").alias("p")).where(F.size("p") >= 3)
    rows = rows.select("line_number", F.col("p")[0].alias("query_id"), F.col("p")[1].alias("name"), F.trim(F.col("p")[2]).alias("v"))
    last = rows.groupBy("query_id", "name").agg(F.max_by("v", "line_number").alias("v"))
    return last.select("query_id", "name", F.when(F.col("v") == "1", True).when(F.col("v") == "0", False).alias("applicable"))


def unique_ids(df: DataFrame, id_col: str) -> DataFrame:
    """``df``, but raises when an id occurs twice or is null."""
    twice = df.groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_n"))
    checked = asserted(twice, (F.col("_n") > 1) | F.col("_id").isNull(), f"{id_col} is null or repeated")
    return df.join(checked.drop("_n"), F.col(id_col) == F.col("_id"), "left_semi")


def read_extraction_cache(spark: SparkSession, path: str, cases: DataFrame, expected: int | None = None) -> DataFrame:
    """Cached expressions whose target and text digest match the cases; else it raises."""
    cache = unique_ids(spark.read.schema("query_id string, target string, expression_sha256 string, expression_json string").json(path), "query_id")
    told = cases.select("query_id", F.col("target").alias("_t"), F.sha2("expression_text", 256).alias("_h"))
    joined = asserted(told.join(cache, "query_id", "left"), ~F.col("target").eqNullSafe(F.col("_t")) | ~F.col("expression_sha256").eqNullSafe(F.col("_h")), "the cache does not match the cases").drop("_t", "_h")
    if expected is not None and (n := joined.count()) != expected:
        raise ValueError(f"{n} cached expressions, not {expected}")
    return joined


def quoted_term(column: str):
    """The inside of a term given as ``q(...)``."""
    c = F.trim(F.col(column))
    return F.when(c.startswith("q(") & c.endswith(")"), F.expr(f"substring(trim({column}), 3, length(trim({column})) - 3)")).otherwise(c)


def one_of_text(clean: str, fallback: str):
    """Clean text where there is any, else the fallback."""
    return F.coalesce(F.when(F.trim(F.col(clean)) != "", F.col(clean)), F.col(fallback))
