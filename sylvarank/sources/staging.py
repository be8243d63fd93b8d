"""Durable intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a session of one JVM without it uses a temporary folder."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = os.path.join(tempfile.gettempdir(), "sylvarank-shared")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stage(df: DataFrame, what: str) -> DataFrame:
    """Writes a table that several later steps read, so that it is computed once and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/sylvarank/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dense_ranks(values: DataFrame, partitions: int | None = None) -> DataFrame:
    """``value, rank``: the distinct values of the one column, ranked from 0 in their order, nulls first.

    Values are dealt to ranges, ranked within each, and shifted by the number of
    values in the ranges before, so no task gets all of them.
    """
    parts = partitions or int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = values.select(F.col(values.columns[0]).alias("value")).distinct()
    dealt = stage(one.repartitionByRange(parts, "value").select("value", F.spark_partition_id().alias("part")), "ranges")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # a row per range
    inside = dealt.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("value")))
    return stage(inside.join(F.broadcast(sizes), "part").select("value", (F.col("before") + F.col("at") - 1).alias("rank")), "ranks")
