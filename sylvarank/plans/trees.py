"""Trees of the driver's tables: an order, its lines, and a leaf for each line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table


def order_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tree_id, node_id, parent_id, ord, depth, label`` of all orders, in preorder."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tree_id"), F.col("o_orderpriority").alias("label"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tree_id"), F.row_number().over(w).alias("k"), "l_returnflag", F.concat(F.lit("Const("), F.col("l_linestatus"), (F.col("l_suppkey") % 7).cast("string"), F.lit(")")).alias("leaf"))
    lines = lines.join(orders.select("tree_id"), "tree_id", "left_semi")
    cells = F.array(
        F.struct((2 * F.col("k") - 1).cast("int").alias("node_id"), F.lit(0).alias("parent_id"), (F.col("k") - 1).cast("int").alias("ord"), F.lit(1).alias("depth"), F.col("l_returnflag").alias("label")),
        F.struct((2 * F.col("k")).cast("int").alias("node_id"), (2 * F.col("k") - 1).cast("int").alias("parent_id"), F.lit(0).alias("ord"), F.lit(2).alias("depth"), F.col("leaf").alias("label")),
    )
    roots = orders.select("tree_id", F.lit(0).alias("node_id"), F.lit(None).cast("int").alias("parent_id"), F.lit(0).alias("ord"), F.lit(0).alias("depth"), "label")
    return roots.unionByName(lines.select("tree_id", F.explode(cells).alias("c")).select("tree_id", "c.*"))


def every_fiftieth(df: DataFrame, id_col: str) -> DataFrame:
    """The stated query set: rows whose id is divisible by 50."""
    return df.where(F.col(id_col) % 50 == 0).select(F.col(id_col).alias("query_id"))
