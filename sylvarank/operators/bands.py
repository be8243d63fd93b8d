"""Size bands, candidate budgets and top-k helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band(size: Column, raw: Column | None = None, ratio: float = 1.2, large_ratio: float = 1.8, large_from: int = 600, diff: float = 25) -> tuple[Column, Column]:
    """Inclusive bounds of comparable sizes around ``size``."""
    r = F.when((size if raw is None else raw) >= large_from, F.lit(large_ratio)).otherwise(F.lit(ratio))
    t = size.cast("double")
    return F.greatest(F.lit(0.0), F.least(t / r, t - diff)), F.greatest(t * r, t + diff)


def binned_band_join(queries: DataFrame, rows: DataFrame, low: str, high: str, value: str, width: int) -> DataFrame:
    """Pairs with ``low <= value <= high`` as an equi-join on bins of ``width``.

    Each row lies in one bin, a query in those its band touches, so the plan is
    a hash join on the bin instead of a nested loop; no pair comes twice.
    """
    bins = queries.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return bins.join(rows.withColumn("_bin", F.floor(F.col(value) / width)), "_bin").where(F.col(value).between(F.col(low), F.col(high))).drop("_bin")


def band_counts(queries: DataFrame, sizes: DataFrame, size_col: str = "size") -> DataFrame:
    """``queries`` with ``in_band``: rows within each band, from a histogram of sizes."""
    hist = sizes.groupBy(F.col(size_col).alias("_v")).agg(F.count("*").alias("_n"))
    counted = binned_band_join(queries.select("query_id", "low", "high"), hist, "low", "high", "_v", 16).groupBy("query_id").agg(F.sum("_n").alias("in_band"))
    return queries.join(counted, "query_id", "left").withColumn("in_band", F.coalesce("in_band", F.lit(0)))


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int | Column, rank_col: str = "position") -> DataFrame:
    """The first ``k`` rows of each group with their positions from 1; a column gives a limit per row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def adaptive_budget(size: Column, beta: float, k_max: int) -> Column:
    return F.least(F.lit(k_max), (F.lit(float(beta)) * size).cast("int"))


def cascade_k(size: Column, bins: tuple[int, ...] = (100, 300, 750, 1500), thresholds: tuple[int, ...] = (20, 50, 100)) -> Column:
    """Limit by size: thresholds are strict upper bounds, the last bin is open."""
    out = F.lit(bins[-1])
    for limit, upper in reversed(list(zip(bins, thresholds))):
        out = F.when(size < upper, F.lit(limit)).otherwise(out)
    return out
