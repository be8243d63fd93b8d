"""Fusion of ranked lists and of score components, gates, ranks and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Hybrid, MarginGate, Weights
from .bands import top_k

COMPONENTS = ("wl", "teds", "jaccard", "collapse_match", "dense", "bm25")


def reciprocal_ranks(lists: list[tuple[DataFrame, float]], k: float = 60.0, limit: int | None = None) -> DataFrame:
    """``query_id, name, score, position`` from lists with positions; weights are used as given."""
    parts = [df.select("query_id", "name", (F.lit(float(w)) / (F.lit(float(k)) + F.col("position"))).alias("share")) for df, w in lists]
    fused = reduce(DataFrame.unionByName, parts).groupBy("query_id", "name").agg(F.round(F.sum("share"), 9).alias("score"))
    order = [F.desc("score"), F.col("name")]
    return top_k(fused, ["query_id"], order, limit) if limit is not None else fused.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def over_best(scored: DataFrame) -> DataFrame:
    """Scores over the query's best one; 0 where that is not positive."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return scored.withColumn("score", F.when(best > 0, F.col("score") / best).otherwise(F.lit(0.0)))


def hybrid(wl: DataFrame, bm25: DataFrame | None, dense: DataFrame | None, settings: Hybrid, limit: int) -> DataFrame:
    """Fused candidates with each source's score: 0 where it has none, six places."""
    lists = [(wl, settings.wl_weight)] + [(d, w) for d, w in ((bm25, settings.bm25_weight), (dense, settings.dense_weight)) if d is not None]
    out = reciprocal_ranks(lists, settings.rrf_k, limit).withColumnRenamed("score", "fused")
    for name, source in (("wl", wl), ("bm25", over_best(bm25) if bm25 is not None else None), ("dense", dense)):
        if source is None:
            out = out.withColumn(f"{name}_score", F.lit(0.0))
        else:
            out = out.join(source.select("query_id", "name", F.col("score").alias("_s")), ["query_id", "name"], "left").withColumn(f"{name}_score", F.round(F.coalesce("_s", F.lit(0.0)), 6)).drop("_s")
    return out


def fused(weights: Weights, dense_weight: Column | None = None) -> Column:
    """Weighted sum of the components; a missing tree-edit score counts 0.

    Components have six places, so twelve hold the sum and no tie is left to rounding.
    """
    parts = [F.lit(float(getattr(weights, c))) * F.coalesce(F.col(c), F.lit(0.0)) for c in COMPONENTS if c != "dense"]
    parts.append((F.lit(float(weights.dense)) if dense_weight is None else dense_weight) * F.coalesce(F.col("dense"), F.lit(0.0)))
    return F.round(reduce(lambda a, b: a + b, parts), 12)


def structural(weights: Weights) -> Column:
    return F.round(reduce(lambda a, b: a + b, (F.lit(float(getattr(weights, c))) * F.coalesce(F.col(c), F.lit(0.0)) for c in COMPONENTS[:4])), 12)


def score_candidates(rows: DataFrame, weights: Weights, large: Weights | None = None, cutoff: int = 50) -> DataFrame:
    """``final`` of candidates; queries of more than ``cutoff`` raw nodes have no tree-edit score and, if given, other weights."""
    big = F.col("raw_size") > cutoff
    told = rows.withColumn("teds", F.when(~big, F.col("teds")))
    return told.withColumn("final", F.when(big, fused(large or weights)).otherwise(fused(weights)))


def margin_gate(rows: DataFrame, weights: Weights, gate: MarginGate, large: Weights | None = None, cutoff: int = 50) -> DataFrame:
    """``final`` with the gate's dense weight, reduced where structure already decides.

    The margin is the best structural score less the second, 0 if there is none.
    Queries of more than ``cutoff`` raw nodes use the large-tree weights, if given.
    """
    big = F.col("raw_size") > cutoff if large is not None else F.lit(False)
    s = rows.withColumn("structural", F.when(big, structural(large or weights)).otherwise(structural(weights)))
    w = Window.partitionBy("query_id").orderBy(F.desc("structural"), "name")
    ranked = s.withColumn("_r", F.row_number().over(w))
    best = ranked.where("_r <= 2").groupBy("query_id").agg((F.max(F.when(F.col("_r") == 1, F.col("structural"))) - F.coalesce(F.max(F.when(F.col("_r") == 2, F.col("structural"))), F.lit(0.0))).alias("margin"))
    dw = float(gate.dense_weight)
    eff = F.lit(dw) if gate.threshold <= 0 else F.lit(dw) * F.greatest(F.lit(float(gate.floor)), 1 - F.col("margin") / gate.threshold)
    told = s.join(best, "query_id").withColumn("dense_weight", F.round(eff, 6))
    return told.withColumn("final", F.when(big, fused(large or weights, F.col("dense_weight"))).otherwise(fused(weights, F.col("dense_weight"))))


def competition_rank(rows: DataFrame, score: str = "final") -> DataFrame:
    """``rank`` 1, 2, 2, 4 by score, and ``position`` by score and name."""
    by = Window.partitionBy("query_id").orderBy(F.desc(score))
    return rows.withColumn("rank", F.rank().over(by)).withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "name")))


def target_rank(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """``query_id, target, final_rank``; null where the target is not among the ranked."""
    hit = ranked.select("query_id", F.col("name").alias("target"), F.col("rank").alias("final_rank"))
    return queries.select("query_id", "target").join(hit, ["query_id", "target"], "left")


def metrics(records: DataFrame, ks: tuple[int, ...] = (1, 5, 10), rank_col: str = "final_rank") -> DataFrame:
    """One row over all records; those without a rank stay in the denominator, and none at all give 0."""
    r, n = F.col(rank_col).cast("double"), F.count("*")
    mean = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)) / F.greatest(n, F.lit(1)), 6)
    out = [n.alias("queries"), F.count(rank_col).alias("completed"), mean(1 / r).alias("mrr")]
    for k in ks:
        hit = F.when(r <= k, 1.0)
        out += [mean(hit).alias(f"recall_{k}"), mean(hit / k).alias(f"precision_{k}"), mean(hit * 2 / (k + 1)).alias(f"f1_{k}"), mean(F.when(r <= k, 1 / F.log2(r + 1))).alias(f"ndcg_{k}")]
    return records.agg(*out)


def pinned_rank(rows: DataFrame, verdicts: DataFrame, weights: Weights | None = None, bonus: float = 0.5) -> DataFrame:
    """Reranks by verdicts, the structural leaders kept in front.

    All rows with the query's best structural score are leaders.  Others get
    ``bonus`` where the verdict is true.  Ranks go up where the key differs from
    the row just before, so a boosted row with exactly the leaders' score shares
    their rank while one with a higher score comes after them.
    """
    s = rows if weights is None else rows.withColumn("structural", structural(weights))
    told = s.join(verdicts, ["query_id", "name"], "left").withColumn("leader", F.col("structural") == F.max("structural").over(Window.partitionBy("query_id")))
    told = told.withColumn("key", F.when(F.col("leader"), F.col("structural")).otherwise(F.round(F.col("structural") + F.when(F.col("applicable"), F.lit(float(bonus))).otherwise(F.lit(0.0)), 12)))
    order = Window.partitionBy("query_id").orderBy(F.desc("leader"), F.desc("key"), "name")
    told = told.withColumn("position", F.row_number().over(order)).withColumn("_prev", F.lag("key").over(order))
    changed = F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col("key")), F.col("position"))
    return told.withColumn("rank", F.max(changed).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("verdict", F.col("applicable").cast("int").cast("double")).drop("_prev")


def probe_pool(ranked: DataFrame, queries: DataFrame, top_n: int = 50, include_target: bool = True) -> DataFrame:
    """Candidates to ask verdicts for: the first ``top_n`` by saved rank (9999 without one), and the target if wanted."""
    pool = top_k(ranked.withColumn("rank", F.coalesce("rank", F.lit(9999))), ["query_id"], [F.col("rank"), F.col("position")], top_n, "_p").select("query_id", "name")
    return pool.unionByName(queries.select("query_id", F.col("target").alias("name"))).distinct() if include_target else pool


def answered(verdicts: DataFrame) -> DataFrame:
    """``query_id`` of the queries that have a verdict line at all, known or not."""
    return verdicts.select("query_id").distinct()


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.count("*").alias("probes"), F.count_if("applicable").alias("applicable"), F.count_if(~F.col("applicable")).alias("rejected"), F.count_if(F.col("applicable").isNull()).alias("unknown"))
