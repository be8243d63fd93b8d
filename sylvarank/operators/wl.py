"""Structural kernel: iterated neighbourhood labels of trees, and cosines of their histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LEAF_KINDS
from ..sources.staging import dense_ranks, stage
from .bands import band, band_counts, binned_band_join, top_k


def tree_stats(nodes: DataFrame) -> DataFrame:
    """``tree_id, size, tree_depth``."""
    return nodes.groupBy("tree_id").agg(F.count("*").alias("size"), F.max("depth").alias("tree_depth"))


def initial_labels(nodes: DataFrame, prefixes: tuple[str, ...] = LEAF_KINDS) -> DataFrame:
    """Leaf kinds shrink to their kind; the depth is appended."""
    kind = F.col("label")
    for p in prefixes:
        kind = F.when(F.col("label").startswith(p), F.lit(p)).otherwise(kind)
    return nodes.withColumn("wl", F.concat(kind, F.lit("_d"), F.col("depth").cast("string")))


def refine(labelled: DataFrame) -> DataFrame:
    """One round: each node's label with its children's, sorted, hashed.

    Every node tells itself and its parent, and one aggregation by tree and node
    collects what it was told; rows that lie together by tree stay where they are.
    """
    me = F.struct(*labelled.columns)
    told = F.array(F.struct(F.col("node_id").alias("at"), me.alias("me"), F.lit(None).cast("string").alias("below")), F.struct(F.col("parent_id").alias("at"), F.when(F.lit(False), me).alias("me"), F.col("wl").alias("below")))
    rows = labelled.select("tree_id", F.explode(told).alias("x")).where("x.at is not null")
    met = rows.groupBy("tree_id", F.col("x.at").alias("at")).agg(F.max("x.me").alias("me"), F.array_join(F.array_sort(F.collect_list("x.below")), ",").alias("below"), F.count("x.below").alias("kids")).where("me is not null")
    text = F.concat(F.col("me.wl"), F.when(F.col("kids") > 0, F.concat(F.lit("("), F.col("below"), F.lit(")"))).otherwise(F.lit("")))
    return met.select(*(F.md5(text.cast("binary")).alias(c) if c == "wl" else F.col(f"me.{c}").alias(c) for c in labelled.columns))


def encode(nodes: DataFrame, iterations: int = 3, prefixes: tuple[str, ...] = LEAF_KINDS) -> DataFrame:
    """``tree_id, key, cnt``: histogram of the labels of rounds before the tree's depth; single nodes have none.

    Nodes are dealt by tree once; the rounds and the histogram follow without another shuffle.
    """
    rows = initial_labels(nodes.select("tree_id", "node_id", "parent_id", "depth", "label"), prefixes).repartition("tree_id")
    rows = rows.select("tree_id", "node_id", "parent_id", "wl", F.max("depth").over(Window.partitionBy("tree_id")).alias("rounds"))
    for i in range(iterations):
        rows = refine(rows).withColumn(f"w{i}", F.when(F.col("rounds") > i, F.concat(F.lit(f"{i}_"), F.col("wl"))))
    keys = rows.select("tree_id", F.explode(F.array(*(f"w{i}" for i in range(iterations)))).alias("key")).where("key is not null")
    return keys.groupBy("tree_id", "key").agg(F.count("*").alias("cnt"))


def dictionary(encoding: DataFrame) -> DataFrame:
    """``key, id``: dense ids from 0 in key order."""
    return dense_ranks(encoding.select("key")).select(F.col("value").alias("key"), F.col("rank").cast("int").alias("id"))


def vectors(encoding: DataFrame, ids: DataFrame) -> DataFrame:
    """``tree_id, wl_ids, wl_counts, wl_norm``; the norm also counts keys without an id."""
    norms = encoding.groupBy("tree_id").agg(F.sqrt(F.sum(F.col("cnt") * F.col("cnt")).cast("double")).alias("wl_norm"))
    packed = encoding.join(ids, "key").groupBy("tree_id").agg(F.array_sort(F.collect_list(F.struct("id", "cnt"))).alias("v"))
    return norms.join(packed, "tree_id", "left").select("tree_id", F.coalesce(F.transform("v", lambda x: x["id"]), F.array().cast("array<int>")).alias("wl_ids"), F.coalesce(F.transform("v", lambda x: x["cnt"]), F.array().cast("array<bigint>")).alias("wl_counts"), "wl_norm")


def classes(encoding: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees with equal size and histogram as one class.

    Returns ``tree_id, cls, size`` and ``cls, size, key, cnt, norm`` of one tree
    of each class.  Scores belong to classes, so equal trees are compared once.
    """
    packed = encoding.groupBy("tree_id").agg(F.array_sort(F.collect_list(F.struct("key", "cnt"))).alias("enc"))
    told = stats.join(packed, "tree_id", "left")
    text = F.concat_ws("|", F.col("size").cast("string"), F.array_join(F.transform(F.coalesce("enc", F.array().cast("array<struct<key:string,cnt:bigint>>")), lambda x: F.concat_ws(":", x["key"], x["cnt"].cast("string"))), ","))
    told = told.withColumn("cls", F.md5(text.cast("binary")))
    rows = told.groupBy("cls").agg(F.first("size").alias("size"), F.first("enc").alias("enc"))
    exploded = rows.where("enc is not null").select("cls", "size", F.explode("enc").alias("e")).select("cls", "size", "e.key", "e.cnt")
    norms = exploded.groupBy("cls").agg(F.sqrt(F.sum(F.col("cnt") * F.col("cnt")).cast("double")).alias("norm"))
    return stage(told.select("tree_id", "cls", "size"), "classes"), stage(exploded.join(norms, "cls"), "class-labels")


def cosine(dot: Column, left: Column, right: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot.cast("double") / (left * right)))


def class_scores(asked: DataFrame, keyed: DataFrame, width: int = 16) -> DataFrame:
    """``q, c, score`` of query and corpus classes that share a label, the corpus class being in the query's band.

    ``asked``: ``q, cls, low, high``.  Labels are joined within bins of sizes,
    so a label that all trees have does not link those of other sizes.
    """
    q = keyed.select("cls", "key", F.col("cnt").alias("qc"), F.col("norm").alias("qn")).join(asked, "cls").drop("cls")
    q = q.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    c = keyed.select(F.col("cls").alias("c"), "size", "key", F.col("cnt").alias("cc"), F.col("norm").alias("cn"), F.floor(F.col("size") / width).alias("bin"))
    pairs = q.join(c, ["key", "bin"]).where(F.col("size").between(F.col("low"), F.col("high")))
    return pairs.groupBy("q", "c").agg(cosine(F.sum(F.col("qc") * F.col("cc")), F.first("qn"), F.first("cn")).alias("score"))


def cosine_top_k(encoding: DataFrame, stats: DataFrame, queries: DataFrame, k: int, zero_fill: bool = False, among: DataFrame | None = None, raw: DataFrame | None = None, **limits) -> DataFrame:
    """``query_id, name, score, position``: the k best trees for each query by rounded score, then id.

    A class beyond the first k (by score, then least member) has k better trees
    before it, so only k classes and k members of each are expanded: what is
    ranked per query is bounded, however many trees are alike.  With
    ``zero_fill`` comparable trees that share no label follow with score 0;
    ``among`` names the trees that may be found, all by default.  ``raw`` has
    the ``raw_size`` of queries, by which large ones get their wider band.
    """
    trees, keyed = classes(encoding, stats)
    wanted = trees.join(queries.select(F.col("query_id").alias("tree_id")), "tree_id", "left_semi")
    sizes_of = wanted.withColumn("raw_size", F.col("size")) if raw is None else wanted.join(raw.select(F.col("query_id").alias("tree_id"), "raw_size"), "tree_id", "left").withColumn("raw_size", F.coalesce("raw_size", "size"))
    low, high = band(F.col("size"), F.col("raw_size"), **limits)
    wanted = stage(sizes_of.select("tree_id", "cls", low.alias("low"), high.alias("high")).withColumn("q", F.concat_ws("|", "cls", F.col("low").cast("string"))), "wanted")
    asked = wanted.select("q", "cls", "low", "high").distinct()
    scored = class_scores(asked, keyed).withColumn("score", F.round("score", 9))
    if zero_fill:
        sizes = trees.select("cls", "size").distinct()
        inside = binned_band_join(asked.drop("cls"), sizes.withColumnRenamed("cls", "c"), "low", "high", "size", 16).select("q", "c")
        scored = inside.join(scored, ["q", "c"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    trees = trees if among is None else trees.join(among.select("tree_id"), "tree_id", "left_semi")
    first = trees.groupBy(F.col("cls").alias("c")).agg(F.min("tree_id").alias("least"))
    best = top_k(scored.join(first, "c"), ["q"], [F.desc("score"), F.col("least")], k, "_p").drop("_p", "least")
    members = top_k(trees.select(F.col("cls").alias("c"), F.col("tree_id").alias("name")), ["c"], [F.col("name")], k, "_p").drop("_p")
    ranked = top_k(best.join(members, "c"), ["q"], [F.desc("score"), F.col("name")], k)
    return wanted.select(F.col("tree_id").alias("query_id"), "q").join(ranked, "q").select("query_id", "name", "score", "position")


def band_totals(stats: DataFrame, queries: DataFrame, encoding: DataFrame | None = None, raw: DataFrame | None = None, among: DataFrame | None = None, **limits) -> DataFrame:
    """``query_id, low, high, in_band, joined``: comparable corpus trees of each query, and those of them that have an encoding."""
    corpus = stats if among is None else stats.join(among.select("tree_id"), "tree_id", "left_semi")
    asked = stats.join(queries.select(F.col("query_id").alias("tree_id")), "tree_id", "left_semi").select(F.col("tree_id").alias("query_id"), "size")
    asked = asked.withColumn("raw_size", F.col("size")) if raw is None else asked.join(raw.select("query_id", "raw_size"), "query_id", "left").withColumn("raw_size", F.coalesce("raw_size", "size"))
    low, high = band(F.col("size"), F.col("raw_size"), **limits)
    asked = asked.select("query_id", low.alias("low"), high.alias("high"))
    out = band_counts(asked, corpus)
    encoded = corpus if encoding is None else corpus.join(encoding.select("tree_id").distinct(), "tree_id", "left_semi")
    return out.join(band_counts(asked, encoded).select("query_id", F.col("in_band").alias("joined")), "query_id")


def array_cosine(ids_a: Column, counts_a: Column, norm_a: Column, ids_b: Column, counts_b: Column, norm_b: Column) -> Column:
    """The kernel on compact vectors, without a shuffle: counts looked up by id."""
    left = F.map_from_arrays(ids_a, counts_a)
    right = F.zip_with(ids_b, counts_b, lambda i, c: c * F.coalesce(F.try_element_at(left, i), F.lit(0)))
    dot = F.aggregate(right, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return F.when((norm_a > 0) & (norm_b > 0) & (dot > 0), cosine(dot, norm_a, norm_b)).otherwise(F.lit(0.0))
