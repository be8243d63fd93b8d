"""Registered queries of the ranking engine, and their SQL for an independent engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import PROFILES, Hybrid, MarginGate, Weights
from .operators import bands, dense, expr, fusion, lexical, manifest, structure, ted, wl
from .plans.trees import every_fiftieth, order_trees
from .sources import sinks
from .sources.staging import stage
from .sources.tables import one_of_text, table

K = 10
#: Trees have at most a few dozen nodes, so bands are narrower than the defaults.
BAND = {"diff": 4, "large_from": 600}
GATED = Weights(0.1, 0.3, 0.1, 0.5, 0.6)
HYBRID = Hybrid()


def _trees(spark, sf):
    nodes = stage(order_trees(spark, sf), "nodes")
    return nodes, wl.tree_stats(nodes), stage(wl.encode(nodes, 3), "encoding")


def _tree_queries(spark, sf):
    return every_fiftieth(table(spark, sf, "orders"), "o_orderkey")


def _wl_top(spark, sf, k=K, **kw):
    _, stats, enc = _trees(spark, sf)
    return wl.cosine_top_k(enc, stats, _tree_queries(spark, sf), k, **BAND, **kw)


def _top_pairs(spark, sf):
    nodes, stats, enc = _trees(spark, sf)
    return nodes, stats, stage(wl.cosine_top_k(enc, stats, _tree_queries(spark, sf), K, **BAND), "top")


def corpus_live_count(spark, sf):
    return table(spark, sf, "documents").where("text is not null and text <> 'null'").agg(F.count("*").alias("live"))


def _bands(spark, sf):
    stats = wl.tree_stats(order_trees(spark, sf))
    low, high = bands.band(F.col("size"), **BAND)
    return stats, stats.where("tree_id % 50 = 0").select(F.col("tree_id").alias("query_id"), "size", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def node_band_counts(spark, sf):
    stats, q = _bands(spark, sf)
    return bands.band_counts(q, stats)


def node_band_join_binned(spark, sf):
    part = table(spark, sf, "part")
    low, high = bands.band(F.col("p_size"), diff=5)
    q = part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), low.alias("low"), high.alias("high"))
    pairs = bands.binned_band_join(q, part.select("p_partkey", "p_size"), "low", "high", "p_size", 8)
    return pairs.groupBy("query_id").agg(F.count("*").alias("matches"), F.min("p_partkey").alias("first_key"), F.max("p_partkey").alias("last_key"))


def coverage_flags(spark, sf):
    orders = table(spark, sf, "orders")
    got = manifest.coverage(table(spark, sf, "customer").select("c_custkey"), "c_custkey", {"in_orders": orders.select("o_custkey"), "in_urgent": orders.where("o_orderpriority = '1-URGENT'").select("o_custkey")})
    return got.select("c_custkey", F.col("in_orders").cast("int").alias("in_orders"), F.col("in_urgent").cast("int").alias("in_urgent"))


def name_lookup(spark, sf):
    part = table(spark, sf, "part")
    wanted = every_fiftieth(part, "p_partkey").select((F.col("query_id") * 2).alias("wanted"))
    return wanted.join(part.select("p_partkey", "p_name", "p_type"), F.col("wanted") == F.col("p_partkey"), "left").select("wanted", "p_name", "p_type")


def tree_size_depth(spark, sf):
    return wl.tree_stats(order_trees(spark, sf))


def wl_initial_labels(spark, sf):
    return wl.initial_labels(order_trees(spark, sf)).select("tree_id", "node_id", F.col("wl").alias("wl_label"))


def wl_round1_labels(spark, sf):
    return wl.refine(wl.initial_labels(order_trees(spark, sf))).select("tree_id", "node_id", F.col("wl").alias("wl_label"))


def wl_encoding(spark, sf):
    return _trees(spark, sf)[2]


def wl_hash_dictionary(spark, sf):
    return wl.dictionary(_trees(spark, sf)[2])


def wl_vectors(spark, sf):
    enc = _trees(spark, sf)[2]
    v = wl.vectors(enc, wl.dictionary(enc))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return v.select("tree_id", text("wl_ids").alias("wl_ids"), text("wl_counts").alias("wl_counts"), F.round("wl_norm", 6).alias("wl_norm"))


def wl_cosine_topk_join(spark, sf):
    return _wl_top(spark, sf)


def wl_cosine_topk_arrays(spark, sf):
    """The same ranking from compact vectors: classes of equal trees are compared by array functions."""
    _, stats, enc = _trees(spark, sf)
    trees, keyed = wl.classes(enc, stats)
    ids = wl.dictionary(enc)
    vec = wl.vectors(keyed.select(F.col("cls").alias("tree_id"), "key", "cnt"), ids).withColumnRenamed("tree_id", "cls").join(trees.select("cls", "size").distinct(), "cls")
    wanted = trees.where("tree_id % 50 = 0")
    low, high = bands.band(F.col("size"), **BAND)
    q = vec.join(wanted.select("cls").distinct(), "cls", "left_semi").select(F.col("cls").alias("q"), low.alias("low"), high.alias("high"), F.col("wl_ids").alias("qi"), F.col("wl_counts").alias("qc"), F.col("wl_norm").alias("qn"))
    pairs = bands.binned_band_join(q, vec.withColumnRenamed("cls", "c"), "low", "high", "size", 8)
    scored = pairs.select("q", "c", F.round(wl.array_cosine(F.col("qi"), F.col("qc"), F.col("qn"), F.col("wl_ids"), F.col("wl_counts"), F.col("wl_norm")), 9).alias("score")).where("score > 0")
    first = trees.groupBy(F.col("cls").alias("c")).agg(F.min("tree_id").alias("least"))
    best = bands.top_k(scored.join(first, "c"), ["q"], [F.desc("score"), F.col("least")], K, "_p").drop("_p", "least")
    members = bands.top_k(trees.select(F.col("cls").alias("c"), F.col("tree_id").alias("name")), ["c"], [F.col("name")], K, "_p").drop("_p")
    ranked = bands.top_k(best.join(members, "c"), ["q"], [F.desc("score"), F.col("name")], K)
    return wanted.select(F.col("tree_id").alias("query_id"), F.col("cls").alias("q")).join(ranked, "q").select("query_id", "name", "score", "position")


def wl_cosine_zero_fill(spark, sf):
    return _wl_top(spark, sf, zero_fill=True)


def wl_coarse_alpha(spark, sf):
    nodes, stats, top = _top_pairs(spark, sf)
    both = top.join(structure.collapse_match(top, nodes), ["query_id", "name"])
    coarse = F.round(0.7 * F.col("score") + (1 - F.lit(0.7)) * F.col("collapse_match"), 6)
    return both.select("query_id", "name", coarse.alias("coarse"))


def _lexical(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("name"), "text")
    tokens = lexical.word_tokens(F.col("text"))
    return lexical.postings(docs, tokens), lexical.lengths(docs, tokens)


def _item_tokens(spark, sf):
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(lexical.word_tokens(F.col("text"))).alias("token"))
    return items.groupBy("query_id", "token").agg(F.count("*").alias("qf"))


def _bm25(spark, sf, k=K):
    post, dl = _lexical(spark, sf)
    return lexical.top_documents(lexical.scores(_item_tokens(spark, sf), post, dl), dl, k, zero_fill=False)


def bm25_doc_stats(spark, sf):
    post, dl = _lexical(spark, sf)
    terms = post.groupBy("name").agg(F.count("*").alias("terms"), F.max("tf").alias("max_tf"))
    return dl.join(terms, "name", "left").select("name", "dl", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("max_tf", F.lit(0)).alias("max_tf"))


def bm25_index_report(spark, sf):
    return lexical.index_report(*_lexical(spark, sf))


def bm25_idf(spark, sf):
    post, dl = _lexical(spark, sf)
    return lexical.frequencies(post, lexical.totals(dl)).select("token", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, sf):
    return _bm25(spark, sf).select("query_id", "name", F.round("score", 6).alias("score"), "position")


def bm25_zero_fill(spark, sf):
    """Queries of one rare token each, the longest of an item, so that names must fill up."""
    post, dl = _lexical(spark, sf)
    one = _item_tokens(spark, sf).groupBy("query_id").agg(F.min(F.struct((-F.length("token")).alias("l"), "token")).alias("m")).select("query_id", F.col("m.token").alias("token"), F.lit(1).cast("long").alias("qf"))
    return lexical.top_documents(lexical.scores(one, post, dl), dl, K).select("query_id", "name", F.round("score", 6).alias("score"), "position")


def name_tokens(spark, sf):
    dotted = F.translate("p_name", " ", ".")
    return table(spark, sf, "part").select("p_partkey", F.array_join(lexical.name_tokens(dotted), "|").alias("tokens"))


def _dense(spark, sf, k=K):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("name"), F.col("embedding").alias("vector"))
    return dense.nearest(rows.where("name % 50 = 0").withColumnRenamed("name", "query_id"), rows, k)


def dense_topk(spark, sf):
    return _dense(spark, sf).select("query_id", "name", F.round("score", 6).alias("score"), "position")


def rrf_two_lists(spark, sf):
    return fusion.reciprocal_ranks([(_bm25(spark, sf), 0.6), (_dense(spark, sf), 0.4)], 60.0, K).select("query_id", "name", "score", "position")


def rrf_three_lists(spark, sf):
    return fusion.reciprocal_ranks([(_wl_top(spark, sf), 0.5), (_bm25(spark, sf), 0.15), (_dense(spark, sf), 0.35)], 60.0, K).select("query_id", "name", "score", "position")


def hybrid_scores(spark, sf):
    out = fusion.hybrid(_wl_top(spark, sf), _bm25(spark, sf), _dense(spark, sf), HYBRID, K)
    return out.select("query_id", "name", "fused", "position", "wl_score", "bm25_score", "dense_score")


def constant_jaccard(spark, sf):
    nodes, stats, top = _top_pairs(spark, sf)
    return structure.constant_jaccard(top, structure.constant_sets(nodes)).select("query_id", "name", F.round("jaccard", 6).alias("jaccard"))


def collapse_match(spark, sf):
    nodes, stats, top = _top_pairs(spark, sf)
    return structure.collapse_match(top, nodes).select("query_id", "name", F.round("collapse_match", 6).alias("collapse_match"))


def ted_similarity(spark, sf):
    nodes, stats, top = _top_pairs(spark, sf)
    return ted.ted_scores(top, nodes, size_cutoff=20).select("query_id", "name", F.round("teds", 6).alias("teds"))


def _components(spark, sf):
    """Candidates with all components; a size ratio stands in for the tree-edit score, Jaccard for the dense one."""
    nodes, stats, top = _top_pairs(spark, sf)
    q, c = stats.select(F.col("tree_id").alias("query_id"), F.col("size").alias("raw_size")), stats.select(F.col("tree_id").alias("name"), F.col("size").alias("c_size"))
    rows = top.select("query_id", "name", F.col("score").alias("wl"), F.col("position").alias("wl_position")).join(q, "query_id").join(c, "name")
    rows = rows.join(structure.constant_jaccard(top, structure.constant_sets(nodes)), ["query_id", "name"]).join(structure.collapse_match(top, nodes), ["query_id", "name"])
    teds = 1 - F.abs(F.col("raw_size") - F.col("c_size")) / F.greatest("raw_size", "c_size")
    return rows.select("query_id", "name", F.round("wl", 6).alias("wl"), F.round(teds, 6).alias("teds"), F.round("jaccard", 6).alias("jaccard"), F.round("collapse_match", 6).alias("collapse_match"), F.round("jaccard", 6).alias("dense"), F.lit(0.0).alias("bm25"), "raw_size", "wl_position")


def fused_scores(spark, sf):
    return _components(spark, sf).select("query_id", "name", fusion.fused(PROFILES["paper"]).alias("final"))


def large_tree_fallback(spark, sf):
    got = fusion.score_candidates(_components(spark, sf), PROFILES["upstream_head"], PROFILES["upstream_head_large_tree"], cutoff=9)
    return got.select("query_id", "name", "teds", "final")


def margin_gate(spark, sf):
    got = fusion.margin_gate(_components(spark, sf), GATED, MarginGate(True, 0.05, 0.2))
    return got.select("query_id", "name", "dense_weight", "final")


def _ranked(spark, sf):
    return fusion.competition_rank(_components(spark, sf).withColumn("final", fusion.fused(PROFILES["paper"])))


def competition_rank(spark, sf):
    return _ranked(spark, sf).select("query_id", "name", "final", "rank", "position")


def adaptive_budget(spark, sf):
    stats = wl.tree_stats(order_trees(spark, sf)).where("tree_id % 50 = 0")
    limits = stats.select(F.col("tree_id").alias("query_id"), "size", bands.adaptive_budget(F.col("size"), 0.4, 5).alias("k"))
    kept = _wl_top(spark, sf).join(limits, "query_id").where("position <= k")
    return limits.join(kept.groupBy("query_id").agg(F.count("*").alias("kept")), "query_id", "left").select("query_id", "size", "k", F.coalesce("kept", F.lit(0)).alias("kept"))


def cascade_k(spark, sf):
    return wl.tree_stats(order_trees(spark, sf)).select("tree_id", bands.cascade_k(F.col("size"), (100, 300, 750, 1500), (5, 11, 21)).alias("k"))


def output_topk_slice(spark, sf):
    return _ranked(spark, sf).where("position <= 3").select("query_id", "name", "final", "rank", "position")


def _relevance(spark, sf):
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    found = _dense(spark, sf).where("query_id <> name").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id").join(labels.select(F.col("vec_id").alias("name"), F.col("label").alias("nl")), "name").where("ql = nl").groupBy("query_id").agg((F.min("position") - 1).alias("final_rank"))
    return every_fiftieth(labels, "vec_id").join(found, "query_id", "left")


def retrieval_metrics(spark, sf):
    return fusion.metrics(_relevance(spark, sf))


def _verdicts(rows):
    m = (F.col("query_id") * 7 + F.col("name")) % 3
    return rows.select("query_id", "name", F.when(m == 0, True).when(m == 1, False).alias("applicable"))


def verdict_rerank(spark, sf):
    rows = stage(_components(spark, sf), "components")
    got = fusion.pinned_rank(rows, _verdicts(rows), PROFILES["paper"], 0.5)
    return got.select("query_id", "name", "key", "rank", "position", "verdict")


def verdict_rerank_tie(spark, sf):
    """Structural scores on a grid of halves, so that boosted rows meet the leaders' score exactly."""
    rows = _components(spark, sf).select("query_id", "name", (F.floor(F.col("collapse_match") * 2) / 2).alias("structural"))
    rows = stage(rows, "components")
    got = fusion.pinned_rank(rows, _verdicts(rows), None, 0.5)
    return got.select("query_id", "name", "key", "rank", "position")


def verdict_counts(spark, sf):
    return fusion.verdict_counts(_verdicts(_top_pairs(spark, sf)[2]))


def _events(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "props")
    return e.where("event_id % 3 <> 0"), e.where("event_id % 5 <> 0")


EVENT_KEY = ["user_id", "event_type"]


def occurrence_match(spark, sf):
    current, legacy = _events(spark, sf)
    return manifest.match_occurrences(current, legacy, EVENT_KEY, ["event_id"], "event_id").select("event_id", "occurrence", "legacy_id")


def legacy_backfill_anti(spark, sf):
    current, legacy = _events(spark, sf)
    return manifest.never_matched(legacy, current, EVENT_KEY, ["event_id"], "event_id").select("event_id", "occurrence")


def _reasoned(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return manifest.with_reasons(e, {"no_props": F.col("props").isNull(), "small_k": k < 10, "low_value": F.col("value") < 5, "purchase": F.col("event_type") == "purchase"})


def exclusion_reasons(spark, sf):
    return _reasoned(spark, sf).where(F.size("reasons") > 0).select("event_id", F.array_join("reasons", "|").alias("reasons"))


def exclusion_reason_counts(spark, sf):
    return manifest.reason_counts(_reasoned(spark, sf))


def duplicate_pairs(spark, sf):
    return manifest.duplicate_pairs(table(spark, sf, "events"), "user_id", "event_type")


def resume_antijoin(spark, sf):
    cases = table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), "o_orderpriority")
    done = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("query_id"))
    return sinks.pending(cases, done)


def text_fallback(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark").select("item_id", F.col("text").alias("clean"))
    return docs.join(items, docs["doc_id"] == items["item_id"], "left").select("doc_id", F.sha2(one_of_text("clean", "text"), 256).alias("digest"))


def request_lines(spark, sf):
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return sinks.request_lines(_bm25(spark, sf).select("query_id", "name", F.col("position").alias("rank")).join(items, "query_id"))


def _expressions(spark, sf):
    """Typed expressions of orders: the priority applied to each line's flags."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"))).alias("ls"))
    rows = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    const = lambda c: F.concat(F.lit('{"const":{"declName":"'), c, F.lit('","us":[]}}'))
    app = lambda f, a: F.concat(F.lit('{"app":{"fn":'), f, F.lit(',"arg":'), a, F.lit("}}"))
    body = F.aggregate(F.coalesce("ls", F.array().cast("array<struct<l_linenumber:int,l_partkey:bigint,l_suppkey:bigint,l_returnflag:string,l_linestatus:string>>")), const(F.col("o_orderpriority")), lambda acc, x: app(acc, app(const(x["l_returnflag"]), const(x["l_linestatus"]))))
    return rows.select(F.col("o_orderkey").alias("tree_id"), body.alias("expression_json"))


def expr_flatten(spark, sf):
    return expr.flatten(_expressions(spark, sf)).withColumn("tree_id", F.col("tree_id").cast("long")).drop("error")


def cse_keys(spark, sf):
    keys = expr.subtree_keys(order_trees(spark, sf))
    return keys.groupBy("tree_id", "key").agg(F.count("*").alias("n")).where("n > 1").select("tree_id", F.md5(F.col("key").cast("binary")).alias("key_md5"), "n")


def wl_band_totals(spark, sf):
    """Comparable trees of each query, and those of them that have an encoding; 25 raw nodes or more widen the band."""
    _, stats, enc = _trees(spark, sf)
    raw = stats.where("tree_id % 50 = 0").select(F.col("tree_id").alias("query_id"), (F.col("size") * 2).alias("raw_size"))
    got = wl.band_totals(stats, _tree_queries(spark, sf), enc, raw, diff=2, large_from=25)
    return got.select("query_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "in_band", "joined")


def probe_pool(spark, sf):
    """The three best of each query and its target, which is the query's own tree."""
    ranked = _ranked(spark, sf).select("query_id", "name", "rank", "position")
    return fusion.probe_pool(ranked, _tree_queries(spark, sf).withColumn("target", F.col("query_id")), 3)


def answered_queries(spark, sf):
    rows = _verdicts(_top_pairs(spark, sf)[2])
    return fusion.answered(rows.where("applicable is not null"))


def target_ranks(spark, sf):
    targets = _tree_queries(spark, sf).withColumn("target", F.col("query_id"))
    return fusion.target_rank(targets, _ranked(spark, sf))


def case_slice(spark, sf):
    """Cases 11 to 60 by key, but for those done before."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), "p_name")
    done = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("query_id"))
    return sinks.pending(parts, done, start=10, limit=50, order_col="query_id")


def _manifest(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", F.get_json_object("props", "$.k").alias("k"), F.col("value").alias("v"))
    rows = e.select("user_id", "event_type", "event_id", F.when(F.col("event_id") % 7 > 0, F.concat(F.lit(" "), "event_type", F.lit(" "))).alias("label"), F.concat(F.lit('{"k":'), "k", F.lit("}")).alias("state"), F.when(F.col("v") >= 5, F.length("k")).alias("nodes"))
    names = {"in_a": e.where("event_type <> 'purchase'").select("event_type"), "in_b": e.where("event_type <> 'click'").select("event_type")}
    return manifest.build_manifest(rows.where("event_id % 3 <> 0"), rows.where("event_id % 5 <> 0"), EVENT_KEY, "event_id", "label", "state", "nodes", names)


def manifest_rows(spark, sf):
    return _manifest(spark, sf)[0].select("query_id", "source_id", "legacy_id", "payload_source", "label", "node_count", F.col("in_a").cast("int").alias("in_a"), F.col("in_b").cast("int").alias("in_b"), "availability_reason")


def manifest_exclusions(spark, sf):
    return _manifest(spark, sf)[1].select("source_id", "label", F.array_join("reasons", "|").alias("reasons"))


def canonical_hash(spark, sf):
    return table(spark, sf, "events").select("event_id", F.sha2(manifest.canonical_json("props"), 256).alias("digest"))


QUERIES = {f.__name__: f for f in (
    corpus_live_count, node_band_counts, node_band_join_binned, coverage_flags, name_lookup, tree_size_depth, wl_initial_labels, wl_round1_labels, wl_encoding,
    wl_hash_dictionary, wl_vectors, wl_cosine_topk_join, wl_cosine_topk_arrays, wl_cosine_zero_fill, wl_coarse_alpha, bm25_doc_stats, bm25_index_report, bm25_idf, bm25_topk, bm25_zero_fill,
    name_tokens, dense_topk, rrf_two_lists, rrf_three_lists, hybrid_scores, constant_jaccard, collapse_match, ted_similarity, fused_scores, large_tree_fallback,
    margin_gate, competition_rank, adaptive_budget, cascade_k, output_topk_slice, retrieval_metrics, verdict_rerank, verdict_rerank_tie, verdict_counts,
    occurrence_match, legacy_backfill_anti, exclusion_reasons, exclusion_reason_counts, duplicate_pairs, resume_antijoin, text_fallback, request_lines, expr_flatten, cse_keys, canonical_hash,
    wl_band_totals, probe_pool, answered_queries, target_ranks, case_slice, manifest_rows, manifest_exclusions,
)}

# The SQL below is built from common table expressions; each query names those it needs.

NODES = """lines AS (SELECT l_orderkey AS tree_id, l_returnflag AS f, 'Const(' || l_linestatus || (l_suppkey % 7) || ')' AS leaf,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS k
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
nodes AS (SELECT o_orderkey AS tree_id, 0 AS node_id, NULL::INT AS parent_id, 0 AS ord, 0 AS depth, o_orderpriority AS label FROM orders
  UNION ALL SELECT tree_id, (2*k-1)::INT, 0, (k-1)::INT, 1, f FROM lines
  UNION ALL SELECT tree_id, (2*k)::INT, (2*k-1)::INT, 0, 2, leaf FROM lines),
stats AS (SELECT tree_id, count(*) AS size, max(depth) AS tree_depth FROM nodes GROUP BY tree_id)"""
WL = NODES + """,
w0 AS (SELECT *, CASE WHEN starts_with(label, 'BVar') THEN 'BVar' WHEN starts_with(label, 'FVar') THEN 'FVar' WHEN starts_with(label, 'MVar') THEN 'MVar' WHEN starts_with(label, 'Sort') THEN 'Sort' WHEN starts_with(label, 'Const') THEN 'Const' ELSE label END || '_d' || depth AS wl FROM nodes),
w1 AS (SELECT n.tree_id, n.node_id, n.parent_id, md5(any_value(n.wl) || CASE WHEN count(c.wl) > 0 THEN '(' || string_agg(c.wl, ',' ORDER BY c.wl) || ')' ELSE '' END) AS wl
  FROM w0 n LEFT JOIN w0 c ON c.tree_id = n.tree_id AND c.parent_id = n.node_id GROUP BY ALL),
w2 AS (SELECT n.tree_id, n.node_id, n.parent_id, md5(any_value(n.wl) || CASE WHEN count(c.wl) > 0 THEN '(' || string_agg(c.wl, ',' ORDER BY c.wl) || ')' ELSE '' END) AS wl
  FROM w1 n LEFT JOIN w1 c ON c.tree_id = n.tree_id AND c.parent_id = n.node_id GROUP BY ALL),
enc AS (SELECT tree_id, '0_' || wl AS key, count(*) AS cnt FROM w1 JOIN stats USING (tree_id) WHERE tree_depth > 0 GROUP BY ALL
  UNION ALL SELECT tree_id, '1_' || wl, count(*) FROM w2 JOIN stats USING (tree_id) WHERE tree_depth > 1 GROUP BY ALL),
norms AS (SELECT tree_id, sqrt(sum(cnt*cnt)::DOUBLE) AS norm FROM enc GROUP BY tree_id),
ids AS (SELECT key, (row_number() OVER (ORDER BY key) - 1)::INT AS id FROM (SELECT DISTINCT key FROM enc))"""
BANDS = """bands AS (SELECT tree_id AS query_id, size, greatest(0.0::DOUBLE, least(size::DOUBLE / 1.2::DOUBLE, size::DOUBLE - 4)) AS low, greatest(size::DOUBLE * 1.2::DOUBLE, size::DOUBLE + 4) AS high FROM stats WHERE tree_id % 50 = 0)"""
TOP = WL + ",\n" + BANDS + """,
dots AS (SELECT q.tree_id AS query_id, c.tree_id AS name, sum(q.cnt*c.cnt)::DOUBLE AS dot FROM enc q JOIN enc c ON q.key = c.key WHERE q.tree_id % 50 = 0 GROUP BY ALL),
scored AS (SELECT d.query_id, d.name, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, dot / (qn.norm * cn.norm))), 9) AS score
  FROM dots d JOIN norms qn ON qn.tree_id = d.query_id JOIN norms cn ON cn.tree_id = d.name JOIN bands b ON b.query_id = d.query_id JOIN stats s ON s.tree_id = d.name WHERE s.size BETWEEN b.low AND b.high),
top AS (SELECT * FROM (SELECT query_id, name, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name)::INT AS position FROM scored) WHERE position <= 10)"""
PAIRS = TOP + """,
names AS (SELECT tree_id, list(DISTINCT m) FILTER (WHERE m IS NOT NULL) AS names FROM (SELECT tree_id, CASE WHEN starts_with(label, 'Const(') THEN regexp_extract(label, '^Const\\(([\\p{L}\\p{N}_]+)', 1) END AS m FROM nodes) GROUP BY tree_id),
jac AS (SELECT query_id, name, CASE WHEN q.names IS NULL AND c.names IS NULL THEN 1.0::DOUBLE ELSE len(list_intersect(coalesce(q.names, []), coalesce(c.names, [])))::DOUBLE / len(list_distinct(list_concat(coalesce(q.names, []), coalesce(c.names, [])))) END AS jaccard
  FROM top JOIN names q ON q.tree_id = query_id JOIN names c ON c.tree_id = name),
arity AS (SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.tree_id = n.tree_id AND c.parent_id = n.node_id) AS n FROM nodes n WHERE n.tree_id IN (SELECT name FROM top UNION SELECT query_id FROM top)),
f0 AS (SELECT query_id, name, t.node_id AS tn, c.node_id AS cn, c.n AS ck, (c.n = 0 OR (t.label = c.label AND t.n = c.n)) AS met FROM top JOIN arity t ON t.tree_id = query_id AND t.depth = 0 JOIN arity c ON c.tree_id = name AND c.depth = 0),
f1 AS (SELECT query_id, name, t.node_id AS tn, c.node_id AS cn, c.n AS ck, (c.n = 0 OR (t.label = c.label AND t.n = c.n)) AS met FROM f0 JOIN arity t ON t.tree_id = query_id AND t.parent_id = tn JOIN arity c ON c.tree_id = name AND c.parent_id = cn AND c.ord = t.ord WHERE met AND ck > 0),
f2 AS (SELECT query_id, name, t.node_id AS tn, c.node_id AS cn, c.n AS ck, (c.n = 0 OR (t.label = c.label AND t.n = c.n)) AS met FROM f1 JOIN arity t ON t.tree_id = query_id AND t.parent_id = tn JOIN arity c ON c.tree_id = name AND c.parent_id = cn AND c.ord = t.ord WHERE met AND ck > 0),
col AS (SELECT query_id, name, count(*) FILTER (WHERE met)::DOUBLE / any_value(size) AS collapse_match FROM (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2) JOIN stats ON tree_id = name GROUP BY ALL),
comp AS (SELECT query_id, name, round(score, 6) AS wl, round(1 - abs(q.size - c.size)::DOUBLE / greatest(q.size, c.size), 6) AS teds, round(jaccard, 6) AS jaccard, round(collapse_match, 6) AS collapse_match, q.size AS raw_size
  FROM top JOIN jac USING (query_id, name) JOIN col USING (query_id, name) JOIN stats q ON q.tree_id = query_id JOIN stats c ON c.tree_id = name)"""
D = lambda x: f"{x}::DOUBLE"
STRUCT = f"round({D(0.1)}*wl + {D(0.3)}*teds + {D(0.1)}*jaccard + {D(0.5)}*collapse_match, 12)"
RANKED = PAIRS + f",\nranked AS (SELECT query_id, name, final, rank() OVER (PARTITION BY query_id ORDER BY final DESC)::INT AS rank, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, name)::INT AS position FROM (SELECT *, {STRUCT} AS final FROM comp))"
LEX = """toks AS (SELECT doc_id AS name, [x for x in regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}]+') if x <> ''] AS t FROM documents),
dl AS (SELECT name, len(t)::BIGINT AS dl FROM toks),
post AS (SELECT name, token, count(*) AS tf FROM (SELECT name, unnest(t) AS token FROM toks) GROUP BY ALL),
tot AS (SELECT count(*)::DOUBLE AS n_docs, coalesce(avg(dl), 0)::DOUBLE AS avgdl FROM dl),
idf AS (SELECT token, df, ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) AS idf FROM (SELECT token, count(*) AS df FROM post GROUP BY token), tot),
q AS (SELECT query_id, token, count(*) AS qf FROM (SELECT item_id AS query_id, unnest([x for x in regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}]+') if x <> '']) AS token FROM benchmark) GROUP BY ALL)"""


def _bm25_sql(query: str, name: str = "bm") -> str:
    return f"""{name} AS (SELECT query_id, name, round(sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) * qf), 9) AS score
  FROM {query} JOIN post USING (token) JOIN idf USING (token) JOIN dl USING (name), tot GROUP BY ALL)"""


BM = LEX + ",\n" + _bm25_sql("q") + """,
bmtop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name)::INT AS position FROM bm) WHERE position <= 10)"""
DENSE = """dtop AS (SELECT * FROM (SELECT query_id, name, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name)::INT AS position FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS name, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0)) WHERE position <= 10)"""


def _rrf(*lists: tuple[str, float]) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, name, {w}::DOUBLE / (60.0::DOUBLE + position) AS s FROM {t}" for t, w in lists)
    return f"rrf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name)::INT AS position FROM (SELECT query_id, name, round(sum(s), 9) AS score FROM ({union}) GROUP BY ALL)) WHERE position <= 10)"


EVENTS = """cur AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS occurrence FROM events WHERE event_id % 3 <> 0),
leg AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS occurrence FROM events WHERE event_id % 5 <> 0)"""
REASONS = """r AS (SELECT event_id, [x for x in [CASE WHEN props IS NULL THEN 'no_props' END, CASE WHEN (json_extract_string(props, '$.k'))::INT < 10 THEN 'small_k' END, CASE WHEN value < 5 THEN 'low_value' END, CASE WHEN event_type = 'purchase' THEN 'purchase' END] if x IS NOT NULL] AS reasons FROM events)"""
PINNED = """keyed AS (SELECT *, structural = max(structural) OVER (PARTITION BY query_id) AS leader, (query_id * 7 + name) % 3 AS m FROM base),
keys AS (SELECT *, CASE WHEN leader THEN structural ELSE round(structural + CASE WHEN m = 0 THEN 0.5::DOUBLE ELSE 0 END, 12) END AS key FROM keyed),
placed AS (SELECT *, row_number() OVER w AS position, lag(key) OVER w AS prev FROM keys WINDOW w AS (PARTITION BY query_id ORDER BY leader DESC, key DESC, name)),
pinned AS (SELECT query_id, name, key, max(CASE WHEN prev IS NULL OR prev <> key THEN position END) OVER (PARTITION BY query_id ORDER BY position)::INT AS rank, position::INT AS position, CASE m WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE END AS verdict FROM placed)"""


def _metric_sql() -> str:
    out = ["count(*) AS queries", "count(final_rank) AS completed", "round(coalesce(sum(1.0::DOUBLE / final_rank), 0) / count(*), 6) AS mrr"]
    for k in (1, 5, 10):
        hit = f"CASE WHEN final_rank <= {k} THEN 1.0::DOUBLE END"
        out += [f"round(coalesce(sum({hit}), 0) / count(*), 6) AS recall_{k}", f"round(coalesce(sum({hit} / {k}), 0) / count(*), 6) AS precision_{k}", f"round(coalesce(sum({hit} * 2 / {k + 1}), 0) / count(*), 6) AS f1_{k}", f"round(coalesce(sum(CASE WHEN final_rank <= {k} THEN 1 / log2(final_rank + 1) END), 0) / count(*), 6) AS ndcg_{k}"]
    return ", ".join(out)


LARGE = f"round({D(0.15)}*wl + {D(0.15)}*jaccard + {D(0.3)}*collapse_match, 12)"
SMALL = f"round({D(0.15)}*wl + {D(0.4)}*teds + {D(0.15)}*jaccard + {D(0.3)}*collapse_match, 12)"
MANIFEST = """ev AS (SELECT user_id, event_type, event_id, CASE WHEN event_id % 7 > 0 THEN event_type END AS label, CASE WHEN value >= 5 THEN length(json_extract_string(props, '$.k'))::INT END AS nodes FROM events),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS o FROM ev WHERE event_id % 3 <> 0),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS o FROM ev WHERE event_id % 5 <> 0),
allrows AS (SELECT c.event_id AS source_id, c.label, c.nodes, l.event_id AS legacy_id, 'current' AS payload_source FROM c LEFT JOIN l USING (user_id, event_type, o)
  UNION ALL SELECT event_id, label, nodes, event_id, 'legacy' FROM l ANTI JOIN c USING (user_id, event_type, o)),
m AS (SELECT *, array_to_string([x for x in [CASE WHEN legacy_id IS NULL THEN 'no_legacy_row' END, CASE WHEN label IS NULL THEN 'no_label' END, CASE WHEN nodes IS NULL THEN 'no_expression' END] if x IS NOT NULL], '|') AS reasons FROM allrows)"""
ORACLE = {
    "manifest_rows": f"WITH {MANIFEST} SELECT 'test-b-' || legacy_id AS query_id, source_id, legacy_id, payload_source, label, nodes AS node_count, (label IN (SELECT event_type FROM events WHERE event_type <> 'purchase'))::INT AS in_a, (label IN (SELECT event_type FROM events WHERE event_type <> 'click'))::INT AS in_b, CASE WHEN label IN ('purchase', 'click') THEN 'target_not_in_corpus' END AS availability_reason FROM m WHERE reasons = ''",
    "manifest_exclusions": f"WITH {MANIFEST} SELECT source_id, label, reasons FROM m WHERE reasons <> ''",
    "wl_band_totals": f"WITH {WL}, b AS (SELECT tree_id AS query_id, greatest(0.0::DOUBLE, least(size::DOUBLE / r, size::DOUBLE - 2)) AS low, greatest(size::DOUBLE * r, size::DOUBLE + 2) AS high FROM (SELECT *, CASE WHEN size * 2 >= 25 THEN 1.8::DOUBLE ELSE 1.2::DOUBLE END AS r FROM stats) WHERE tree_id % 50 = 0), e AS (SELECT DISTINCT tree_id FROM enc) "
    "SELECT query_id, round(low, 6) AS low, round(high, 6) AS high, count(s.tree_id) AS in_band, count(e.tree_id) AS joined FROM b LEFT JOIN stats s ON s.size BETWEEN low AND high LEFT JOIN e ON e.tree_id = s.tree_id GROUP BY query_id, low, high",
    "probe_pool": f"WITH {RANKED} SELECT query_id, name FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, position) AS p FROM ranked) WHERE p <= 3 UNION SELECT o_orderkey, o_orderkey FROM orders WHERE o_orderkey % 50 = 0",
    "answered_queries": f"WITH {TOP} SELECT DISTINCT query_id FROM top WHERE (query_id * 7 + name) % 3 < 2",
    "target_ranks": f"WITH {RANKED} SELECT o_orderkey AS query_id, o_orderkey AS target, rank AS final_rank FROM orders LEFT JOIN ranked ON query_id = o_orderkey AND name = o_orderkey WHERE o_orderkey % 50 = 0",
    "case_slice": "SELECT p_partkey AS query_id, p_name FROM part WHERE p_partkey > 10 AND p_partkey <= 60 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')",
    "corpus_live_count": "SELECT count(*) AS live FROM documents WHERE text IS NOT NULL AND text <> 'null'",
    "node_band_counts": f"WITH {NODES}, {BANDS} SELECT b.query_id, b.size, round(low, 6) AS low, round(high, 6) AS high, count(s.tree_id) AS in_band FROM bands b LEFT JOIN stats s ON s.size BETWEEN round(low, 6) AND round(high, 6) GROUP BY ALL",
    "node_band_join_binned": "WITH q AS (SELECT p_partkey AS query_id, greatest(0.0::DOUBLE, least(p_size / 1.2::DOUBLE, p_size::DOUBLE - 5)) AS low, greatest(p_size * 1.2::DOUBLE, p_size::DOUBLE + 5) AS high FROM part WHERE p_partkey % 50 = 0) SELECT query_id, count(*) AS matches, min(p_partkey) AS first_key, max(p_partkey) AS last_key FROM q JOIN part ON p_size BETWEEN low AND high GROUP BY query_id",
    "coverage_flags": "SELECT c_custkey, (c_custkey IN (SELECT o_custkey FROM orders))::INT AS in_orders, (c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'))::INT AS in_urgent FROM customer",
    "name_lookup": "SELECT wanted, p_name, p_type FROM (SELECT p_partkey * 2 AS wanted FROM part WHERE p_partkey % 50 = 0) LEFT JOIN part ON p_partkey = wanted",
    "tree_size_depth": f"WITH {NODES} SELECT * FROM stats",
    "wl_initial_labels": f"WITH {WL} SELECT tree_id, node_id, wl AS wl_label FROM w0",
    "wl_round1_labels": f"WITH {WL} SELECT tree_id, node_id, wl AS wl_label FROM w1",
    "wl_encoding": f"WITH {WL} SELECT * FROM enc",
    "wl_hash_dictionary": f"WITH {WL} SELECT * FROM ids",
    "wl_vectors": f"WITH {WL} SELECT tree_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS wl_ids, string_agg(cnt::VARCHAR, ',' ORDER BY id) AS wl_counts, round(any_value(norm), 6) AS wl_norm FROM enc JOIN ids USING (key) JOIN norms USING (tree_id) GROUP BY tree_id",
    "wl_cosine_topk_join": f"WITH {TOP} SELECT * FROM top",
    "wl_cosine_topk_arrays": f"WITH {TOP} SELECT * FROM top WHERE score > 0",
    "wl_cosine_zero_fill": f"WITH {TOP} SELECT * FROM (SELECT b.query_id, s.tree_id AS name, coalesce(score, 0.0::DOUBLE) AS score, row_number() OVER (PARTITION BY b.query_id ORDER BY coalesce(score, 0) DESC, s.tree_id)::INT AS position FROM bands b JOIN stats s ON s.size BETWEEN b.low AND b.high LEFT JOIN scored x ON x.query_id = b.query_id AND x.name = s.tree_id) WHERE position <= 10",
    "wl_coarse_alpha": f"WITH {PAIRS} SELECT query_id, name, round(0.7::DOUBLE * score + (1 - 0.7::DOUBLE) * collapse_match, 6) AS coarse FROM top JOIN col USING (query_id, name)",
    "bm25_doc_stats": f"WITH {LEX} SELECT name, dl, count(token) AS terms, coalesce(max(tf), 0) AS max_tf FROM dl LEFT JOIN post USING (name) GROUP BY ALL",
    "bm25_index_report": f"WITH {LEX} SELECT count(*) AS documents, count(*) FILTER (WHERE dl = 0) AS empty_documents, sum(dl)::BIGINT AS total_tokens, round(avg(dl), 6) AS mean_length, (SELECT count(DISTINCT token) FROM post) AS vocabulary FROM dl",
    "bm25_idf": f"WITH {LEX} SELECT token, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": f"WITH {BM} SELECT query_id, name, round(score, 6) AS score, position FROM bmtop",
    "bm25_zero_fill": f"WITH {LEX}, one AS (SELECT query_id, arg_min(token, (-length(token), token)) AS token, 1 AS qf FROM q GROUP BY query_id), {_bm25_sql('one', 'hits')}, "
    "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS p FROM hits) WHERE p <= 10), n AS (SELECT query_id, count(*) AS k FROM best GROUP BY query_id), "
    "fill AS (SELECT n.query_id, dl.name, 0.0::DOUBLE AS score, k + row_number() OVER (PARTITION BY n.query_id ORDER BY dl.name) AS p FROM n, dl WHERE k < 10 AND NOT EXISTS (SELECT 1 FROM best b WHERE b.query_id = n.query_id AND b.name = dl.name)) "
    "SELECT query_id, name, round(score, 6) AS score, p::INT AS position FROM (SELECT * FROM best UNION ALL SELECT * FROM fill WHERE p <= 10)",
    "name_tokens": "WITH s AS (SELECT p_partkey, replace(p_name, ' ', '.') AS n FROM part), t AS (SELECT p_partkey, n, x, min(i) AS i FROM (SELECT p_partkey, n, unnest(string_split(n, '.')) AS x, generate_subscripts(string_split(n, '.'), 1) AS i FROM s) WHERE x <> '' GROUP BY ALL) SELECT p_partkey, n || '|' || string_agg(x, '|' ORDER BY i) AS tokens FROM t GROUP BY p_partkey, n",
    "dense_topk": f"WITH {DENSE} SELECT query_id, name, round(score, 6) AS score, position FROM dtop",
    "rrf_two_lists": f"WITH {BM}, {DENSE}, {_rrf(('bmtop', 0.6), ('dtop', 0.4))} SELECT * FROM rrf",
    "rrf_three_lists": f"WITH {TOP}, {BM}, {DENSE}, {_rrf(('top', 0.5), ('bmtop', 0.15), ('dtop', 0.35))} SELECT * FROM rrf",
    "hybrid_scores": f"WITH {TOP}, {BM}, {DENSE}, {_rrf(('top', 0.5), ('bmtop', 0.15), ('dtop', 0.35))} SELECT r.query_id, r.name, r.score AS fused, r.position, round(coalesce(t.score, 0), 6) AS wl_score, round(coalesce(b.score / m.best, 0), 6) AS bm25_score, round(coalesce(d.score, 0), 6) AS dense_score FROM rrf r LEFT JOIN top t ON t.query_id = r.query_id AND t.name = r.name LEFT JOIN bmtop b ON b.query_id = r.query_id AND b.name = r.name LEFT JOIN (SELECT query_id, max(score) AS best FROM bmtop GROUP BY query_id) m ON m.query_id = r.query_id LEFT JOIN dtop d ON d.query_id = r.query_id AND d.name = r.name",
    "constant_jaccard": f"WITH {PAIRS} SELECT query_id, name, round(jaccard, 6) AS jaccard FROM jac",
    "collapse_match": f"WITH {PAIRS} SELECT query_id, name, round(collapse_match, 6) AS collapse_match FROM col",
    "fused_scores": f"WITH {PAIRS} SELECT query_id, name, {STRUCT} AS final FROM comp",
    "large_tree_fallback": f"WITH {PAIRS} SELECT query_id, name, CASE WHEN raw_size <= 9 THEN teds END AS teds, CASE WHEN raw_size > 9 THEN {LARGE} ELSE {SMALL} END AS final FROM comp",
    "margin_gate": f"WITH {PAIRS}, s AS (SELECT *, {STRUCT} AS st FROM comp), o AS (SELECT query_id, st, row_number() OVER (PARTITION BY query_id ORDER BY st DESC, name) AS r FROM s), g AS (SELECT query_id, max(CASE WHEN r = 1 THEN st END) - coalesce(max(CASE WHEN r = 2 THEN st END), 0) AS margin FROM o WHERE r <= 2 GROUP BY query_id), "
    "e AS (SELECT query_id, round(0.6::DOUBLE * greatest(0.2::DOUBLE, 1 - margin / 0.05::DOUBLE), 6) AS dw FROM g) SELECT query_id, name, dw AS dense_weight, round(0.1::DOUBLE*wl + 0.3::DOUBLE*teds + 0.1::DOUBLE*jaccard + 0.5::DOUBLE*collapse_match + dw*jaccard, 12) AS final FROM s JOIN e USING (query_id)",
    "competition_rank": f"WITH {RANKED} SELECT * FROM ranked",
    "adaptive_budget": f"WITH {TOP}, k AS (SELECT query_id, size, least(5, trunc(0.4::DOUBLE * size)::INT) AS k FROM bands) SELECT k.query_id, k.size, k.k, count(t.name) AS kept FROM k LEFT JOIN top t ON t.query_id = k.query_id AND t.position <= k.k GROUP BY ALL",
    "cascade_k": f"WITH {NODES} SELECT tree_id, CASE WHEN size < 5 THEN 100 WHEN size < 11 THEN 300 WHEN size < 21 THEN 750 ELSE 1500 END AS k FROM stats",
    "output_topk_slice": f"WITH {RANKED} SELECT * FROM ranked WHERE position <= 3",
    "retrieval_metrics": f"WITH {DENSE}, hit AS (SELECT query_id, min(position) - 1 AS final_rank FROM dtop JOIN embeddings q ON q.vec_id = query_id JOIN embeddings c ON c.vec_id = name WHERE q.label = c.label AND query_id <> name GROUP BY query_id) SELECT {_metric_sql()} FROM (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 50 = 0) LEFT JOIN hit USING (query_id)",
    "verdict_rerank": f"WITH {PAIRS}, base AS (SELECT query_id, name, {STRUCT} AS structural FROM comp), {PINNED} SELECT query_id, name, key, rank, position, verdict FROM pinned",
    "verdict_rerank_tie": f"WITH {PAIRS}, base AS (SELECT query_id, name, floor(collapse_match * 2)::DOUBLE / 2 AS structural FROM comp), {PINNED} SELECT query_id, name, key, rank, position FROM pinned",
    "verdict_counts": f"WITH {TOP}, v AS (SELECT (query_id * 7 + name) % 3 AS m FROM top) SELECT count(*) AS probes, count(*) FILTER (WHERE m = 0) AS applicable, count(*) FILTER (WHERE m = 1) AS rejected, count(*) FILTER (WHERE m = 2) AS unknown FROM v",
    "occurrence_match": f"WITH {EVENTS} SELECT cur.event_id, occurrence::INT AS occurrence, leg.event_id AS legacy_id FROM cur LEFT JOIN leg USING (user_id, event_type, occurrence)",
    "legacy_backfill_anti": f"WITH {EVENTS} SELECT event_id, occurrence::INT AS occurrence FROM leg ANTI JOIN cur USING (user_id, event_type, occurrence)",
    "exclusion_reasons": f"WITH {REASONS} SELECT event_id, array_to_string(reasons, '|') AS reasons FROM r WHERE len(reasons) > 0",
    "exclusion_reason_counts": f"WITH {REASONS} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY reason",
    "duplicate_pairs": "SELECT count(*) AS total, count(DISTINCT (user_id, event_type)) AS distinct_pairs, count(*) - count(DISTINCT (user_id, event_type)) AS repeated FROM events",
    "resume_antijoin": "SELECT o_orderkey AS query_id, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "text_fallback": "SELECT doc_id, sha256(coalesce(CASE WHEN trim(b.text) <> '' THEN b.text END, d.text)) AS digest FROM documents d LEFT JOIN benchmark b ON item_id = doc_id",
    "request_lines": f"WITH {BM} SELECT query_id, query_id || chr(9) || translate(any_value(text), chr(9) || chr(10) || chr(13), '   ') || chr(9) || string_agg(name::VARCHAR, ',' ORDER BY position) AS line FROM bmtop JOIN benchmark ON item_id = query_id GROUP BY query_id",
    "cse_keys": f"WITH {NODES}, k2 AS (SELECT tree_id, node_id, parent_id, ord, label AS key FROM nodes WHERE depth = 2), k1 AS (SELECT n.tree_id, n.node_id, n.parent_id, n.ord, concat_ws('-', n.label, string_agg(c.key, '-' ORDER BY c.ord)) AS key FROM nodes n LEFT JOIN k2 c ON c.tree_id = n.tree_id AND c.parent_id = n.node_id WHERE n.depth = 1 GROUP BY n.tree_id, n.node_id, n.parent_id, n.ord, n.label), k0 AS (SELECT n.tree_id, n.node_id, n.parent_id, n.ord, concat_ws('-', n.label, string_agg(c.key, '-' ORDER BY c.ord)) AS key FROM nodes n LEFT JOIN k1 c ON c.tree_id = n.tree_id AND c.parent_id = n.node_id WHERE n.depth = 0 GROUP BY n.tree_id, n.node_id, n.parent_id, n.ord, n.label) SELECT tree_id, md5(key) AS key_md5, count(*) AS n FROM (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2) GROUP BY tree_id, key HAVING count(*) > 1",
    "canonical_hash": "SELECT event_id, sha256('{\"k\":' || json_extract_string(props, '$.k') || '}') AS digest FROM events",
}
