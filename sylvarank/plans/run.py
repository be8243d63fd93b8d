"""The batch pipeline: retrieval, fusion, scoring, ranks and run records; reranking and summaries of saved runs."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, load_config
from ..operators import bands, dense, expr, fusion, lexical, structure, ted, wl
from ..sources.sinks import append_records, pending, request_lines, write_atomically
from ..sources.staging import stage
from ..sources.tables import read_aligned_cases, read_extraction_cache, read_json_cases, read_runs, read_verdicts, table  # noqa: F401

SCORE = ("name", "wl", "teds", "jaccard", "collapse_match", "final", "rank", "dense", "bm25")


def corpus_tables(expressions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node rows of the corpus expressions (``name, expression_json``) that parse, and the rejected ones."""
    live = expressions.where("expression_json is not null and expression_json <> 'null'")
    nodes = stage(expr.flatten(live, "name", "expression_json", share=False), "corpus-nodes")
    return nodes.where("error is null").drop("error"), nodes.where("error is not null").select(F.col("tree_id").alias("name"), F.col("error").alias("exception"))


def constant_tokens(expressions: DataFrame, id_col: str) -> DataFrame:
    """``tree_id, token``: names of constants in the expressions as they stand, each with its segments."""
    names = expr.constant_tokens(expressions, id_col)
    return names.select("tree_id", F.explode(lexical.name_tokens(F.col("name"))).alias("token"))


def retrieve(cases: DataFrame, case_nodes: DataFrame, raw: DataFrame, corpus: DataFrame, corpus_expressions: DataFrame, config: Config, query_vectors: DataFrame | None = None, vectors: DataFrame | None = None, encoding: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``query_id, name, wl, dense, bm25, limit``, the candidates of each query; and the counts of its band.

    The structural list is cut to each query's budget.  Where ``coarse_alpha``
    is below 1 it is ordered by the mix of kernel and lock-step match instead,
    over all of the band and without a limit.  With the hybrid switched on,
    lists are fused by reciprocal ranks at the plain candidate limit.
    ``encoding`` is a stored encoding of the corpus; without one it is computed.
    """
    r = config.retrieval
    nodes = case_nodes.unionByName(corpus)
    stats = wl.tree_stats(nodes)
    made = wl.encode(nodes if encoding is None else case_nodes, r.iterations)
    encoding = stage(made if encoding is None else made.unionByName(encoding.select(F.col("tree_id").cast("string").alias("tree_id"), "key", "cnt")), "encoding")
    queries = cases.select("query_id")
    limit = F.lit(r.candidate_limit)
    if config.cascade.enabled:
        limit = bands.cascade_k(F.col("raw_size"), config.cascade.k_bins, config.cascade.size_thresholds)
    elif r.adaptive:
        limit = bands.adaptive_budget(F.col("size"), r.beta, r.k_max)
    sizes = stats.select(F.col("tree_id").alias("query_id"), "size")
    limits = queries.join(sizes, "query_id").join(raw, "query_id", "left").select("query_id", limit.alias("limit"))
    most = max(r.candidate_limit, r.k_max, *config.cascade.k_bins) if config.cascade.enabled or r.adaptive else r.candidate_limit
    among = corpus.select("tree_id").distinct()
    limits_of = {"ratio": r.node_ratio, "large_ratio": r.large_node_ratio, "large_from": r.large_tree_nodes, "diff": r.absolute_diff}
    totals = stage(wl.band_totals(stats, queries, encoding, raw, among, **limits_of), "totals")
    coarse = r.coarse_alpha < 1
    if coarse:
        most = totals.agg(F.max("in_band")).first()[0] or 0  # the whole band is ordered
    top = wl.cosine_top_k(encoding, stats, queries, most, zero_fill=True, among=among, raw=raw, **limits_of)
    if coarse:
        both = top.drop("position").join(structure.collapse_match(top, nodes), ["query_id", "name"])
        mixed = both.withColumn("coarse", F.round(F.lit(r.coarse_alpha) * F.col("score") + (1 - F.lit(r.coarse_alpha)) * F.col("collapse_match"), 9))
        top = fusion.competition_rank(mixed, "coarse").select("query_id", "name", "score", "position")
        top = stage(top.join(limits, "query_id"), "structural")
    else:
        top = stage(top.join(limits, "query_id").where("position <= limit"), "structural")
    if not config.hybrid.enabled:
        return top.select("query_id", "name", F.round("score", 6).alias("wl"), F.lit(0.0).alias("dense"), F.lit(0.0).alias("bm25"), "limit"), totals
    post = stage(constant_tokens(corpus_expressions, "name").groupBy(F.col("tree_id").alias("name"), "token").agg(F.count("*").alias("tf")), "postings")
    dl = among.select(F.col("tree_id").alias("name")).join(post.groupBy("name").agg(F.sum("tf").alias("dl")), "name", "left").select("name", F.coalesce("dl", F.lit(0)).alias("dl"))
    asked = constant_tokens(cases, "query_id").groupBy(F.col("tree_id").alias("query_id"), "token").agg(F.count("*").alias("qf"))
    bm25 = lexical.top_documents(lexical.scores(asked, post, dl), dl, r.candidate_limit)
    near = dense.nearest(query_vectors, vectors, r.candidate_limit) if vectors is not None and query_vectors is not None else None
    fused = fusion.hybrid(top.select("query_id", "name", "score", "position"), bm25, near, config.hybrid, r.candidate_limit)
    return fused.join(limits, "query_id").select("query_id", "name", F.col("wl_score").alias("wl"), F.col("dense_score").alias("dense"), F.col("bm25_score").alias("bm25"), "limit"), totals


def run_batch(cases: DataFrame, corpus_expressions: DataFrame, config: Config, query_vectors: DataFrame | None = None, vectors: DataFrame | None = None, encoding: DataFrame | None = None) -> DataFrame:
    """One record per case: counts, the band, candidates' scores and ranks, the target's rank and scores, and errors.

    A case whose expression fails keeps its record with ``exception`` and no
    rank.  Candidates that do not parse are left out; a record lists under
    ``candidate_exceptions`` those that lie in no band because they have no
    tree, when they are its target.
    """
    more = [c for c in ("benchmark", "source_metadata") if c in cases.columns]
    cases = stage(cases.select("query_id", "target", "expression_json", *more), "cases")
    corpus, bad = corpus_tables(corpus_expressions)
    flat = stage(expr.flatten(cases, "query_id", "expression_json"), "case-nodes")
    case_nodes = flat.where("error is null").drop("error")
    errors = flat.where("error is not null").select(F.col("tree_id").alias("query_id"), F.col("error").alias("exception"))
    raw = stage(expr.flatten(cases, "query_id", "expression_json", share=False, simplify=False).where("error is null").groupBy(F.col("tree_id").alias("query_id")).agg(F.count("*").alias("raw_size")), "raw-sizes")
    found, totals = retrieve(cases, case_nodes, raw, corpus, corpus_expressions, config, query_vectors, vectors, encoding)
    found = stage(found, "candidates")
    nodes = case_nodes.unionByName(corpus)
    s = config.scoring
    keyed = found.join(raw, "query_id")
    teds = ted.ted_scores(keyed.where(F.col("raw_size") <= s.ted_cutoff), nodes, None, s.insert_cost, s.delete_cost, s.replace_cost, s.simple_scale, raw)
    six = lambda df, c: df.withColumn(c, F.round(c, 6))
    rows = keyed.join(six(teds, "teds"), ["query_id", "name"], "left").join(six(structure.constant_jaccard(found, structure.constant_sets(nodes)), "jaccard"), ["query_id", "name"]).join(six(structure.collapse_match(found, nodes), "collapse_match"), ["query_id", "name"])
    scored = fusion.score_candidates(stage(rows, "components"), s.weights, s.large_tree_weights, s.ted_cutoff)
    if config.gate.enabled:
        scored = fusion.margin_gate(scored, s.weights, config.gate, s.large_tree_weights, s.ted_cutoff)
    ranked = stage(fusion.competition_rank(scored), "ranked")
    top = ranked.where(F.col("position") <= config.retrieval.output_top_k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", *SCORE))).alias("t"))
    top = top.select("query_id", F.transform("t", lambda x: F.struct(*(x[c].alias(c) for c in SCORE))).alias("top_k"))
    counts = ranked.groupBy("query_id").agg(F.count("*").alias("candidates"), F.first("limit").alias("limit"))
    of_target = cases.select("query_id", F.col("target").alias("name")).join(ranked, ["query_id", "name"]).select("query_id", F.struct(*SCORE).alias("target_scores"))
    known = corpus.select(F.col("tree_id").alias("target")).distinct().withColumn("target_in_corpus", F.lit(True))
    failed = bad.groupBy(F.col("name").alias("target")).agg(F.collect_list(F.struct("name", "exception")).alias("candidate_exceptions"))
    shown = wl.tree_stats(case_nodes).select(F.col("tree_id").alias("query_id"), F.col("size").alias("query_nodes"))
    out = cases.select("query_id", "target", *more)
    for part in (fusion.target_rank(cases, ranked).drop("target"), top, counts, errors, totals, raw, shown, of_target):
        out = out.join(part, "query_id", "left")
    out = out.join(known, "target", "left").join(failed, "target", "left").crossJoin(F.broadcast(wl.tree_stats(corpus).agg(F.count("*").alias("corpus_trees"))))
    return out.select(
        "query_id", *more, "target", "final_rank", "top_k", F.coalesce("candidates", F.lit(0)).alias("candidates"), "limit", F.coalesce("target_in_corpus", F.lit(False)).alias("target_in_corpus"),
        F.col("target_scores").isNotNull().alias("target_in_candidates"), "target_scores", F.col("corpus_trees").alias("before_filter"), F.coalesce("in_band", F.lit(0)).alias("after_filter"), F.coalesce("joined", F.lit(0)).alias("with_encoding"),
        F.struct(F.col("raw_size").alias("raw"), F.col("query_nodes").alias("simplified"), F.col("low").alias("least"), F.col("high").alias("most")).alias("node_filter"),
        F.struct(F.lit(config.cascade.enabled).alias("enabled"), F.lit(config.cascade.policy).alias("policy"), F.when(F.lit(config.cascade.enabled), F.col("limit")).alias("limit")).alias("cascade"),
        F.coalesce("candidate_exceptions", F.array().cast("array<struct<name:string,exception:string>>")).alias("candidate_exceptions"), "exception",
    )


def rerank(records: DataFrame, verdicts: DataFrame, config: Config) -> DataFrame:
    """Saved records reranked by verdicts with the base weights; records without candidates pass unchanged.

    A target that lies below the saved list is recovered from its own scores
    (``target_scores``, where records have them), so that it keeps a rank.
    Raises when no saved list reaches the number of candidates to ask for.
    """
    deepest = records.agg(F.max(F.size("top_k"))).first()[0]
    if deepest is not None and deepest < config.verdicts.top_n:
        raise ValueError(f"records hold at most {deepest} candidates, {config.verdicts.top_n} are needed")
    pool = F.col("top_k")
    if "target_scores" in records.columns:
        listed = F.transform("top_k", lambda x: x["name"])
        below = F.col("target_scores").isNotNull() & ~F.array_contains(listed, F.col("target_scores.name"))
        pool = F.when(below, F.concat("top_k", F.array("target_scores"))).otherwise(pool)
    rows = records.where("size(top_k) > 0").select("query_id", "target", F.explode(pool).alias("c")).select("query_id", "target", "c.*").drop("rank")
    again = stage(fusion.pinned_rank(rows, verdicts, config.scoring.weights, config.verdicts.bonus), "reranked")
    shown = [c for c in SCORE if c != "final"]
    lists = again.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", *shown, F.col("key").alias("final"), "verdict"))).alias("t"), F.max(F.when(F.col("name") == F.col("target"), F.col("rank"))).alias("new_rank"))
    lists = lists.select("query_id", "new_rank", F.transform("t", lambda x: F.struct(*(x[c].alias(c) for c in (*SCORE, "verdict")))).alias("reranked"))
    out = records.join(lists, "query_id", "left")
    return out.select("query_id", "target", F.when(F.col("reranked").isNotNull(), F.col("new_rank")).otherwise(F.col("final_rank")).alias("final_rank"), "reranked", F.col("reranked").isNotNull().alias("applied"))


def probe_requests(records: DataFrame, cases: DataFrame, config: Config, done: DataFrame | None = None, include_target: bool = True) -> DataFrame:
    """``query_id, line``: what a prover is to be asked about saved records, but for queries in ``done`` that have verdicts.

    ``cases`` has ``query_id`` and the ``text`` of each query.
    """
    saved = records.where("size(top_k) > 0")
    if done is not None:
        saved = saved.join(done.select("query_id").distinct(), "query_id", "left_anti")
    ranked = saved.select("query_id", F.posexplode("top_k").alias("position", "c")).select("query_id", "position", F.col("c.name").alias("name"), F.col("c.rank").alias("rank"))
    pool = fusion.probe_pool(ranked, saved.select("query_id", "target"), config.verdicts.top_n, include_target)
    order = ranked.select("query_id", "name", "position")
    asked = pool.join(order, ["query_id", "name"], "left").select("query_id", "name", F.coalesce("position", F.lit(9999)).alias("rank"))
    return request_lines(asked.join(cases.select("query_id", "text"), "query_id"))


def summarize(records: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    return fusion.metrics(records, ks)


def main(argv: list[str] | None = None) -> None:
    """``run``, ``rerank`` and ``summarize`` from the command line."""
    p = argparse.ArgumentParser(prog="sylvarank")
    p.add_argument("command", choices=("run", "rerank", "summarize"))
    p.add_argument("--config")
    p.add_argument("--profile")
    p.add_argument("--cases")
    p.add_argument("--corpus", help="Parquet with name and expression_json")
    p.add_argument("--records")
    p.add_argument("--verdicts")
    p.add_argument("--output")
    p.add_argument("--aligned", nargs=2, metavar=("EXPRESSIONS", "NAMES"), help="cases as two files, line by line; needs --cache")
    p.add_argument("--cache", help="extracted expressions of the aligned cases")
    p.add_argument("--query-vectors", help="Parquet with query_id and vector")
    p.add_argument("--vectors", help="Parquet with name and vector")
    p.add_argument("--encoding", help="Parquet with the corpus's stored encoding: tree_id, key, cnt")
    p.add_argument("--reranked", help="where records reranked by --verdicts go, when the configuration has verdicts enabled")
    p.add_argument("--start", type=int, default=0)
    p.add_argument("--limit", type=int)
    p.add_argument("--resume", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("sylvarank").getOrCreate()
    config = load_config(a.config, a.profile) if a.config else Config()
    read = lambda path: spark.read.parquet(path) if path else None
    if a.command == "run":
        cases = read_extraction_cache(spark, a.cache, read_aligned_cases(spark, *a.aligned)) if a.aligned else read_json_cases(spark, a.cases)
        cases = cases if "line_number" in cases.columns else cases.withColumn("line_number", F.regexp_extract("query_id", r"(\d+)$", 1).cast("long"))
        cases = pending(cases, spark.createDataFrame([], "query_id string"), start=a.start, limit=a.limit, order_col="line_number")
        records = run_batch(cases, spark.read.parquet(a.corpus), config, read(a.query_vectors), read(a.vectors), read(a.encoding))
        append_records(records, a.output, a.resume)
        if config.verdicts.enabled and a.verdicts:
            append_records(rerank(read_runs(spark, a.output), read_verdicts(spark, a.verdicts), config), a.reranked or f"{a.output}-reranked", a.resume)
    elif a.command == "rerank":
        append_records(rerank(read_runs(spark, a.records), read_verdicts(spark, a.verdicts), config), a.output, a.resume)
    else:
        row = summarize(read_runs(spark, a.records)).first().asDict()
        if a.output:
            if os.path.exists(a.output):
                raise FileExistsError(a.output)
            write_atomically(a.output, row)
        print(json.dumps(row, sort_keys=True))


if __name__ == "__main__":
    main()
