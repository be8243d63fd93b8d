"""The batch pipeline from expressions to records, reranking, resuming and streams."""

import json

import pytest

from sylvarank.config import config_from
from sylvarank.plans import run
from sylvarank.sources import sinks
from sylvarank.streaming import run_stream

CONST = lambda n: {"const": {"declName": n, "us": []}}
APP = lambda f, a: {"app": {"fn": f, "arg": a}}


@pytest.fixture(scope="module")
def inputs(spark):
    corpus = [("T.a", APP(APP(CONST("Eq"), CONST("x")), CONST("y"))), ("T.b", APP(CONST("Eq"), CONST("z"))), ("T.c", APP(APP(CONST("And"), CONST("p")), CONST("q"))), ("T.bad", {"nope": {}})]
    cases = [("q1", "T.a", APP(APP(CONST("Eq"), CONST("x")), CONST("y"))), ("q2", "T.none", APP(CONST("And"), CONST("p"))), ("q3", "T.b", {"bvar": {"deBruijnIndex": 3}})]
    return (
        spark.createDataFrame([(q, t, json.dumps(e)) for q, t, e in cases], "query_id string, target string, expression_json string"),
        spark.createDataFrame([(n, json.dumps(e)) for n, e in corpus], "name string, expression_json string"),
    )


@pytest.mark.parametrize("hybrid", [False, True])
def test_records(spark, inputs, hybrid):
    config = config_from({"hybrid": {"enabled": hybrid}, "gate": {"enabled": hybrid}})
    got = {r["query_id"]: r for r in run.run_batch(*inputs, config).collect()}
    assert set(got) == {"q1", "q2", "q3"}
    first = got["q1"]["top_k"][0]
    assert got["q1"]["final_rank"] == 1 and first["name"] == "T.a" and first["teds"] == first["jaccard"] == first["collapse_match"] == 1
    assert got["q2"]["final_rank"] is None and not got["q2"]["target_in_corpus"] and len(got["q2"]["top_k"]) == 3
    assert got["q3"]["exception"].startswith("ValueError") and got["q3"]["top_k"] is None


def test_rerank_and_summary(spark, inputs):
    config = config_from({"verdicts": {"top_n": 2}})
    records = run.run_batch(*inputs, config)
    verdicts = spark.createDataFrame([("q1", "T.c", True), ("q1", "T.b", False), ("q1", "T.a", None)], "query_id string, name string, applicable boolean")
    got = {r["query_id"]: r for r in run.rerank(records, verdicts, config).collect()}
    assert [c["name"] for c in got["q1"]["reranked"]] == ["T.a", "T.c", "T.b"] and got["q1"]["final_rank"] == 1
    assert not got["q3"]["applied"]
    assert run.summarize(records).first()["recall_1"] == round(1 / 3, 6)
    with pytest.raises(ValueError, match="are needed"):
        run.rerank(records, verdicts, config_from({}))


def test_record_fields(spark, inputs):
    got = {r["query_id"]: r for r in run.run_batch(*inputs, config_from({"cascade": {"enabled": True}})).collect()}
    r = got["q1"]
    assert (r["before_filter"], r["after_filter"], r["with_encoding"], r["target_in_candidates"], r["target_scores"]["name"]) == (3, 3, 3, True, "T.a")
    assert r["node_filter"]["raw"] == r["node_filter"]["simplified"] == 5 and r["node_filter"]["least"] == 0 and r["node_filter"]["most"] == 30
    assert r["cascade"]["limit"] == 100 and got["q2"]["target_scores"] is None
    lost = inputs[0].where("query_id = 'q2'").replace("T.none", "T.bad", "target")
    assert [e["name"] for e in run.run_batch(lost, inputs[1], config_from({})).first()["candidate_exceptions"]] == ["T.bad"]


def test_tokens_are_of_the_whole_expression(spark):
    twice = APP(CONST("Rare.name"), {"sort": "u"})
    e = {"forallE": {"binderName": "h", "binderInfo": "d", "binderType": CONST("Nat"), "body": APP(APP(CONST("Eq"), twice), {"proj": {"typeName": "Prod", "idx": 0, "struct": twice}})}}
    df = spark.createDataFrame([("q", json.dumps(e)), ("bad", "{"), ("none", None)], "query_id string, expression_json string")
    got = sorted(r["token"] for r in run.constant_tokens(df, "query_id").collect())
    assert got == sorted(["Nat", "Nat", "Eq", "Eq", *["Rare.name", "Rare", "name"] * 2, "Prod", "Prod"])


def test_a_target_below_the_saved_list_is_recovered(spark, inputs):
    config = config_from({"retrieval": {"output_top_k": 1}, "verdicts": {"top_n": 1}})
    cases = inputs[0].where("query_id = 'q1'").replace("T.a", "T.c", "target")
    records = run.run_batch(cases, inputs[1], config)
    none = spark.createDataFrame([], "query_id string, name string, applicable boolean")
    got = run.rerank(records, none, config).first()
    assert [c["name"] for c in got["reranked"]] == ["T.a", "T.c"] and got["final_rank"] == 2
    texts = spark.createDataFrame([("q1", "a text")], "query_id string, text string")
    assert run.probe_requests(records, texts, config).first()["line"] == "q1\ta text\tT.a,T.c"
    assert run.probe_requests(records, texts, config, texts).count() == 0


def test_coarse_order(spark, inputs):
    got = {r["query_id"]: r for r in run.run_batch(*inputs, config_from({"retrieval": {"coarse_alpha": 0.5, "candidate_limit": 1}})).collect()}
    assert got["q1"]["candidates"] == 3 and got["q1"]["final_rank"] == 1  # the coarse path has no limit


def test_stored_encoding(spark, inputs):
    from sylvarank.operators import wl

    corpus, _ = run.corpus_tables(inputs[1])
    stored = wl.encode(corpus)
    plain, again = (sorted(map(str, run.run_batch(*inputs, config_from({}), encoding=e).select("query_id", "final_rank", "top_k").collect())) for e in (None, stored))
    assert plain == again


def test_deep_expressions(spark):
    from sylvarank.operators import expr

    deep = '{"app":{"fn":' * 1500 + '{"sort":"u"}' + ',"arg":{"sort":"v"}}}' * 1500
    got = expr.flatten(spark.createDataFrame([("d", deep)], "tree_id string, expression_json string"))
    assert got.where("error is not null").count() == 0 and got.count() > 1000


def test_stream_resumes(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in (["a", "b"], ["b", "c"]):
        spark.createDataFrame([(i,) for i in batch], "query_id string").write.mode("append").json(source)
        run_stream(spark.readStream.schema("query_id string").json(source), lambda df: df.distinct(), out, str(tmp_path / "ck")).awaitTermination()
    assert sorted(r[0] for r in spark.read.json(out).collect()) == ["a", "b", "c"]


def test_pending(spark):
    cases = spark.createDataFrame([(f"q{i}", i) for i in range(1, 7)], "query_id string, line_number long")
    done = spark.createDataFrame([("q3",)], "query_id string")
    assert sorted(r[0] for r in sinks.pending(cases, done, start=1, limit=3, order_col="line_number").collect()) == ["q2", "q4"]
