"""Hand-sized cases with known values."""

import functools
import io
import json
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from sylvarank.config import Weights, config_from
from sylvarank.operators import bands, dense, expr, fusion, lexical, manifest, structure, ted, wl
from sylvarank.sources import archive, sinks, tables

CONST = lambda n: {"const": {"declName": n, "us": []}}
APP = lambda f, a: {"app": {"fn": f, "arg": a}}
FORALL = lambda n, t, b: {"forallE": {"binderName": n, "binderType": t, "body": b, "binderInfo": "default"}}


def nodes_of(spark, **trees):
    rows = [(name, *r) for name, e in trees.items() for r in expr.preorder(expr.parse(e) if isinstance(e, dict) else e)]
    return spark.createDataFrame(rows, "tree_id string, node_id int, parent_id int, ord int, depth int, ctor string, label string, n_children int")


def lit(x):
    return {"lit": {"literal": x}}


BV = {"bvar": {"deBruijnIndex": 0}}


def distance(a, b):
    ids = {}
    side = lambda e: ted.Postorder(*(tuple(x) for x in zip(*((r[3], r[5]) for r in expr.preorder(expr.parse(e))))), ids)
    left, right = side(a), side(b)
    d = ted.edit_distance(left, right)
    return round(d, 9), round(ted.similarity(d, len(left.labels), len(right.labels)), 6)


def test_edit_distances():
    assert distance(lit("a"), lit("b")) == (0.4, 0.6)
    assert distance(BV, lit("b")) == (0, 1)
    assert distance(APP(lit("a"), lit("b")), APP(lit("a"), lit("c"))) == (0.8, 0.733333)
    assert distance(APP(lit("a"), BV), lit("a")) == (1.2, 0.6)


def random_tree(r, n):
    if n == 1:
        return lit(r.choice("ab")) if r.random() < 0.6 else CONST(r.choice("xy"))
    if n == 2:
        return {"mdata": {"data": "m", "expr": random_tree(r, 1)}}
    k = r.randint(1, n - 2)
    return APP(random_tree(r, k), random_tree(r, n - 1 - k))


def test_edit_distance_against_forests():
    simple = lambda t: t[0].startswith(("BVar(", "Const("))
    cost = lambda t: 0.2 if simple(t) else 1.0

    def tree(node):
        return expr.label(node), tuple(map(tree, node[2]))

    @functools.cache
    def forest(a, b):
        if not a and not b:
            return 0.0
        out = []
        if a:
            out.append(forest(a[:-1] + a[-1][1], b) + cost(a[-1]))
        if b:
            out.append(forest(a, b[:-1] + b[-1][1]) + cost(b[-1]))
        if a and b:
            x, y = a[-1], b[-1]
            free = x == y or simple(x) or simple(y)
            out.append(forest(a[:-1], b[:-1]) + forest(x[1], y[1]) + (0 if free else 0.4))
        return min(out)

    r = random.Random(5)
    for _ in range(150):
        a, b = random_tree(r, r.randint(1, 8)), random_tree(r, r.randint(1, 8))
        assert distance(a, b)[0] == pytest.approx(forest((tree(expr.parse(a)),), (tree(expr.parse(b)),)))
        assert distance(a, a)[0] == 0


def test_structural_kernel(spark):
    nodes = nodes_of(spark, a=APP(CONST("A"), BV), b=APP(CONST("B"), CONST("C")), c=CONST("A"))
    enc = wl.encode(nodes, 1)
    assert {r["key"] for r in enc.where("tree_id = 'a'").collect()} == {"0_0b896e713881864e5b8aeebb5ab969d0", "0_64d8b5fa8adfaecce15cd4e059240530", "0_d86bc933600f98862870044c526ef930"}
    assert enc.where("tree_id = 'c'").count() == 0
    top = wl.cosine_top_k(enc, wl.tree_stats(nodes), spark.createDataFrame([("a",)], "query_id string"), 5, zero_fill=True)
    assert [(r["name"], round(r["score"], 6)) for r in top.orderBy("position").collect()] == [("a", 1.0), ("b", 0.516398), ("c", 0.0)]


def test_collapse_and_constants(spark):
    big = APP(CONST("A"), APP(lit("x"), lit("y")))
    nodes = nodes_of(spark, t=big, c=APP(CONST("A"), CONST("B")), d=APP(APP(CONST("C"), CONST("D")), CONST("E")), i=CONST("instAddNat"), n=lit("z"))
    pairs = spark.createDataFrame([("t", "c"), ("c", "d"), ("i", "n")], "query_id string, name string")
    got = {(r[0], r[1]): round(r[2], 6) for r in structure.collapse_match(pairs, nodes).collect()}
    assert got["t", "c"] == 1.0 and got["c", "d"] == 0.4
    jac = {(r[0], r[1]): r[2] for r in structure.constant_jaccard(pairs, structure.constant_sets(nodes)).collect()}
    assert jac["i", "n"] == 1.0 and jac["t", "c"] == 0.5


def test_regex_takes_subscripts(spark):
    df = spark.createDataFrame([("t", "Const(Foo₁.bar, [])")], "tree_id string, label string")
    assert structure.constant_sets(df).first()["names"] == ["Foo₁"]


def test_bands(spark):
    df = spark.createDataFrame([(10,), (40,), (300,)], "s int")
    low, high = bands.band(F.col("s"))
    assert [tuple(r) for r in df.select(low, high).collect()] == [(0, 35), (15, 65), (250, 360)]
    assert df.select(bands.cascade_k(F.lit(20))).first()[0] == 300
    assert [df.select(bands.cascade_k(F.lit(s))).first()[0] for s in (5, 20, 75, 1000)] == [100, 300, 750, 1500]
    assert df.select(bands.adaptive_budget(F.lit(41), 2.5, 1500), bands.adaptive_budget(F.lit(41), 0, 1500)).first()[:] == (102, 0)


def test_names_and_bm25(spark):
    df = spark.createDataFrame([("Set.PairwiseDisjoint",), ("Nat",), ("Foo.Foo",), ("a'.b",)], "n string")
    assert [r[0] for r in df.select(lexical.name_tokens(F.col("n"))).collect()] == [["Set.PairwiseDisjoint", "Set", "PairwiseDisjoint"], ["Nat", "Nat"], ["Foo.Foo", "Foo"], ["a'.b", "a", "b"]]
    docs = spark.createDataFrame([("d1", "a a b"), ("d2", "b"), ("d3", "")], "name string, text string")
    t = lexical.word_tokens(F.col("text"))
    post, dl = lexical.postings(docs, t), lexical.lengths(docs, t)
    q = spark.createDataFrame([("q", "a", 1), ("z", "zz", 1)], "query_id string, token string, qf long")
    got = lexical.top_documents(lexical.scores(q, post, dl), dl, 3).orderBy("position").collect()
    assert [(r["name"], round(r["score"], 6)) for r in got] == [("d1", 0.999571), ("d2", 0), ("d3", 0)]
    assert round(lexical.frequencies(post, lexical.totals(dl)).where("token = 'a'").first()["idf"], 6) == 0.980829


def ranked(spark, **lists):
    return {k: spark.createDataFrame([("q", n, i + 1, 1.0) for i, n in enumerate(v)], "query_id string, name string, position int, score double") for k, v in lists.items()}


def test_fusion_and_ranks(spark):
    x = ranked(spark, wl="XY", bm="YZ", de="ZX")
    got = {r["name"]: round(r["score"], 7) for r in fusion.reciprocal_ranks([(x["wl"], 0.5), (x["bm"], 0.15), (x["de"], 0.35)]).collect()}
    assert got == {"X": 0.0138419, "Y": 0.0105235, "Z": 0.0081571}
    finals = spark.createDataFrame([("q", n, s) for n, s in zip("abcd", (0.9, 0.7, 0.7, 0.1))], "query_id string, name string, final double")
    assert [r["rank"] for r in fusion.competition_rank(finals).orderBy("position").collect()] == [1, 2, 2, 4]


@pytest.mark.parametrize(("boosted", "want"), [(0.9, [1, 2, 2, 4]), (0.5, [1, 1, 1, 4])])
def test_pinned_rank(spark, boosted, want):
    rows = spark.createDataFrame([("q", "a", 1.0), ("q", "b", boosted), ("q", "c", boosted), ("q", "d", 0.2)], "query_id string, name string, structural double")
    verdicts = spark.createDataFrame([("q", "b", True), ("q", "c", True), ("q", "d", None)], "query_id string, name string, applicable boolean")
    assert [r["rank"] for r in fusion.pinned_rank(rows, verdicts).orderBy("name").collect()] == want
    none = verdicts.where("false")
    assert [r["name"] for r in fusion.pinned_rank(rows, none).orderBy("position").collect()] == list("abcd")


def test_gate_and_metrics(spark):
    from sylvarank.config import MarginGate

    rows = spark.createDataFrame([("m", "a", 0.52), ("m", "b", 0.50), ("n", "a", 0.549), ("n", "b", 0.5), ("s", "a", 0.01)], "query_id string, name string, wl double")
    for c in ("teds", "jaccard", "collapse_match", "dense", "bm25"):
        rows = rows.withColumn(c, F.lit(0.0))
    got = {r["query_id"]: round(r["dense_weight"], 6) for r in fusion.margin_gate(rows, Weights(wl=1.0, dense=0.6), MarginGate(True, 0.05, 0.2)).collect()}
    assert got == {"m": 0.36, "n": 0.12, "s": 0.48}
    m = fusion.metrics(spark.createDataFrame([(1,), (3,), (None,), (11,)], "final_rank int")).first()
    assert (m["completed"], m["mrr"], m["recall_1"], m["recall_5"], m["precision_5"], m["f1_5"], m["ndcg_5"]) == (3, 0.356061, 0.25, 0.5, 0.1, 0.166667, 0.375)
    assert fusion.metrics(spark.createDataFrame([], "final_rank int")).first()["mrr"] == 0


def test_expressions(spark):
    fv = {"fvar": "q"}
    shared = expr.share_subtrees(expr.parse(APP(APP(CONST("F"), fv), fv)))
    assert shared == expr.parse(APP(APP(CONST("F"), {"fvar": "v0"}), {"fvar": "v0"}))
    with pytest.raises(ValueError, match="unbound"):
        expr.share_subtrees(expr.parse(BV))
    body = CONST("B")
    assert expr.drop_simple_binders(expr.parse(FORALL("n", CONST("Nat"), body))) == expr.parse(body)
    kept = expr.parse(FORALL("h", APP(CONST("a"), CONST("b")), body))
    assert expr.drop_simple_binders(kept) == kept
    for bad in ({"bvar": {"deBruijnIndex": True}}, {"const": {"declName": 1, "us": []}}, {"x": {}}, [], {"app": {"fn": CONST("a")}}):
        with pytest.raises(ValueError):
            expr.parse(bad)
    df = spark.createDataFrame([("a", json.dumps(APP(CONST("A"), CONST("B")))), ("b", "{"), ("c", None)], "tree_id string, expression_json string")
    got = expr.flatten(df).collect()
    assert sorted((r["tree_id"], r["label"]) for r in got if r["error"] is None) == [("a", "App"), ("a", "Const(A, [])"), ("a", "Const(B, [])")]
    assert {r["tree_id"] for r in got if r["error"]} == {"b", "c"}


def test_ted_cutoff(spark):
    nodes = nodes_of(spark, a=lit("a"), b=lit("b"), c=APP(lit("a"), lit("b")))
    pairs = spark.createDataFrame([("a", "b"), ("c", "a")], "query_id string, name string")
    got = {r["query_id"]: r["teds"] for r in ted.ted_scores(pairs, nodes, size_cutoff=2).collect()}
    assert got == {"a": pytest.approx(0.6), "c": None}


def test_archive(spark, tmp_path):
    lines = [b"-- x", b"COPY public.t (id, data) FROM stdin;", b'1\t{"a": "x\\\\ny", "k": 2}', b'2\t{"a": "raw', b'tail", "g": "open " quote", "z": 1}', b"\\.", b""]
    raw = b"\n".join(lines)
    path = tmp_path / "d.tar.gz"
    with tarfile.open(path, "w:gz") as tar:
        info = tarfile.TarInfo("d.sql")
        info.size = len(raw)
        tar.addfile(info, io.BytesIO(raw))
    got = {r["record_id"]: json.loads(r["payload"]) for r in archive.read_dump(spark, str(path), "COPY public.t (id, data) FROM stdin;", fields=("a",), bounded={"g": "z"}).collect()}
    assert got == {1: {"a": "x\ny", "k": 2}, 2: {"a": "raw\ntail", "g": 'open " quote'}}
    with pytest.raises(ValueError):
        list(archive.copy_records(iter([b"COPY x", b"1\ta"]), b"COPY x"))
    assert archive.copy_unescape(rb"a\tb\\n\1\x41\.") == b"a\tb\\n1x41." and archive.loose_unescape(r"\q\"\u0041") == 'q"A'


def test_sources(spark, tmp_path):
    (tmp_path / "e.txt").write_text("a\nb\n")
    (tmp_path / "n.txt").write_text("x\ny\n")
    got = tables.read_aligned_cases(spark, str(tmp_path / "e.txt"), str(tmp_path / "n.txt")).orderBy("query_id").collect()
    assert [(r["query_id"], r["target"]) for r in got] == [("test-a-001", "x"), ("test-a-002", "y")]
    (tmp_path / "n.txt").write_text("x\n")
    with pytest.raises(Exception, match="differ in length"):
        tables.read_aligned_cases(spark, str(tmp_path / "e.txt"), str(tmp_path / "n.txt")).collect()
    (tmp_path / "v.tsv").write_text("q\ta\t1\tfull\nq\tb\t0\tfull\nq\tc\t\tfull\nq\td\nq\ta\t0\tfull\n")
    assert {r["name"]: r["applicable"] for r in tables.read_verdicts(spark, str(tmp_path / "v.tsv")).collect()} == {"a": False, "b": False, "c": None}
    (tmp_path / "s.tsv").write_text("n1\tsome\ttext\nn2\t\nbad\n")
    assert [tuple(r) for r in tables.read_statements(spark, str(tmp_path / "s.tsv")).collect()] == [("n1", "some\ttext")]
    q = spark.createDataFrame([("q(x + y)",), ("z",)], "t string")
    assert [r[0] for r in q.select(tables.quoted_term("t")).collect()] == ["x + y", "z"]


def test_sinks(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "query_id string")
    out = str(tmp_path / "o")
    sinks.append_records(rows("a"), out)
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.append_records(rows("a"), out)
    sinks.append_records(rows("a", "b"), out, resume=True)
    assert sorted(r[0] for r in spark.read.json(out).collect()) == ["a", "b"]
    cand = spark.createDataFrame([("q", "a\tb", "p", 1), ("q", "a\tb", "r", 2)], "query_id string, text string, name string, rank int")
    assert sinks.request_lines(cand).first()["line"] == "q\ta b\tp,r"
    digest = sinks.write_atomically(str(tmp_path / "p.json"), {"b": 1, "a": 2})
    assert sinks.file_digest(str(tmp_path / "p.json")) == digest == (tmp_path / "p.json.sha256").read_text()


def test_occurrences(spark):
    df = spark.createDataFrame([(3, "k"), (1, "k"), (2, "k")], "id int, k string")
    assert [(r["id"], r["occurrence"]) for r in manifest.occurrences(df, ["k"], ["id"]).orderBy("id").collect()] == [(1, 0), (2, 1), (3, 2)]


def test_config():
    c = config_from({"retrieval": {"candidate_limit": 7}, "cascade": {"k_bins": [1, 2], "size_thresholds": [5]}}, "upstream_head")
    assert c.retrieval.k_max == 7 and c.scoring.large_tree_weights == Weights(0.15, 0.0, 0.15, 0.30)
    for bad in ({"scoring": {"tie_method": "dense"}}, {"retrieval": {"backend": "x"}}, {"cascade": {"k_bins": [1]}}, {"verdicts": {"mode": "no"}}, {"scoring": {"profile": "none"}}, {"hybrid": {"rrf_k": 0}}, {"retrieval": {"what": 1}}):
        with pytest.raises(ValueError):
            config_from(bad)


def test_dense(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None)], "name long, vector array<double>")
    got = dense.nearest(rows.where("name = 1").withColumnRenamed("name", "query_id"), rows, 2)
    assert [(r["name"], r["score"]) for r in got.orderBy("position").collect()] == [(1, 1.0), (3, 1.0)]
    assert dense.nearest(rows.where("false").withColumnRenamed("name", "query_id"), rows, 2).count() == 0
