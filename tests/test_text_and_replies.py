from pyspark.sql import functions as F

from treeline.functions import stats
from treeline.functions import text as T
from treeline.operators import replies as P


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first().y


def test_terms(spark):
    assert one(spark, "  Red, (Big)  Dog! ", T.clean_term) == "red big dog"
    assert one(spark, "b (b, b2)", T.parse_lemma) == ["b", "b2"]
    assert one(spark, "x|y|z", T.parse_lemma) == ["x", "y", "z"]
    assert one(spark, "plain", T.parse_lemma) == ["plain"]
    assert one(spark, "p (other, q)", T.parse_lemma) == ["p (other, q)"]
    assert one(spark, "b (b, b2)", T.primary_term) == "b"
    assert one(spark, "x|y", T.primary_term) == "x|y"
    df = spark.createDataFrame([(["B!", "a|b"],), (["!!"],), (["One"],)], "t array<string>")
    assert [r[0] for r in df.select(T.lemma_of(F.col("t"))).collect()] == ["b (b, a)", None, "one"]


def test_size_buckets(spark):
    got = [r[0] for r in spark.createDataFrame([(n,) for n in (100, 150, 151, 500, 5000, 30000)], "n int").select(T.size_bucket("n")).collect()]
    assert got == ["0-150", "0-150", "151-1000", "151-1000", "1001-10000", "10001+"]


def test_labels_and_verdicts(spark):
    r = one(spark, "Our Method [full] (k=1000, clawback=5)", T.parse_label)
    assert (r.base_method, r.k, r.clawback, r.variant, r.strategy) == ("Our Method [full]", 1000, 5, "full", "Clawback(k=5)")
    r = one(spark, "X+restructure_prune_only_top15+rank_leverage (k=10, clawback=0)", T.parse_label)
    assert (r.top_n, r.rank_by, r.strategy) == (15, "leverage", "Prune-only")
    assert one(spark, "keep? no: SEVER.", T.decide_sever) is True
    assert one(spark, "keepsake severed", T.decide_sever) is False
    assert one(spark, None, T.decide_sever) is False
    assert one(spark, "gt_missing, or rather not_isa", T.parse_bucket) == "not_isa"
    assert one(spark, "dunno", T.parse_bucket) == "unclear"


def _resp(spark, text):
    return spark.createDataFrame([("r", "t", 0, text)], "run_id string, target string, chunk int, text string")


def _vocab(spark):
    return spark.createDataFrame([("dog", "dog (dog, hound)"), ("animal", "animal"), ("cat", "cat")], "primary string, node string")


def test_arrow_lines(spark):
    text = "- 'Dog' <= \"Animal\"\na <= b <= c\ncat <= animal\nrock <= animal\ncat <= animal"
    got = sorted(tuple(r) for r in P.parse_arrow_lines(_resp(spark, text), _vocab(spark)).select("parent", "child").collect())
    assert got == [("animal", "cat"), ("animal", "cat"), ("animal", "dog (dog, hound)")]


def test_json_forms_and_diagnostics(spark):
    resp, vocab = _resp(spark, 'Sure: [["animal", "Dog"], ["animal", "cat"], "x", ["animal"]]'), _vocab(spark)
    assert P.parse_json_pairs(resp, vocab).count() == 1
    assert P.parse_json_pairs(resp, vocab, case_sensitive=False).count() == 2
    d = P.parse_diagnostics(resp, vocab).first()
    assert (d.regex_match, d.json_ok, d.n_strict, d.n_json_ci, d.n_regex_ci, d.n_line) == (True, True, 1, 2, 2, 0)
    broken = P.parse_diagnostics(_resp(spark, '[["animal", "cat"], ["animal", "dog"], [oops]]'), vocab).first()
    assert (broken.regex_match, broken.json_ok, broken.n_regex_ci) == (True, False, 2)
    assert P.parse_loss_summary(P.parse_diagnostics(resp, vocab)).first().verdict == "parsing_loss"


def test_objects_and_channels(spark):
    got = P.parse_parent_child_objects(_resp(spark, '{"Parent": "A ", "child":"b"} {"parent": "c", "child": "C"}')).select("parent", "child").collect()
    assert [tuple(r) for r in got] == [("a", "b")]
    rows = [("r", "dog", 0, "dog <= animal", "cat <= animal"), ("r", "cat", 0, "none", "cat <= animal\ncat <= animal")]
    resp = spark.createDataFrame(rows, "run_id string, target string, chunk int, content string, reasoning string")
    edges, salience = P.assertions_to_edges(resp, _vocab(spark))
    assert sorted((r.target, r.child) for r in edges.collect()) == [("cat", "cat"), ("dog", "dog (dog, hound)")]
    assert {r.child: r.n for r in salience.collect()} == {"dog (dog, hound)": 1, "cat": 3}


def test_p_values():
    for t, df, p in ((2.0, 10, 0.07338803), (12.706205, 1, 0.05), (0.0, 5, 1.0), (3.0, 200, 0.00303897)):
        assert abs(stats.two_sided_p(t, df) - p) < 1e-5


def test_vocabularies_are_joined_once_and_never_broadcast(spark, monkeypatch):
    calls, real = [], P._known
    monkeypatch.setattr(P, "_known", lambda pairs, vocab: calls.append(1) or real(pairs, vocab))
    d = P.parse_diagnostics(_resp(spark, '[["animal", "cat"], ["animal", "cat"], ["animal", "CAT"], ["animal", "unknown"]]'), _vocab(spark))
    r = d.first()
    assert len(calls) == 1 and (r.n_strict, r.n_json_ci, r.n_regex_ci, r.n_line, r.n_pairs_wellformed) == (2, 3, 3, 0, 4)
    plan = P.parse_arrow_lines(_resp(spark, "cat <= animal"), _vocab(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
