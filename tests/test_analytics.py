"""Fits, ranks and quantiles against plain computation."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F
from treeline.functions import stats as S
from treeline.operators import analytics as A


@pytest.mark.parametrize("rows", [1_000_000, 5])
def test_running_totals_equal_sums(spark, monkeypatch, rows):
    """One large group and small ones, dealt by ranges or not."""
    monkeypatch.setattr(S, "WINDOW_ROWS", rows)
    rng = random.Random(rows)
    data = [(rng.choice(["a", "a", "a|b", None]), i, rng.randrange(40), rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(data, "k string, id int, x int, v int").repartition(5)
    got = {r.id: (r.upto, r.whole) for r in S.running_totals(df, ["k"], [F.desc("x"), F.col("id")], {"upto": F.col("v")}, {"whole": F.col("v")}).collect()}
    for k, i, x, _ in data:
        same = [d for d in data if d[0] == k]
        assert got[i] == (sum(d[3] for d in same if (-d[2], d[1]) <= (-x, i)), sum(d[3] for d in same))
    ranks = {(r.k, r.x): r["rank"] for r in S.value_ranks(df, ["k"], "x").collect()}
    for k, x in {(d[0], d[2]) for d in data}:
        own = sorted(d[2] for d in data if d[0] == k)
        assert ranks[k, x] == pytest.approx(np.mean([i for i, y in enumerate(own, 1) if y == x]))
    shares = [0, 0.1, 0.25, 0.5, 0.77, 1]
    assert S.quantiles(df, "x", shares) == pytest.approx(np.quantile([d[2] for d in data], shares).tolist())
    assert S.quantiles(df.limit(0), "x", [0.5]) == [None]
    auc = {r.k: r.auc for r in A.roc_auc(df.withColumn("y", F.col("v") % 2), "x", "y", "k").collect()}
    for k in ("a", "a|b"):
        pos, neg = ([d[2] for d in data if d[0] == k and d[3] % 2 == y] for y in (1, 0))
        assert auc[k] == pytest.approx(np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]))


def test_folds_equal_a_fit_each(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rng = random.Random(3)
    names, data = ["u", "v"], []
    for i in range(900):
        u, v = rng.gauss(0, 1), rng.random()
        data.append((f"g{i % 3}", f"p{i}", f"c{i}", u, v, int(rng.random() < 1 / (1 + np.exp(-(2 * u - v - 0.5))))))
    df = spark.createDataFrame(data, "graph_id string, parent string, child string, u double, v double, is_fp int")
    got = {r.graph_id: r.weights for r in A.logistic_folds(df, names).collect()}
    rows = VectorAssembler(inputCols=names, outputCol="x").transform(df)
    for g in (None, "g0", "g1", "g2"):
        fit = LogisticRegression(featuresCol="x", labelCol="is_fp", regParam=0.01, standardization=False, maxIter=300, tol=1e-12).fit(rows.where(F.lit(g is None) | (F.col("graph_id") != F.lit(g))))
        assert got[g] == pytest.approx([*fit.coefficients, fit.intercept], abs=1e-6)
    p = {r.child: (r.p_fp, r.p_in_sample) for r in A.learned_suspicion(df, names).collect()}
    for g, _, c, u, v, _ in data[:50]:
        assert p[c] == pytest.approx([1 / (1 + np.exp(-(got[k][0] * u + got[k][1] * v + got[k][2]))) for k in (g, None)])


def test_folds_with_labels_of_one_value(spark):
    data = [("a", "p", "c", 1.0, 1), ("a", "p", "d", 2.0, 0), ("b", "p", "e", 3.0, 1), ("b", "p", "f", 0.0, 1)]
    df = spark.createDataFrame(data, "graph_id string, parent string, child string, u double, is_fp int")
    got = {(r.graph_id, r.child): r.p_fp for r in A.learned_suspicion(df, ["u"]).collect()}
    assert got["a", "c"] == 0.5 and got["b", "e"] != 0.5 and len(got) == 4
    assert A.learned_suspicion(df.limit(0), ["u"]).collect() == []
