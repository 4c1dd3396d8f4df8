"""What the fitted models are worth: gradients, held-out rows, clusters, and raking against a plain version."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from treeline.llm import mixing as M
from treeline.llm import toxicity as X
from treeline.llm.decontaminate import words_of

SF = "/root/testdata/sf0.1"


def test_ordinal_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    n, k = 40, 5
    pairs = np.nonzero(rng.random((n, k)) < 0.4)
    grades, weight = rng.integers(0, 3, n), rng.random(n) + 0.5
    p = rng.normal(size=k + 2) / 2
    _, g = X.likelihood(p, pairs, grades, weight, k, 3, 0.1)
    for i in range(k + 2):
        step = np.zeros(k + 2)
        step[i] = 1e-6
        numeric = (X.likelihood(p + step, pairs, grades, weight, k, 3, 0.1)[0] - X.likelihood(p - step, pairs, grades, weight, k, 3, 0.1)[0]) / 2e-6
        assert abs(g[i] - numeric) < 1e-6


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    own = labels.where("crc32(cast(doc_id as string)) % 2 = 0")
    other = labels.where("crc32(cast(doc_id as string)) % 2 = 1").join(docs.where("text is not null").select("doc_id"), "doc_id", "left_semi")
    got = X.toxicity(docs, docs, own).join(other, "doc_id").select("toxic", "rejected").collect()
    caught = [r.rejected for r in got if r.toxic == 1]
    wrong = [r.rejected for r in got if r.toxic == 0]
    assert len(caught) >= 80 and np.mean(caught) > 0.8 and np.mean(wrong) < 0.02


def test_toxicity_equals_plain_features_and_scores(spark):
    """Features by their chi-squared statistic over all labelled documents, and severities text by text."""
    sf = SF.replace("0.1", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    features = lambda t: {f for w in set(words_of(t)) for f in X.word_features(w)}
    toxic = {r.doc_id: r.toxic for r in labels.groupBy("doc_id").agg({"toxic": "max"}).toDF("doc_id", "toxic").collect() if texts.get(r.doc_id) is not None and r.toxic in (0, 1)}
    assert len(toxic) < X.FIT_ROWS / 2
    seen = {}
    for i, bad in toxic.items():
        for f in features(texts[i]):
            seen.setdefault(f, [0, 0])[bad] += 1
    n = [sum(bad == k for bad in toxic.values()) for k in (0, 1)]

    def chi2(f):
        b, a = seen[f]
        c, d = n[1] - a, n[0] - b
        return sum(n) * (a * d - b * c) ** 2 / ((a + b) * (c + d) * n[1] * n[0])

    model = X.fit_severity(docs, labels)
    some = [f for f, (b, a) in seen.items() if 5 <= a + b < sum(n)]
    value = {f: chi2(f) for f in some}
    assert set(model.features) == {f for f in some if value[f] >= X.LEAST_CHI2} and 0 < len(model.features) < X.FEATURES
    order = [value[f] for f in sorted(model.features, key=model.features.get)]
    assert all(a >= b - 1e-9 for a, b in itertools.pairwise(order))
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    for r in X.toxicity(docs, docs, labels).collect():
        z = sum(model.weights[model.features[f]] for f in features(texts[r.doc_id]) if f in model.features)
        above = [1 / (1 + np.exp(-np.clip(z - t, -30, 30))) for t in model.thresholds]
        assert (r.expected_severity, r.p_toxic) == pytest.approx((sum(above), above[0]), abs=1e-9)
        assert (r.grade, r.rejected) == (sum(p >= 0.5 for p in above), above[0] >= 0.5)


def test_rare_toxic_labels_are_not_drowned(spark):
    rng = random.Random(3)
    text = lambda i: " ".join([f"w{rng.randrange(80)}" for _ in range(30)] + (["grumbly", "plonker"] if i % 50 == 0 else []))
    rows = [(i, text(i), int(i % 50 == 0)) for i in range(5000)] + [(0, text(0), 1)] * 300
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = X.fit_severity(d, d.select("doc_id", "toxic"), fit_rows=400)
    got = X.score_severity(d, model).selectExpr("toxic", "_severity.p_toxic >= 0.5 as r").groupBy("toxic", "r").count().collect()
    assert {(r.toxic, r.r) for r in got} == {(0, False), (1, True)}


def test_topics_tell_vocabularies_apart(spark):
    rng = random.Random(5)
    words = [[f"{c}{c}{c}{i:03}" for i in range(60)] for c in "abcd"]
    rows = [(i, " ".join(rng.choice(words[i % 4]) for _ in range(80))) for i in range(400)] + [(900, None), (901, ""), (902, "a bc")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    topics = M.fit_topics(d, n_topics=4, sample=200)
    got = {r.doc_id: r["_mix"] for r in M.describe_documents(d, topics).collect()}
    by = [{got[i].topic for i in range(400) if i % 4 == k} for k in range(4)]
    assert all(len(b) == 1 for b in by) and len(set.union(*by)) == 4
    assert [tuple(got[i]) for i in (900, 901, 902)] == [(0, None), (0, None), (2, None)]


def test_mixture_equals_plain_raking(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = M.mixture(docs).toPandas()
    cells = got.assign(**{m: got[m].fillna("(none)") for m in M.MARGINS})
    total = cells.n_tokens.sum()
    table = cells.groupby(list(M.MARGINS)).n_tokens.sum().astype(float).reset_index()
    goal = pd.Series(1.0, index=table.index)
    for depth in range(3):
        by, up = list(M.MARGINS[: depth + 1]), list(M.MARGINS[:depth])
        part = table.groupby(by).n_tokens.sum() ** M.TEMPER
        within = part / (part.groupby(level=up).transform("sum") if up else part.sum())
        goal *= [within.loc[tuple(r) if depth else r[0]] for r in table[by].itertuples(index=False)]
    goals = {m: goal.groupby(table[m]).sum() for m in M.MARGINS}
    assert goal.sum() == pytest.approx(1)
    weight = pd.Series(1.0, index=cells.index)
    for _ in range(500):
        for m, goal in goals.items():
            now = (cells.n_tokens * weight).groupby(cells[m]).sum() / total
            weight *= cells[m].map(goal / now.where(now > 0, 1.0))
    # Levels without a token keep their factor; their documents have no share either way.
    some = cells.n_tokens > 0
    ratio = (got.weight / weight)[some]
    assert ratio.max() / ratio.min() < 1 + 1e-6
    assert ((got.probability / got.weight)[some]).std() < 1e-9 and got.probability.max() <= 1


def test_topics_are_apart_from_languages_and_none_is_tiny(spark):
    rng = random.Random(8)
    common = {lang: [f"{lang}word{i:02}" for i in range(20)] for lang in ("de", "en", "fr")}
    special = [[f"theme{k}x{i:02}" for i in range(12)] for k in range(3)]
    rows = []
    for i in range(600):
        lang = ("de", "en", "fr")[i % 3]
        rows.append((i, " ".join(rng.choice(common[lang]) for _ in range(60)) + " " + " ".join(rng.choice(special[i // 3 % 3]) for _ in range(30)), lang))
    rows += [(1000 + i, f"stray{i} lonely{i} " * 9, None if i % 2 else "en") for i in range(4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    topics = M.fit_topics(d, n_topics=6)
    assert min(topics.sizes) >= M.LEAST_TOPIC * 604 and sum(topics.sizes) == 604
    got = {r.doc_id: r["_mix"].topic for r in M.describe_documents(d, topics).collect()}
    themes = {t: {i // 3 % 3 for i in range(600) if got[i] == t} for t in set(got.values())}
    assert all(len(k) <= 1 for k in themes.values())
    assert M.fit_topics(d, n_topics=6).sizes == topics.sizes


def test_topics_are_fitted_on_all_rows(spark):
    """More rows than the driver fits alone: sizes, weights and language means are those of every row with a term, and
    the same however rows lie."""
    rng = random.Random(7)
    words = [[f"{c}{c}{c}{i:03}" for i in range(40)] for c in "abc"]
    rows = [(i, " ".join(rng.choice(words[i % 3]) for _ in range(50)), ("de", "en", None)[i // 3 % 3]) for i in range(500)]
    rows += [rows[0]] * 20 + [(900, None, "de"), (901, "a bc", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = M.cluster([(M.term_slots(t)[1], lang) for _, t, lang in rows], 3)
    got = M.fit_topics(d, n_topics=3, sample=60)
    assert sum(got.sizes) == 520 and sorted(got.sizes) == sorted(whole.sizes)
    assert np.allclose(got.weight, whole.weight) and np.allclose(got.mean, whole.mean, atol=1e-7)
    assert set(got.means) == {"de", "en"} and all(np.allclose(got.means[k], whole.means[k], atol=1e-7) for k in got.means)
    assert np.allclose(sorted(map(tuple, got.centres)), sorted(map(tuple, whole.centres)), atol=1e-5)
    again = M.fit_topics(d.repartition(5), n_topics=3, sample=60)
    assert (again.centres == got.centres).all() and again.sizes == got.sizes


def test_mixture_meets_its_own_targets(spark, recwarn):
    """Shares after raking are those of the tempered cells, on all three margins, though sources keep to languages."""
    rows = [(i, f"alpha{i % 5} bravo{i % 7} " * (3 + i % 4), ("en", "de")[i % 40 == 0], ("web", "wiki", "code")[(i % 40 == 0) + (i % 9 == 0)]) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = M.mixture(d).toPandas()
    cells = got.groupby(list(M.MARGINS)).n_tokens.sum().reset_index(name="tokens")
    goals = M.tempered(spark.createDataFrame(cells)).toPandas()
    for m in M.MARGINS:
        share = (got.n_tokens * got.probability).groupby(got[m]).sum() / (got.n_tokens * got.probability).sum()
        assert share.to_dict() == pytest.approx(goals.groupby(m).goal.sum().to_dict(), abs=1e-8)
    assert not [w for w in recwarn if "raking" in str(w.message)]
