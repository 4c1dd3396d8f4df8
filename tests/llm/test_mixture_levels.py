"""Margins with very many levels, and targets that do not name them all."""

import numpy as np
import pyarrow as pa
import pytest
from treeline.llm import mixing as M


def described(spark, n_sources=400):
    """Sources of 2 to 11 documents; languages go unevenly over them; the first source is large."""
    docs = []
    for s in range(n_sources):
        for i in range(3000 if s == 0 else 2 + s % 10):
            docs.append((len(docs), f"word{(s + i) % 7}xx " * (5 + i % 3), "en" if (s + i) % 3 else "de", f"s{s:03}"))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")


def shares(out, weights=None):
    mass = out.n_tokens * (1.0 if weights is None else weights)
    return (mass.groupby(out.source).sum() / mass.sum()).to_dict()


def test_every_source_is_raked_to_its_own_share(spark):
    out = M.mixture(described(spark)).toPandas()
    lifted = {k: v**0.8 for k, v in shares(out).items()}
    whole = sum(lifted.values())
    got = shares(out, out.probability)
    assert len(got) == 400 and all(got[k] == pytest.approx(v / whole, rel=1e-6) for k, v in lifted.items())


def test_targets_reach_rare_sources_and_spare_the_others(spark):
    out = M.mixture(described(spark), targets={"source": {"s000": 0.5, "s390": 0.01}}).toPandas()
    before, after = shares(out), shares(out, out.probability)
    left = sum(v for k, v in before.items() if k not in ("s000", "s390"))
    assert after["s390"] == pytest.approx(0.02 * after["s000"], rel=1e-6)
    assert after["s390"] + after["s000"] == pytest.approx(1 - left, rel=1e-6)
    assert all(after[k] == pytest.approx(v, rel=1e-6) for k, v in before.items() if k not in ("s000", "s390"))


@pytest.mark.parametrize("targets", [None, {"source": {"s000": 0.1, "s039": 0.0, "none": 1.0}, "lang": {"de": 0.5, "en": 0.5}}])
def test_tables_give_what_the_driver_gives(spark, monkeypatch, targets):
    docs = described(spark, 40)
    want = {r.doc_id: r for r in M.mixture(docs, targets=targets).collect()}
    monkeypatch.setattr(M, "CELLS", 3)
    for r in M.mixture(docs, targets=targets).collect():
        assert r.probability == pytest.approx(want[r.doc_id].probability, rel=1e-6, abs=1e-12) and r.weight == pytest.approx(want[r.doc_id].weight, rel=1e-6, abs=1e-12)


def test_a_pass_over_terms_gives_the_sums_of_the_whole_vectors(monkeypatch):
    rng = np.random.default_rng(1)
    slots = [rng.choice(M.TERMS, size=rng.integers(1, 60), replace=False).astype(np.int32) for _ in range(500)]
    counts = [rng.integers(1, 9, len(x)).astype(np.int32) for x in slots]
    langs = [["en", "de", "fr", None][i % 4] for i in range(500)]
    base = M.Topics(np.zeros((0, M.TERMS)), rng.random(M.TERMS) + 0.1, rng.random(M.TERMS) / 30, {k: rng.random(M.TERMS) / 30 for k in ("de", "en")})
    centres = M._unit(rng.standard_normal((5, M.TERMS)))
    x = base.rows(slots, counts, langs)
    own = (x @ centres.T).argmax(axis=1)
    kind = pa.list_(pa.int32())
    cuts = [slice(0, 200), slice(200, 500)]
    batches = [(pa.array(slots[c], kind), pa.array(counts[c], kind), pa.array(langs[c], pa.string())) for c in cuts]

    class Tallied:
        def __init__(self, terms, tally, key, arrays=False):
            self.rows = [{"key": k, "slot": i, "n": n} for k, v in tally(iter(batches)).items() for i, n in enumerate(v)]

        def collect(self):
            return self.rows

    monkeypatch.setattr(M, "_tallied", Tallied)
    sums, sizes, near = M._assigned(None, base, [centres])[0]
    assert sizes.tolist() == np.bincount(own, minlength=5).tolist()
    assert np.allclose(sums, [x[own == k].sum(axis=0) for k in range(5)], atol=1e-6) and near / M.SCALE == pytest.approx((x @ centres.T).max(axis=1).sum())


def test_a_pass_reads_blocks_of_texts(spark, monkeypatch):
    """Passes read a row for each block of texts instead of one for each text, and give the same sums."""
    rng = np.random.default_rng(2)
    rows = [([int(s) for s in rng.choice(M.TERMS, size=1 + i % 40, replace=False)], [1 + j % 5 for j in range(1 + i % 40)], ["en", "de", "fr", None][i % 4]) for i in range(300)]
    terms = spark.createDataFrame(rows, "slots array<int>, counts array<int>, _lang string").repartition(2)
    base = M.Topics(np.zeros((0, M.TERMS)), rng.random(M.TERMS) + 0.1, rng.random(M.TERMS) / 30, {k: rng.random(M.TERMS) / 30 for k in ("de", "en")})
    starts = [M._unit(rng.standard_normal((n, M.TERMS))) for n in (4, 2)]
    monkeypatch.setattr(M, "BLOCK", 64)
    packed = M._packed(terms, base)
    assert 5 <= packed.count() <= 7
    for (a, sizes, near), (b, sizes_b, near_b) in zip(M._assigned(terms, base, starts), M._assigned(packed, base, starts), strict=True):
        assert sizes.tolist() == sizes_b.tolist() and np.array_equal(a, b) and near == near_b


def test_a_pass_gives_no_rows_for_tasks_without_texts(spark):
    terms = spark.createDataFrame([([1, 2], [1, 1], "en")], "slots array<int>, counts array<int>, _lang string").repartition(40)
    base = M.Topics(np.zeros((0, M.TERMS)), np.ones(M.TERMS), np.zeros(M.TERMS), {"en": np.zeros(M.TERMS)})

    def tally(batches):
        return {0: np.array([sum(len(rows[2]) for rows in batches)])}

    assert [r["n"] for r in M._tallied(terms, tally, "int", arrays=True).collect()] == [1]
    assert M._assigned(M._packed(terms, base), base, [np.eye(M.TERMS)[:2]])[0][1].tolist() == [0, 1]
