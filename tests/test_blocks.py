"""Closures by blocks against joined paths."""

import random

import pytest
from treeline.operators import blocks as B
from treeline.operators import scoring as M
from treeline.operators.graph import bottleneck_closure

from tests.test_graph import edges, rows


def both_sides(spark, seed):
    """Paths with bridges between them, some with cycles: few edges lead far."""
    rng, sides = random.Random(seed), ([], [])
    name = lambda i: f"n{i}"
    for g in ("one", "two", "three"):
        for i in range(60):
            for e in sides:
                e += [(g, name(i), name(j)) for j in (i + 1, i + rng.randint(2, 9)) if rng.random() < 0.7]
                if g == "three" and rng.random() < 0.1:
                    e.append((g, name(i + 3), name(i)))
    return [spark.createDataFrame(sorted({x for x in e if x[1] != x[2]}), "graph_id string, parent string, child string") for e in sides]


@pytest.mark.parametrize(("bits", "columns"), [(3, 1 << 14), (4, 7), (11, 16)])
def test_sizes_equal_joined_paths(spark, bits, columns):
    for seed in (1, 2):
        pred, gt = both_sides(spark, seed)
        graphs = pred.select("graph_id").distinct()
        parts = B.blocks(pred, gt, bits, columns, crossing=1)
        assert parts is not None and (parts.mail.count() > 0) == (bits < 11)
        got = {tuple(r) for r in M._by_blocks(parts, graphs).collect()}
        assert got == {tuple(r) for r in M._joined_modes(pred, gt, graphs).collect()} and len(got) == 12


def test_near_edges_are_not_joined(spark, monkeypatch):
    """Where names that sort together lie together, modes are counted without a table of all pairs."""

    def joined(*_):
        raise AssertionError("paths were joined")

    monkeypatch.setattr(M, "close_pairs", joined)
    e = edges(spark, [(f"c{i}", f"c{i + 1}") for i in range(300)])
    got = rows(M.evaluate_modes(e.where("child <> 'c300'"), e), "mode", "precision", "recall")
    assert ("Cond_Clos", 1.0, 299 * 300 / 2 / (300 * 301 / 2)) in got


def test_far_edges_make_no_blocks(spark):
    rng = random.Random(4)
    e = edges(spark, sorted({(f"n{rng.randrange(200)}", f"n{rng.randrange(200)}") for _ in range(300)}))
    assert B.blocks(e, e, bits=3) is None


def sweep_scores(spark, pred):
    return spark.createDataFrame([(*r, f"r{k}", float(hash_of(k, *r))) for r in pred.collect() for k in range(2)], "graph_id string, parent string, child string, ranker string, score double")


def hash_of(k, *names):
    return sum(ord(c) * (k + 3) ** i for i, c in enumerate("".join(names))) % 11


@pytest.mark.parametrize("safe", [True, False])
def test_sweep_by_numbers_equals_sweep_by_names(spark, safe):
    pred, gt = both_sides(spark, 3)
    scores, ks = sweep_scores(spark, pred), [0, 1, 2, 5]
    closure = M.transitive_closure(pred)
    got, want = ({tuple(r) for r in M.prune_sweep(pred, scores, gt, ks, safe, closure=c).collect()} for c in (None, closure))
    assert got == want and len(got) == 3 * (3 * len(ks) + 1)
    parts = [{tuple(r) for r in M.edge_components(pred, closure=c).collect()} for c in (M.paths(pred, gt), closure)]
    assert parts[0] == parts[1]


def test_sweep_names_no_pairs(spark, monkeypatch):
    def named(*_):
        raise AssertionError("pairs were named")

    monkeypatch.setattr(M, "transitive_closure", named)
    monkeypatch.setattr(M, "_links", named)
    e = edges(spark, [(f"c{i}", f"c{i + 1}") for i in range(100)])
    scores = sweep_scores(spark, e)
    got = rows(M.prune_sweep(e, scores, e, [0, 1]), "ranker", "k", "tp", "n_pred", "n_gt")
    assert ("baseline", 0, 5050, 5050, 5050) in got and len(got) == 5 and all(x[2] == x[3] for x in got)


@pytest.mark.parametrize("limit", [2000, 3])
def test_levels_in_one_pass_equal_other_ways(spark, limit):
    rng = random.Random(limit)
    table = [("g", r, f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", rng.randrange(5)) for r in "ab" for _ in range(25)]
    e = spark.createDataFrame(table, "graph_id string, ranker string, parent string, child string, level long")
    one, other = ({tuple(r) for r in bottleneck_closure(e, ("graph_id", "ranker"), limit, few).collect()} for few in (16, 0))
    assert one == other and one
