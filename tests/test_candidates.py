"""Lexical and vector candidates against all pairs."""

import random

import numpy as np
import pytest

from treeline.operators import candidates as C


@pytest.mark.parametrize("chars", [2_000_000, 40])
def test_lexical_edges_equal_all_pairs(spark, chars):
    rng = random.Random(chars)
    parts = ["tree", "treeline", "line", "old", "grey oak", "ääkk", "oa"]
    rows = sorted({(g, " ".join(rng.sample(parts, rng.randint(1, 4)))) for g in ("a", "b") for _ in range(60)}) + [("a", "Oak (oak, grey oak)"), ("a", "oak|x"), ("b", "x" * 5000 + "tree")]
    got = {tuple(r) for r in C.lexical_edges(spark.createDataFrame(rows, "graph_id string, node string"), chars).collect()}
    first = {"Oak (oak, grey oak)": "oak", "oak|x": "oak|x"}
    term = lambda n: first.get(n, n)
    want = {(g, u, v) for g, u in rows for h, v in rows if g == h and u != v and len(term(u)) > 3 and term(u) != term(v) and term(u) in term(v)}
    assert got == want and len(got) > 100
    assert C.lexical_edges(spark.createDataFrame([], "graph_id string, node string")).collect() == []


def clustered(n, dim, clusters, spread, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim))
    return [(f"v{i:04d}", (centres[i % clusters] + spread * rng.standard_normal(dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize(("spread", "skips"), [(0.15, True), (3.0, False)])
def test_cosines_equal_all_pairs(spark, monkeypatch, spread, skips):
    monkeypatch.setattr(C, "CELL", 20)
    monkeypatch.setattr(C, "BLOCK", 15)
    data = clustered(600, 16, 12, spread, 5) + [("zero", [0.0] * 16), ("same", [1.0] + [0.0] * 15), ("twin", [2.0] + [0.0] * 15), ("none", [])]
    left, right = (spark.createDataFrame(x, "name string, vec array<double>") for x in (data[::2], data))
    at = lambda d: np.stack([v for _, v in d if v]) / np.maximum(np.linalg.norm(np.stack([v for _, v in d if v]), axis=1, keepdims=True), 1e-12)
    a, b = [n for n, v in data[::2] if v], [n for n, v in data if v]
    s = at(data[::2]) @ at(data).T
    for i, n in enumerate(a):
        s[i, b.index(n)] = -9
    shares = []
    got = {(r.a, r.b) for r in C.cosine_pairs(left, right, 0.8, shares).collect()}
    assert got == {(a[i], b[j]) for i, j in zip(*np.nonzero(s > 0.8), strict=True)}
    best = {r.child: r.cosine for r in C.nearest_parent(left, right).collect()}
    assert set(best) == set(a) and all(best[n] == pytest.approx(s[i].max()) for i, n in enumerate(a))
    C.cosine_pairs(left, right, None, shares)
    assert (min(shares) > 0.5) == skips


def test_a_vector_goes_to_a_bounded_number_of_shares(spark, monkeypatch):
    monkeypatch.setattr(C, "CELL", 10)
    monkeypatch.setattr(C, "BLOCK", 5)
    rows = spark.createDataFrame(clustered(800, 16, 12, 3.0, 7), "name string, vec array<double>")
    pivots = C._pivots(rows, 80)
    cells = C._in_cells(rows, pivots)
    side = C._summary(cells)
    met = [(i, j) for i in side for j in side]
    dealt, keys = C._shared(cells, cells, met, (side, side))
    assert keys == C.SHARES**2 and dealt.count() == 2 * 800 * C.SHARES  # blocks of cells sent each vector to some 160
    own = {(r._k, r.side, r.name) for r in dealt.collect()}
    at = {s: {} for s in (0, 1)}
    for k, s, name in own:
        at[s].setdefault(name, set()).add(k)
    assert all(len(at[0][a] & at[1][b]) == 1 for a in list(at[0])[:50] for b in at[1])


def test_the_nearest_of_equal_vectors_is_the_smallest_name(spark, monkeypatch):
    monkeypatch.setattr(C, "CELL", 20)
    monkeypatch.setattr(C, "BLOCK", 15)
    base = clustered(40, 64, 5, 0.3, 3)
    data = [(f"{c}{n}", v) for c in "abcdef" for n, v in base]
    rows = spark.createDataFrame(data, "name string, vec array<double>")
    got = {r.child: r.parent for r in C.nearest_parent(rows, rows).collect()}
    assert got == {c + n: ("b" if c == "a" else "a") + n for c, (n, _) in ((c, x) for c in "abcdef" for x in base)}
