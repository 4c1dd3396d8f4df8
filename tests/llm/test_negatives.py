"""Hard negatives against all scores, and the intervals of the codes."""

import random

import numpy as np
import pytest
from treeline.llm import negatives as N

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    kept = set()
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) or abs(x) > N.LARGEST for x in v):
            continue
        kept.add((i, tuple(int(np.floor(256 * x)) for x in v), (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, va, la in kept:
        if a % 50:
            continue
        score = lambda v, va=va: sum(x * y for x, y in zip(v, va, strict=True))
        near = [(i, score(v), label) for i, v, label in kept if len(v) == len(va)]
        own = sorted(((-s, i) for i, s, label in near if label == la and i != a))[:5]
        for s, p in own:
            fits = sorted((-t, i) for i, t, label in near if label != la and 50 * -s <= 100 * t <= 95 * -s)[:3]
            out += [(a, p, r, i, -s, -t) for r, (t, i) in enumerate(fits, 1)]
    return sorted(out)


def sample(rng, n, dim, ids=None):
    centre = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    return [(i if ids is None else rng.choice(ids), [x + rng.gauss(0, 0.7) for x in centre[i % 12]], rng.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("dim", [64, 5, 100])
def test_negatives_equal_all_scores(spark, monkeypatch, dim):
    monkeypatch.setattr(N, "BLOCK", 70)
    monkeypatch.setattr(N, "ANCHORS", 3)
    rng = random.Random(dim)
    rows = sample(rng, 500, dim)
    rows += [(600 + i, rows[i][1], rows[i][2]) for i in range(0, 60)]  # ties
    rows += [(1000 + 50 * i, [-x for x in rows[i][1]], 1) for i in range(4)]
    got = sorted(tuple(r) for r in N.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(rows) and len(got) > 60


def test_odd_rows(spark):
    rng = random.Random(1)
    rows = sample(rng, 120, 3) + [(None, [1.0, 1.0, 1.0], 1), (50, None, 1), (100, [1.0, 1.0, 1.0], None), (150, [1.0, None, 1.0], 1), (200, [float("nan"), 1.0, 1.0], 1), (250, [float("inf"), 1.0, 1.0], 1), (300, [3e38, 1.0, 1.0], 1)]
    rows += [(350, [], 0), (351, [], 0), (352, [], 1), (400, [0.5, 0.25], 1), (401, [0.5, 0.5], 1), (402, [0.25, 0.25], 2), (450, [0.0, 0.0, 0.0], 1)]
    rows += rows[:30] + [(0, [0.5, 0.5, 0.5], 2)]
    df = spark.createDataFrame([(*r, "x", 3, 1.5) for r in rows], f"{SCHEMA}, block string, side int, rank double")
    got = [tuple(r) for r in N.hard_negatives(df).collect()]
    assert sorted(got) == brute(rows)
    assert N.hard_negatives(df.limit(0)).collect() == []


@pytest.mark.parametrize("dim", [1, 3, 64, 130])
def test_intervals_hold_every_product(dim):
    rng = np.random.default_rng(dim)
    v = rng.integers(-300, 300, (400, dim))
    v[0] = 0
    codes, align, rest, norm = N.encode(v)
    for a in (v[1], v[0], v[2] * 5):
        low, high = N.Anchor(a, N.rotations(dim, N.LEVELS)).intervals(codes, align, rest, norm)
        exact = v @ a
        assert (low <= exact).all() and (exact <= high).all()
    assert (rest[1:] < 0.25 * norm[1:]).mean() > 0.9


def test_few_rows_are_scored_in_integers(spark, monkeypatch):
    """The codes leave a small part of the rows for exact scores."""
    got = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    v = np.floor(256 * np.array([r.embedding for r in got], dtype=float)).astype(np.int32)
    block = object.__new__(N._Block)
    block.ids, block.labels, block.ints, block.turns = np.array([r.vec_id for r in got]), np.array([r.label for r in got]), v, N.rotations(64, N.LEVELS)
    block.codes, block.align, block.rest, block.norm = N.encode(v)
    scored = []
    monkeypatch.setattr(N._Block, "scores", lambda self, at, a: scored.append(len(at)) or self.ints[at].astype(np.int64) @ a.astype(np.int64))
    for i in range(0, 2000, 50):
        at, s = N.positives_of(block, block.ids[i], block.labels[i], v[i], 5)
        list(N.negatives_of(block, block.labels[i], v[i], [(int(block.ids[p]), int(x)) for p, x in zip(at, s, strict=True)], 3, 50, 95))
    assert np.mean(scored) < 0.2 * len(v)
