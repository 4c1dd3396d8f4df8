"""Hold-out and examples against brute force on random graphs."""

import itertools
import random

import pytest
from treeline.operators import finetune as N

from .test_graph import edges, rows


def reach(pairs):
    """All pairs joined by a path."""
    out = set(pairs)
    while more := {(a, d) for (a, b), (c, d) in itertools.product(out, pairs) if b == c} - out:
        out |= more
    return out


def random_dag(rng, names, n):
    return sorted({tuple(sorted(rng.sample(range(len(names)), 2))) for _ in range(n)}), names


def forms(node):
    return set(node.split("|"))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_holdout_and_leaks_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    names = [f"u{i}|v{i}" if i % 4 == 0 else f"u{i}" for i in range(16)]
    ev = [(names[a], names[b]) for a, b in random_dag(rng, names[:10], 9)[0]]
    pool = [(names[a], names[b]) for a, b in random_dag(rng, names, 30)[0]]
    pool += [(f"v{i}", f"u{j}") for i, j in ((0, 5), (4, 8), (0, 15)) if (f"v{i}", f"u{j}") not in pool]
    closed = reach(ev)
    leaks = {(p, c) for p, c in pool if any(forms(p) & forms(a) and forms(c) & forms(d) for a, d in closed)}
    held = {n for e in ev for n in e}
    apart = {(p, c) for p, c in pool if not {p, c} & held}
    train, evaluation = edges(spark, pool), edges(spark, ev)
    report = N.leakage_report(train, evaluation).first()
    shown = set().union(*(forms(n) for e in pool for n in e))
    asked = set().union(*(forms(n) for n in held))
    assert (report.violations, report.eval_terms, report.shared_terms) == (len(leaks), len(asked), len(asked & shown))
    kept, stats = N.holdout_pairs(train, evaluation)
    assert rows(kept, "parent", "child") == apart - leaks
    assert (stats.first().pool_edges, stats.first().dropped_node_overlap) == (len(pool), len(pool) - len(apart))
    assert rows(N.holdout_pairs(train, evaluation, node_disjoint=False)[0], "parent", "child") == set(pool) - leaks
    N.assert_no_leak(kept, evaluation)
    if leaks:
        with pytest.raises(ValueError):
            N.assert_no_leak(train, evaluation)


@pytest.mark.parametrize("size", [3, 50])
def test_examples_equal_brute_force(spark, size):
    rng = random.Random(size)
    names = [f"k{i:02}" for i in range(14)]
    train = [(names[a], names[b]) for a, b in random_dag(rng, names, 15)[0]]
    nodes = {n for e in train for n in e}
    closed = reach(train)
    got = N.make_examples(edges(spark, train), size).collect()
    assert {r.target for r in got} == nodes and len(got) == len(nodes)
    for r in got:
        told = {tuple(x.split(" <= ")) for x in r.completion.split("\n")} if r.completion != "none" else set()
        shown = set(r.candidates)
        assert len(shown) == len(r.candidates) == min(size, len(nodes) - 1) and r.target not in shown
        assert told == {(d, a) for a, d in closed if (a == r.target and d in shown) or (d == r.target and a in shown)}
        related = {x for p in closed if r.target in p for x in p} - {r.target}
        assert len(shown & related) == min(size, len(related))
    again = N.make_examples(edges(spark, train).repartition(5), size).collect()
    assert {r.target: r.candidates for r in again} == {r.target: r.candidates for r in got}
    assert N.make_examples(edges(spark, [])).count() == 0
