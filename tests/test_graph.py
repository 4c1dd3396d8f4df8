import random

import pytest
from pyspark.sql import functions as F

from treeline.operators import graph as R

G = "g"


def edges(spark, pairs, graph="g"):
    return spark.createDataFrame([(graph, a, b) for a, b in pairs], "graph_id string, parent string, child string")


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def random_pairs(rng, nodes, n, acyclic=False):
    """Distinct pairs of numbered nodes; acyclic ones go up a shuffled order."""
    names = [f"n{i}" for i in range(nodes)]
    rng.shuffle(names)
    out = set()
    while len(out) < n:
        i, j = rng.randrange(nodes), rng.randrange(nodes)
        if not acyclic or i < j:
            out.add((names[i], names[j]))
    return sorted(out)


def distances(pairs):
    """{(ancestor, descendant): edges of a shortest path}."""
    below, out = {}, {}
    for p, c in pairs:
        below.setdefault(p, set()).add(c)
    for start in below:
        front, hops = {start}, 0
        while front:
            hops += 1
            front = {c for p in front for c in below.get(p, ())} - {d for a, d in out if a == start}
            out |= {(start, c): hops for c in front}
    return out


@pytest.mark.parametrize("acyclic", [True, False])
def test_closure_and_reduction_equal_search(spark, acyclic):
    rng = random.Random(acyclic)
    graphs = {f"g{n}": random_pairs(rng, n, 3 * n // 2, acyclic) for n in (6, 15, 40)}
    graphs["line"] = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(37)]
    e = spark.createDataFrame([(g, *x) for g, ps in graphs.items() for x in ps], "graph_id string, parent string, child string")
    c = R.transitive_closure(e)
    want = {g: distances(ps) for g, ps in graphs.items()}
    assert rows(c, "graph_id", "ancestor", "descendant", "hops") == {(g, *x, h) for g, d in want.items() for x, h in d.items()}
    assert rows(R.is_dag(e), "graph_id", "is_dag") == {(g, all(a != b for a, b in d)) for g, d in want.items()}
    if acyclic:
        red = R.transitive_reduction(e, c)
        kept = {(g, a, b) for g, ps in graphs.items() for a, b in ps if not any((a, m) in want[g] and (m, b) in want[g] for m in {x for y in ps for x in y})}
        assert rows(red, "graph_id", "parent", "child") == kept
        assert rows(R.implied_edges(c, red), "graph_id", "ancestor", "descendant") == {(g, *x) for g, d in want.items() for x in d} - kept


def test_long_paths_take_few_rounds(spark, monkeypatch):
    """A path and a ring of 5000 nodes, with twigs: rounds follow the logarithm of their length."""
    n, rounds = 5000, []
    name = lambda i: f"n{i:04d}"
    path = [(name(i), name(i + 1)) for i in range(n)] + [(name(i), f"twig{i}") for i in range(0, n, 1000)]
    ring = [(name(i), name((i + 1) % n)) for i in range(n)] + [("in", name(7)), (name(9), "out")]
    e = edges(spark, path, "path").union(edges(spark, ring, "ring"))
    real = R.written
    monkeypatch.setattr(R, "written", lambda df, what: rounds.append(what) or real(df, what))
    assert dict(rows(R.is_dag(e), "graph_id", "is_dag")) == {"path": True, "ring": False}
    assert len(rounds) < 40 and rounds.count("core") < 20
    sets = {(r.graph_id, r.node): r.scc for r in R.scc(e).collect()}
    assert {v for (g, _), v in sets.items() if g == "ring"} == {name(0), "in", "out"} and all(k[1] == v for k, v in sets.items() if k[0] == "path")
    rounds.clear()
    layers = dict(rows(R.longest_path_layers(edges(spark, path)), "node", "layer"))
    assert layers == {**{name(i): i for i in range(n + 1)}, **{f"twig{i}": i + 1 for i in range(0, n, 1000)}}
    assert len(rounds) < 60


@pytest.mark.parametrize("limit", [2000, 3])
def test_bottleneck_closure_equals_thresholds(spark, limit):
    rng = random.Random(limit)
    data = {("a", "b|c"): 6, ("a|b", "c"): 12, ("z", "z"): 25}
    table = [(*key, p, c, rng.randrange(5)) for key, n in data.items() for p, c in random_pairs(rng, n, 2 * n)]
    e = spark.createDataFrame(table, "graph_id string, ranker string, parent string, child string, level long")
    want = {}
    for key in data:
        for level in range(5):
            want |= {(*key, *x): level for x in distances([(p, c) for g, r, p, c, v in table if (g, r) == key and v >= level])}
    got = {tuple(r)[:4]: r.level for r in R.bottleneck_closure(e, ("graph_id", "ranker"), limit).collect()}
    assert got == want


def test_least_key_equals_closure(spark):
    rng = random.Random(9)
    pairs = random_pairs(rng, 60, 90)
    closed = distances(pairs)
    nodes = sorted({x for p in pairs for x in p})
    key = {v: k for k, v in enumerate(rng.sample(nodes, 25))}
    got = dict(rows(R.least_reaching(edges(spark, pairs), spark.createDataFrame([("g", v, k) for v, k in key.items()], "graph_id string, node string, key int")), "node", "least"))
    want = {v: min((k for u, k in key.items() if u == v or (u, v) in closed), default=None) for v in nodes}
    assert got == {v: k for v, k in want.items() if k is not None}


def test_closure_on_cycles_and_empty(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("x", "x")])
    want = {("a", "a"), ("a", "b"), ("b", "a"), ("b", "b"), ("a", "c"), ("b", "c"), ("x", "x")}
    assert rows(R.transitive_closure(e), "ancestor", "descendant") == want
    assert rows(R.small_closures(e), "ancestor", "descendant") == want
    assert rows(R.small_closures(e, max_nodes=2), "ancestor", "descendant") == want
    assert R.transitive_closure(edges(spark, [])).count() == 0


def test_scc_and_cycle_breaking(spark):
    e = edges(spark, [("r", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")])
    assert dict(rows(R.scc(e), "node", "scc")) == {"r": "r", "a": "a", "b": "a", "c": "a", "d": "d"}
    out = R.break_cycles(e)
    kept = rows(out, "parent", "child")
    assert kept <= rows(e, "parent", "child") and {("r", "a"), ("c", "d")} <= kept and ("d", "d") not in kept
    assert [r.is_dag for r in R.is_dag(out).collect()] == [True]
    assert [r.is_dag for r in R.is_dag(e).collect()] == [False]


def test_weighted_cycle_breaking_drops_heaviest(spark):
    e = spark.createDataFrame([("g", "a", "b", 1.0), ("g", "b", "a", 5.0), ("g", "b", "c", 9.0)], "graph_id string, parent string, child string, weight double")
    assert rows(R.break_cycles(e, "weight"), "parent", "child") == {("a", "b"), ("b", "c")}
    with pytest.raises(ValueError):
        R.break_cycles(e, "other")


def test_condense_synonyms(spark):
    e = edges(spark, [("dog", "hound"), ("hound", "dog"), ("animal", "dog"), ("hound", "pup")])
    out, mapping = R.condense_synonyms(e)
    assert rows(out, "parent", "child") == {("animal", "dog (dog, hound)"), ("dog (dog, hound)", "pup")}
    assert dict(rows(mapping, "node", "cluster"))["hound"] == "dog (dog, hound)"


def test_components_of_a_long_chain(spark):
    e = edges(spark, [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(120)] + [("x", "y")])
    got = rows(R.weak_components(e), "node", "component")
    assert {c for _, c in got} == {"n000", "x"} and len(got) == 123


def test_layers_depths_roots(spark):
    pairs = random_pairs(random.Random(4), 40, 70, acyclic=True)
    e = edges(spark, pairs)
    layer = dict.fromkeys({x for p in pairs for x in p}, 0)
    for _ in layer:
        layer |= {c: max(layer[p] + 1 for p, d in pairs if d == c) for _, c in pairs}
    assert dict(rows(R.longest_path_layers(e), "node", "layer")) == layer
    tops, far = {p for p, _ in pairs} - {c for _, c in pairs}, distances(pairs)
    assert dict(rows(R.min_depth(e), "node", "depth")) == {v: min(0 if v in tops else far.get((r, v), 99) for r in tops) for v in layer}
    two = edges(spark, [("a", "b"), ("c", "d")])
    rooted = R.add_virtual_root(two)
    assert rows(rooted, "parent", "child") == {("a", "b"), ("c", "d"), ("virtual_root", "a"), ("virtual_root", "c")}
    assert rows(R.drop_virtual_root(rooted), "parent", "child") == rows(two, "parent", "child")
    single = edges(spark, [("a", "b"), ("a", "c")])
    assert rows(R.add_virtual_root(single), "parent", "child") == rows(single, "parent", "child")


def test_sample_is_closed_and_split_is_disjoint(spark):
    e = edges(spark, [(f"r{i % 3}", f"m{i}") for i in range(12)] + [(f"m{i}", f"l{i}{j}") for i in range(12) for j in range(3)])
    sample = R.closed_sample(e, 10)
    nodes = {r.node for r in R.nodes_of(sample).collect()}
    assert len(nodes) >= 10
    ups = {r.parent for r in e.where(F.col("child").isin(list(nodes))).collect()}
    assert ups <= nodes
    test, train = R.branch_split(e)
    a, b = ({r.node for r in R.nodes_of(x).collect()} for x in (test, train))
    assert a and b and not a & b
    again = R.branch_split(e.repartition(7))[1]
    assert rows(again, "parent", "child") == rows(train, "parent", "child")


def test_single_branch_trains_and_leaves_no_test(spark):
    test, train = R.branch_split(edges(spark, [("a", "b"), ("b", "c")]))
    assert test.count() == 0 and train.count() == 2


def test_explode_graph(spark):
    e = edges(spark, [("a|b", "c")])
    assert rows(R.explode_graph(e), "parent", "child") == {("a", "b"), ("b", "a"), ("a", "c"), ("b", "c")}


def test_many_graphs_at_once(spark):
    e = edges(spark, [("p", "q"), ("q", "r")], "one").union(edges(spark, [("a", "b")], "two"))
    assert R.transitive_closure(e).groupBy("graph_id").count().collect().__len__() == 2
    assert R.transitive_closure(e).where("graph_id = 'two'").count() == 1


def test_strong_sets_and_weighted_cycles_equal_brute_force(spark):
    rng = random.Random(7)
    graphs = {f"g{i}": sorted({(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", float(rng.randrange(5))) for _ in range(2 * n)}) for i, n in enumerate([3, 5, 8, 12, 20] * 20)}
    frame = spark.createDataFrame([(g, *e) for g, es in graphs.items() for e in es], "graph_id string, parent string, child string, weight double")
    frame = frame.groupBy("graph_id", "parent", "child").agg(F.max("weight").alias("weight"))

    def reach(pairs):
        out = set(pairs)
        while more := {(a, d) for a, b in out for c, d in pairs if b == c} - out:
            out |= more
        return out

    weights = {(r.graph_id, r.parent, r.child): r.weight for r in frame.collect()}
    want, kept = set(), set()
    for g in graphs:
        own = {(p, c): w for (x, p, c), w in weights.items() if x == g}
        closed = reach(own)
        for n in {x for e in own for x in e}:
            want.add((g, n, min([n] + [m for m in {x for e in own for x in e} if (n, m) in closed and (m, n) in closed])))
        left = {e for e in own if e[0] != e[1]}
        # An edge on a cycle goes, the heaviest first: what is on none never comes to be on one.
        for e in sorted(left, key=lambda e: (-own[e], e)):
            if (e[1], e[0]) in reach(left):
                left = left - {e}
        kept |= {(g, *e) for e in left}
    assert {(r.graph_id, r.node, r.scc) for r in R.scc(frame).collect()} == want
    few = frame.where("graph_id in ('g1', 'g2', 'g3', 'g4')")
    assert {(r.graph_id, r.node, r.scc) for r in R.scc(few, 2).collect()} == {w for w in want if w[0] in ("g1", "g2", "g3", "g4")}
    assert {(r.graph_id, r.parent, r.child) for r in R.break_cycles(frame, "weight").collect()} == kept


def test_broken_cycles_keep_repeated_rows(spark):
    e = edges(spark, [("a", "b"), ("a", "b"), ("b", "c"), ("b", "c"), ("c", "b"), ("c", "b"), ("c", "c")])
    assert sorted(tuple(r) for r in R.break_cycles(e).select("parent", "child").collect()) == [("a", "b")] * 2 + [("b", "c")] * 2


def test_large_graphs_of_small_components_need_no_joins(spark, monkeypatch):
    e = edges(spark, [(f"n{i}-{j}", f"n{i}-{(j * 7 + 1) % 5}") for i in range(8) for j in range(5)])
    want = rows(R.small_closures(e), "ancestor", "descendant"), rows(R.scc(e), "node", "scc"), rows(R.is_dag(e), "graph_id", "is_dag")
    for name in ("transitive_closure", "_core"):
        monkeypatch.setattr(R, name, None)
    assert (rows(R.small_closures(e, 5), "ancestor", "descendant"), rows(R.scc(e, 5), "node", "scc"), rows(R.is_dag(e, 5), "graph_id", "is_dag")) == want


def test_reach_is_counted_with_and_without_nulls(spark):
    """No path goes through a null, but one may start or end in it."""
    pairs = [("a", "b"), ("b", "c"), ("b", None), (None, "c"), ("c", "d"), ("d", "c")]
    e = edges(spark, pairs)
    want = {("a", "b", 1), ("a", "c", 2), ("a", None, 2), ("a", "d", 3), ("b", "c", 1), ("b", None, 1), ("b", "d", 2), (None, "c", 1), (None, "d", 2), ("c", "d", 1), ("c", "c", 2), ("d", "c", 1), ("d", "d", 2)}
    assert rows(R.transitive_closure(e), "ancestor", "descendant", "hops") == want
    assert rows(R.reach_counts(e), "ancestor", "n", "most") == {("a", 4, 3), ("b", 3, 2), (None, 2, 2), ("c", 2, 2), ("d", 2, 2)}
    whole = edges(spark, [p for p in pairs if None not in p])
    assert rows(R.reach_counts(whole), "ancestor", "n", "most") == {("a", 3, 3), ("b", 2, 2), ("c", 2, 2), ("d", 2, 2)}


def test_a_closure_ends_with_its_last_pair_that_goes_on(spark, monkeypatch):
    """Two levels take one round: its pairs end in leaves."""
    names, write = [], R.written
    monkeypatch.setattr(R, "written", lambda df, name: names.append(name) or write(df, name))
    assert rows(R.transitive_closure(edges(spark, [("a", "b"), ("b", "c"), ("b", "d")])), "ancestor", "descendant", "hops") == {("a", "b", 1), ("b", "c", 1), ("b", "d", 1), ("a", "c", 2), ("a", "d", 2)}
    assert names.count("closure") == 2


def test_layers_follow_each_edge_once(spark, monkeypatch):
    """A ladder six deep: a table a layer and a few more, where levels of a closure or peeled cores took dozens; a graph
    with a cycle counts ancestors beside it, and too few rounds give the same through chains."""
    pairs = [(f"{x}{i}", f"{y}{i + 1}") for i in range(6) for x in "ab" for y in "ab"]
    e = edges(spark, pairs, "ladder").union(edges(spark, [("r", "s"), ("s", "t"), ("t", "s"), ("t", "u")], "cycle"))
    rounds, real = [], R.written
    monkeypatch.setattr(R, "written", lambda df, what: rounds.append(what) or real(df, what))
    want = {("ladder", f"{x}{i}", i) for x in "ab" for i in range(7)} | {("cycle", "r", 0), ("cycle", "s", 2), ("cycle", "t", 2), ("cycle", "u", 3)}
    assert rows(R.longest_path_layers(edges(spark, pairs, "ladder")), "graph_id", "node", "layer") == {x for x in want if x[0] == "ladder"}
    assert len(rounds) < 16
    assert rows(R.longest_path_layers(e), "graph_id", "node", "layer") == want
    assert rows(R.longest_path_layers(e, rounds=2), "graph_id", "node", "layer") == want


def test_pairs_of_a_closure_are_counted_without_names(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")], "g").union(edges(spark, [("a", "b")], "h"))
    want = {r[R.G]: r["count"] for r in R.transitive_closure(e).where("ancestor <> descendant").groupBy(R.G).count().collect()}
    sizes = R.closure_sizes(e)
    assert dict(rows(sizes, R.G, "n")) == want == {"g": 7, "h": 1}


def test_edges_are_made_once_for_a_virtual_root(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    e = edges(spark, [("a", "b"), ("c", "d"), ("a", "d")]).withColumn("parent", F.udf(seen, "string").asNondeterministic()("parent"))
    assert len(R.add_virtual_root(e).collect()) == 5
    assert made.value == 3
