"""Operators on edge tables (graph_id, parent, child). One call works on any number of graphs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions.stats import numbered, running_totals
from treeline.functions.text import lemma_of, parse_lemma
from treeline.tables import written

G = "graph_id"
VIRTUAL_ROOT = "virtual_root"
#: Stands for "not reachable from a root" where nodes are ordered by depth.
UNREACHED = 1 << 30


def edges_of(e: DataFrame) -> DataFrame:
    return e.select(G, "parent", "child").distinct()


def nodes_of(e: DataFrame) -> DataFrame:
    return e.select(G, F.col("parent").alias("node")).union(e.select(G, "child")).distinct()


def roots_of(e: DataFrame) -> DataFrame:
    return e.select(G, F.col("parent").alias("node")).distinct().join(e.select(G, F.col("child").alias("node")), [G, "node"], "left_anti")


def node_ids(e: DataFrame) -> DataFrame:
    """(graph_id, node, id): numbers that no two nodes share, of whatever graph. They are written, since they are given
    out anew each time they are computed."""
    return written(nodes_of(e).withColumn("id", F.monotonically_increasing_id()), "node-ids")


def as_ids(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct edges as numbers (a, d) of ``nodes``."""
    a, d = (nodes.select(G, F.col("node").alias(end), F.col("id").alias(x)) for end, x in (("parent", "a"), ("child", "d")))
    return edges_of(e).join(a, [G, "parent"]).join(d, [G, "child"]).select("a", "d")


def close_pairs(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, a, d, hops): all pairs joined by a path over the distinct ``edges`` (by, a, d), with the length of the
    shortest. Nodes on cycles reach themselves.

    Each round doubles the length of the paths that are known: a shortest path of h + 1 to 2h edges is one of h edges
    and a known one. So only the pairs at distance h are extended, rounds are as many as the logarithm of the longest
    shortest path, and each is written. Pairs that end in a leaf are marked and never extended; without another pair at
    distance h there is none beyond.
    """
    on = edges.select(*by, F.col("a").alias("d"), F.lit(True).alias("_on")).distinct()
    known = written(edges.join(on, [*by, "d"], "left").select(*by, "a", "d", F.lit(1).alias("hops"), F.col("_on").isNotNull().alias("_on")), "closure")
    far, h = known.where("_on"), 1
    while not far.isEmpty():
        ahead = known.select(*by, F.col("a").alias("_via"), "d", (F.col("hops") + h).alias("hops"), "_on")
        found = far.select(*by, "a", F.col("d").alias("_via")).join(ahead, [*by, "_via"]).select(*by, "a", "d", "hops", "_on")
        # What was known has at most h edges, and what is found has more.
        new = known.union(found).groupBy(*by, "a", "d").agg(F.min("hops").alias("hops"), F.max("_on").alias("_on"))
        new = written(new.where(F.col("hops") > h), "closure")
        known, h = known.union(new), 2 * h
        far = new.where((F.col("hops") == h) & F.col("_on"))
    return known.drop("_on")


def _closed_ids(e: DataFrame, numbers: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(pairs, nodes): the closure as ``numbers`` of nodes; without, or where a name or a graph is null, which no path
    goes through, the closure (graph_id, a, d, hops) of names, and no nodes."""
    base = written(edges_of(e), "edges")
    nodes = node_ids(base) if numbers else None
    if nodes is None or not nodes.where(f"{G} is null or node is null").isEmpty():
        return close_pairs(base.select(G, F.col("parent").alias("a"), F.col("child").alias("d")), (G,)), None
    return close_pairs(as_ids(base, nodes)), nodes


def transitive_closure(e: DataFrame) -> DataFrame:
    """(graph_id, ancestor, descendant, hops): all pairs joined by a path of one or more edges, with the length of
    the shortest. Nodes on cycles reach themselves. Paths are joined as numbers; names are put back at the end."""
    pairs, nodes = _closed_ids(e)
    if nodes is None:
        return pairs.select(G, F.col("a").alias("ancestor"), F.col("d").alias("descendant"), "hops")
    a = nodes.select(G, F.col("node").alias("ancestor"), F.col("id").alias("a"))
    d = nodes.select(F.col("node").alias("descendant"), F.col("id").alias("d"))
    return pairs.join(a, "a").join(d, "d").select(G, "ancestor", "descendant", "hops")


def closure_sizes(e: DataFrame) -> DataFrame:
    """(graph_id, n): how many pairs of different nodes are joined by a path, in graphs that have any. Pairs stay numbers
    of nodes: only a count for each node gets its graph."""
    pairs, nodes = _closed_ids(e)
    if nodes is None:
        return pairs.where("a <> d").groupBy(G).agg(F.count("*").alias("n"))
    counts = pairs.where("a <> d").groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"))
    return counts.join(nodes, "id").groupBy(G).agg(F.sum("n").alias("n"))


def reach_counts(e: DataFrame, numbers: bool = True) -> DataFrame:
    """(graph_id, ancestor, n, most): how many nodes each node reaches, and how far the furthest of them is. Nodes that
    reach none are left out. Without ``numbers`` paths are joined by names: for graphs of so few levels that numbering
    their nodes costs more than it saves."""
    pairs, nodes = _closed_ids(e, numbers)
    count = [F.count("*").alias("n"), F.max("hops").alias("most")]
    if nodes is None:
        return pairs.groupBy(G, F.col("a").alias("ancestor")).agg(*count)
    return pairs.groupBy(F.col("a").alias("id")).agg(*count).join(nodes, "id").select(G, F.col("node").alias("ancestor"), "n", "most")


def _order(n: int, a: np.ndarray, d: np.ndarray) -> tuple[list[int], list[int], list[list[int]]]:
    """(nodes, each after its parents; nodes on cycles and below; children of each node) of a graph of numbers below n."""
    children: list[list[int]] = [[] for _ in range(n)]
    open_parents = np.bincount(d, minlength=n).tolist()
    for x, y in zip(a.tolist(), d.tolist(), strict=True):
        children[x].append(y)
    done = [i for i in range(n) if not open_parents[i]]
    for x in done:
        for y in children[x]:
            open_parents[y] -= 1
            if not open_parents[y]:
                done.append(y)
    return done, [i for i in range(n) if open_parents[i]], children


def _spread_down(one: np.ndarray, more: np.ndarray, order: tuple[list[int], list[int], list[list[int]]]) -> None:
    """Adds to the rows ``more`` of a node what its parents have in ``one`` (edges) or ``more`` (longer paths)."""
    first, cyclic, children = order
    some = (one.any(axis=1) | more.any(axis=1)).tolist()
    for x in first:
        if some[x] and children[x]:
            row = one[x] | more[x]
            for y in children[x]:
                more[y] |= row
                some[y] = True
    grew = bool(cyclic)
    while grew:
        grew = False
        for x in cyclic:
            row = one[x] | more[x]
            for y in children[x]:
                if (row & ~more[y]).any():
                    more[y] |= row
                    grew = True


def bottleneck_closure(e: DataFrame, by: tuple[str, ...] = (G,), max_nodes: int = 2000, few: int = 16, max_edges: int = 1 << 20) -> DataFrame:
    """(by, ancestor, descendant, level): for each pair joined by a path, the highest level that all edges of some path
    reach. ``e`` is (by, parent, child, level), level an integer; a graph is what has one value of ``by``.

    Graphs of up to ``max_edges`` edges in ``few`` levels at most are closed in one pass, each once a level, for some
    sources at a time. So are other graphs of up to ``max_nodes`` nodes, each by adding its edges from the highest level
    down: the pairs that an edge is the first to join have its level. In what is left pairs that have risen are joined with
    known pairs until none rises any more, in as many rounds as the logarithm of the longest path.
    """
    by = list(by)
    e = e.groupBy(*by, "parent", "child").agg(F.max("level").cast("long").alias("level"))
    kinds = dict(e.dtypes)
    kind = ", ".join([*(f"{k} {kinds[k]}" for k in by), f"ancestor {kinds['parent']}, descendant {kinds['parent']}, level long"])
    flat = e.groupBy(*by).agg(F.count("*").alias("_n"), F.count_distinct("level").alias("_l")).where((F.col("_n") <= max_edges) & (F.col("_l") <= few))
    flat = written(flat.select(*by), "flat")

    def by_levels(group: pd.DataFrame) -> pd.DataFrame:
        names, codes = np.unique(np.concatenate((group["parent"], group["child"])), return_inverse=True)
        n, m, level = len(names), len(group), group["level"].to_numpy()
        a, d, parts = codes[:m], codes[m:], []
        steps = [(x, level >= x) for x in sorted(set(level.tolist()), reverse=True)]
        orders = [_order(n, a[on], d[on]) for _, on in steps]
        width = max(64, min(n, (1 << 26) // n))
        for start in range(0, n, width):
            end, known = min(n, start + width), np.zeros((n, min(n, start + width) - start), bool)
            for (x, on), order in zip(steps, orders, strict=True):
                own = on & (a >= start) & (a < end)
                one, more = np.zeros_like(known), np.zeros_like(known)
                one[d[own], a[own] - start] = True
                _spread_down(one, more, order)
                below, above = np.nonzero((one | more) & ~known)
                known |= one | more
                parts.append(pd.DataFrame({"ancestor": names[above + start], "descendant": names[below], "level": x}))
        out = pd.concat(parts)
        return pd.DataFrame({**{k: [group[k].iloc[0]] * len(out) for k in by}, **{c: out[c].to_numpy() for c in out}})

    quick = e.join(flat, by, "left_semi").groupBy(*by).applyInPandas(by_levels, kind)
    e = written(e.join(flat, by, "left_anti").select(*by, "parent", "child", "level"), "levelled")
    if e.isEmpty():
        return quick
    ends = e.select(*by, F.col("parent").alias("node")).union(e.select(*by, "child")).distinct()
    large = written(ends.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > max_nodes).select(*by), "large")

    def close(group: pd.DataFrame) -> pd.DataFrame:
        names, codes = np.unique(np.concatenate((group["parent"], group["child"])).astype(object), return_inverse=True)
        n, m = len(names), len(group)
        reach, level = np.zeros((n, n), bool), np.zeros((n, n), np.int64)
        order = np.argsort(-group["level"].to_numpy(), kind="stable")
        for p, c, x in zip(codes[:m][order], codes[m:][order], group["level"].to_numpy()[order], strict=True):
            if reach[p, c]:
                continue
            below = reach[c].copy()
            below[c] = True
            above = np.append(np.flatnonzero(reach[:, p] & ~reach[:, c]), [] if reach[p, p] else p).astype(int)
            fresh = below & ~reach[above]
            level[above] = np.where(fresh, x, level[above])
            reach[above] |= fresh
        a, d = np.nonzero(reach)
        return pd.DataFrame({**{k: group[k].iloc[0] for k in by}, "ancestor": names[a], "descendant": names[d], "level": level[a, d]})

    small = quick.union(e.join(large, by, "left_anti").groupBy(*by).applyInPandas(close, kind))
    if large.isEmpty():
        return small
    pair = [*by, "ancestor", "descendant"]
    known = new = written(e.join(large, by, "left_semi").select(*by, F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), "level"), "bottleneck")
    first = lambda df: df.select(*by, "ancestor", F.col("descendant").alias("_via"), F.col("level").alias("_l"))
    last = lambda df: df.select(*by, F.col("ancestor").alias("_via"), "descendant", "level")
    while True:
        found = first(new).join(last(known), [*by, "_via"]).union(first(known).join(last(new), [*by, "_via"]).select(*by, "_via", "ancestor", "_l", "descendant", "level"))
        found = found.groupBy(*pair).agg(F.max(F.least("_l", "level")).alias("level"))
        was = known.withColumnRenamed("level", "_was")
        new = written(found.join(was, pair, "left").where("_was is null or level > _was").select(*pair, "level"), "bottleneck-new")
        if new.isEmpty():
            return small.union(known)
        known = written(known.union(new).groupBy(*pair).agg(F.max("level").alias("level")), "bottleneck")


def _closed(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(names in order, matrix that is 1 where one reaches another) of a small graph: squared until nothing is added."""
    names, codes = np.unique(np.concatenate((group["parent"], group["child"])).astype(object), return_inverse=True)
    m = np.zeros((len(names), len(names)), dtype=np.float32)
    m[codes[: len(group)], codes[len(group) :]] = 1
    while True:
        grown = np.minimum(m + m @ m, 1)
        if (grown == m).all():
            return names, m
        m = grown


def _by_size(e: DataFrame, max_nodes: int) -> tuple[DataFrame, DataFrame]:
    """(edges of pieces of up to ``max_nodes`` nodes, with their ``_piece``; edges of larger ones). A piece is a graph or,
    of a graph over ``max_nodes`` nodes, a weak component: paths and strong sets never leave it."""
    e = written(edges_of(e), "sized")
    over = written(nodes_of(e).groupBy(G).agg(F.count("*").alias("_n")).where(F.col("_n") > max_nodes).select(G), "large")
    whole = e.join(over, G, "left_anti").withColumn("_piece", F.lit(None).cast("string"))
    if over.isEmpty():
        return whole, e.limit(0)
    large = e.join(over, G, "left_semi")
    part = written(weak_components(large).withColumnRenamed("component", "_piece"), "pieces")
    sizes = part.groupBy(G, "_piece").agg(F.count("*").alias("_n"))
    part = part.join(sizes, [G, "_piece"]).select(G, F.col("node").alias("parent"), "_piece", "_n")
    large = written(large.join(part, [G, "parent"]).select(G, "parent", "child", "_piece", "_n"), "large-edges")
    return whole.union(large.where(F.col("_n") <= max_nodes).drop("_n")), large.where(F.col("_n") > max_nodes).select(G, "parent", "child")


def small_closures(e: DataFrame, max_nodes: int = 2000) -> DataFrame:
    """The same pairs (without hops) for very many small graphs in one pass: each graph, or weak component of a large
    one, is one group, a Boolean matrix squared until nothing is added. Components over ``max_nodes`` nodes go through
    the joins instead, so no task ever holds more than such a matrix."""
    small, large = _by_size(e, max_nodes)

    def close(group: pd.DataFrame) -> pd.DataFrame:
        names, m = _closed(group)
        a, d = np.nonzero(m)
        key = group[G].iloc[0]
        return pd.DataFrame({G: [key.asDict() if hasattr(key, "asDict") else key] * len(a), "ancestor": names[a], "descendant": names[d]})

    kind = dict(e.dtypes)[G]
    out = small.groupBy(G, "_piece").applyInPandas(close, f"{G} {kind}, ancestor string, descendant string")
    if large.isEmpty():
        return out
    return out.union(transitive_closure(large).drop("hops"))


def transitive_reduction(e: DataFrame, c: DataFrame) -> DataFrame:
    """The edges of acyclic graphs that no longer path implies."""
    via = edges_of(e).withColumnRenamed("child", "_via")
    implied = via.join(c.select(G, F.col("ancestor").alias("_via"), F.col("descendant").alias("child")), [G, "_via"])
    return edges_of(e).join(implied.select(G, "parent", "child"), [G, "parent", "child"], "left_anti")


def implied_edges(c: DataFrame, reduction: DataFrame) -> DataFrame:
    r = reduction.select(G, F.col("parent").alias("ancestor"), F.col("child").alias("descendant"))
    return c.select(G, "ancestor", "descendant").join(r, [G, "ancestor", "descendant"], "left_anti")


def _chains(e: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(edges, chains): nodes of one parent and one child vanish, and each run of them becomes one edge. chains is
    (graph_id, node, head, tail, place, ring): the nodes before and after the run, the node's distance from head, and
    for runs that bite their tail the smallest node of the ring. None if there are no such nodes.

    Pointers double their reach each round, so rounds are as many as the logarithm of the longest run.
    """
    ends = e.select(G, F.col("child").alias("node"), F.col("parent").alias("_p"), F.lit(None).cast("string").alias("_c")).union(e.select(G, "parent", F.lit(None), "child"))
    ends = ends.groupBy(G, "node").agg(F.count("_p").alias("_in"), F.count("_c").alias("_out"), F.min("_p").alias("head"), F.min("_c").alias("tail"))
    inner = written(ends.where("_in = 1 and _out = 1 and head <> node").select(G, "node", "head", "tail"), "inner")
    n = inner.count()
    if not n:
        return e, None
    is_inner = lambda c, name: inner.select(G, F.col("node").alias(c), F.lit(True).alias(name))
    at = inner.join(is_inner("tail", "_t"), [G, "tail"], "left").join(is_inner("head", "_h"), [G, "head"], "left")
    at = written(at.select(G, "node", "head", "tail", F.lit(1).alias("place"), F.col("node").alias("ring"), F.col("_h").isNotNull().alias("_h"), F.col("_t").isNotNull().alias("_t")), "chains")
    reach = 1
    while reach < 2 * n and not at.where("_h or _t").isEmpty():
        ahead = at.select(G, F.col("node").alias("tail"), F.col("tail").alias("_tail"), F.col("ring").alias("_ring"), F.col("_t").alias("_more"))
        back = at.select(G, F.col("node").alias("head"), F.col("head").alias("_head"), F.col("place").alias("_place"), F.col("_h").alias("_less"))
        at = at.join(ahead, [G, "tail"], "left").join(back, [G, "head"], "left")
        at = at.select(
            G, "node", F.coalesce("_head", "head").alias("head"), F.coalesce("_tail", "tail").alias("tail"), (F.col("place") + F.coalesce("_place", F.lit(0))).alias("place"),
            F.least("ring", "_ring").alias("ring"), F.coalesce("_less", F.lit(False)).alias("_h"), F.coalesce("_more", F.lit(False)).alias("_t"),
        )
        at, reach = written(at, "chains"), 2 * reach
    first, second = (inner.select(G, F.col("node").alias(end)) for end in ("parent", "child"))
    outer = e.join(first, [G, "parent"], "left_anti")
    through = outer.join(at.select(G, F.col("node").alias("child"), "tail"), [G, "child"]).select(G, "parent", F.col("tail").alias("child"))
    rest = outer.join(second, [G, "child"], "left_anti").select(G, "parent", "child").union(through).distinct()
    return rest, at.select(G, "node", "head", "tail", "place", F.when(F.col("_t"), F.col("ring")).alias("ring"))


def _core(e: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(edges, chains): what is left when nodes without incoming or outgoing edges are taken away and chains become
    single edges, again and again. A graph is cyclic exactly if an edge or a ring is left."""
    left, chains = written(edges_of(e), "core"), []
    n = left.count()
    while n:
        now = left.join(left.select(G, F.col("child").alias("parent")).distinct(), [G, "parent"], "left_semi")
        now = now.join(left.select(G, F.col("parent").alias("child")).distinct(), [G, "child"], "left_semi")
        left = written(now.select(G, "parent", "child"), "core")
        m = left.count()
        if 0 < 2 * m > n:
            left, found = _chains(left)
            if found is not None:
                left = written(left, "core")
                m = left.count()
                chains.append(found)
        if m == n:
            break
        n = m
    return left, chains


def _small_sets(e: DataFrame) -> DataFrame:
    """(graph_id, node, scc, cyclic) of small pieces, each a Boolean matrix: cyclic nodes reach themselves."""

    def sets(group: pd.DataFrame) -> pd.DataFrame:
        names, m = _closed(group)
        key = group[G].iloc[0]
        both = (m * m.T > 0) | np.eye(len(names), dtype=bool)
        return pd.DataFrame({G: [key.asDict() if hasattr(key, "asDict") else key] * len(names), "node": names, "scc": names[both.argmax(axis=1)], "cyclic": m.diagonal() > 0})

    return e.groupBy(G, "_piece").applyInPandas(sets, f"{G} {dict(e.dtypes)[G]}, node string, scc string, cyclic boolean")


def is_dag(e: DataFrame, max_nodes: int = 2000) -> DataFrame:
    """(graph_id, is_dag). Of weak components over ``max_nodes`` nodes sources, sinks and chains are taken away until no
    edge is left, or none can be; smaller ones are closed."""
    small, large = _by_size(e, max_nodes)
    out = _small_sets(small).select(G, "cyclic")
    if not large.isEmpty():
        core, chains = _core(large)
        out = out.union(large.select(G, F.lit(False))).union(core.select(G, F.lit(True)))
        for c in chains:
            out = out.union(c.where("ring is not null").select(G, F.lit(True)))
    return out.groupBy(G).agg((~F.bool_or("cyclic")).alias("is_dag"))


def scc(e: DataFrame, max_nodes: int = 2000) -> DataFrame:
    """(graph_id, node, scc): strongly connected sets, each named by its smallest node. Graphs and weak components of up
    to ``max_nodes`` nodes are closed, all in one pass. Of larger ones, what lies on no cycle is taken off and chains are shortened
    before the rest is coloured, so no table of all pairs is made."""
    small, large = _by_size(e, max_nodes)
    out = _small_sets(small).select(G, "node", "scc")
    if large.isEmpty():
        return out
    core, chains = _core(large)
    label = _coloured(core)
    for chain in reversed(chains):  # a run is part of a set if both its ends are
        label = written(label, "labels")
        ends = [label.select(G, F.col("node").alias(end), F.col("scc").alias(f"_{end}")) for end in ("head", "tail")]
        own = chain.join(ends[0], [G, "head"], "left").join(ends[1], [G, "tail"], "left")
        inside = F.coalesce("_head", "head") == F.coalesce("_tail", "tail")
        own = own.select(G, "node", F.when(F.col("ring").isNotNull(), F.col("ring")).when(inside, F.col("_head")).alias("scc"))
        label = label.union(own.where("scc is not null"))
    named = label.groupBy(G, "scc").agg(F.min("node").alias("_least"))
    label = label.join(named, [G, "scc"]).select(G, "node", F.col("_least").alias("scc"))
    return out.union(nodes_of(large).join(label, [G, "node"], "left").select(G, "node", F.coalesce("scc", "node").alias("scc")))


def least_reaching(e: DataFrame, keys: DataFrame) -> DataFrame:
    """(graph_id, node, least): the smallest key among the nodes that reach a node, itself included. ``keys`` is
    (graph_id, node, key), each key of one node of its graph; nodes that no key reaches are left out.

    Only keys that have just fallen are passed on, along edges; and a node also takes the key of the node whose key it
    has, which reaches it as well. So each round moves as many rows as keys have fallen, and far less than a closure.
    """
    base = written(edges_of(e), "reach-edges")
    state = nodes_of(base).union(keys.select(G, "node")).distinct().join(keys.select(G, "node", "key"), [G, "node"], "left")
    state = written(state.select(G, "node", "key", F.col("key").alias("least"), F.col("key").isNotNull().alias("_fell")), "least")
    while not state.where("_fell").isEmpty():
        passed = state.where("_fell").select(G, F.col("node").alias("parent"), "least").join(base, [G, "parent"]).select(G, F.col("child").alias("node"), "least")
        owner = state.where("least < key").select(G, F.col("key").alias("least"), F.col("least").alias("_l"))
        jumped = state.where("least is not null").select(G, "node", "least").join(owner, [G, "least"]).select(G, "node", F.col("_l").alias("least"))
        told = passed.union(jumped).groupBy(G, "node").agg(F.min("least").alias("_told"))
        fell = F.col("_told").isNotNull() & (F.col("least").isNull() | (F.col("_told") < F.col("least")))
        state = state.join(told, [G, "node"], "left").select(G, "node", "key", F.least("least", "_told").alias("least"), fell.alias("_fell"))
        state = written(state, "least")
    return state.where("least is not null").select(G, "node", "least")


def _coloured(e: DataFrame) -> DataFrame:
    """(graph_id, node, scc) by colouring: every node takes the smallest name that reaches it. The nodes of one colour
    that reach the node of that name are its strongly connected set; they go, and the rest is coloured anew. Tables
    are as large as the edges."""
    left = written(edges_of(e), "colour-edges")
    done = [left.select(G, F.col("parent").alias("node"), F.col("child").alias("scc")).limit(0)]
    while not left.isEmpty():
        colour = least_reaching(left, nodes_of(left).withColumn("key", F.col("node")))
        p, c = (colour.select(G, F.col("node").alias(x), F.col("least").alias(f"_{x}")) for x in ("parent", "child"))
        inside = left.join(p, [G, "parent"]).join(c, [G, "child"]).where("_parent = _child").select(G, F.col("child").alias("parent"), F.col("parent").alias("child"))
        # Seen backwards, the smallest name of a colour reaches exactly the nodes that reach it.
        back = least_reaching(inside, nodes_of(left).withColumn("key", F.col("node"))).select(G, "node", F.col("least").alias("_back"))
        found = written(colour.join(back, [G, "node"]).where("least = _back").select(G, "node", F.col("least").alias("scc")), "colour-sets")
        done.append(found)
        for end in ("parent", "child"):
            left = left.join(found.select(G, F.col("node").alias(end)), [G, end], "left_anti")
        left = written(left.select(G, "parent", "child"), "colour-edges")
    out = done[0]
    for found in done[1:]:
        out = out.union(found)
    return out


def _components(pairs: DataFrame) -> DataFrame:
    """(graph_id, node, component) over undirected pairs (graph_id, a, b): the component's smallest node.

    Nodes are ordered by a hash while they are contracted into their smallest neighbours, so long sorted chains
    shrink by a factor each round; the names are put back at the end.
    """
    key = lambda c: F.concat(F.lpad(F.hex(F.xxhash64(G, c)), 16, "0"), F.lit(":"), F.col(c))
    live = written(pairs.select(G, key("a").alias("a"), key("b").alias("b")).where("a <> b").distinct(), "components")
    found = live.select(G, F.col("a").alias("node")).union(live.select(G, "b")).distinct().withColumn("root", F.col("node"))
    found = written(found, "components")
    while not live.isEmpty():
        both = live.select(G, "a", "b").union(live.select(G, "b", "a"))
        up = both.groupBy(G, F.col("a").alias("root")).agg(F.min("b").alias("_m")).select(G, "root", F.least("root", "_m").alias("_up"))
        up = written(up, "parents")
        found = written(found.join(up, [G, "root"], "left").select(G, "node", F.coalesce("_up", "root").alias("root")), "components")
        a, b = (up.select(G, F.col("root").alias(x), F.col("_up").alias(f"_{x}")) for x in "ab")
        live = written(live.join(a, [G, "a"]).join(b, [G, "b"]).where("_a <> _b").select(G, F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), "components")
    name = F.substring("node", 18, 1 << 30)
    named = found.select(G, "root", name.alias("node"))
    return named.join(named.groupBy(G, "root").agg(F.min("node").alias("component")), [G, "root"]).select(G, "node", "component")


def mutual_components(e: DataFrame) -> DataFrame:
    """(graph_id, node, component): components over pairs that name each other as parent; every node has one."""
    e = edges_of(e)
    mutual = e.join(e.select(G, F.col("child").alias("parent"), F.col("parent").alias("child")), [G, "parent", "child"])
    found = _components(mutual.select(G, F.col("parent").alias("a"), F.col("child").alias("b")))
    return nodes_of(e).join(found, [G, "node"], "left").select(G, "node", F.coalesce("component", "node").alias("component"))


def weak_components(e: DataFrame) -> DataFrame:
    """(graph_id, node, component): components of the graphs without their directions."""
    found = _components(e.select(G, F.col("parent").alias("a"), F.col("child").alias("b")))
    return nodes_of(e).join(found, [G, "node"], "left").select(G, "node", F.coalesce("component", "node").alias("component"))


def condense_synonyms(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, mapping): nodes that name each other as parent become one node with all their forms; edges within
    it vanish. mapping is (graph_id, node, cluster)."""
    comp = written(mutual_components(e), "mutual")
    named = comp.groupBy(G, "component").agg(F.array_sort(F.collect_list("node")).alias("_all"))
    named = named.select(G, "component", F.when(F.size("_all") > 1, lemma_of(F.col("_all"))).otherwise(F.get("_all", F.lit(0))).alias("cluster"))
    mapping = comp.join(named, [G, "component"]).select(G, "node", "cluster")
    return relabel(e, mapping), mapping


def relabel(e: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with both ends replaced by their clusters; loops and repeats vanish."""
    p = mapping.select(G, F.col("node").alias("parent"), F.col("cluster").alias("_p"))
    c = mapping.select(G, F.col("node").alias("child"), F.col("cluster").alias("_c"))
    return e.join(p, [G, "parent"]).join(c, [G, "child"]).where("_p <> _c").select(G, F.col("_p").alias("parent"), F.col("_c").alias("child")).distinct()


def min_depth(e: DataFrame) -> DataFrame:
    """(graph_id, node, depth): distance from the nearest root. Nodes no root reaches are left out."""
    base = edges_of(e)
    found = written(roots_of(base).withColumn("depth", F.lit(0)), "depth")
    new, d = found, 0
    while True:
        d += 1
        reached = new.select(G, F.col("node").alias("parent")).join(base, [G, "parent"]).select(G, F.col("child").alias("node")).distinct()
        new = written(reached.join(found, [G, "node"], "left_anti").withColumn("depth", F.lit(d)), "depth")
        if new.isEmpty():
            return found
        found = written(found.union(new), "depth") if d % 8 == 0 else found.union(new)


def break_cycles(e: DataFrame, mode: str = "order") -> DataFrame:
    """Acyclic subgraphs. Edges between different strongly connected sets are never touched.

    ``order``: inside a set only edges that go up in (distance from the nearest root, name) stay: one pass, and
    acyclic because the order is strict. ``weight``: the heaviest edge (ties: smallest parent, then child) of
    each set that is left goes, until none is left; ``e`` has a column weight. Loops go in either mode; rows that
    repeat an edge stay as often as they are given.
    """
    if mode == "order":
        key = min_depth(e)
        sets = scc(e).join(key, [G, "node"], "left").withColumn("_key", F.struct(F.coalesce("depth", F.lit(UNREACHED)).alias("d"), F.col("node").alias("n")))
        sets = written(sets.select(G, "node", "scc", "_key"), "sets")
        p, c = (sets.select(G, F.col("node").alias(x), F.col("scc").alias(f"_s{x}"), F.col("_key").alias(f"_k{x}")) for x in ("parent", "child"))
        out = e.select(G, "parent", "child").join(p, [G, "parent"]).join(c, [G, "child"])
        return out.where("_sparent <> _schild or _kparent < _kchild").select(G, "parent", "child")
    if mode != "weight":
        raise ValueError("mode must be 'order' or 'weight'")
    return _lighten(e)


def _lighten(e: DataFrame) -> DataFrame:
    """The ``weight`` mode of ``break_cycles``. Edges are numbered in the order in which they would go. An edge goes
    exactly if it closes a cycle with edges of higher numbers: lower ones have gone, or lie on no cycle.

    So each edge has a number from which on its ends are in one strongly connected set, and these are found by halving,
    all blocks at once: a block (lo, hi) holds the edges for which it is in that range. The sets of its edges from the
    middle on tell to which half each edge belongs, and become single nodes in the lower half. As many passes as the
    logarithm of the edges, each over every edge once at most.
    """
    e = written(e.where("parent <> child").select(G, "parent", "child", "weight"), "lighten")
    ranked = written(numbered(e, [G], [F.desc("weight"), F.col("parent"), F.col("child")], "no", "hi"), "lighten-no")
    left = ranked.select(G, F.col("parent").alias("p"), F.col("child").alias("c"), "no", F.lit(0).alias("lo"), F.col("hi").cast("int").alias("hi"))
    gone = []
    while True:
        left = written(left, "lighten-blocks")
        if left.isEmpty():
            break
        mid = F.expr("(lo + hi + 1) div 2").cast("int")
        block = F.struct(G, "lo")
        # The same edges can have several numbers once nodes have become one.
        upper = left.where(F.col("no") >= mid).select(block.alias(G), F.col("p").alias("parent"), F.col("c").alias("child")).where("parent <> child")
        sets = written(scc(upper.distinct()).where("node <> scc").select(F.col(f"{G}.{G}").alias(G), F.col(f"{G}.lo").alias("lo"), "node", "scc"), "lighten-sets")
        to = lambda x: sets.select(G, "lo", F.col("node").alias(x), F.col("scc").alias(f"_{x}"))
        now = left.join(to("p"), [G, "lo", "p"], "left").join(to("c"), [G, "lo", "c"], "left").withColumns({"_p": F.coalesce("_p", "p"), "_c": F.coalesce("_c", "c"), "_mid": mid})
        one = F.col("_p") == F.col("_c")
        now = now.select(
            G, F.when(one, F.col("p")).otherwise(F.col("_p")).alias("p"), F.when(one, F.col("c")).otherwise(F.col("_c")).alias("c"), "no",
            F.when(one, F.col("_mid")).otherwise(F.col("lo")).alias("lo"), F.when(one, F.col("hi")).otherwise(F.col("_mid") - 1).alias("hi"),
        )
        now = written(now, "lighten-halves")
        # From ``lo`` on the ends are in one set: an edge of no higher number goes. Blocks without open edges are done.
        gone.append(now.where("no <= lo").select(G, "no"))
        still = now.where("no > lo and no <= hi").select(G, "lo").distinct()
        left = now.where("no > lo").join(still, [G, "lo"], "left_semi")
    out = ranked
    for g in gone:
        out = out.join(g, [G, "no"], "left_anti")
    return out.select(G, "parent", "child", "weight")


def add_virtual_root(e: DataFrame) -> DataFrame:
    """Graphs with more than one root get a common one. The edges are made once; one aggregate over their ends gives the
    roots."""
    base = written(edges_of(e), "rooted")
    ends = base.select(G, F.col("parent").alias("node"), F.lit(True).alias("_top")).union(base.select(G, "child", F.lit(False)))
    roots = written(ends.groupBy(G, "node").agg(F.bool_and("_top").alias("_top")).where("_top").select(G, "node"), "roots")
    several = roots.groupBy(G).agg(F.count("*").alias("_n")).where("_n > 1").select(G)
    return base.union(roots.join(several, G, "left_semi").select(G, F.lit(VIRTUAL_ROOT).alias("parent"), F.col("node").alias("child")))


def drop_virtual_root(e: DataFrame) -> DataFrame:
    return e.where((F.col("parent") != VIRTUAL_ROOT) & (F.col("child") != VIRTUAL_ROOT))


def node_degrees(e: DataFrame) -> DataFrame:
    """(graph_id, node, in_degree, out_degree, is_root, is_leaf)."""
    e = edges_of(e)
    ends = e.select(G, F.col("child").alias("node"), F.lit(1).alias("_in"), F.lit(0).alias("_out")).union(e.select(G, "parent", F.lit(0), F.lit(1)))
    out = ends.groupBy(G, "node").agg(F.sum("_in").alias("in_degree"), F.sum("_out").alias("out_degree"))
    return out.withColumn("is_root", F.col("in_degree") == 0).withColumn("is_leaf", F.col("out_degree") == 0)


def _peeled(e: DataFrame, rounds: int | None = None) -> tuple[DataFrame, bool]:
    """(layers, done): (graph_id, node, layer), the longest path from a root by the lengths ``_w`` of the edges, of nodes
    that no cycle leads to. Not done if ``rounds`` were too few.

    A node is settled in the round in which the last of its parents is, so each edge is followed once, as numbers. What is
    passed on between rounds are the nodes just settled, and those that some parents, but not all, have told of.
    """
    nodes = node_ids(e)
    a, d = (nodes.select(G, F.col("node").alias(end), F.col("id").alias(x)) for end, x in (("parent", "a"), ("child", "d")))
    base = written(e.join(a, [G, "parent"]).join(d, [G, "child"]).select("a", "d", "_w"), "peel-edges")
    need = base.groupBy("d").agg(F.count("*").alias("need"))
    roots = nodes.select("id").join(base.select(F.col("d").alias("id")), "id", "left_anti")
    base = written(base.join(need, "d").select("a", "d", "_w", "need"), "peel-needs")
    now = written(roots.select(F.col("id").alias("d"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("need"), F.lit(0).alias("layer")), "peel")
    found, recent, done = now, [], 0
    while not now.where("n = need").isEmpty():
        if done == rounds:
            return found, False
        told = now.where("n = need").select(F.col("d").alias("a"), "layer").join(base, "a").select("d", F.lit(1).cast("long").alias("n"), "need", (F.col("layer") + F.col("_w")).alias("layer"))
        every = told.union(now.where("n < need").select("d", "n", "need", "layer")).groupBy("d")
        now = written(every.agg(F.sum("n").alias("n"), F.max("need").alias("need"), F.max("layer").alias("layer")), "peel")
        recent.append(now.where("n = need"))
        done += 1
        if len(recent) == 16:
            for r in recent:
                found = found.union(r)
            found, recent = written(found, "peeled"), []
    for r in recent:
        found = found.union(r)
    return found.select(F.col("d").alias("id"), "layer").join(nodes, "id").select(G, "node", F.col("layer").cast("int").alias("layer")), True


def longest_path_layers(e: DataFrame, rounds: int = 26) -> DataFrame:
    """(graph_id, node, layer): length of the longest path from a root; in cyclic graphs the number of a node's
    ancestors instead. Nodes go layer by layer, and a graph is cyclic if some never go. Where ``rounds`` are too few,
    chains become one edge of their length, so that rounds follow the branchings on a path."""
    base = written(edges_of(e).where(f"{G} is not null"), "layers")
    out, done = _peeled(base.withColumn("_w", F.lit(1)), rounds)
    chain = None
    if not done:
        rest, chain = _chains(base)
        rest = rest.withColumn("_w", F.lit(1))
        if chain is not None:
            chain = written(chain, "layer-chains")
            long = chain.groupBy(G, F.col("head").alias("parent"), F.col("tail").alias("child")).agg((F.max("place") + 1).cast("int").alias("_l"))
            rest = rest.join(long, [G, "parent", "child"], "left").select(G, "parent", "child", F.greatest("_w", "_l").alias("_w"))
        out = _peeled(written(rest, "layer-edges"))[0]
    if chain is not None:
        out = written(out, "layers")
        heads = out.select(G, F.col("node").alias("head"), "layer")
        out = out.union(chain.join(heads, [G, "head"]).select(G, "node", (F.col("layer") + F.col("place")).cast("int").alias("layer")))
    every = written(nodes_of(base).join(out, [G, "node"], "left"), "layers")
    over = every.where("layer is null").select(G).distinct()
    if over.isEmpty():
        return every
    over = written(over, "cyclic")
    cyclic = base.join(over, G, "left_semi")
    above = small_closures(cyclic).where("ancestor <> descendant").groupBy(G, F.col("descendant").alias("node")).agg(F.count("*").cast("int").alias("layer"))
    return every.join(over, G, "left_anti").union(nodes_of(cyclic).join(above, [G, "node"], "left").select(G, "node", F.coalesce("layer", F.lit(0)).alias("layer")))


def reachable_subgraph(e: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges out of every node that the seeds (graph_id, node) reach."""
    base = edges_of(e)
    found = written(seeds.select(G, "node").distinct(), "reached")
    new = found
    while True:
        out = new.select(G, F.col("node").alias("parent")).join(base, [G, "parent"]).select(G, F.col("child").alias("node")).distinct()
        new = written(out.join(found, [G, "node"], "left_anti"), "reached")
        if new.isEmpty():
            return base.join(found.select(G, F.col("node").alias("parent")), [G, "parent"], "left_semi").select(G, "parent", "child")
        found = written(found.union(new), "reached")


def induced_subgraph(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    p, c = nodes.select(G, F.col("node").alias("parent")), nodes.select(G, F.col("node").alias("child"))
    return edges_of(e).join(p, [G, "parent"], "left_semi").join(c, [G, "child"], "left_semi").select(G, "parent", "child")


def hash_order(seed: int, *columns: str) -> Column:
    """A shuffle that depends on the values alone."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *columns))


def closed_sample(e: DataFrame, target_nodes: int = 100, seed: int = 42) -> DataFrame:
    """Nodes in shuffled order join the sample together with all their ancestors until it has ``target_nodes``
    nodes; the edges among them. A node is in as soon as the first of its descendants (or itself) is, so one
    running count finds where to stop."""
    nodes = numbered(nodes_of(edges_of(e)), [G], [hash_order(seed, "node"), F.col("node")], "_rank")
    nodes = written(nodes, "ranked")
    up = edges_of(e).select(G, F.col("child").alias("parent"), F.col("parent").alias("child"))
    first = written(least_reaching(up, nodes.withColumnRenamed("_rank", "key")).withColumnRenamed("least", "_first"), "first")
    joined = first.groupBy(G, "_first").agg(F.count("*").alias("_n"))
    running = running_totals(joined, [G], [F.col("_first")], {"_total": F.col("_n")})
    stop = running.groupBy(G).agg(F.coalesce(F.min(F.when(F.col("_total") >= target_nodes, F.col("_first"))), F.max("_first")).alias("_stop"))
    return induced_subgraph(e, first.join(stop, G).where("_first <= _stop").select(G, "node"))


def branch_split(e: DataFrame, ratio: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(test edges, train edges). A branch is a child of a root with all its descendants and that root; the
    first max(1, floor(ratio * n)) branches in shuffled order train, the rest test, and shared nodes are test
    nodes. Graphs without roots take every node for a root."""
    e = edges_of(e)
    roots = roots_of(e)
    tops = roots.union(nodes_of(e).join(roots.select(G).distinct(), G, "left_anti"))
    branch = tops.select(G, F.col("node").alias("parent")).join(e, [G, "parent"]).select(G, F.col("parent").alias("_root"), F.col("child").alias("_start"))
    branch = numbered(branch, [G], [hash_order(seed, "_root", "_start"), F.col("_root"), F.col("_start")], "_no", "_n")
    branch = written(branch.withColumn("_train", F.col("_no") <= F.greatest(F.lit(1), F.floor(F.col("_n") * ratio))).drop("_no", "_n"), "branches")
    # Keys of branches that test are smaller, so a node's least key tells whether any of its branches tests.
    starts = branch.groupBy(G, F.col("_start").alias("node")).agg(F.min("_train").alias("_t")).select(G, "node", F.concat(F.col("_t").cast("int").cast("string"), "node").alias("key"))
    member = least_reaching(e, starts).select(G, "node", F.substring("least", 1, 1).alias("_train"))
    member = member.union(branch.select(G, F.col("_root").alias("node"), F.col("_train").cast("int").cast("string")))
    member = written(member.groupBy(G, "node").agg((F.min("_train") == "1").alias("_train")), "members")
    return induced_subgraph(e, member.where("not _train")), induced_subgraph(e, member.where("_train"))


def explode_graph(e: DataFrame) -> DataFrame:
    """Every surface form a node of its own: forms of one node name each other as parent, and each form of a
    parent has each form of the child. No form is its own parent."""
    forms = nodes_of(e).select(G, parse_lemma("node").alias("_t"))
    cliques = forms.select(G, F.explode("_t").alias("parent"), "_t").select(G, "parent", F.explode("_t").alias("child"))
    across = edges_of(e).select(G, F.explode(parse_lemma("parent")).alias("parent"), parse_lemma("child").alias("_c")).select(G, "parent", F.explode("_c").alias("child"))
    return cliques.union(across).where("parent <> child").distinct()


def node_neighbourhood(e: DataFrame, asked: DataFrame, k: int = 6) -> DataFrame:
    """Per asked edge: the parent's parents and other children, the child's other parents and children (first k
    names, then how many more), and the child's children that the parent does not have itself."""
    e = edges_of(e)
    ends = {
        "parent_parents": e.select(G, F.col("child").alias("parent"), F.col("parent").alias("_n")),
        "parent_children": e.select(G, "parent", F.col("child").alias("_n")),
        "child_parents": e.select(G, "child", F.col("parent").alias("_n")),
        "child_children": e.select(G, F.col("parent").alias("child"), F.col("child").alias("_n")),
    }
    asked = asked.select(G, "parent", "child").distinct()
    parts = []
    for kind, near in ends.items():
        hit = asked.join(near, [G, kind.split("_")[0]])
        if kind == "parent_children":
            hit = hit.where("_n <> child")
        if kind == "child_parents":
            hit = hit.where("_n <> parent")
        parts.append(hit.select(G, "parent", "child", F.lit(kind).alias("kind"), "_n"))
    grand = asked.join(ends["child_children"], [G, "child"]).select(G, "parent", "child", "_n")
    apart = grand.join(e.select(G, "parent", F.col("child").alias("_n")), [G, "parent", "_n"], "left_anti")
    parts.append(apart.select(G, "parent", "child", F.lit("inconsistent").alias("kind"), "_n"))
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    one = Window.partitionBy(G, "parent", "child", "kind")
    every = every.withColumn("_r", F.row_number().over(one.orderBy("_n"))).withColumn("n", F.count("*").over(one)).where(F.col("_r") <= k)
    shown = every.groupBy(G, "parent", "child", "kind", "n").agg(F.array_join(F.array_sort(F.collect_list("_n")), ", ").alias("_s"))
    more = F.when(F.col("n") > k, F.concat(F.lit(", ... (+"), (F.col("n") - k).cast("string"), F.lit(" more)"))).otherwise("")
    return shown.select(G, "parent", "child", "kind", "n", F.concat("_s", more).alias("names"))


def concept_subgraph(e: DataFrame, text: str) -> DataFrame:
    """Edges with the text in one of their ends, whatever its case; further columns (such as a tag) stay."""
    return e.where(F.contains(F.lower("parent"), F.lit(text.lower())) | F.contains(F.lower("child"), F.lit(text.lower())))
