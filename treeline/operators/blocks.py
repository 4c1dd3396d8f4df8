"""Closures of two sides by blocks: nodes that sort together are closed in one task, and only what leaves a block is sent."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators.graph import G, _order, _spread_down
from treeline.tables import written

#: A block has up to 2 ** BITS nodes; sources are closed so many at a time, which bounds the memory of a task.
BITS, COLUMNS = 11, 1 << 14
#: Where more than one edge in CROSSING leaves its block, where a block is sent more sources than LETTERS or where rounds
#: are too few, blocks don't pay, and callers join paths instead. Results are the same.
CROSSING, LETTERS, ROUNDS = 8, 1 << 24, 12
INNER, LEAVES, SENT = 0, 1, 2
LETTER = "a long, d long, s int, kind int, p array<long>, g array<long>, n long"


class Blocks(NamedTuple):
    """``nodes`` is (graph_id, node, id); ``rows`` are the edges, each in the block of its end, or of its start if it
    leaves that; ``mail`` holds all ancestors of the start of each edge that comes from another block. ``columns``
    sources are closed at a time."""

    nodes: DataFrame
    rows: DataFrame
    mail: DataFrame
    columns: int


class Closed(NamedTuple):
    """What reaches the nodes of a block: ``own`` are their numbers, ``cols`` those of (a part of) the sources. Of each
    side ``direct`` are the edges and ``longer`` the pairs that a path of two or more edges joins."""

    own: np.ndarray
    cols: np.ndarray
    direct: list[np.ndarray]
    longer: list[np.ndarray]

    def pairs(self, side: int) -> np.ndarray:
        return self.direct[side] | self.longer[side]


def _close(group: pd.DataFrame, columns: int) -> Iterator[Closed]:
    """The closure of a block, for some sources at a time."""
    a, d, s, kind = (group[c].to_numpy() for c in ("a", "d", "s", "kind"))
    sent = kind == SENT
    far = [[x for x in group[c][sent]] for c in "pg"]
    own = np.unique(np.concatenate((a[~sent], d[kind == INNER], d[sent])))
    every = np.unique(np.concatenate((own, a[sent], *far[0], *far[1]))).astype(np.int64)
    inner = [(kind == INNER) & (s & bit > 0) for bit in (1, 2)]
    orders = [_order(len(own), np.searchsorted(own, a[i]), np.searchsorted(own, d[i])) for i in inner]
    for start in range(0, len(every), columns):
        cols = every[start : start + columns]
        direct, longer = [], []

        def put(m: np.ndarray, at: np.ndarray, sources: np.ndarray, cols: np.ndarray = cols) -> None:
            here = (sources >= cols[0]) & (sources <= cols[-1])
            m[at[here], np.searchsorted(cols, sources[here])] = True

        for side in (0, 1):
            one, more = np.zeros((len(own), len(cols)), bool), np.zeros((len(own), len(cols)), bool)
            ends = inner[side] | sent & (s & (side + 1) > 0)
            put(one, np.searchsorted(own, d[ends]), a[ends])
            at = np.searchsorted(own, d[sent])
            put(more, np.repeat(at, [len(x) for x in far[side]]), np.concatenate([np.zeros(0, np.int64), *far[side]]).astype(np.int64))
            _spread_down(one, more, orders[side])
            direct.append(one)
            longer.append(more)
        yield Closed(own, cols, direct, longer)


def _letters(group: pd.DataFrame, columns: int) -> pd.DataFrame:
    """What the edges that leave a block carry: all ancestors of their start."""
    out = group[group["kind"] == LEAVES]
    found: list[list[list[np.ndarray]]] = [[[] for _ in range(len(out))] for _ in "pg"]
    for c in _close(group, columns):
        at = np.searchsorted(c.own, out["a"].to_numpy())
        for side in (0, 1):
            reached = c.pairs(side)
            for i, (x, s) in enumerate(zip(at, out["s"], strict=True)):
                if s & (side + 1):
                    found[side][i].append(c.cols[reached[x]])
    p, g = ([np.concatenate([np.zeros(0, np.int64), *x]) for x in side] for side in found)
    out = {"a": out["a"], "d": out["d"], "s": out["s"], "kind": SENT, "p": p, "g": g, "n": [len(x) + len(y) for x, y in zip(p, g, strict=True)]}
    return pd.DataFrame(out, columns=list(out))


def _by_block(rows: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], kind: str) -> DataFrame:
    def each(group: pd.DataFrame) -> pd.DataFrame:
        return f(group)

    # A number of partitions, since there is little to read, and much to do.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "block").groupBy("block").applyInPandas(each, kind)


def blocks(pred: DataFrame, gt: DataFrame, bits: int = BITS, columns: int = COLUMNS, crossing: int = CROSSING) -> Blocks | None:
    """Both sides' distinct edges in blocks, with all that blocks tell each other; None where blocks don't pay. Names and
    graphs are not null.

    Nodes are numbered by graph, length of the name and name, so that names with running numbers stay together. Blocks
    send the ancestors of nodes that have an edge to another block, and again when these have grown: rounds are as many
    as blocks on a path. Tables of nodes and edges are packed well in files, so Spark would broadcast ones of many rows.
    """
    ends = pred.union(gt).select(G, F.col("parent").alias("node")).union(pred.union(gt).select(G, "child")).distinct()
    place = [G, F.length("node"), "node"]
    nodes = written(ends.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("id", F.monotonically_increasing_id()), "block-nodes")
    every = pred.select(G, "parent", "child", F.lit(1).alias("s")).union(gt.select(G, "parent", "child", F.lit(2))).groupBy(G, "parent", "child").agg(F.bit_or("s").alias("s"))
    a, d = (nodes.select(G, F.col("node").alias(end), F.col("id").alias(x)) for end, x in (("parent", "a"), ("child", "d")))
    of = lambda x: F.shiftright(x, bits)
    rows = every.join(a.hint("merge"), [G, "parent"]).join(d.hint("merge"), [G, "child"]).select("a", "d", "s", F.when(of("a") == of("d"), INNER).otherwise(LEAVES).alias("kind"))
    none = F.lit(None).cast("array<long>")
    rows = written(rows.select(of("a").alias("block"), "a", "d", "s", "kind", none.alias("p"), none.alias("g"), F.lit(0).cast("long").alias("n")), "block-rows")
    leaving = rows.where(F.col("kind") == LEAVES)
    n = rows.agg(F.count("*"), F.count_if(F.col("kind") == LEAVES)).first()
    if n[1] * crossing > n[0]:
        return None
    senders = leaving.select("block").distinct()
    send = lambda x: _by_block(x, partial(_letters, columns=columns), LETTER).select(of("d").alias("block"), "*")
    mail = fresh = written(send(rows.join(senders, "block", "left_semi")), "block-mail")
    for _ in range(ROUNDS):
        if fresh.isEmpty():
            return Blocks(nodes, rows, mail, columns)
        if mail.groupBy("block").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] > LETTERS:
            return None
        asked = senders.join(fresh.select("block").distinct(), "block", "left_semi")
        told = send(rows.union(mail).join(asked, "block", "left_semi"))
        fresh = written(told.join(mail.select("a", "d", F.col("n").alias("_n")).hint("merge"), ["a", "d"]).where("n > _n").select(*mail.columns), "block-fresh")
        mail = written(mail.join(fresh.select("a", "d").hint("merge"), ["a", "d"], "left_anti").select(*mail.columns).union(fresh), "block-mail")
    return None


def closed(b: Blocks, f: Callable[[Closed], pd.DataFrame], kind: str) -> DataFrame:
    """The rows that ``f`` makes of each block's closure, for some sources at a time."""

    columns = b.columns

    def each(group: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([f(c) for c in _close(group, columns)])

    # An edge that leaves a block has been sent to the block of its end.
    return _by_block(b.rows.where(F.col("kind") == INNER).union(b.mail), each, kind)


#: Counts of ``sizes``: pairs of the closure, edges, and edges that no longer path implies; of one side, the other, both.
COUNTS = [f"{what}_{which}" for what in ("closed", "raw", "red") for which in ("n_pred", "n_gt", "tp")]


def sizes(b: Blocks) -> DataFrame:
    """(graph_id, COUNTS, loops): counts by graph; loops: how many nodes reach themselves."""

    def count(c: Closed) -> pd.DataFrame:
        out = {"id": c.own}
        for what, (p, g) in {"closed": (c.pairs(0), c.pairs(1)), "raw": c.direct, "red": [one & ~more for one, more in zip(c.direct, c.longer, strict=True)]}.items():
            for which, m in (("n_pred", p), ("n_gt", g), ("tp", p & g)):
                out[f"{what}_{which}"] = m.sum(axis=1)
        either = (c.pairs(0) | c.pairs(1)) & (c.own[:, None] == c.cols[None, :])
        return pd.DataFrame({**out, "loops": either.any(axis=1).astype(np.int64)})

    rows = closed(b, count, "id long, " + ", ".join(f"{x} long" for x in [*COUNTS, "loops"]))
    return rows.join(b.nodes.hint("merge"), "id").groupBy(G).agg(*[F.sum(x).alias(x) for x in [*COUNTS, "loops"]])


def pairs(b: Blocks) -> DataFrame:
    """(a, d, ok, direct, longer): the closure of the first side as numbers; ok: the other side's has the pair too;
    direct: it is an edge; longer: a path of two or more edges joins it."""

    def each(c: Closed) -> pd.DataFrame:
        d, a = np.nonzero(c.pairs(0))
        return pd.DataFrame({"a": c.cols[a], "d": c.own[d], "ok": c.pairs(1)[d, a], "direct": c.direct[0][d, a], "longer": c.longer[0][d, a]})

    return closed(b, each, "a long, d long, ok boolean, direct boolean, longer boolean")
