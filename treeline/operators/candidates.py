"""Candidate edges from terms, vectors and perplexities, and the requests that ask for more."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions.stats import numbered
from treeline.functions.text import primary_term
from treeline.tables import written

G = "graph_id"


#: Characters of terms in a block: what an automaton is built from. It bounds memory and changes no result.
TERMS = 2_000_000


def lexical_edges(nodes: DataFrame, block_chars: int = TERMS) -> DataFrame:
    """``nodes(graph_id, node)``: u -> v if u's primary term is part of v's, differs from it and has over three
    characters.

    Terms lie in blocks. Every task that has rows of a block builds one automaton of the block's terms and runs its
    share of the graph's terms through it: each is read once a block, whatever its length, and neither its substrings
    nor pairs of terms are made.
    """
    terms = written(nodes.select(G, "node", primary_term("node").alias("_p")).distinct(), "terms")
    own = terms.select(G, "_p").distinct()
    needles = own.where(F.length("_p") > 3)
    # Graphs are taken as one table: a term of another graph is found and dropped in the join. Long graphs have blocks.
    size = needles.agg(F.sum(F.length("_p"))).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    block = F.pmod(F.xxhash64("_p"), F.lit(blocks)).cast("int").alias("_b")
    parts = needles.select(block, "_p").distinct().groupBy("_b").agg(F.collect_list("_p").alias("_needles"))
    texts = own.select("_p").distinct()
    shares = max(1, -(-texts.count() // 50_000))
    spread = texts.withColumn("_s", F.pmod(F.xxhash64("_p", F.lit(1)), F.lit(shares)).cast("int")).groupBy("_s").agg(F.collect_list("_p").alias("_texts"))
    spread = spread.select("_texts", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for needles, texts in zip(b["_needles"].to_pylist(), b["_texts"].to_pylist(), strict=True):
                machine = ahocorasick.Automaton()
                for w in needles:
                    machine.add_word(w, w)
                machine.make_automaton()
                inside, around = [], []
                for t in texts:
                    hits = {w for _, w in machine.iter(t)} - {t}
                    inside += hits
                    around += [t] * len(hits)
                yield pa.RecordBatch.from_pydict({"_in": inside, "_around": around}, schema=pa.schema([("_in", pa.string()), ("_around", pa.string())]))

    hits = spread.join(parts, "_b").repartition(blocks * shares).mapInArrow(found, "_in string, _around string")
    up = terms.select(G, F.col("_p").alias("_in"), F.col("node").alias("parent"))
    down = terms.select(G, F.col("_p").alias("_around"), F.col("node").alias("child"))
    return hits.join(up, "_in").join(down, [G, "_around"]).where("parent <> child").select(G, "parent", "child").distinct()


#: Pivots at most (their pairs of cells are a table on the driver), vectors per pivot wished for, and per block of a product.
PIVOTS, CELL, BLOCK = 256, 250, 2000
#: Shares that a side is cut into, each sent to the shares of the other one, and vectors per share at most: of more, there
#: are more shares. So what is shuffled grows with the vectors, not with their pairs, up to SHARES * SHARE of them.
SHARES, SHARE = 12, 100_000
#: Cosines no further apart than this are equal: products of the same vectors differ in their last bits by where they lie.
SAME = 1e-12


def _unit(v) -> np.ndarray:
    m = np.stack(list(v)).astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """Directions of ``n`` vectors spread over the table: of four times as many, drawn by a hash of their names, each
    next one is the furthest from those taken."""
    length = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    drawn = [r.vec for r in vectors.where(length > 0).orderBy(F.xxhash64("name"), "name").select("vec").limit(4 * n).collect()]
    if not drawn:
        return np.zeros((0, 1))
    unit, taken = _unit(drawn), [0]
    near = unit @ unit[0]
    while len(taken) < min(n, len(unit)):
        taken.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[taken[-1]])
    return unit[taken]


def _in_cells(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(name, vec, cell, angle): the pivot of least angle; -1 for vectors without a direction."""

    @F.pandas_udf("cell int, angle double")
    def nearest(vec: pd.Series) -> pd.DataFrame:
        unit = _unit(vec)
        none = ~unit.any(axis=1) | (len(pivots) == 0)
        near = unit @ pivots.T if len(pivots) else np.zeros((len(unit), 1))
        cell = near.argmax(axis=1)
        angle = np.arccos(np.clip(near[np.arange(len(unit)), cell], -1, 1))
        return pd.DataFrame({"cell": np.where(none, -1, cell).astype("int32"), "angle": np.where(none, 0.0, angle)})

    return written(vectors.select("name", "vec", nearest("vec").alias("_c")).select("name", "vec", "_c.*"), "cells")


def _summary(cells: DataFrame) -> dict[int, tuple[int, float, float]]:
    """{cell: (vectors, least angle, largest angle)}."""
    return {r.cell: (r.n, r.least, r.most) for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most")).collect()}


def _highest(pivots: np.ndarray, left: dict, right: dict) -> dict[tuple[int, int], float]:
    """{(cell of left, cell of right): what no cosine of their vectors exceeds}. The angle of two vectors is at least the
    angle between one and the other's pivot less the other's own, whichever side it is seen from."""
    between = np.arccos(np.clip(pivots @ pivots.T, -1, 1)) if len(pivots) else None
    out = {}
    for i, (_, low, most) in left.items():
        for j, (_, low_j, most_j) in right.items():
            if min(i, j) < 0:
                out[i, j] = 0.0  # no direction: all cosines are 0
            else:
                apart = between[i, j]
                gap = max(0.0, apart - most - most_j, low - apart - most_j, low_j - apart - most)
                out[i, j] = 1.0 if gap <= 0 else float(np.cos(gap))
    return out


def _intervals(side: dict[int, tuple[int, float, float]], shares: int) -> tuple[dict[int, int], list[set[int]]]:
    """Where each cell begins when a side's cells are laid end to end, and the cells that each of ``shares`` equal
    stretches of them holds."""
    starts, at, total = {}, 0, sum(x[0] for x in side.values())
    held = [set() for _ in range(shares)]
    for c in sorted(side):
        starts[c] = at
        at += side[c][0]
        for k in range(starts[c] * shares // total, (at - 1) * shares // total + 1):
            held[k].add(c)
    return starts, held


def _shared(left: DataFrame, right: DataFrame, met: list[tuple[int, int]], sizes: tuple[dict, dict]) -> tuple[DataFrame, int]:
    """(_k, side, cell, name, vec) and the number of keys: every vector goes to the pairs of shares that it is part of, at
    most SHARES of them up to SHARES * SHARE vectors a side. Shares are stretches of cells; ``met`` are the pairs of cells
    to compare, and pairs of shares without one are left out."""
    spark, counts = left.sparkSession, [sum(x[0] for x in side.values()) for side in sizes]
    shares = [max(1, min(SHARES, -(-n // BLOCK)), -(-n // SHARE)) for n in counts]
    laid = [_intervals(side, k) if side else ({}, [set()]) for side, k in zip(sizes, shares, strict=True)]
    wanted: dict[int, set[int]] = {}
    for i, j in met:
        wanted.setdefault(i, set()).add(j)
    pairs = []
    for i, cells in enumerate(laid[0][1]):
        others = set().union(*(wanted.get(c, set()) for c in cells))
        pairs += [(i, j) for j, own in enumerate(laid[1][1]) if others & own]
    table = F.broadcast(spark.createDataFrame([(n, i, j) for n, (i, j) in enumerate(pairs)], "_k int, _s0 int, _s1 int"))  # a row for each pair of shares

    def dealt(rows: DataFrame, side: int) -> DataFrame:
        starts = F.broadcast(spark.createDataFrame([(c, at, sizes[side][c][0]) for c, at in laid[side][0].items()], "cell int, _start long, _size long"))  # a row for each pivot
        share = F.floor((F.col("_start") + F.pmod(F.xxhash64("name"), F.col("_size"))) * shares[side] / max(1, counts[side])).cast("int")
        return rows.join(starts, "cell").withColumn(f"_s{side}", share).join(table, f"_s{side}").select("_k", F.lit(side).alias("side"), "cell", "name", "vec")

    return dealt(left, 0).union(dealt(right, 1)), max(1, len(pairs))


PAIR = pa.schema([("a", pa.string()), ("b", pa.string()), ("cosine", pa.float64())])


def _directions(rows: pa.Table) -> np.ndarray:
    return _unit(rows["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1))


def _stretches(cells: np.ndarray) -> list[tuple[int, slice]]:
    """(cell, rows) of sorted cells, BLOCK rows at most."""
    ends = np.append(np.flatnonzero(np.diff(cells)) + 1, len(cells))
    return [(int(cells[lo]), slice(at, min(at + BLOCK, hi))) for lo, hi in zip(np.append(0, ends[:-1]), ends, strict=True) for at in range(lo, hi, BLOCK)]


def _products(met: list[tuple[int, int]], threshold: float | None):
    wanted = set(met)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(list(batches))
        sides = [both.filter(pc.equal(both["side"], k)).sort_by([("cell", "ascending"), ("name", "ascending")]) for k in (0, 1)]
        if not (len(sides[0]) and len(sides[1])):
            return
        names = [x["name"].combine_chunks() for x in sides]
        code = pa.concat_arrays(names).dictionary_encode().indices.to_numpy()
        code = code[: len(names[0])], code[len(names[0]) :]
        u, v = (_directions(x) for x in sides)
        rows, columns = (_stretches(x["cell"].to_numpy()) for x in sides)
        for c, at in rows:
            own, place = np.full(at.stop - at.start, -np.inf), np.full(at.stop - at.start, -1)
            for d, other in columns:
                if (c, d) not in wanted:
                    continue
                s = u[at] @ v[other].T
                if np.isin(code[0][at], code[1][other]).any():
                    s[code[0][at][:, None] == code[1][other][None, :]] = -np.inf
                if threshold is not None:
                    i, j = np.nonzero(s > threshold)
                    yield pa.RecordBatch.from_arrays([names[0].take(pa.array(i + at.start)), names[1].take(pa.array(j + other.start)), pa.array(s[i, j])], schema=PAIR)
                    continue
                top = s.max(axis=1)
                j = (s >= top[:, None] - SAME).argmax(axis=1)
                tied = np.flatnonzero((np.abs(top - own) <= SAME) & (place >= 0) & np.isfinite(top))
                better = top > own
                better[tied] = [names[1][int(j[k] + other.start)].as_py() < names[1][int(place[k])].as_py() for k in tied]
                own, place = np.where(better, top, own), np.where(better, j + other.start, place)
            if threshold is None:
                some = np.flatnonzero(np.isfinite(own) & (place >= 0))
                yield pa.RecordBatch.from_arrays([names[0].take(pa.array(some + at.start)), names[1].take(pa.array(place[some])), pa.array(own[some])], schema=PAIR)

    return products


def cosine_pairs(left: DataFrame, right: DataFrame, threshold: float | None, skipped: list | None = None) -> DataFrame:
    """(a, b, cosine) of ``left(name, vec)`` and ``right(name, vec)`` by matrix products of blocks: pairs above
    the threshold, or, without one, the best b of each share per a (ties: the smallest name). A name is never
    compared with itself.

    Vectors lie in cells around pivots. The angles to the pivots bound every cosine between two cells, so pairs of
    cells that can't exceed the threshold are skipped; without a threshold, cells first meet themselves, and then only
    cells that can exceed the least of the best cosines found. Results are exact. ``skipped`` is given the share of
    pairs of vectors that were never compared.
    """
    left, right = (x.select("name", "vec").where("vec is not null and size(vec) > 0") for x in (left, right))
    n = right.count()
    pivots = _pivots(right, max(1, min(PIVOTS, n // CELL)))
    a, b = _in_cells(left, pivots), _in_cells(right, pivots)
    sizes = _summary(a), _summary(b)
    highest = _highest(pivots, *sizes)

    def compare(met: list[tuple[int, int]]) -> DataFrame:
        rows, keys = _shared(a, b, met, sizes)
        return rows.repartition(keys, "_k").groupBy("_k").applyInArrow(_products(met, threshold), "a string, b string, cosine double")

    if threshold is not None:
        met = [p for p, top in highest.items() if top > threshold - 1e-9]
        out = compare(met)
    else:
        first = [p for p in highest if p[0] == p[1]]
        own = written(compare(first), "own-cells")
        best = a.join(own.groupBy(F.col("a").alias("name")).agg(F.max("cosine").alias("_best")), "name", "left")
        least = {r.cell: r.least for r in best.groupBy("cell").agg(F.min(F.coalesce("_best", F.lit(-2.0))).alias("least")).collect()}
        more = [p for p, top in highest.items() if p[0] != p[1] and top >= least[p[0]] - 1e-9]
        met, out = first + more, own.union(compare(more))
    if skipped is not None:
        total = sum(x[0] for x in sizes[0].values()) * n
        skipped.append(1 - sum(sizes[0][i][0] * sizes[1][j][0] for i, j in met) / max(1, total))
    return out


def vector_edges(emb: DataFrame, threshold: float = 0.65) -> DataFrame:
    """``emb(name, vec)``: u -> v if their cosine is above the threshold and u's name is shorter."""
    pairs = cosine_pairs(emb, emb, threshold)
    return pairs.where(F.length("a") < F.length("b")).select(F.col("a").alias("parent"), F.col("b").alias("child"), "cosine")


def nearest_parent(test: DataFrame, pool: DataFrame) -> DataFrame:
    """The closest pool entry of every test entry (never itself; ties: the smallest name)."""
    best = cosine_pairs(test, pool, None)
    first = best.groupBy("a").agg(F.min(F.struct(F.round(-F.col("cosine"), 12).alias("d"), "b")).alias("m"))
    return first.select(F.col("m.b").alias("parent"), F.col("a").alias("child"), (-F.col("m.d")).alias("cosine"))


def perplexity_parents(ppl: DataFrame, ratio: float = 15.0, max_parents: int = 3) -> DataFrame:
    """``ppl(child, parent, ppl)``: parents whose forward perplexity is below ``ratio`` times the reverse one (a
    reverse of 0 disqualifies), the ``max_parents`` lowest per child (ties: the smallest name), with weight."""
    back = ppl.select(F.col("child").alias("parent"), F.col("parent").alias("child"), F.col("ppl").alias("_rev"))
    ok = ppl.where("child <> parent").join(back, ["child", "parent"]).where((F.col("_rev") != 0) & (F.col("ppl") / F.col("_rev") < ratio))
    rank = F.row_number().over(Window.partitionBy("child").orderBy("ppl", "parent"))
    return ok.withColumn("_r", rank).where(F.col("_r") <= max_parents).select("parent", "child", F.col("ppl").alias("weight"))


#: What a request asks, by variant: the relation's wording upward and downward, whether other pairs are ruled
#: out, whether an example is shown, and further words. Each differs from ``full`` in one respect.
RULES = {
    "extension": ("everything called '{t}' may also be called C", "everything called C may also be called '{t}'"),
    "direct": ("C is the direct parent concept of '{t}'", "C is a direct child concept of '{t}'"),
    "isa": ("'{t}' is a kind of C", "C is a kind of '{t}'"),
    "plain": ("'{t}' may also be called C", "C may also be called '{t}'"),
}
VARIANTS = {
    "full": ("extension", True, True, True, ""),
    "direct": ("direct", True, True, True, ""),
    "isa": ("isa", True, True, True, ""),
    "no_quantifier": ("plain", True, True, True, ""),
    "oneway": ("extension", False, True, True, ""),
    "no_example": ("extension", True, True, False, ""),
    "no_restriction": ("extension", True, False, True, ""),
    "no_conversational": ("extension", True, True, True, " Write nothing else."),
}
#: Variants that ask for a JSON list of [parent, child]: the wording, and whether the target is listed too.
JSON_VARIANTS = {"full_json": ("extension", False), "legacy_json": ("direct", False), "legacy_vocab_fix": ("direct", True)}


def prompt_text(target: Column, candidates: Column, variant: str = "full") -> Column:
    """The request for one target and its candidates."""
    as_json = variant in JSON_VARIANTS
    rules, both, only, example, more = (JSON_VARIANTS[variant][0], True, True, True, "") if as_json else VARIANTS[variant]
    up, down = RULES[rules]
    lines = [f"- Where {up}, write " + ('["C", "{t}"].' if as_json else "{t} <= C.")]
    if both:
        lines.append(f"- Where {down}, write " + ('["{t}", "C"].' if as_json else "C <= {t}."))
    if only:
        lines.append("Relate candidates to '{t}' only, not to each other.")
    lines.append(("Answer with one JSON list of [parent, child] arrays; [] if there is none." if as_json else "One relation a line; 'none' if there is none.") + more)
    if example:
        lines.append('Example: [["bird", "owl"]]' if as_json else "Example: owl <= bird")
    template = "Which of the candidates C are above or below '{t}' in an is-a hierarchy?\n" + "\n".join(lines) + "\nCandidates:\n"
    listed = F.concat(F.array(target), candidates) if as_json and JSON_VARIANTS[variant][1] else candidates
    return F.concat(F.replace(F.lit(template), F.lit("{t}"), target), F.array_join(F.transform(listed, lambda c: F.concat(F.lit("- "), c)), "\n"))


def extraction_requests(nodes: DataFrame, chunk_size: int = 1000, variant: str = "full") -> DataFrame:
    """(graph_id, target, chunk, n_candidates, prompt): every primary term asks about all others, ``chunk_size``
    at a time, in the order of their names. Candidate lists are made once per (graph, chunk); a target within a
    chunk shifts what comes after it by one, so each request takes its slice from at most two of them."""
    ranked = nodes.select(G, primary_term("node").alias("term")).distinct()
    ranked = numbered(ranked, [G], [F.col("term")], "_at", "_n")
    ranked = written(ranked.withColumn("_at", F.col("_at") - 1), "terms")
    lists = ranked.groupBy(G, F.floor(F.col("_at") / chunk_size).alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "term"))), lambda x: x["term"]).alias("_terms"))
    n_chunks = F.ceil((F.col("_n") - 1) / chunk_size)
    asked = ranked.where("_n > 1").select(G, F.col("term").alias("target"), "_at", F.explode(F.sequence(F.lit(0).cast("long"), n_chunks - 1)).alias("chunk"))
    here, nxt = lists, lists.select(G, (F.col("chunk") - 1).alias("chunk"), F.get("_terms", F.lit(0)).alias("_head"))
    asked = asked.join(here, [G, "chunk"]).join(nxt, [G, "chunk"], "left")
    low, high = F.col("chunk") * chunk_size, (F.col("chunk") + 1) * chunk_size
    head = F.when(F.col("_head").isNotNull(), F.array("_head")).otherwise(F.array().cast("array<string>"))
    rest = F.slice("_terms", 2, chunk_size)
    # Before the target: as listed. In its own chunk: without it, and the next one's head moves up. After: shifted.
    shown = F.when(F.col("_at") >= high, F.col("_terms")).when(F.col("_at") < low, F.concat(rest, head)).otherwise(F.concat(F.array_remove("_terms", F.col("target")), head))
    return asked.select(G, "target", "chunk", F.size(shown).cast("long").alias("n_candidates"), prompt_text(F.col("target"), shown, variant).alias("prompt"))


def batch_requests(test: DataFrame, train: DataFrame, chunk: int = 100) -> DataFrame:
    """Each chunk of train pairs (graph_id, parent, child) with each chunk of test terms (graph_id, node):
    (graph_id, train_chunk, test_chunk, examples, terms). Without train pairs there is one empty chunk."""
    number = F.floor((F.col("_no") - 1) / chunk)
    terms = numbered(test.select(G, "node").distinct(), [G], [F.col("node")], "_no").withColumn("test_chunk", number)
    terms = terms.groupBy(G, "test_chunk").agg(F.array_join(F.array_sort(F.collect_list("node")), "\n").alias("terms"))
    pairs = numbered(train.select(G, "parent", "child").distinct(), [G], [F.col("parent"), F.col("child")], "_no").withColumn("train_chunk", number)
    pair = F.to_json(F.struct("parent", "child"))
    pairs = pairs.groupBy(G, "train_chunk").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(pair)), ", "), F.lit("]")).alias("examples"))
    out = terms.join(pairs, G, "left")
    return out.select(G, F.coalesce("train_chunk", F.lit(0)).alias("train_chunk"), "test_chunk", F.coalesce("examples", F.lit("[]")).alias("examples"), "terms")


def needed_pairs(e: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Distinct (child, parent) primaries of the edges in both directions, without those already known."""
    p, c = primary_term("parent"), primary_term("child")
    pairs = e.select(c.alias("child"), p.alias("parent")).union(e.select(p, c)).distinct()
    return pairs if known is None else pairs.join(known.select("child", "parent"), ["child", "parent"], "left_anti")
