"""Hard negatives of anchors, found through rotated one-bit codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.common import written

#: One-bit codes of a vector; each codes what the ones before it left.
LEVELS = 8
#: Bits of a rotated anchor's components; popcounts of so many planes make an inner product with a code.
PLANES = 8
#: Vectors, and anchors, in a block: what a task holds. They bound memory and change no result.
BLOCK, ANCHORS = 8192, 2048
#: A component's size up to which sums of products fit 64 bits at any length up to 2^20.
LARGEST = 1 << 20

PACKED = "block int, ids binary, labels binary, dim int, ints binary, codes binary, align binary, rest binary, norm binary"


def rotations(dim: int, levels: int) -> np.ndarray:
    """The fixed random rotations of all levels, each on top of the ones before."""
    rng, out = np.random.default_rng(7), []
    for _ in range(levels):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        q *= np.sign(np.diag(r))
        out.append(out[-1] @ q if out else q)
    return np.array(out)


def _words(bits: np.ndarray) -> np.ndarray:
    """The bits along the last axis in 64-bit words."""
    n = bits.shape[-1]
    wide = np.zeros((*bits.shape[:-1], -(-n // 64) * 64), np.uint8)
    wide[..., :n] = bits
    return np.packbits(wide, axis=-1, bitorder="little").view(np.uint64)


def encode(v: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, align, rest, norm) of integer vectors: words of sign bits and the stored alignment per level, the length
    of what no code covers, and the vector's length. Each level rotates what is left anew, takes its signs (1 or -1
    over the root of the dimension, a vector of length 1), stores its product with them, and takes that part away."""
    (n, dim), turns = v.shape, rotations(v.shape[1], levels)
    left, codes, align = v.astype(np.float64), [], []
    for k in range(levels):
        left = left @ (turns[k] if k == 0 else turns[k - 1].T @ turns[k])
        up = left >= 0
        codes.append(_words(up))
        align.append(np.abs(left).sum(axis=1) / np.sqrt(dim))
        left -= np.where(up, 1.0, -1.0) * (align[k] / np.sqrt(dim))[:, None]
    return np.array(codes), np.array(align), np.linalg.norm(left, axis=1), np.linalg.norm(v.astype(np.float64), axis=1)


class Anchor:
    """An anchor's rotated vectors in bit planes, for intervals of its inner products with coded vectors."""

    def __init__(self, vector: np.ndarray, turns: np.ndarray, planes: int = PLANES):
        q = vector.astype(np.float64) @ turns
        self.low, span = q.min(axis=1), np.ptp(q, axis=1)
        self.step = np.where(span > 0, span, 1.0) / (2**planes - 1)
        k = np.rint((q - self.low[:, None]) / self.step[:, None]).astype(np.uint64)
        self.planes = _words(((k[:, None, :] >> np.arange(planes, dtype=np.uint64)[:, None]) & np.uint64(1)).astype(np.uint8))
        near = self.low[:, None] + self.step[:, None] * k.astype(np.float64)
        #: The planes stand for ``near``; the length of what they miss bounds their error on a code, which has length 1.
        self.total, self.missed, self.length, self.root = near.sum(axis=1), np.linalg.norm(q - near, axis=1), np.linalg.norm(vector.astype(np.float64)), np.sqrt(q.shape[1])

    def intervals(self, codes: np.ndarray, align: np.ndarray, rest: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the inner products. Each code's part comes from popcounts; by Cauchy-Schwarz what no code covers adds
        at most its length times the anchor's."""
        middle, wide = np.zeros(len(rest)), rest * self.length + 1e-6 * (1 + norm * self.length)
        for i, (words, a) in enumerate(zip(codes, align, strict=True)):
            ones = sum(np.bitwise_count(words & p).sum(axis=1, dtype=np.int64) << j for j, p in enumerate(self.planes[i]))
            dot = 2 * (self.low[i] * np.bitwise_count(words).sum(axis=1, dtype=np.int64) + self.step[i] * ones) - self.total[i]
            middle += a * dot / self.root
            wide += a * self.missed[i]
        return middle - wide, middle + wide


def _vectors(rows: DataFrame, vector: str) -> DataFrame:
    """(vec_id, label, v, block seeds): rows that take part, once each, with integer components."""
    x = F.transform(vector, lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: F.coalesce(F.abs(c) <= float(LARGEST), F.lit(False)))  # NaN is larger than any number
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & whole)
    return kept.select("vec_id", label.cast("long").alias("label"), F.transform(x, lambda c: F.floor(c * 256).cast("int")).alias("v")).distinct()


def _packed(v: DataFrame, blocks: int, levels: int, name: str) -> DataFrame:
    """The vectors in blocks by a hash of their ids: one row per block and length of vectors."""

    def pack(t: pa.Table) -> pa.Table:
        out = []
        width = np.asarray(t["v"].combine_chunks().value_lengths()) if len(t) else np.zeros(0, int)
        for dim in np.unique(width):
            at = np.flatnonzero(width == dim)
            part = t.take(pa.array(at))
            ints = np.asarray(part["v"].combine_chunks().flatten()).astype(np.int32).reshape(len(at), dim)
            found = encode(ints, levels) if dim else (np.zeros((levels, len(at), 0), np.uint64), np.zeros((levels, len(at))), np.zeros(len(at)), np.zeros(len(at)))
            cols = [np.asarray(part["vec_id"]).astype(np.int64), np.asarray(part["label"]).astype(np.int64), ints, *found]
            blobs = [c.tobytes() for c in cols]
            out.append({"block": part["block"][0].as_py(), "ids": blobs[0], "labels": blobs[1], "dim": int(dim)} | dict(zip(("ints", "codes", "align", "rest", "norm"), blobs[2:], strict=True)))
        kinds = [("block", pa.int32()), *((c, pa.int32() if c == "dim" else pa.binary()) for c in ("ids", "labels", "dim", "ints", "codes", "align", "rest", "norm"))]
        return pa.Table.from_pylist(out, schema=pa.schema(kinds))

    dealt = v.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return written(dealt.groupBy("block").applyInArrow(pack, PACKED), name)


class _Block:
    def __init__(self, r: dict, levels: int):
        self.ids, self.labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
        n, dim = len(self.ids), r["dim"]
        self.ints = np.frombuffer(r["ints"], np.int32).reshape(n, dim)
        self.codes = np.frombuffer(r["codes"], np.uint64).reshape(levels, n, -(-dim // 64))
        self.align = np.frombuffer(r["align"]).reshape(levels, n)
        self.rest, self.norm = np.frombuffer(r["rest"]), np.frombuffer(r["norm"])
        self.turns = rotations(dim, levels) if dim else None

    def scores(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return self.ints[at].astype(np.int64) @ anchor.astype(np.int64)

    def intervals(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.turns is None:
            return np.zeros(len(self.ids)), np.zeros(len(self.ids))
        return Anchor(anchor, self.turns).intervals(self.codes, self.align, self.rest, self.norm)


def _first(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:n]


def _best(lower: np.ndarray, n: int) -> float:
    """A value that n of the lower bounds reach; nothing below it can be among the first n."""
    return -np.inf if len(lower) < n else np.partition(lower, len(lower) - n)[len(lower) - n]


def positives_of(block: _Block, vec_id: int, label: int, anchor: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the block's first n other rows of the label."""
    lower, upper = block.intervals(anchor)
    same = np.flatnonzero((block.labels == label) & (block.ids != vec_id))
    same = same[upper[same] >= _best(lower[same], n)]
    score = block.scores(same, anchor)
    top = _first(score, block.ids[same], n)
    return same[top], score[top]


def negatives_of(block: _Block, label: int, anchor: np.ndarray, wanted: list[tuple[int, int]], n: int, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(positive's id, places, scores): the block's first n rows of other labels in the band of each positive."""
    lower, upper = block.intervals(anchor)
    other = block.labels != label
    for pid, score in wanted:
        floor, ceiling = low * score / 100, high * score / 100
        if floor > ceiling:
            continue
        near = np.flatnonzero(other & (upper >= floor) & (lower <= ceiling))
        sure = near[(lower[near] >= floor) & (upper[near] <= ceiling)]
        near = near[upper[near] >= _best(lower[sure], n)]
        exact = block.scores(near, anchor)
        fits = (low * score <= 100 * exact) & (100 * exact <= high * score)
        near, exact = near[fits], exact[fits]
        top = _first(exact, block.ids[near], n)
        yield pid, near[top], exact[top]


def hard_negatives(
    rows: DataFrame, vector: str = "embedding", anchor: Column | None = None, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, levels: int = LEVELS
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (a condition on the
    rows; vec_id divisible by 50 if not given) and each of its first ``positives`` other rows of its label, the first
    ``negatives`` rows of other labels whose score is ``low`` to ``high`` hundredths of the positive's. Scores are
    inner products of floor(256 x); higher ones come first, ties by vec_id.

    Every vector is stored with rotated one-bit codes and their alignments. Popcounts give an interval for each inner
    product that certainly holds it; what may be among the first is scored in integers. Vectors lie in blocks, anchors
    too, and each block of vectors meets each block of anchors: rows of pairs never exist, only the first few of each
    block.

    Rows with a null label, vector, component or id, or a component that isn't finite or exceeds 2^20 in size, take no
    part. Rows that repeat in full count once; rows that share an id only are rows of their own but never each other's
    positives. Vectors of different lengths never meet; empty ones have score 0. Labels of ids divisible by 7 first
    become (label + 1) % 10. Other columns don't matter, whatever their names. An empty table gives an empty one.
    """
    v = written(_vectors(rows, vector), "vectors")
    chosen = v.where(F.col("vec_id") % 50 == 0 if anchor is None else anchor)
    n, m = v.count(), chosen.count()
    blocks, sides = max(1, -(-n // BLOCK)), max(1, -(-m // ANCHORS))
    base = _packed(v, blocks, levels, "vector-blocks")
    asks = chosen.withColumn("side", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(sides)).cast("int"))
    # Anchors that share an id are told apart by what they are.
    asks = written(asks.withColumn("key", F.xxhash64("vec_id", "label", "v")), "anchors")
    spread = base.withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))

    def meet(questions: DataFrame, answer, kind: str) -> DataFrame:
        """Every block of vectors against every block of questions (side, ask)."""
        gathered = questions.groupBy("side").agg(F.collect_list("ask").alias("asks"))
        pairs = spread.join(gathered, "side").repartition(blocks * sides, "block", "side")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    block = _Block(r, levels)
                    out = [x for a in r["asks"] if len(a["v"]) == r["dim"] for x in answer(block, a)]
                    frame = pd.DataFrame(out, columns=[c.split()[0] for c in kind.split(", ")])
                    yield pa.RecordBatch.from_pandas(frame, schema=pa.schema([(c.split()[0], pa.int64()) for c in kind.split(", ")]), preserve_index=False)

        return pairs.mapInArrow(run, kind)

    def own(block: _Block, a: dict):
        at, score = positives_of(block, a["vec_id"], a["label"], np.array(a["v"], np.int32), positives)
        return [(a["key"], a["vec_id"], pos, s) for pos, s in zip(block.ids[at].tolist(), score.tolist(), strict=True)]

    first = asks.select("side", F.struct("key", "vec_id", "label", "v").alias("ask"))
    found = meet(first, own, "key long, anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("key", "anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    best = written(found.withColumn("r", place).where(F.col("r") <= positives), "positives")
    wanted = best.groupBy("key").agg(F.collect_list(F.struct("r", "positive_id", "positive_score")).alias("wanted"))
    second = asks.join(wanted, "key").select("side", F.struct("key", "vec_id", "label", "v", "wanted").alias("ask"))

    def others(block: _Block, a: dict):
        anchor_v = np.array(a["v"], np.int32)
        score = {w["r"]: w["positive_score"] for w in a["wanted"]}
        pid = {w["r"]: w["positive_id"] for w in a["wanted"]}
        for r, at, exact in negatives_of(block, a["label"], anchor_v, list(score.items()), negatives, low, high):
            for i, s in zip(block.ids[at].tolist(), exact.tolist(), strict=True):
                yield a["key"], a["vec_id"], r, pid[r], score[r], i, s

    hits = meet(second, others, "key long, anchor_id long, r long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("key", "anchor_id", "r").orderBy(F.desc("negative_score"), "negative_id"))
    hits = hits.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return hits.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
