"""Removal of repeated byte strings: common prefixes of suffixes from a Burrows-Wheeler transform.

Every start of a ``length``-byte string is keyed by the smallest hash of the ``GRAM``-byte strings within it.
Equal strings have equal keys, so only starts that share a key need comparing. Consecutive starts with one key
form a run; runs whose key occurs once are done, equal runs are counted as one, and the texts of what is left
are brought together by key. There a Burrows-Wheeler transform tells which suffixes share ``length`` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import set_aside, written

LENGTH = 200
#: Bytes of the strings whose smallest hash is a key.
GRAM = 48
#: Bytes of text under one key that are compared in one block. Keys with more are refined first.
BLOCK_BYTES = 1 << 18
#: A key with more than one in HOT of all runs is hot.
HOT = 1000
#: Starts in a part of a run, level by level, where a key has more text than that.
WIDTHS = (32, 8, 2, 1)

#: Starts of a text that are hashed at a time, and bytes of pieces handed on at a time.
CHUNK, BATCH_BYTES = 1 << 20, 1 << 22

_ODD = np.uint64(0x9E3779B97F4A7C15)


@cache
def _byte_codes() -> np.ndarray:
    """A random 64-bit number for each byte, the same everywhere."""
    return np.frombuffer(b"".join(hashlib.sha256(b"byte %d" % b).digest()[:8] for b in range(256)), dtype="<u8")


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    base = 0xD6E8FEB86659FD93
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class RollingHash:
    """64-bit hashes of any substring of a byte array, from prefix sums."""

    def __init__(self, data: np.ndarray):
        n = 1 << max(16, int(len(data)).bit_length())
        up, self.down = _powers(n)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_byte_codes()[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h = (self.sums[stop] - self.sums[start]) * self.down[start]
        h ^= h >> np.uint64(29)
        h *= _ODD
        return h ^ (h >> np.uint64(32))


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest value of every ``width`` consecutive ones, by prefix and suffix minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs_of(data: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, number of starts, key, hash of the run's bytes) of all runs of one text."""
    if len(data) < length:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64),) * 2
    h = RollingHash(data)
    at = np.arange(len(data) - gram + 1)
    hashes = h.of(at, at + gram)
    keys = _window_minima(hashes, length - gram + 1)
    # A run ends where the key changes, and where the place that has the key is left behind (the same bytes may
    # come again): so no two strings of a run are equal.
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (hashes[: len(keys) - 1] == keys[:-1])
    first = np.nonzero(new)[0]
    sizes = np.diff(np.append(first, len(keys)))
    return first, sizes, keys[first], h.of(first, first + sizes + length - 1)


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array up to ``depth`` characters, by prefix doubling."""
    n = len(data)
    padded = np.zeros(n + 8, dtype=np.uint64)
    padded[:n] = data
    rank = np.zeros(n, dtype=np.uint64)
    for k in range(7):
        rank = (rank << np.uint64(9)) | (padded[k : n + k] + np.uint64(1)) * (np.arange(n) + k < n)
    order = np.argsort(rank)
    done = 7
    while True:
        sorted_rank = rank[order]
        step = np.zeros(n, dtype=np.int64)
        step[1:] = sorted_rank[1:] != sorted_rank[:-1]
        dense = np.empty(n, dtype=np.uint64)
        dense[order] = np.cumsum(step).astype(np.uint64) + np.uint64(1)
        if done >= depth or step.sum() == n - 1:
            return order
        after = np.zeros(n, dtype=np.uint64)
        after[: max(0, n - done)] = dense[done:]
        rank = (dense << np.uint64(32)) | after
        order = np.argsort(rank)
        done *= 2


def common_prefixes(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in the suffix order: the common prefix with the place before, or ``length`` if it is that
    long or longer (place 0: 0).

    Intervals of suffixes that share a prefix are extended backward, breadth first, by every character of the
    transform: intervals of the strings one character longer come out. The end of an interval that is met for
    the first time has the length of the string that bounded it, so common prefixes are found by increasing
    value, and the search stops where ``length`` is reached.
    """
    n = len(data)
    text = np.append(data.astype(np.int16) + 1, 0).astype(np.int16)  # a sentinel smaller than any byte
    bwt = text[np.append(n, order) - 1]
    # Where the suffix goes that is one character longer than the one in a row.
    longer = np.empty(n + 1, dtype=np.int64)
    longer[np.argsort(bwt, kind="stable")] = np.arange(n + 1)
    found = np.full(n + 2, -1, dtype=np.int32)
    found[0] = found[n + 1] = 0
    lo, hi = np.array([0]), np.array([n + 1])
    for depth in range(length):
        if not len(lo):
            break
        width = hi - lo
        alone = longer[lo[width == 1]]  # a single suffix has one extension
        lo, width = lo[width > 1], width[width > 1]
        rows = np.arange(width.sum()) + np.repeat(lo - np.cumsum(width) + width, width)
        which = np.repeat(np.arange(len(lo)), width)
        to = longer[rows]
        sort = np.argsort(to)
        to, which, c = to[sort], which[sort], bwt[rows[sort]]
        # Rows of one interval that go on with one character lie side by side.
        new = np.ones(len(to), dtype=bool)
        new[1:] = (which[1:] != which[:-1]) | (c[1:] != c[:-1])
        start = np.nonzero(new)[0]
        stop = np.append(start[1:], len(to))[: len(start)]
        lo, hi = np.concatenate((alone, to[start])), np.concatenate((alone, to[stop - 1])) + 1
        # Per step, one interval ends at each place at most; those whose end is known are not gone into again.
        fresh = found[hi] < 0
        lo, hi = lo[fresh], hi[fresh]
        found[hi] = depth
    found[found < 0] = length
    return found[1 : n + 1]


def repeated_in_runs(runs: list[bytes], counts: list[int], length: int) -> list[tuple[int, list[list[int]]]]:
    """(number of the run, merged [start, end) spans) of runs with strings that occur twice or more; ``counts``
    tells how often a run occurs."""
    sizes = np.array([len(r) for r in runs])
    data = np.frombuffer(b"\xff".join(runs) + b"\xff", dtype=np.uint8)  # no UTF-8 text has this byte
    begin = np.cumsum(sizes + 1) - sizes - 1
    order = suffix_order(data, length)
    same = common_prefixes(data, order, length)
    # How often the string at each position counts; strings over the end of a run do not.
    run = np.repeat(np.arange(len(runs)), sizes + 1)
    at = np.arange(len(data)) - begin[run]
    weight = np.where(at <= sizes[run] - length, np.minimum(counts, 2)[run], 0)
    group = np.cumsum(same < length)
    total = np.bincount(group, weights=weight[order])
    often = np.zeros(len(data), dtype=bool)
    often[order] = total[group] >= 2
    found = np.nonzero(often & (weight > 0))[0]
    if not len(found):
        return []
    new = np.nonzero((np.diff(found) > length) | (np.diff(run[found]) > 0))[0]
    lo, hi = found[np.append(0, new + 1)], found[np.append(new, len(found) - 1)]
    out: list[tuple[int, list[list[int]]]] = []
    for r, a, b in zip(run[lo].tolist(), at[lo].tolist(), (at[hi] + length).tolist(), strict=True):
        if out and out[-1][0] == r:
            out[-1][1].append([a, b])
        else:
            out.append((r, [[a, b]]))
    return out


def _identity(text: Column) -> list[Column]:
    """Two columns that tell texts apart: 128 bits of two hashes. Equal texts lose the same bytes."""
    return [F.xxhash64(text).alias("_a"), F.xxhash64(F.lit(1), text).alias("_b")]


def _runs(docs: DataFrame, length: int) -> DataFrame:
    """All runs: (_a, _b, start, n, key, run)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts, size = [], 0
            for a, b, text in batch[["_a", "_b", "_text"]].itertuples(index=False):
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                for at in range(0, len(data) - length + 1, CHUNK):
                    start, n, key, run = runs_of(data[at : at + CHUNK + length - 1], length)
                    parts.append((np.full(len(start), a), np.full(len(start), b), start + at, n, key.view(np.int64), run.view(np.int64)))
                    size += len(start)
                if size > 50_000:
                    yield _frame(parts)
                    parts, size = [], 0
            if parts:
                yield _frame(parts)

    text = F.col("text")
    rows = docs.where(F.octet_length("text") >= length).select(*_identity(text), text.alias("_text"))
    return rows.mapInPandas(cut, "_a long, _b long, start int, n short, key long, run long")


def _frame(parts: list[tuple]) -> pd.DataFrame:
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    frame = pd.DataFrame(dict(zip(("_a", "_b", "start", "n", "key", "run"), columns, strict=True)))
    return frame.astype({"start": "int32", "n": "int16"})


def repeated_spans(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs(text)`` -> (_a, _b, spans): per text that has any, the sorted spans of bytes covered by a string of
    ``length`` bytes that also starts anywhere else. _a and _b identify the text.

    Keys and runs are counted with map-side combine before anything is joined, so copies and common passages
    are not gathered. Runs are told apart by their key and their hash (128 bits in all); equal ones are counted,
    not compared byte by byte. Keys with more than ``block_bytes`` of different runs (a passage in very many
    surroundings) are cut into smaller ones until they fit the transform.
    """
    runs = written(_runs(docs, length), "all-runs")
    often = written(runs.groupBy("key").agg(F.count("*").alias("_k")).where("_k > 1"), "often")
    # Fewer than HOT keys can have so many runs. Theirs are all suspects, and need not meet in one task to be told.
    hot = F.col("_k") * HOT > runs.count()
    heavy = F.broadcast(often.where(hot).select("key"))
    light = runs.join(heavy, "key", "left_anti").join(often.where(~hot).select("key"), "key")
    # The place tells the rest. Grouped by it alone, rows of one text are combined before they are sent.
    told = [F.first(c).alias(c) for c in ("n", "key", "run")]
    suspects = runs.join(heavy, "key").unionByName(light).groupBy("_a", "_b", "start").agg(*told, F.count("*").alias("times"))
    suspects = written(suspects, "suspects")
    place = F.struct("_a", "_b", "start", "n")
    distinct = suspects.groupBy("key", "run").agg(F.sum("times").alias("times"), F.min(place).alias("p"))
    distinct = written(distinct.select("key", "run", "times", "p.*"), "runs")
    # Written on its own: joins with it can be split where one key has very many runs.
    keys = distinct.groupBy("key").agg(F.count("*").alias("_k"), F.sum(F.col("n") + length - 1).alias("_bytes"))
    keys = written(keys.select("key", (F.col("_k") == 1).alias("_alone"), (F.col("_bytes") > block_bytes).alias("_large")), "run-keys")
    # A key with one run: its strings are all repeated if the run is, and none is otherwise.
    whole = distinct.where("times > 1").join(keys.where("_alone").select("key"), "key")
    whole = whole.select("key", "run", F.array(F.array(F.lit(0), F.col("n") + length - 1)).alias("spans"))
    asked = distinct.join(keys.where("not _alone").select("key", "_large"), "key")
    texts = docs.where(F.octet_length("text") >= length).select(*_identity(F.col("text")), "text")
    texts = texts.groupBy("_a", "_b").agg(F.first("text").alias("_text"))
    wanted = asked.groupBy("_a", "_b").agg(F.collect_list(F.struct("key", "run", "times", "start", "n", "_large")).alias("_w"))
    wanted = wanted.select("_a", "_b", *[F.col(f"_w.{c}").alias("_" + c.lstrip("_")) for c in ("key", "run", "times", "start", "n", "_large")])
    pieces = wanted.join(texts, ["_a", "_b"]).mapInPandas(_cutter(length), "key long, run long, times long, large boolean, piece binary")
    pieces = written(pieces, "pieces")
    small, decided = _refined(pieces.where("large"), length, block_bytes)
    small = small.union(pieces.where("not large").select("key", "run", F.col("key").alias("top"), F.col("run").alias("top_run"), F.lit(0).alias("at"), "times", "piece"))
    small = small.repartition("key").sortWithinPartitions("key")
    by_block = small.mapInPandas(_block_finder(length, block_bytes), "key long, run long, spans array<array<int>>")
    decided = written(whole.union(by_block).union(decided), "decided")
    moved = F.transform("spans", lambda s: F.struct((s[0] + F.col("start")).alias("lo"), (s[1] + F.col("start")).alias("hi")))
    hits = suspects.join(decided, ["key", "run"]).select("_a", "_b", F.explode(moved).alias("s"))
    return hits.groupBy("_a", "_b").agg(F.array_sort(F.collect_set("s")).alias("spans"))


def _cutter(length: int):
    """Cuts the asked runs out of texts; pieces are handed on in batches of about BATCH_BYTES."""
    def together(parts: list[tuple]) -> pd.DataFrame:
        *columns, pieces = zip(*parts, strict=True)
        frame = pd.DataFrame(dict(zip(("key", "run", "times", "large"), map(np.concatenate, columns), strict=True)))
        return frame.assign(piece=list(chain.from_iterable(pieces)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts, size = [], 0
            for *own, start, n, text in batch[["_key", "_run", "_times", "_large", "_start", "_n", "_text"]].itertuples(index=False, name=None):
                raw = text.encode()
                stop = start + n + (length - 1)
                parts.append((*own, [raw[lo:hi] for lo, hi in zip(start.tolist(), stop.tolist(), strict=True)]))
                size += int((stop - start).sum())
                if size > BATCH_BYTES:
                    yield together(parts)
                    parts, size = [], 0
            if parts:
                yield together(parts)

    return cut


def _block_finder(length: int, block_bytes: int):
    """Rows sorted by key: whole keys are gathered into blocks of about ``block_bytes``. Of a part (key, run) of the
    run (top, top_run), spans are told as those of the run."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block: list[tuple] = []
        own: list[tuple] = []
        size = 0

        def done() -> pd.DataFrame:
            rows = []
            for i, spans in repeated_in_runs([r[5] for r in block], [r[4] for r in block], length):
                _, top, top_run, at, *_ = block[i]
                rows.append((top, top_run, [[at + lo, at + hi] for lo, hi in spans]))
            return pd.DataFrame(rows, columns=["key", "run", "spans"])

        for batch in batches:
            for r in batch[["key", "top", "top_run", "at", "times", "piece"]].itertuples(index=False, name=None):
                if own and own[-1][0] != r[0]:
                    block += own
                    own = []
                    if size > block_bytes:
                        yield done()
                        block, size = [], 0
                own.append(r)
                size += len(r[5])
        block += own
        if block:
            yield done()

    return find


PART = ["key", "run", "top", "top_run", "at", "times", "piece"]


def _refined(pieces: DataFrame, length: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(parts, decided) of keys of any size: parts (PART) whose keys hold at most ``block_bytes`` and go through
    the transform, and what was decided on the way as (key, run, spans).

    All strings of a run hold its key's bytes at one place, and equal strings hold them at the same distance from
    their start. So runs are cut by that distance into parts of at most WIDTHS starts, level by level; a part's new
    key is the hash of its old one, the distance and the bytes that all its strings share. Equal parts that occur
    twice are repeated as a whole; a key with one part only is done; a key that is small now is a block's; the rest
    goes to the next level, and at the last each part is one string. Each level makes a few rows of each run that
    is left and counts them with map-side combine, so a passage in any number of surroundings is not gathered.
    """
    rows = pieces.select("key", "run", F.col("key").alias("top"), F.col("run").alias("top_run"), F.lit(0).alias("at"), "times", "piece", F.lit(-1).alias("anchor"))
    decided = small = None
    for width in WIDTHS:
        schema = "key long, run long, top long, top_run long, at int, times long, piece binary, anchor int"
        parts = written(rows.mapInPandas(_parter(length, width), schema), f"parts{width}")
        seen = parts.groupBy("key", "run").agg(F.sum("times").alias("_t"), F.count("*").alias("_c"), F.sum(F.octet_length("piece")).alias("_size"))
        seen = written(seen, "seen")
        whole = parts.join(seen.where("_t > 1").select("key", "run"), ["key", "run"])
        span = F.array(F.array(F.col("at"), F.col("at") + F.octet_length("piece")))
        own = whole.select(F.col("top").alias("key"), F.col("top_run").alias("run"), span.alias("spans"))
        decided = own if decided is None else decided.union(own)
        mixed = seen.groupBy("key").agg(F.count("*").alias("_n"), F.sum("_size").alias("_size")).where("_n > 1")
        mixed = written(mixed.select("key", (F.col("_size") <= block_bytes).alias("_small")), "mixed")
        rows = parts.join(mixed, "key")
        own = rows.where("_small").select(*PART)
        small = own if small is None else small.union(own)
        rows = rows.where("not _small")
    return small, decided


def _parter(length: int, width: int):
    """Cuts runs into parts of at most ``width`` starts by the distance of the key's place from the start."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, top, top_run, at, times, piece, anchor in batch[["key", "top", "top_run", "at", "times", "piece", "anchor"]].itertuples(index=False, name=None):
                data = np.frombuffer(piece, dtype=np.uint8)
                if anchor < 0:  # the place in the piece that has the run's key
                    i = np.arange(len(data) - GRAM + 1)
                    anchor = int(np.nonzero(RollingHash(data).of(i, i + GRAM).view(np.int64) == key)[0][0])
                starts = len(piece) - length + 1
                low = 0
                while low < starts:
                    far = anchor - low  # distance of the first string
                    high = min(starts, low + far % width + 1)
                    share = far - far % width  # the nearest distance that a string of this part can have
                    core = piece[anchor - share : anchor - share - (width - 1) + length]
                    part = piece[low : high - 1 + length]
                    rows.append((_hash64(key, share, core), _hash64(far, high - low, part), top, top_run, at + low, times, part, anchor - low))
                    low = high
            yield pd.DataFrame(rows, columns=["key", "run", "top", "top_run", "at", "times", "piece", "anchor"])

    return cut


def _hash64(a: int, b: int, data: bytes) -> int:
    digest = hashlib.blake2b(b"%d %d " % (a, b) + data, digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def cut_repeats(docs: DataFrame, length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """``docs`` with ``_spans`` (array of lo, hi; empty: nothing to remove) and ``_kept``: the bytes left, or
    ``as_text`` the text left (bytes left over of a character cut in two go with it; null texts stay null).
    Null texts are empty ones. Each row is judged as a text of its own, so rows that repeat a text remove each
    other."""
    spans = written(repeated_spans(docs.select("text"), length), "spans")

    @F.pandas_udf(f"spans array<struct<lo:int,hi:int>>, kept {'string' if as_text else 'binary'}")
    def keep(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, own in zip(texts, spans, strict=True):
            merged: list[dict] = []
            for s in own:
                if merged and s["lo"] <= merged[-1]["hi"]:
                    merged[-1]["hi"] = max(merged[-1]["hi"], s["hi"])
                else:
                    merged.append({"lo": s["lo"], "hi": s["hi"]})
            raw, kept, at = text.encode(), [], 0
            for s in merged:
                kept.append(raw[at : s["lo"]])
                at = s["hi"]
            left = b"".join([*kept, raw[at:]])
            out.append((merged, left.decode(errors="ignore") if as_text else left))
        return pd.DataFrame(out, columns=["spans", "kept"])

    a, b = _identity(F.col("text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumns({"_a": a, "_b": b}).join(spans.withColumnRenamed("spans", "_found"), ["_a", "_b"], "left").drop("_a", "_b")
    some = F.col("_found").isNotNull()
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    out = out.withColumn("_cut", keep.asNondeterministic()(F.when(some, text).otherwise(""), F.coalesce("_found", none)))
    whole = F.col("text") if as_text else text.cast("binary")
    return out.withColumns({"_spans": F.col("_cut.spans"), "_kept": F.when(some, F.col("_cut.kept")).otherwise(whole)}).drop("_cut", "_found")


def repeat_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts are empty, and shorter ones than ``length`` stay. Every row gives a row, null ids included; rows that
    repeat a text of that length remove each other whole. Texts of any length are read whole, other columns are
    ignored, and an empty table gives an empty one."""
    out = cut_repeats(docs.select("doc_id", "text"), length)
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return out.select(
        "doc_id", n.alias("n_bytes"), (n - F.octet_length("_kept")).cast("long").alias("n_removed"),
        F.size("_spans").cast("long").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``; a document of which only white space is left goes,
    unless nothing was cut. Null and shorter texts stay as they are; rows that repeat a text of that length all go.
    Other columns stay, whatever their names; an empty table gives an empty one."""
    original, docs = docs.columns, set_aside(docs)
    names = docs.columns
    out = cut_repeats(docs, length, as_text=True)
    out = out.where((F.size("_spans") == 0) | F.col("_kept").rlike(r"[^\s]"))
    return out.select(*[F.col("_kept").alias("text") if c == "text" else F.col(f"`{c}`") for c in names]).toDF(*original)
