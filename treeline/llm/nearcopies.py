"""Links between word-shingle sets of a given Jaccard similarity, for what SimHash keys cannot reach.

Of two texts with similarity 0.8, some ten of 64 SimHash bits differ; keys that are sure to meet at such a distance
would be hundreds per text. So links beyond the reach of the Golay keys are completed through MinHash bands. Every
link, from whichever key, is held against the exact similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import components, written

#: Bands and the minima in each: a pair of similarity s shares no band with probability (1 - s**4)**25, which is
#: 2 in a million at 0.8 and less above.
BANDS, ROWS = 25, 4
_NUMBERS = np.array([xxhash.xxh64_intdigest(str(i).encode()) for i in range(2 * BANDS * ROWS)], dtype=np.uint64)
FLIPS, FACTORS = _NUMBERS[: BANDS * ROWS], _NUMBERS[BANDS * ROWS :] | np.uint64(1)

#: Sets of one bucket that a task compares at once with as many others: by number, and by bytes in all.
BLOCK, BLOCK_BYTES = 1024, 2 << 20
#: Rounds in which the rows of a bucket are held against its smallest one only.
STARS = 3


def band_keys(found: np.ndarray) -> list[int]:
    """One key per band of a set of hashes; none if it is empty."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype="<u8")
    for i in range(0, len(found), 8192):
        least = np.minimum(least, ((found[i : i + 8192, None] ^ FLIPS) * FACTORS).min(axis=0))
    raw = np.array([xxhash.xxh64_intdigest(x.tobytes(), band) for band, x in enumerate(least.reshape(BANDS, ROWS))], dtype=np.uint64)
    return raw.view(np.int64).tolist()


def verified_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose ``sets(id, set)`` have the similarity or more; a set is the bytes of sorted hashes.
    The pairs should be a written table, so that the joins can be split where one set is in very many."""
    own = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("_x")), "a")
    both = written(own, "pairs").join(sets.select(F.col("id").alias("b"), F.col("set").alias("_y")), "b")

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(x, y, strict=True):
            both = np.concatenate((np.frombuffer(a, dtype="<u8"), np.frombuffer(b, dtype="<u8")))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            out.append(common >= similarity * (len(both) - common) - 1e-9)
        return pd.Series(out, dtype=bool)

    return both.where(near("_x", "_y")).select("a", "b")


def forest(ids: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between the rows ``left`` and ``right`` that join their components: every pair of rows in different
    ones is compared until a link joins these. All sets on the right are compared with one on the left at once."""
    here = roots.copy()  # each row's component so far
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    order = np.concatenate([np.arange(begin[j], begin[j] + sizes[j]) for j in right])
    members, first = codes[order], np.cumsum(sizes[right]) - sizes[right]
    mark = np.zeros(int(codes.max()) + 1, dtype=np.int32)
    found = []
    for i in left.tolist():
        if (here[right] == here[i]).all():
            continue
        own = codes[begin[i] : begin[i] + sizes[i]]
        mark[own] = 1
        common = np.add.reduceat(mark[members], first)
        mark[own] = 0
        for j in right[common >= similarity * (sizes[i] + sizes[right] - common) - 1e-9].tolist():
            if here[i] != here[j]:
                here[here == here[j]] = here[i]
                found.append((int(ids[i]), int(ids[j])))
    return found


def _compared(similarity: float):
    """Rows sorted by pair of blocks -> links."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = pd.DataFrame()
        for batch in batches:
            batch = pd.concat([rest, batch], ignore_index=True) if len(rest) else batch
            names = ["_key", "_lo", "_hi"]
            cut = int(np.argmax((batch[names] == batch[names].iloc[-1]).all(axis=1).to_numpy()))
            rest = batch.iloc[cut:]  # the last pair of blocks may go on in the next batch
            if cut:
                yield links(batch.iloc[:cut])
        if len(rest):
            yield links(rest)

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for (_, lo, hi), part in rows.groupby(["_key", "_lo", "_hi"], sort=False):
            roots, side = part["root"].to_numpy(), part["_i"].to_numpy()
            left, right = np.nonzero(side == lo)[0], np.nonzero(side == hi)[0]
            if len(left) and len(right) and (roots != roots[0]).any():
                found += forest(part["id"].to_numpy(), roots, [np.frombuffer(x, dtype="<u8") for x in part["set"]], left, right, similarity)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return compare


def shared_bands(nodes: DataFrame) -> DataFrame:
    """``nodes(id, n, keys)`` -> (_key, id, n) for the keys that two nodes or more have."""
    bands = nodes.select("id", "n", F.explode("keys").alias("_key"))
    buckets = written(bands.groupBy("_key").agg(F.count("*").alias("_c")).where("_c > 1").select("_key"), "buckets")
    return written(bands.join(buckets, "_key").select("_key", "id", "n"), "bands")


def _rooted(bands: DataFrame, links: DataFrame) -> DataFrame:
    """The bands with the component of each row over the links."""
    roots = written(components(links).withColumnRenamed("node", "id"), "roots")
    return written(bands.select("_key", "id", "n").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")


def similar_links(bands: DataFrame, sets: DataFrame, seeds: DataFrame, similarity: float = 0.8, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, stars: int = STARS) -> DataFrame:
    """Links (a, b) that leave components whole: every pair that shares a key in ``bands(_key, id, n)`` and is so
    similar is linked, directly or over others. ``sets(id, set)`` are the nodes' sets of ``n`` hashes;
    ``seeds(a, b)`` are links that are known already, and are part of the result.

    First come rounds of stars: every row of a bucket is held against the bucket's smallest, unless they are in one
    component. That is one comparison a row, and the same ones in most buckets of a group of copies. What is found
    contracts the components, the smallest rows have met all others and go, and buckets of one component are done.

    What a few rounds leave, rows that are not like their smallest ones, is dealt out as blocks of bounded size. Every
    pair of blocks of a bucket is compared in a group of its own that returns at most one link per row, and whose rows
    skip those of their own component: a large group of copies is never gathered in one task, and its pairs are never
    made as rows.
    """
    links, live = seeds.select("a", "b"), bands
    for _ in range(stars):
        rooted = _rooted(live, links)
        heads = rooted.groupBy("_key").agg(F.min("root").alias("_x"), F.max("root").alias("_y"), F.min(F.struct("id", "root")).alias("_head")).where("_x <> _y")
        met = written(rooted.join(written(heads.select("_key", "_head"), "heads"), "_key").where("id <> _head.id"), "stars")
        pairs = written(met.where("root <> _head.root").select(F.col("_head.id").alias("a"), F.col("id").alias("b")).distinct(), "star-pairs")
        if pairs.isEmpty():
            return links
        links, live = written(links.union(verified_pairs(pairs, sets, similarity)), "links"), met
    rooted = _rooted(live, links)
    members = [F.bit_xor(F.xxhash64("id")).alias("_m1"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("_m2"), F.count("*").alias("_c")]
    several = rooted.groupBy("_key").agg(F.min("root").alias("_x"), F.max("root").alias("_y"), F.sum(F.col("n") * 8).alias("_size"), *members).where("_x <> _y")
    # Near copies share many bands: of buckets with the same members one is compared.
    several = several.groupBy("_m1", "_m2", "_c").agg(F.min("_key").alias("_key"), F.max("_size").alias("_size"))
    n_blocks = F.greatest(F.ceil(F.col("_c") / block), F.ceil(F.col("_size") / block_bytes)).cast("int")
    several = written(several.select("_key", n_blocks.alias("_b")), "live")
    if several.isEmpty():
        return links
    rows = rooted.join(several, "_key").withColumn("_i", F.pmod(F.xxhash64("id"), "_b").cast("int"))
    # Block i meets every block j: the pair (i, j) is named by its smaller and larger number.
    rows = rows.select("id", "root", "_key", "_i", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("_j"))
    rows = written(rows.select("id", "root", "_key", "_i", F.least("_i", "_j").alias("_lo"), F.greatest("_i", "_j").alias("_hi")), "blocks")
    dealt = rows.join(sets, "id").repartition("_key", "_lo", "_hi").sortWithinPartitions("_key", "_lo", "_hi")
    found = dealt.select("_key", "_lo", "_hi", "_i", "id", "root", "set").mapInPandas(_compared(similarity), "a long, b long").distinct()
    return found.union(links)
