"""SimHash near-duplicates found through Golay-code keys."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import LOWER_ASCII, components, set_aside, written
from treeline.llm.nearcopies import band_keys, shared_bands, similar_links, verified_pairs

BITS = 64
#: The generator polynomial of the binary Golay code, and the code's length and message length.
GENERATOR, LENGTH, MESSAGE = 0b101011100011, 23, 12

#: First bit and width of each segment of a fingerprint. The last is filled up with zeros.
SEGMENTS = ((0, 23), (23, 23), (46, 18))

#: Fingerprints that one task compares at once with as many others, and that one task makes keys of.
BLOCK, KEYED_ROWS = 4096, 50_000


def shingle_hashes(text: str | None, shingle_words: int) -> np.ndarray:
    """XXH64 hashes of a text's shingles in order, repeats included. Fewer words are one shingle, none have none."""
    words = text.encode().translate(LOWER_ASCII).split() if text else []
    if not words:
        return np.empty(0, dtype="<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(shingle_words, len(words))
    starts = np.concatenate(([0], ends[: len(words) - k])).tolist()
    stops = (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], dtype="<u8")


def majority_bits(h: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half of the hashes; 0 if there are none."""
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 65536):
        bits = np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    return majority_bits(shingle_hashes(text, shingle_words))


@cache
def _error_patterns() -> np.ndarray:
    """The error of at most three bits for each of the 2048 syndromes: the code is perfect, so there is one."""
    one = _syndromes(np.left_shift(1, np.arange(LENGTH)))
    table = np.zeros(1 << (LENGTH - MESSAGE), dtype=np.int64)
    bits = [1 << i for i in range(LENGTH)]
    for i in range(LENGTH):
        table[one[i]] = bits[i]
        for j in range(i):
            table[one[i] ^ one[j]] = bits[i] | bits[j]
            for k in range(j):
                table[one[i] ^ one[j] ^ one[k]] = bits[i] | bits[j] | bits[k]
    return table


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of the words as polynomials over GF(2), divided by the generator."""
    r = np.array(words, dtype=np.int64)
    for bit in range(LENGTH - 1, LENGTH - MESSAGE - 1, -1):
        r = np.where(r >> bit & 1, r ^ (GENERATOR << (bit - (LENGTH - MESSAGE))), r)
    return r


def decode(words: np.ndarray) -> np.ndarray:
    """Index (the message bits) of the codeword nearest to each 23-bit word."""
    return (words ^ _error_patterns()[_syndromes(words)]) >> (LENGTH - MESSAGE)


def nearby_indices(words: np.ndarray, width: int = LENGTH) -> np.ndarray:
    """Codeword indices of the words themselves (column 0) and of all words one flip away among the low ``width``
    bits: one to six different ones; -1 stands for no further one."""
    words = np.asarray(words, dtype=np.int64)
    own = decode(words)
    near = decode(words[:, None] ^ (1 << np.arange(width))[None, :])
    near[near == own[:, None]] = -1
    near.sort(axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    return np.concatenate((own[:, None], -np.sort(-near, axis=1)[:, :5]), axis=1)


def block_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key) for all keys.

    Of two words one flip apart, one has odd weight. So if only words of odd weight list the indices of the words
    around them, and words of even weight their own one, words that differ in at most one bit share an index.
    At most three differing bits leave either at most one in each of the three segments: a key of three indices
    finds these; or two and more in one segment and at most one in the other two together: a key of their two
    indices finds these, with one weight for both of them.
    """
    words = [(fps >> np.uint64(at)).astype(np.int64) & ((1 << width) - 1) for at, width in SEGMENTS]
    near = [nearby_indices(w, width) for w, (_, width) in zip(words, SEGMENTS, strict=True)]
    odd = [np.bitwise_count(w).astype(np.int64) & 1 for w in words]
    each = [np.where((o[:, None] == 1) | (np.arange(6) == 0)[None, :], n, -1) for n, o in zip(near, odd, strict=True)]
    x, y, z = each[0][:, :, None, None], each[1][:, None, :, None], each[2][:, None, None, :]
    found = [np.where((x >= 0) & (y >= 0) & (z >= 0), (x << 2 * MESSAGE) | (y << MESSAGE) | z, -1).reshape(len(fps), -1)]
    for n, (a, b) in enumerate(((0, 1), (0, 2), (1, 2)), start=1):
        both = np.concatenate((np.stack((near[a], np.broadcast_to(near[b][:, :1], near[a].shape)), axis=2), np.stack((np.broadcast_to(near[a][:, :1], near[b][:, 1:].shape), near[b][:, 1:]), axis=2)), axis=1)
        use = (both >= 0).all(axis=2) & ((odd[a] ^ odd[b])[:, None].astype(bool) | (np.arange(both.shape[1]) == 0)[None, :])
        found.append(np.where(use, (n << 3 * MESSAGE) | (both[:, :, 0] << MESSAGE) | both[:, :, 1], -1))
    keys = np.concatenate(found, axis=1)
    at = np.nonzero(keys >= 0)
    return at[0], keys[at]


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """``docs`` with one more column ``_fp`` (long). Null and empty texts have fingerprint zero."""

    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = [fingerprint(t, shingle_words) for t in texts]
            yield pd.Series(np.array(found, dtype=np.uint64).view(np.int64), dtype="int64")

    return docs.withColumn("_fp", hashed.asNondeterministic()("text"))  # evaluated once, whatever is asked of it later


def _links(left: np.ndarray, right: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks of fingerprints (or within one, given twice).
    Rows that an earlier row has already reached through a common neighbour add one edge at most."""
    root = {int(x): int(x) for x in np.concatenate((left, right))}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []
    for x in left:
        near = right[np.bitwise_count(right ^ x) <= max_bits]
        a = find(int(x))
        for y in near.tolist():
            b = find(y)
            if a != b:
                edges.append((int(x), y))
                root[b] = a
    return edges


def _compare_sorted(rows: pd.DataFrame, max_bits: int, small: int = 8) -> pd.DataFrame:
    """Links within each pair of blocks; ``rows`` are sorted by pair. Small ones are compared all at once."""
    values, side, lo, hi = (rows[c].to_numpy() for c in ("_fp", "_i", "_lo", "_hi"))
    key = rows["_key"].to_numpy()
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    starts = np.nonzero(new)[0]
    sizes = np.diff(np.append(starts, len(rows)))
    stop = np.repeat(starts + sizes, sizes)
    found = [np.empty((0, 2), dtype=np.int64)]
    at = np.nonzero(np.repeat(sizes <= small, sizes))[0]
    for d in range(1, small):
        at = at[at + d < stop[at]]
        near = at[np.bitwise_count(values[at] ^ values[at + d]) <= max_bits]
        found.append(np.stack((values[near], values[near + d]), axis=1))
    for a, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        v, s = values[a : a + n], side[a : a + n]
        if edges := _links(v[s == lo[a]], v[s == hi[a]], max_bits):
            found.append(np.array(edges, dtype=np.int64))
    return pd.DataFrame(np.concatenate(found), columns=["a", "b"])


def fingerprint_links(fps: DataFrame, max_bits: int = 3, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fps(_fp)`` that differ in at most ``max_bits`` bits (three
    at most), thinned to a spanning forest per bucket: components are whole, all pairs are never made.

    A bucket of n fingerprints is dealt out as n/block blocks and every pair of blocks is compared in a task of
    its own, so no task holds more than two blocks however large a bucket grows.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the keys are complete for at most 3 differing bits")

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["_fp"].to_numpy(np.int64)
            for i in range(0, len(values), 2048):
                part = values[i : i + 2048]
                rows, keys = block_keys(part.view(np.uint64))
                yield pd.DataFrame({"_fp": part[rows], "_key": keys})

    # Some fifty keys come of eight bytes: partitions go by rows, not by the bytes read.
    parts = max(fps.count() // KEYED_ROWS + 1, fps.sparkSession.sparkContext.defaultParallelism)
    keys = written(fps.repartition(parts).mapInPandas(keyed, "_fp long, _key long"), "keys")
    sizes = keys.groupBy("_key").agg(F.count("*").alias("_n"), F.min("_fp").alias("a"), F.max("_fp").alias("b")).where("_n > 1")
    sizes = written(sizes, "buckets")
    # Most buckets hold two fingerprints, by chance or because they are near: their pair is already here.
    two = sizes.where("_n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b")
    n_blocks = F.ceil(F.col("_n") / block).cast("int")
    members = keys.join(sizes.where("_n > 2").select("_key", "_n"), "_key").select("_key", "_fp", n_blocks.alias("_b"), F.pmod(F.xxhash64("_fp"), n_blocks).cast("int").alias("_i"))
    # Block i meets every block j: the pair (i, j) is named by its smaller and larger number.
    others = F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("_j")
    members = members.select("_key", "_fp", "_i", "_b", others).select("_key", "_fp", "_i", F.least("_i", "_j").alias("_lo"), F.greatest("_i", "_j").alias("_hi"))

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = pd.DataFrame()
        for batch in batches:
            batch = pd.concat([rest, batch], ignore_index=True)
            last = (batch[["_key", "_lo", "_hi"]] == batch[["_key", "_lo", "_hi"]].iloc[-1]).all(axis=1).to_numpy()
            cut = int(np.argmax(last))  # the last pair of blocks may go on in the next batch
            rest = batch.iloc[cut:]
            if cut:
                yield _compare_sorted(batch.iloc[:cut], max_bits)
        if len(rest):
            yield _compare_sorted(rest, max_bits)

    dealt = members.repartition("_key", "_lo", "_hi").sortWithinPartitions("_key", "_lo", "_hi")
    return dealt.mapInPandas(compared, "a long, b long").union(two).distinct()


def near_duplicates(hashed: DataFrame, max_bits: int = 3) -> DataFrame:
    """``hashed(..., _fp)`` -> ``(_fp, _root)`` for each distinct fingerprint: its component's representative."""
    fps = written(hashed.select("_fp").distinct(), "fingerprints")
    roots = components(written(fingerprint_links(fps, max_bits), "links"))
    return fps.join(roots.withColumnRenamed("node", "_fp"), "_fp", "left").select("_fp", F.coalesce("root", "_fp").alias("_root"))


def simhash_components(docs: DataFrame, max_bits: int = 3, shingle_words: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, fingerprint, component_id), one row per input row.

    component_id is the smallest doc_id reachable over links of at most ``max_bits`` differing bits (null if
    all of a component's ids are null). Copies share a fingerprint and are linked through it; they are never
    paired. Null and empty texts have fingerprint zero, which is linked like any other. Rows that repeat share a
    component; texts of any length are read whole; other columns are ignored; an empty table gives an empty one.
    """
    hashed = written(fingerprints(docs.select("doc_id", "text"), shingle_words).select("doc_id", "_fp"), "simhash")
    roots = written(near_duplicates(hashed, max_bits), "roots")
    first = hashed.groupBy("_fp").agg(F.min("doc_id").alias("_first"))
    least = roots.join(first, "_fp").groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = written(roots.join(least, "_root").select("_fp", "component_id"), "named")
    return hashed.join(named, "_fp").select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def _described(shingle_words: int) -> Column:
    """Of a text: fp, id (a hash of its set of shingles), n (their number) and the set's band keys."""

    @F.pandas_udf("fp long, id long, n int, keys array<long>")
    def described(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                h = shingle_hashes(t, shingle_words)
                own = np.unique(h)
                rows.append((_signed(majority_bits(h)), _signed(xxhash.xxh64_intdigest(own.tobytes())), len(own), band_keys(own)))
            yield pd.DataFrame(rows, columns=["fp", "id", "n", "keys"])

    return described.asNondeterministic()("text")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _sets(texts: DataFrame, shingle_words: int) -> DataFrame:
    """``texts(id, text)`` -> (id, set), the set as the bytes of its sorted hashes."""

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.unique(shingle_hashes(t, shingle_words)).tobytes() for t in batch], dtype=object)

    return texts.select("id", packed.asNondeterministic()("text").alias("set"))


def _key_pairs(nodes: DataFrame, max_bits: int) -> DataFrame:
    """Pairs of ``nodes(id, fp)`` that the Golay keys bring together, thinned: nodes of one fingerprint meet its
    first, and linked fingerprints meet with their firsts."""
    firsts = written(nodes.groupBy("fp").agg(F.min("id").alias("first")), "fingerprints")
    links = fingerprint_links(firsts.select(F.col("fp").alias("_fp")), max_bits)
    for c in "ab":
        links = links.join(firsts.select(F.col("fp").alias(c), F.col("first").alias(f"_{c}")), c)
    own = nodes.join(firsts, "fp").where("id <> first").select("id", "first")
    return links.select(F.col("_a").alias("a"), F.col("_b").alias("b")).union(own)


def deduplicate(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` with one row left of each group that is linked by word shingles of at least this
    Jaccard similarity: that of the smallest doc_id (null ids last; of rows that repeat it, one).

    Texts whose fingerprints differ in at most ``max_bits`` bits meet through their Golay keys and are held against
    the exact similarity; links between the components that this leaves, which are further apart, are completed
    through ``nearcopies``. Texts with equal sets of shingles are one node; null texts and texts without words are
    copies of each other. Other columns are kept, whatever their names. An empty table gives an empty one.
    """
    original, docs = docs.columns, set_aside(docs)
    names = docs.columns
    hashed = written(docs.withColumn("_near", _described(shingle_words)).withColumn("_row", F.monotonically_increasing_id()), "nearcopies")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_row").alias("r"))
    firsts = written(hashed.groupBy(F.col("_near.id").alias("id")).agg(F.min(order).alias("first")), "firsts")
    rows = firsts.select("id", F.col("first.r").alias("_row"))
    nodes = written(hashed.join(rows, "_row").select("id", F.col("_near.n").alias("n"), F.col("_near.keys").alias("keys"), F.col("_near.fp").alias("fp")), "nodes")
    pairs = written(_key_pairs(nodes, max_bits), "pairs")
    bands = shared_bands(nodes)
    asked = written(bands.select("id").union(pairs.select("a")).union(pairs.select("b")).distinct(), "candidates")
    texts = hashed.select("_row", "text").join(rows.join(asked, "id"), "_row").select("id", "text")
    sets = written(_sets(texts, shingle_words), "sets")
    seeds = written(verified_pairs(pairs, sets, similarity), "seeds")
    roots = written(components(similar_links(bands, sets, seeds, similarity)), "roots")
    rooted = firsts.join(roots.withColumnRenamed("node", "id"), "id", "left")
    keep = written(rooted.groupBy(F.coalesce("root", "id").alias("g")).agg(F.min("first").alias("first")).select(F.col("first.r").alias("_row")), "kept")
    return hashed.join(keep, "_row", "left_semi").select(*[F.col(f"`{c}`") for c in names]).toDF(*original)
