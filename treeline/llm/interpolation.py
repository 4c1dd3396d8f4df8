"""Log-probabilities of texts under a bigram model with deleted interpolation."""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import written

#: Bytes of text in a block, and distinct n-grams that meet in a group. They bound memory and change no result.
BLOCK_BYTES, GROUP = 12 << 20, 1_000_000
#: Bytes that are hashed at once.
SLICE = 1 << 20
#: Folds: counts come from KEPT, weights from DELETED, the model from both; HELD_OUT takes no part.
KEPT, DELETED, HELD_OUT = 0, 1, 2
#: One in so many training documents is in the deleted part.
PARTS = 16
#: Buckets of contexts by frequency: never seen, once, 2-3, 4-7 and so on.
BUCKETS = 21
#: Rounds of expectation-maximisation at most, and the gain in nats a token that ends them.
ROUNDS, GAIN = 40, 1e-6
#: A-Z become a-z, white space becomes a space; a line feed ends a document.
PLAIN = bytes(32 if b in b"\t\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
LOW40 = np.uint64((1 << 40) - 1)

_rng = np.random.default_rng(11)
_BYTE = _rng.integers(1, 1 << 64, 256, dtype=np.uint64)
_BYTE[[10, 32]] = 0
_PLACE = np.zeros(0, np.uint64)
#: Stands for the end of a document, and for what precedes its first word.
END = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(n: int) -> np.ndarray:
    """A random odd number for each place in a word."""
    global _PLACE
    if len(_PLACE) < n:
        _PLACE = _mix(np.arange(1, n + 4096, dtype=np.uint64) * END) | np.uint64(1)
    return _PLACE


def _slices(blob: bytes) -> Iterator[np.ndarray]:
    at = 0
    while at < len(blob):
        stop = at + SLICE
        if stop < len(blob):
            ends = [e for e in (blob.find(b" ", stop), blob.find(b"\n", stop)) if e >= 0]
            stop = min(ends) + 1 if ends else len(blob)
        yield np.frombuffer(blob[at:stop], np.uint8)
        at = stop


def token_hashes(blob: bytes) -> np.ndarray:
    """64-bit hashes of the words between spaces, and END for every line feed."""
    out = [np.zeros(0, np.uint64)]
    for x in _slices(blob):
        line, word = x == 10, (x != 10) & (x != 32)
        first = word.copy()
        first[1:] &= ~word[:-1]
        starts, ends, here = np.flatnonzero(first), np.flatnonzero(line), np.arange(len(x))
        place = here - np.maximum.accumulate(np.where(first, here, 0))
        h = _BYTE[x] * _places(int(place.max()) + 1)[place]
        h = _mix(np.add.reduceat(h, starts)) if len(starts) else np.zeros(0, np.uint64)
        order = np.argsort(np.concatenate((starts, ends)), kind="stable")
        out.append(np.concatenate((h, np.full(len(ends), END)))[order])
    return np.concatenate(out)


def fold_of(doc_id: int | None) -> int:
    """A null id counts as an empty one."""
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    return HELD_OUT if h % 7 == 2 else DELETED if h // 7 % PARTS == 0 else KEPT


def text_blocks(docs: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """(block, fold, ids, tokens, texts): the documents in blocks of about ``size`` bytes, each of one fold."""
    kind = pa.schema([("block", pa.int64()), ("fold", pa.int32()), ("ids", pa.list_(pa.int64())), ("tokens", pa.int64()), ("texts", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = itertools.count((task.partitionId() if task else 0) << 32)
        ids, texts, sizes = ({f: [] for f in (KEPT, DELETED, HELD_OUT)} for _ in range(3))

        def out(f: int) -> pa.RecordBatch:
            blob = b"".join(texts[f])
            row = {"block": next(number), "fold": f, "ids": list(ids[f]), "tokens": len(blob.split()) + len(ids[f]), "texts": zstandard.compress(blob, 3)}
            for x in (ids, texts, sizes):
                x[f].clear()
            return pa.RecordBatch.from_pylist([row], schema=kind)

        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                f = fold_of(doc_id)
                plain = (text or "").encode("utf-8", "surrogatepass").translate(PLAIN) + b"\n"
                if sizes[f] and sum(sizes[f]) + len(plain) > size:
                    yield out(f)
                ids[f].append(doc_id)
                texts[f].append(plain)
                sizes[f] = [sum(sizes[f]) + len(plain)]
        for f in ids:
            if ids[f]:
                yield out(f)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(pack, "block long, fold int, ids array<long>, tokens long, texts binary")


class Tokens:
    """The tokens of a block: ``keys`` of each n-gram length, sorted, with their counts and where each token's is."""

    def __init__(self, texts: bytes, groups: tuple[int, int], places: bool = True):
        self.hashes = token_hashes(zstandard.decompress(texts))
        before = np.concatenate((np.full(1, END), self.hashes[:-1]))
        pair = _mix(before * np.uint64(0xD6E8FEB86659FD93) + self.hashes)
        group = ((pair >> np.uint64(40)) * np.uint64(groups[1])) >> np.uint64(24)
        #: A bigram is told by its group and 40 bits within it, a word by 64.
        self.each = (self.hashes, (group << np.uint64(40)) | (pair & LOW40))
        found = [np.unique(k, return_inverse=places, return_counts=True) for k in self.each]
        self.keys, self.counts = [f[0] for f in found], [f[-1] for f in found]
        self.groups = [((self.keys[0] >> np.uint64(40)) * np.uint64(groups[0])) >> np.uint64(24), self.keys[1] >> np.uint64(40)]
        self.where = [f[1] for f in found] if places else None

    def totals(self, start: bool, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of each token's word and bigram: the block's own (``start``) or none where there is no answer."""
        found = []
        for n in (0, 1):
            total = self.counts[n].astype(np.int64) if start else np.zeros(len(self.keys[n]), np.int64)
            for a in answers:
                if a["n"] == n + 1:
                    total[np.searchsorted(self.keys[n], _unpacked(a["keys"], n, a["group"]))] = _planes(a["totals"])
            found.append(total)
        return found[0][self.where[0]], found[1][self.where[1]]


def _packed(keys: np.ndarray, n: int) -> bytes:
    return keys.tobytes() if n == 0 else keys.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(blob: bytes, n: int, group: int) -> np.ndarray:
    if n == 0:
        return np.frombuffer(blob, np.uint64)
    out = np.zeros((len(blob) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view(np.uint64) | np.uint64(group << 40)


def _as_planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte: small ones leave runs of zeros, which compress."""
    return np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()


def _planes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).reshape(-1).view(np.int64)


ANSWER = "block long, fold int, n int, group int, of int, keys binary, totals binary, stats array<long>"


def count_ngrams(blocks: DataFrame, groups: tuple[int, int]) -> DataFrame:
    """(block, fold, n, group, of, keys, totals, stats): what each block has to know of the whole corpus.

    A block sends its distinct words and bigrams, with counts, to groups by their hashes, where the blocks' counts are
    added up. What comes back is the total over all training documents (of 0), where it is not the block's own count,
    and to blocks of the deleted part also the total over the kept part (of 1), where there is one. Groups of words also
    give a row without a block: distinct words and tokens of the kept part, and of all training documents.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                t = Tokens(r["texts"], groups, places=False)
                for n in (0, 1):
                    first = np.flatnonzero(np.diff(t.groups[n].astype(np.int64), prepend=-1))
                    rows = [
                        {"n": n + 1, "group": int(t.groups[n][i]), "block": r["block"], "fold": r["fold"], "keys": _packed(t.keys[n][i:j], n), "counts": _as_planes(t.counts[n][i:j])}
                        for i, j in itertools.pairwise([*first.tolist(), len(t.keys[n])])
                    ]
                    kind = pa.schema([("n", pa.int32()), ("group", pa.int32()), ("block", pa.int64()), ("fold", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)

    kind = pa.schema([("block", pa.int64()), ("fold", pa.int32()), ("n", pa.int32()), ("group", pa.int32()), ("of", pa.int32()), ("keys", pa.binary()), ("totals", pa.binary()), ("stats", pa.list_(pa.int64()))])

    def total(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        n, group = rows[0]["n"] - 1, rows[0]["group"]
        keys = [_unpacked(r["keys"], n, group) for r in rows]
        counts = [_planes(r["counts"]) for r in rows]
        order = np.argsort(every := np.concatenate(keys), kind="stable")
        new = np.concatenate(([True], every[order][1:] != every[order][:-1]))
        place = np.empty(len(every), np.int64)
        place[order] = np.cumsum(new) - 1
        kept, both = np.zeros((2, int(new.sum())), np.int64)
        ends = np.cumsum([len(k) for k in keys])
        at = [place[e - len(k) : e] for k, e in zip(keys, ends, strict=True)]
        for r, p, c in zip(rows, at, counts, strict=True):  # a block has each key once
            if r["fold"] == KEPT:
                kept[p] += c
            if r["fold"] != HELD_OUT:
                both[p] += c
        out = []
        for r, k, p, c in zip(rows, keys, at, counts, strict=True):
            own = c if r["fold"] != HELD_OUT else 0
            for of, found, told in ((0, both[p], both[p] != own), (1, kept[p], kept[p] > 0)):
                if told.any() and (of == 0 or r["fold"] == DELETED):
                    out.append({"block": r["block"], "fold": r["fold"], "n": n + 1, "group": group, "of": of, "keys": _packed(k[told], n), "totals": _as_planes(found[told])})
        if n == 0:
            out.append({"block": None, "n": 1, "group": group, "stats": [int((kept > 0).sum()), int(kept.sum()), int((both > 0).sum()), int(both.sum())]})
        return pa.Table.from_pylist(out, schema=kind)

    sent = blocks.select("block", "fold", "texts").mapInArrow(send, "n int, group int, block long, fold int, keys binary, counts binary")
    return sent.groupBy("n", "group").applyInArrow(total, ANSWER)


def bucket_of(context: np.ndarray) -> np.ndarray:
    """Bucket of a context by its count."""
    return np.minimum(np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(int) + 1, 0), BUCKETS - 1)


def _before(words: np.ndarray, end: int) -> np.ndarray:
    return np.concatenate((np.full(1, end), words[:-1])) if len(words) else words


def deleted_counts(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """(bucket, context, pair, word, n): tokens of the deleted part by the kept part's counts of their context, of both
    together and of themselves."""

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        out, asked = [], right.to_pylist()
        for r in left.to_pylist():
            t = Tokens(r["texts"], (r["g1"], r["g2"]))
            word, pair = t.totals(False, asked)
            end = word[np.flatnonzero(t.hashes == END)[0]]
            cols = np.stack((_before(word, end), pair, word))
            order = np.lexsort(cols)
            cols = cols[:, order]
            first = np.flatnonzero(np.concatenate(([True], (cols[:, 1:] != cols[:, :-1]).any(axis=0))))
            n = np.diff(np.append(first, cols.shape[1]))
            cols = cols[:, first]
            out.append(pa.table({"bucket": pa.array(bucket_of(cols[0]), pa.int32()), "context": cols[0], "pair": cols[1], "word": cols[2], "n": n}))
        kind = pa.schema([("bucket", pa.int32()), *((c, pa.int64()) for c in ("context", "pair", "word", "n"))])
        return pa.concat_tables(out) if out else kind.empty_table()

    told = answers.where(f"fold = {DELETED} and of = 1")
    return blocks.where(f"fold = {DELETED}").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(look, "bucket int, context long, pair long, word long, n long")


def learn_weights(deleted: DataFrame, words: int, tokens: int, rounds: int = ROUNDS, gain: float = GAIN) -> np.ndarray:
    """Weights (bucket; of the bigram's, the word's and the uniform estimate) by expectation-maximisation on the deleted
    part: each round shares every token out to the estimates by what they give it, in one aggregate per bucket, and
    each share counts one token more than it has. Where the deleted part has no token of a bucket, the next lower
    bucket's weights hold (equal ones below all), and contexts never seen have no bigram estimate."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    seen, last = np.zeros(BUCKETS, bool), -math.inf
    for _ in range(rounds):
        w = [F.element_at(F.array(*[F.lit(float(x)) for x in weights[:, i]]), F.col("bucket") + 1) for i in range(3)]
        given = (F.when(F.col("context") > 0, w[0] * F.col("pair") / F.col("context")).otherwise(0.0), w[1] * F.col("word") / max(tokens, 1), w[2] / (words + 1))
        rows = deleted.select("bucket", "n", *[g.alias(f"p{i}") for i, g in enumerate(given)]).withColumn("p", F.expr("p0 + p1 + p2"))
        sums = [F.sum(F.col("n") * F.col(f"p{i}") / F.col("p")).alias(f"s{i}") for i in range(3)]
        found = rows.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log("p")).alias("fit"), *sums).collect()
        for r in found:
            share = np.array([r.s0, r.s1, r.s2]) + 1
            seen[r.bucket], weights[r.bucket] = True, share / share.sum()
        fit = sum(r.fit for r in found) / max(1, sum(r.n for r in found))
        if not found or fit - last < gain:
            break
        last = fit
    for b in range(BUCKETS):
        if not seen[b]:
            weights[b] = weights[b - 1] if b > 1 else 1 / 3
    weights[0] = [0, weights[0][1], weights[0][2]]
    weights[0] /= weights[0].sum()
    if not tokens:
        weights[:] = [0, 0, 1]
    return weights


def score_texts(docs: DataFrame, block_bytes: int = BLOCK_BYTES, group: int = GROUP) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of ``docs(doc_id, text)``.

    Tokens are the words between white space (A-Z lower-cased), then one end. Training documents are those whose
    crc32(doc_id as text) mod 7 is not 2. base_score adds up log10((c + 1) / (N + V + 1)), score the log10 of the
    interpolated probability: the bigram's and the word's share in training and 1 / (V + 1), mixed by weights that
    depend on the frequency of the token before. Weights are learned on a sixteenth of the training documents against
    the counts of the rest; then all training documents are counted.

    Null texts are empty (one token, the end); a null id counts as an empty one (training); rows that repeat count
    each; other columns don't matter, whatever their names; an empty table gives an empty one. Texts of any length stay
    whole. Without training documents every token has probability 1.
    """
    blocks = written(text_blocks(docs, block_bytes), "blocks")
    tokens = blocks.agg(F.sum("tokens")).first()[0] or 0
    groups = (max(1, -(-tokens // (4 * group))), max(1, -(-tokens // group)))
    blocks = blocks.withColumns({"g1": F.lit(groups[0]), "g2": F.lit(groups[1])})
    answers = written(count_ngrams(blocks, groups), "counts")
    stats = answers.where("block is null").agg(*[F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(4)]).first()
    v_kept, n_kept, v, n = (x or 0 for x in stats)
    deleted = written(deleted_counts(blocks, answers), "deleted")
    weights = learn_weights(deleted, v_kept, n_kept)
    if not n:
        weights[:] = [0, 0, 1]

    result = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out, asked = [], right.to_pylist()
        for r in left.to_pylist():
            t = Tokens(r["texts"], groups)
            word, pair = t.totals(r["fold"] != HELD_OUT, asked)
            ends = np.flatnonzero(t.hashes == END)
            context = _before(word, word[ends[0]])
            w = weights[bucket_of(context)]
            p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(n, 1) + w[:, 2] / (v + 1)
            first = np.concatenate(([0], ends[:-1] + 1))
            add = lambda x, first=first: np.add.reduceat(x, first)
            cols = {"doc_id": pa.array(r["ids"], pa.int64()), "held_out": pa.array([r["fold"] == HELD_OUT] * len(ends)), "n_tokens": ends - first + 1, "n_known": add((word > 0).astype(np.int64)), "train_tokens": np.full(len(ends), n)}
            out.append(pa.table(cols | {"base_score": add(np.log10((word + 1) / (n + v + 1))), "score": add(np.log10(p))}))
        return pa.concat_tables(out) if out else result.empty_table()

    told = answers.where("of = 0")
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, kind)
