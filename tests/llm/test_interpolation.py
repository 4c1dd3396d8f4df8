"""Interpolated scores against counts in dictionaries, and on awkward rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from treeline.llm import interpolation as I

SCHEMA = "doc_id long, text string"


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", lower), None]


def brute(rows):
    docs = [(d, I.fold_of(d), tokens(t)) for d, t in rows]

    def count(folds):
        one, two = Counter(), Counter()
        for _, fold, words in docs:
            if fold in folds:
                one.update(words)
                two.update(zip([None, *words], words, strict=False))
        return one, two

    def bucket(c):
        return min(int(math.log2(c)) + 1, I.BUCKETS - 1) if c else 0

    def shares(w, c, p, u, n, v):
        return w[0] * p / c if c else 0, w[1] * u / max(n, 1), w[2] / (v + 1)

    one, two = count({I.KEPT})
    seen = Counter((one[a], two[a, b], one[b]) for _, f, words in docs if f == I.DELETED for a, b in zip([None, *words], words, strict=False))
    weights, last = {b: [1 / 3] * 3 for b in range(I.BUCKETS)}, -math.inf
    for _ in range(I.ROUNDS):
        sums = {bucket(c): [1.0] * 3 for c, _, _ in seen}
        fit = 0
        for (c, p, u), n in seen.items():
            s = shares(weights[bucket(c)], c, p, u, sum(one.values()), len(one))
            fit += n * math.log(sum(s))
            sums[bucket(c)] = [x + n * y / sum(s) for x, y in zip(sums[bucket(c)], s, strict=True)]
        weights |= {b: [x / sum(s) for x in s] for b, s in sums.items()}
        fit /= max(1, sum(seen.values()))
        if not seen or fit - last < I.GAIN:
            break
        last = fit
    for b in range(2, I.BUCKETS):
        if b not in {bucket(c) for c, _, _ in seen}:
            weights[b] = weights[b - 1]
    if 1 not in {bucket(c) for c, _, _ in seen}:
        weights[1] = [1 / 3] * 3
        for b in range(2, I.BUCKETS):
            if b not in {bucket(c) for c, _, _ in seen}:
                weights[b] = weights[b - 1]
    weights[0] = [0, *(x / sum(weights[0][1:]) for x in weights[0][1:])]
    one, two = count({I.KEPT, I.DELETED})
    n, v = sum(one.values()), len(one)
    out = []
    for d, fold, words in docs:
        pairs = list(zip([None, *words], words, strict=False))
        base = sum(math.log10((one[b] + 1) / (n + v + 1)) for b in words)
        score = sum(math.log10(sum(shares(weights[bucket(one[a])], one[a], two[a, b], one[b], n, v))) for a, b in pairs)
        out.append((d, fold == I.HELD_OUT, len(words), sum(one[b] > 0 for b in words), n, base, score))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


@pytest.mark.parametrize(("size", "group"), [(300, 20), (I.BLOCK_BYTES, I.GROUP)])
def test_scores_equal_counting(spark, size, group):
    """Many small blocks and groups give what one of each gives."""
    rng = random.Random(5)
    words = [f"W{i}é" if i % 5 else f"w{i}" for i in range(60)]
    rows = [(i, rng.choice(" \t\n").join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randint(0, 40)))) for i in range(400)]
    rows += [(i + 400, rows[7][1]) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    same(I.score_texts(df, size, group).collect(), brute(rows))


def test_odd_rows(spark):
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [(None, "One two"), (1, None), (2, ""), (3, " \n\t "), (4, long), (4, long), (6, "ÄÖ ßé — ſ \v x"), (9, "\x00   a"), (12, "y" * 3_000_000)]
    df = spark.createDataFrame([(*r, 1, "k", 2.0) for r in rows], f"{SCHEMA}, block int, fold string, score double")
    same(I.score_texts(df).collect(), brute(rows))
    assert I.score_texts(df.limit(0)).collect() == []
    held = [(d, "a b c") for d in range(60) if I.fold_of(d) == I.HELD_OUT]
    assert {tuple(r)[1:] for r in I.score_texts(spark.createDataFrame(held, SCHEMA)).collect()} == {(True, 4, 0, 0, 0.0, 0.0)}


def test_hashes_of_slices(monkeypatch):
    rng = random.Random(2)
    blob = b"".join(rng.choice([b"a", b"bc", b" ", b"\n", b"d" * 50]) for _ in range(4000))
    whole = I.token_hashes(blob)
    monkeypatch.setattr(I, "SLICE", 7)
    assert (I.token_hashes(blob) == whole).all()
    names = [w for line in blob.decode().split("\n")[:-1] for w in [*line.split(), None]] + blob.decode().rsplit("\n", 1)[1].split()
    assert len(names) == len(whole) and len({(a, int(b)) for a, b in zip(names, whole, strict=True)}) == len(set(names)) == len(set(whole.tolist()))


def test_mixture_beats_single_words(spark):
    """Held-out texts: the model's perplexity is below that of smoothed words."""
    got = I.score_texts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).where("held_out").toPandas()
    n = got.n_tokens.sum()
    assert 10 ** (-got.score.sum() / n) < 0.5 * 10 ** (-got.base_score.sum() / n)
