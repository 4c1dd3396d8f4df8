"""Spelling variants against all pairs of words, and on awkward rows."""

import itertools
import random
from collections import Counter

import pytest
from treeline.llm import variants as V


def distance_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for word, k in V.occurrences(doc_id, text or ""):
            n[word] += k
    n = {w: k for w, k in n.items() if k >= 3}
    near = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if distance_one(a, b):
            near[a].append(b)
            near[b].append(a)
    best = {w: min(x, key=lambda y: (-n[y], y)) for w, x in near.items() if x}
    form = {w: f for w, f in best.items() if n[f] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def near_copies(rng, n):
    """Words of few letters, with many near and chained pairs, and frequent beginnings and ends."""
    letters, out = "abé", []
    for _ in range(n):
        w = rng.choice(["", "abab", "éaa"]) + "".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) + rng.choice(["", "tion", "ab"])
        out += [w] * rng.choice([1, 3, 4, 9, 20, 50])
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])
            out += [w] * rng.choice([1, 3, 7])
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("over", [100, 5, 0])
def test_variants_equal_all_pairs(spark, over):
    rng = random.Random(over)
    words = near_copies(rng, 160)
    rows = [(i, " ".join(w.upper() if i % 3 else w for w in words[i::40])) for i in range(40)]
    got = V.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), frequent_over=over)
    want = brute(rows)
    assert {tuple(r) for r in got.collect()} == want
    assert sum(w[1] is not None for w in want) > 30 and any(w[1] != w[2] for w in want if w[1])


def test_one_edit_leaves_a_gram():
    """For any dictionary: a near pair shares grams beyond what the bound says may be touched, and a list."""
    rng = random.Random(3)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(5, 14)))
        i = rng.randrange(len(a))
        b = rng.choice([a[:i] + rng.choice("abc") + a[i:], a[:i] + rng.choice("bc") + a[i + 1 :]])
        if a == b:
            continue
        frequent = {"".join(rng.choice("ab\x02\x03") for _ in range(rng.randint(2, 6))): rng.randint(1, 9) for _ in range(rng.choice([0, 30, 300]))}
        x, y = (set(V.lists_of(w, frequent)) for w in (a, b))
        side = 0 if len(a) == len(b) else 1
        assert {k for k, s in x if s == 0} & {k for k, s in y if s == side}, (a, b)
        for s in (f"\x02{w}\x03" for w in (a, b)):
            longest = (len(s)) // 2
            grams = V.cut(s, frequent, longest)
            assert len(grams) > V.affected(grams, longest) and all(p < q and e < f for (p, e), (q, f) in itertools.pairwise(grams))


def test_dictionary_is_bounded(spark):
    words = spark.createDataFrame([(w, 3) for w in {"".join(p) for p in itertools.product("ab", repeat=9)}], "word string, n long")
    free, held = V.gram_dictionary(words, 1), V.gram_dictionary(words, 1, limit=40)
    assert len(held) <= 40 < len(free) and all(free[g] == n for g, n in held.items())


def test_odd_rows(spark):
    long = "abcdefgh" * 5000
    rows = [(None, "Couleur couleur COULEUR", 1, "x"), (1, None, 2, None), (2, "", 3, "y"), (3, "couleurs Couleurs-couleurs ab ab ab ÷×÷×÷ ÉÉÉÉÉ", 4, "n"), (4, f"{long} {long}x {long}x {long}x", 5, "z"), (5, f"{long} {long}", 6, "k"), (5, f"{long} {long}", 6, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, word string")
    got = {tuple(r) for r in V.spelling_variants(df).collect()}
    assert got == brute([r[:2] for r in rows]) and len(got) == 4
    assert V.spelling_variants(df.limit(0)).collect() == []


def test_lists_are_not_broadcast(spark):
    """Posting lists are many times the words that Spark sizes them by, so no table that grows with the words is broadcast."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") not in ("-1", "0")
    words = spark.createDataFrame([(f"couleur{c}", n) for n, c in enumerate("abcdef", 3)], "word string, n long")
    docs = spark.createDataFrame([(1, " ".join(f"couleur{c} " * n for n, c in enumerate("abcdef", 3)))], "doc_id long, text string")
    for df in (V.near_words(words), V.spelling_variants(docs)):
        assert df.count() and "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
