"""The pipeline's near-duplicate stage against brute force over all pairs."""

import itertools
import random

import corpus_pipeline
from treeline.llm import nearcopies as N
from treeline.llm import simhash as S

SF = "/root/testdata/sf0.001"


def brute_kept(docs, similarity=0.8, k=5):
    sets = []
    for _, t in docs:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
            root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(d)
    return sorted(min(g) for g in groups.values())


def varied_corpus():
    """Copies with one changed word in 120, chains of them, copies that are too far, and groups of many."""
    rng = random.Random(4)
    docs = []
    for i in range(25):
        own = [f"t{rng.randrange(4000)}" for _ in range(120)]
        docs.append(" ".join(own))
        for j in range(60 if i < 2 else 6):
            w = own if i % 2 else docs[-1].split()
            w = list(w)
            for _ in range(1 + (j % 5 if i % 3 else 0)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(99)}"
            docs.append(" ".join(w))
    ids = list(range(len(docs) + 6))
    rng.shuffle(ids)
    return list(zip(ids, [*docs, None, "", "A b", "a B", "one two three four five six", "x y"], strict=True))


def kept(spark, docs, stage):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted(r.doc_id for r in stage(df).collect())


def test_stage_keeps_what_brute_force_keeps(spark, monkeypatch):
    docs = varied_corpus()
    want = brute_kept(docs)
    assert kept(spark, docs, lambda d: corpus_pipeline.remove_near_duplicates(spark, d, SF)) == want
    # Tiny blocks: every bucket is split. No bits: the keys link equal fingerprints only.
    for stars in (0, 1):
        monkeypatch.setattr(N.similar_links, "__defaults__", (0.8, 2, 4096, stars))
        assert kept(spark, docs, lambda d: S.deduplicate(d, max_bits=0)) == want


def test_stage_on_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = corpus_pipeline.remove_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == brute_kept(rows)


def test_one_large_group_of_near_copies(spark):
    """Copies with a word changed in each: a comparison or two a text, not one a pair."""
    rng = random.Random(1)
    own = [f"t{rng.randrange(4000)}" for _ in range(120)]
    docs = []
    for i in range(3000):
        w = list(own)
        w[i % 120] = f"z{i}"
        docs.append((i, " ".join(w)))
    pairs = []
    real = N.verified_pairs
    N.verified_pairs = lambda p, *a: pairs.append(p.count()) or real(p, *a)
    try:
        assert kept(spark, docs, S.deduplicate) == [0]
    finally:
        N.verified_pairs = real
    assert sum(pairs) < 12 * len(docs)
