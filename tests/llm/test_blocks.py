"""Blocks of items and of slots change no result, and predictions are those of a plain kernel regression."""

import itertools
import random
import tracemalloc

import numpy as np
from treeline.llm import decontaminate as D
from treeline.llm import language as L

SF = "/root/testdata/sf0.001"


def test_blocks_of_items_clean_as_one_block_does(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 as _row", "'x' as _hits")
    docs = docs.union(docs.limit(3)).union(docs.limit(2).selectExpr("*").withColumn("text", docs.text.substr(1, 0)))
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    one, many = (sorted(map(repr, D.decontaminate(docs, items, block_words=n).collect())) for n in (D.BLOCK_WORDS, 400))
    assert len(D._blocks(items, 400)) > 2 and one == many
    assert D.decontaminate(docs.limit(0), items, block_words=400).count() == 0


def test_items_that_repeat_a_text_are_one_text_of_several_ids(spark):
    text = " ".join(f"word{i}" for i in range(30))
    items = spark.createDataFrame([(str(i) if i else None, text) for i in range(300)] + [("z", text.upper()), ("z", text)], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"so {text} ends"), (2, "clean words alone")], "doc_id long, text string")
    got = {r.doc_id: r for r in D.contamination_digest(docs, items, block_words=200).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items) == (32, 30, 300) and got[2].n_hit == 0
    assert len(D._blocks(items.select("text").distinct(), 200)) < 5


def test_automaton_equals_all_windows_on_few_words():
    """Few words, so that states split often, have several items and several transitions."""
    for seed in range(60):
        rng = random.Random(seed)
        window, letters = rng.randrange(1, 6), [bytes([97 + i]) for i in range(rng.randrange(1, 4))]
        items = [(i, rng.choices(letters, k=rng.randrange(0, 14))) for i in range(rng.randrange(0, 7))]
        machine = D.ItemAutomaton(items, window)
        for _ in range(5):
            text = rng.choices([*letters, b"other"], k=40)
            hit, found = set(), set()
            for (name, own), i in itertools.product(items, range(40)):
                n = min(window, len(own))
                if n and any(own[j : j + n] == text[i : i + n] for j in range(len(own) - n + 1)):
                    hit.update(range(i, i + n))
                    found.add(name)
            spans, names = machine.scan(text)
            assert {x for a, b in spans for x in range(a, b)} == hit and names == found
            assert all(b < c for (_, b), (c, _) in itertools.pairwise(spans))


def test_automaton_takes_few_bytes_a_word():
    rng = random.Random(4)
    vocabulary = [b"w%d" % int(3000 * rng.random() ** 3) for _ in range(40_000)]
    items = [((str(i),), vocabulary[i * 40 : i * 40 + 40]) for i in range(1000)]
    tracemalloc.start()
    machine = D.ItemAutomaton(items, 10)
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(machine.link) > 40_000 and most / 40_000 < 300


def test_slots_as_bits_and_back():
    at = np.array([0, 7, 8, L.SLOTS - 1])
    assert L.unpack(L.pack(at)).tolist() == at.tolist() and len(L.pack(at)) == L.SLOTS // 8
    assert L.unpack(L.pack(at[:0])).tolist() == []


def test_slots_unpacked_in_parts_give_the_same_kernel(monkeypatch):
    texts = [f"word{i} {'abcdefg'[i % 7] * 3} und die katze {i * i}" for i in range(21)]
    sets = [L.presence(t) for t in texts]
    model = L.landmark_model(["x", "y", "z"], sets[:13])
    whole = model.kernel(sets)
    monkeypatch.setattr(L, "BATCH_SLOTS", 7)
    assert np.array_equal(whole, model.kernel(sets)) and whole.shape == (21, 13)


def test_predictions_equal_plain_regression(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in L.identify_languages(docs).collect()}
    rows = [r for r in docs.select("doc_id", "text", "lang").collect() if r.text and any(map(str.isalpha, r.text))]
    known = [r for r in rows if r.lang is not None and not got[r.doc_id].held_out]
    assert len(known) < L.FIT_ROWS and max(sum(r.lang == x for r in known) for x in {r.lang for r in known}) <= L.FIT_PER_LANGUAGE
    # The same landmarks: those of the smallest hashes in each language.
    u = {r.doc_id: r.u for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id, 7), 1 << 30) as u").collect()}
    names = sorted({r.lang for r in known})
    marks = [r for x in names for r in sorted((r for r in known if r.lang == x), key=lambda r: u[r.doc_id])[: L.LANDMARKS]]
    sets = {r.doc_id: set(L.presence(r.text).tolist()) for r in rows}
    k = lambda a, b: np.array([[len(sets[x.doc_id] & sets[y.doc_id]) / (len(sets[x.doc_id]) * len(sets[y.doc_id])) ** 0.5 for y in b] for x in a])
    left, y = k(known, marks), np.array([[1.0 if r.lang == x else -1.0 for x in names] for r in known])
    w = np.array([1 / sum(r.lang == s.lang for s in known) for r in known])[:, None]
    alpha = np.linalg.solve(left.T @ (left * w) + 1e-2 * k(marks, marks) + 1e-8 * np.eye(len(marks)), left.T @ (y * w))
    asked = rows[::3]
    values = k(asked, marks) @ alpha
    top = np.sort(values, axis=1)
    score = 1 / (1 + np.exp(-4 * (top[:, -1] - top[:, -2])))
    for r, v, s in zip(asked, values, score, strict=True):
        assert got[r.doc_id].lang_pred == names[v.argmax()] and abs(got[r.doc_id].score - s) < 1e-3
