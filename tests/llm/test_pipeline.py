import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_their_decisions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    seen = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns[: len(names)] == names
        assert docs.columns == names or i == len(corpus_pipeline.STAGES) - 1
        seen.append(docs.count())
        assert docs.select("doc_id").distinct().count() == seen[-1]
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeats", "decontamination", "mixture"]


def test_stages_on_empty_and_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    for rows in ([], [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, None), (None, "same words here", "en", "s", 15, "y"), (3, "same words here", None, None, 15, "y")]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.columns[:6] == docs.columns[:6]
            docs = spark.createDataFrame(out.select(*docs.columns).collect(), schema)
        assert docs.count() <= 3


def test_stages_on_very_long_texts(spark):
    """Of two long near copies one stays as it is, and a benchmark item inside a long text is cut out of it."""
    rng = random.Random(6)
    long, other = (" ".join(f"{w}{rng.randrange(20_000)}" for _ in range(40_000)) for w in ("lexeme", "vocable"))
    near = long.replace("lexeme", "glyph", 1)
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect() if r.text and len(r.text.split()) >= 12)
    half = other.index(" ", len(other) // 2)
    rows = [(1, long), (2, near), (3, f"{other[:half]} {item}{other[half:]}"), (4, "a short text about nothing at all")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    schema = docs.schema
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, SF).select(*schema.names).collect(), schema)
    got = {r.doc_id: r.text for r in docs.collect()}
    assert len({1, 2} & set(got)) == 1 and {3, 4} < set(got)
    assert all(got[i] == dict(rows)[i] for i in set(got) - {3})
    assert got[3].split()[: other[:half].count(" ") + 1] == other[:half].split() and other[half:].split() == got[3].split()[-other[half:].count(" ") :]
    assert " ".join(item.lower().split()[:12]) not in " ".join(got[3].lower().split())
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() <= len(got)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
