"""The corpus pipeline: toxicity, near-duplicates, repeated strings, benchmark leaks, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read back as the
next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import decontaminate, mixing, repeats, simhash, toxicity
from treeline.llm.common import table, written


def _recounted(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after`` with n_chars of the texts as they are now, if the documents have that column."""
    if "n_chars" not in before.columns:
        return after
    kind = before.schema["n_chars"].dataType
    return after.withColumn("n_chars", F.length("text").cast(kind)).select(*[F.col(f"`{c}`") for c in before.columns])


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model calls toxic go. It learns from the labelled rows of ``documents``. Null and
    empty texts have no toxic word; rows that repeat a text share a fate; an empty table gives an empty one."""
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more) stays: that of the
    smallest id, null ids last. Null texts and texts without words are copies of each other, repeated rows too."""
    return simhash.deduplicate(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start more than once are cut out; a document of which nothing is left goes. Null and
    shorter texts stay; rows that repeat a text of that length remove each other."""
    return _recounted(docs, repeats.remove_repeats(docs))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark windows are cut out; a document that mostly consists of them goes. Null and empty texts stay."""
    return _recounted(docs, decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def sample_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled with the raked weights, which they carry as sampling_weight. Null and empty texts have no
    tokens and the weight of their levels; null sources and languages are levels; rows that repeat id and text share
    a fate."""
    return mixing.sample_mixture(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("repeats", remove_repeats),
    ("decontamination", remove_benchmark),
    ("mixture", sample_mixture),
]

#: The model fit and the iterative fit have no SQL; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
