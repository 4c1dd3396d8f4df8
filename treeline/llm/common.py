"""What several corpus operators share: the shared work folder, written tables and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.tables import work_dir

#: Maps A-Z to a-z and leaves every other byte alone.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back: it cuts the lineage, is computed
    once, and survives the loss of any executor. ``options`` are those of the writer."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/treeline/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Python workers get texts in batches of at most ``size`` bytes (unless the session asks for another size),
    so that what a worker holds does not depend on how long texts are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64m") in ("64m", "67108864b", "67108864"):
        spark.conf.set(key, size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def set_aside(docs: DataFrame) -> DataFrame:
    """``docs`` with columns whose names start with _ under other names. The operators' own columns start so:
    none can clash, and the caller puts the names back with ``toDF``."""
    taken, out = set(docs.columns), []
    for i, c in enumerate(docs.columns):
        new = f"aside{i}{c}" if c.startswith("_") else c
        while new != c and new in taken:
            new = f"a{new}"
        out.append(new)
    return docs.toDF(*out)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (two long columns of hash-like node ids): one row
    ``(node, root)`` for every node that has an edge to another one.

    Each round contracts every node into its smallest neighbour and relabels the edges; with hash-like ids the
    number of live nodes at least halves in expectation, so rounds grow with the logarithm of the longest
    path. Only aggregates with map-side combine and equi-joins are used, so a hub is never gathered in one
    task. Roots are arbitrary representatives. Empty input gives an empty result.
    """
    live = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps = []
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("parent"))
        parent = written(parent, "parents")
        maps.append(parent)
        pa, pb = (parent.select(F.col("node").alias(c), F.col("parent").alias(f"p{c}")) for c in "ab")
        live = live.join(pa, "a").join(pb, "b").where("pa <> pb")
        live = written(live.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if not maps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = maps[0].withColumnRenamed("parent", "root")
    for step in maps[1:]:
        nxt = step.select(F.col("node").alias("root"), "parent")
        found = found.join(nxt, "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
    return found
