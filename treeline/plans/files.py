"""Round trips of the sources and sinks: derived tables are written in the shared folder and read back.

Spark names part files itself, so what readers take from file names is left to the tests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.plans.fixtures import ctes
from treeline.plans.queries import CLEAN, query
from treeline.sources import readers as S
from treeline.sources import writers as W
from treeline.tables import work_dir

#: Rows that a JSON document holds at most, about.
DOCUMENT_ROWS = 10_000


def _folder(df: DataFrame, kind: str) -> str:
    return f"{work_dir(df.sparkSession)}/treeline/{kind}-{uuid.uuid4().hex}"


def _json_documents(rows: DataFrame, path: str) -> None:
    """The rows as JSON arrays, one document per file and about DOCUMENT_ROWS rows in each."""
    n = rows.count() // DOCUMENT_ROWS + 1
    arrays = rows.groupBy(F.pmod(F.xxhash64(*rows.columns), F.lit(n)).alias("_part")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    arrays.write.partitionBy("_part").text(path)


_CLEANED = f"{CLEAN.format('parent')} as parent, {CLEAN.format('child')} as child"
_EDGES = " where parent <> '' and child <> ''"


@query("s1_read_taxo_tsv", ctes("parts") + f", e as (select {_CLEANED} from parts) select distinct parent, child from e" + _EDGES)
def _(t):
    e = t("parts")
    path = _folder(e, "tsv")
    e.select(F.lit("1"), "child", "parent").write.csv(path, sep="\t", quote="")
    return S.read_taxo_tsv(e.sparkSession, path).drop("graph_id")


@query("s2_read_edge_csv", ctes("parts") + f", e as (select {_CLEANED} from parts where length(child) % 3 <> 0) select distinct parent, child from e" + _EDGES)
def _(t):
    e = t("parts")
    path = _folder(e, "csv")
    weight = F.when(F.length("child") % 3 == 0, "0.5").when(F.length("child") % 3 == 1, "1").otherwise("1.0")
    e.select(F.col("parent").alias("Source"), F.concat("child", F.lit(" (or so)")).alias("Target"), weight.alias("Weight")).write.csv(path, header=True)
    return S.read_edge_csv(e.sparkSession, path).drop("graph_id")


@query("s3_read_pairs_json", ctes("parts") + f", e as (select {_CLEANED} from parts) select distinct parent, child from e" + _EDGES)
def _(t):
    e = t("parts").select("parent", "child")
    path = _folder(e, "pairs")
    _json_documents(e, path)
    return S.read_pairs_json(e.sparkSession, path).drop("graph_id")


@query("s4_read_obo", ctes("parts") + f", e as (select {_CLEANED} from parts) select distinct parent, child from e" + _EDGES)
def _(t):
    e = t("parts")
    path = _folder(e, "obo")
    key = lambda c: F.concat(F.lit("X:"), F.substring(F.md5(c), 1, 12))
    up = e.groupBy(F.col("child").alias("node")).agg(F.array_join(F.sort_array(F.collect_set(F.concat(F.lit("is_a: "), key(F.col("parent")), F.lit(" ! it")))), "\n").alias("_up"))
    nodes = e.select(F.col("parent").alias("node")).union(e.select("child")).distinct().join(up, "node", "left")
    nodes.select(F.concat_ws("\n", F.lit("[Term]"), F.concat(F.lit("id: "), key(F.col("node"))), F.concat(F.lit("name: "), "node"), "_up", F.lit("")).alias("value")).write.text(path)
    return S.read_obo(e.sparkSession, path).drop("graph_id")


@query("s5_read_graphml", ctes("parts", "geo") + ", e as (select * from parts union all select * from geo) select distinct parent, child from e")
def _(t):
    e = t("parts").union(t("geo"))
    path = _folder(e, "graphml")
    W.write_graphml(e, path)
    return S.read_graphml(e.sparkSession, path)[1].drop("graph_id")


@query("s6_read_results_json", ctes("runs") + 'select dataset, use_synsets, explode_nodes, method, model, f1 as "Cond_Clos_F1", 0.0::double as "Cond_Red_F1", null::double as "Cond_Red_Recall" from runs')
def _(t):
    runs = t("runs")
    path = _folder(runs, "results")
    blocks = runs.groupBy("dataset", "use_synsets", "explode_nodes").agg(F.collect_list(F.struct("method", "model", F.col("f1").alias("Cond_Clos_F1"))).alias("results"))
    _json_documents(blocks.withColumn("dataset", F.concat("dataset", F.lit(".csv"))), path)
    return S.read_results_json(runs.sparkSession, path).select("dataset", "use_synsets", "explode_nodes", "method", "model", "Cond_Clos_F1", "Cond_Red_F1", "Cond_Red_Recall")


@query("s7_read_diagnostics", ctes("diag") + "select graph_id as dataset, parent, child, cast(leverage as double) as leverage, cast(neighborhood_agreement as double) as neighborhood_agreement, cast(votes as int) as votes, salience, is_fp from diag")
def _(t):
    d = t("diag")
    path = _folder(d, "diagnostics")
    d.withColumnRenamed("graph_id", "dataset").write.csv(path, header=True)
    return S.read_diagnostics(d.sparkSession, path).drop("variant")


@query("s8_read_reply_log", "select concat('t', event_id) as target, cast(user_id % 7 as int) as chunk, cast(floor(value) as bigint) as reasoning_chars, cast(greatest(event_id % 5, event_id % 3) as int) as edges, greatest(event_id % 5, event_id % 3) > 0 as produced from events")
def _(t):
    e = t("events")
    path = _folder(e, "log")
    diag = F.struct((F.col("event_id") % 5).cast("int").alias("n_strict"), (F.col("event_id") % 3).cast("int").alias("n_line"))
    e.select(F.concat(F.lit("t"), "event_id").alias("target"), (F.col("user_id") % 7).cast("int").alias("chunk"), F.floor("value").alias("reasoning_chars"), diag.alias("diag")).write.json(path)
    return S.read_reply_log(e.sparkSession, path).drop("dataset", "variant")


@query("s9_write_benchmark", ctes("geo", "parts") + ", e as (select * from geo union all select * from parts) select 'graph' as what, graph_id, parent, child from e union all select 'pair', graph_id, parent, child from e where length(child) % 2 = 0")
def _(t):
    e = t("geo").union(t("parts"))
    path = _folder(e, "benchmark")
    W.write_benchmark(e, e.where(F.length("child") % 2 == 0), path)
    read, names = e.sparkSession.read, ["graph_id", "parent", "child"]
    graphs = read.parquet(f"{path}/graphs").select(F.lit("graph").alias("what"), *names)
    return graphs.union(read.json(f"{path}/train_pairs").select(F.lit("pair").alias("what"), *names))
