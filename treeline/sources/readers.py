"""Edge tables, benchmark graphs, result stores, diagnostics and reply logs from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions.text import clean_term, lemma_of

EDGE = ("graph_id", "parent", "child")
#: Dataset and variant of a file's name, parted at the last double underscore.
FILE = r"^(.*)__([A-Za-z0-9]+(?:_[A-Za-z0-9]+)*)\.{}$"


def _edges(df: DataFrame, graph_id: str) -> DataFrame:
    ok = (F.col("parent") != "") & (F.col("child") != "")
    return df.where(ok).select(F.lit(graph_id).alias("graph_id"), "parent", "child").distinct()


def read_taxo_tsv(spark: SparkSession, path: str, graph_id: str = "taxo") -> DataFrame:
    """Headerless TSV of (relation, hyponym, hypernym): an edge from hypernym to hyponym, terms cleaned. Rows
    with more or fewer fields are dropped."""
    rows = spark.read.csv(path, sep="\t", schema="rel string, hyponym string, hypernym string", mode="DROPMALFORMED", quote="")
    rows = rows.where("hyponym is not null and hypernym is not null")
    return _edges(rows.select(clean_term("hypernym").alias("parent"), clean_term("hyponym").alias("child")), graph_id)


def read_edge_csv(spark: SparkSession, path: str, use_synsets: bool = False, graph_id: str = "csv") -> DataFrame:
    """CSV with Source, Target and perhaps Weight: rows of weight 1 (without the column: all). Terms are cut to
    their first form, or packed with their synonyms."""
    rows = spark.read.csv(path, header=True, escape='"')
    if "Weight" in rows.columns:
        rows = rows.where(F.col("Weight").try_cast("double") == 1.0)

    def term(name: str):
        c = F.col(name)
        if use_synsets:
            return lemma_of(F.array(c))
        return clean_term(F.get(F.split(F.regexp_replace(c, r"\s*\(.*?\)", ""), r"\|"), 0))

    rows = rows.where("Source is not null and Target is not null")
    return _edges(rows.select(term("Source").alias("parent"), term("Target").alias("child")), graph_id)


def read_pairs_json(spark: SparkSession, path: str, graph_id: str = "pairs") -> DataFrame:
    """A JSON array of {"parent", "child"}; pairs with an empty end are dropped."""
    rows = spark.read.json(path, schema="parent string, child string", multiLine=True)
    return _edges(rows.select(clean_term("parent").alias("parent"), clean_term("child").alias("child")), graph_id)


def read_obo(spark: SparkSession, path: str, use_synsets: bool = False, graph_id: str = "obo") -> DataFrame:
    """OBO terms: an edge from each is_a target's name to the term's name (the id where there is no name)."""
    # A stanza starts with its name in brackets, whatever kind of line end the file has.
    text = spark.read.text(path, lineSep="[Term]").withColumn("value", F.regexp_replace("value", "\r\n?", "\n"))
    text = text.withColumn("value", F.regexp_extract("value", r"^\s*\n((?:(?!\[)[^\n]*\n?)*)", 1))

    def one(field: str):
        return F.trim(F.regexp_extract("value", rf"(?m)^{field}:\s*([^\n]*)", 1))

    name = F.when(one("name") == "", one("id")).otherwise(one("name"))
    synonyms = F.regexp_extract_all("value", F.lit(r'(?m)^synonym:\s*"([^"]*)"'), F.lit(1))
    node = lemma_of(F.concat(F.array(name), synonyms)) if use_synsets else clean_term(name)
    up = F.regexp_extract_all("value", F.lit(r"(?m)^is_a:\s*([^\s!]+)"), F.lit(1))
    terms = text.select(one("id").alias("id"), node.alias("node"), up.alias("up")).where("id <> ''")
    links = terms.select(F.col("node").alias("child"), F.explode("up").alias("id"))
    return _edges(links.join(terms.select("id", F.col("node").alias("parent")), "id"), graph_id)


def read_graphml(spark: SparkSession, path: str, graph_id: str = "graphml") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a saved graph without its virtual root."""
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id string").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema("_source string, _target string").load(path)
    nodes = nodes.where("_id <> 'virtual_root'").select(F.lit(graph_id).alias("graph_id"), F.col("_id").alias("node")).distinct()
    edges = edges.where("_source <> 'virtual_root' and _target <> 'virtual_root'")
    return nodes, edges.select(F.lit(graph_id).alias("graph_id"), F.col("_source").alias("parent"), F.col("_target").alias("child")).distinct()


METRICS = ("Cond_Red_F1", "Cond_Red_Precision", "Cond_Red_Recall", "Cond_Clos_F1", "Cond_Clos_Precision", "Cond_Clos_Recall", "Exp_Raw_F1", "Exp_Clos_F1")


def read_results_json(spark: SparkSession, path: str) -> DataFrame:
    """The nested result store as one row per run: dataset (without .csv), use_synsets, explode_nodes, ordinal,
    method, model, metrics. Absent F1 values are 0, absent precisions and recalls null."""
    fields = ", ".join(f"{m}: double" for m in (*METRICS, "Runtime_sec"))
    schema = f"dataset string, use_synsets boolean, explode_nodes boolean, results array<struct<method: string, model: string, {fields}>>"
    blocks = spark.read.json(path, schema=schema, multiLine=True)
    runs = blocks.select(F.regexp_replace("dataset", r"\.csv$", "").alias("dataset"), "use_synsets", "explode_nodes", F.posexplode("results").alias("ordinal", "r"))
    values = [(F.coalesce(F.col(f"r.{m}"), F.lit(0.0)) if m.endswith("F1") else F.col(f"r.{m}")).alias(m) for m in METRICS]
    return runs.select("dataset", "use_synsets", "explode_nodes", "ordinal", "r.method", "r.model", *values, F.col("r.Runtime_sec").alias("Runtime_sec"))


def read_diagnostics(spark: SparkSession, path: str, variant: str | None = None) -> DataFrame:
    """Per-edge diagnostics of many runs with the variant of each file (the last word of its name); the variant
    asked for must be that whole word."""
    schema = "dataset string, parent string, child string, leverage double, neighborhood_agreement double, votes int, salience long, is_fp int"
    rows = spark.read.csv(path, header=True, schema=schema, escape='"')
    rows = rows.withColumn("variant", F.regexp_extract(F.col("_metadata.file_name"), FILE.format("csv"), 2))
    return rows if variant is None else rows.where(F.col("variant") == variant)


def read_reply_log(spark: SparkSession, path: str) -> DataFrame:
    """Debug logs: dataset and variant from the file name, and per reply its edges (the larger of the strict and
    the line count), its reasoning length and whether it produced any."""
    diag = "regex_match boolean, json_ok boolean, n_strict int, n_json_ci int, n_regex_ci int, n_line int, n_pairs_wellformed int"
    schema = f"target string, chunk int, content string, reasoning string, reasoning_chars long, parsed_from string, n_edges int, diag struct<{diag.replace(' boolean', ': boolean').replace(' int', ': int')}>"
    rows = spark.read.json(path, schema=schema)
    name = F.col("_metadata.file_name")
    edges = F.greatest(F.coalesce("diag.n_strict", F.lit(0)), F.coalesce("diag.n_line", F.lit(0)))
    return rows.select(
        F.regexp_extract(name, FILE.format("jsonl"), 1).alias("dataset"), F.regexp_extract(name, FILE.format("jsonl"), 2).alias("variant"),
        "target", "chunk", F.coalesce("reasoning_chars", F.lit(0)).alias("reasoning_chars"), edges.alias("edges"), (edges > 0).alias("produced"),
    )
