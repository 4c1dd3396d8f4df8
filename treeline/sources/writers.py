"""Benchmark graphs, fine-tuning examples and match reports to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_benchmark(edges: DataFrame, train_pairs: DataFrame, path: str) -> None:
    """Test graphs as Parquet by graph, training pairs as JSON by graph."""
    edges.write.partitionBy("graph_id").mode("overwrite").parquet(f"{path}/graphs")
    train_pairs.write.partitionBy("graph_id").mode("overwrite").json(f"{path}/train_pairs")


def _escaped(c: str) -> Column:
    out = F.col(c)
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def write_graphml(edges: DataFrame, path: str) -> None:
    """One GraphML file per graph. A graph's lines are written in order as they come, by one task since they are one
    file; nothing is gathered in memory."""
    graph = edges.select("graph_id").distinct()
    line = lambda df, section, text: df.select("graph_id", F.lit(section).alias("_s"), text.alias("value"))
    nodes = edges.select("graph_id", F.col("parent").alias("node")).union(edges.select("graph_id", "child")).distinct()
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'
    lines = line(graph, 0, F.lit(head)).union(line(nodes, 1, F.concat(F.lit('<node id="'), _escaped("node"), F.lit('"/>'))))
    link = F.concat(F.lit('<edge source="'), _escaped("parent"), F.lit('" target="'), _escaped("child"), F.lit('"/>'))
    lines = lines.union(line(edges.select("graph_id", "parent", "child").distinct(), 2, link)).union(line(graph, 3, F.lit("</graph></graphml>")))
    lines = lines.repartition("graph_id").sortWithinPartitions("graph_id", "_s", "value")
    lines.select("graph_id", "value").write.partitionBy("graph_id").mode("overwrite").text(path)


def write_sft_jsonl(examples: DataFrame, path: str) -> None:
    """One {"prompt", "completion"} per line, by domain."""
    examples.select("domain", "prompt", "completion").write.partitionBy("domain").mode("overwrite").json(path)


def write_reports(report: DataFrame, path: str) -> None:
    """Rows tagged TP, FP or FN as CSV, by graph."""
    report.select("graph_id", "tag", F.col("parent"), F.col("child")).write.partitionBy("graph_id").mode("overwrite").csv(path, header=True)
