"""Training pairs without leaks, and the examples made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions.stats import numbered
from treeline.functions.text import parse_lemma
from treeline.operators.candidates import prompt_text
from treeline.operators.graph import G, hash_order, nodes_of, transitive_closure
from treeline.operators.scoring import term_pairs
from treeline.tables import written


def _leaking(pairs: DataFrame, eval_edges: DataFrame) -> DataFrame:
    """Pairs (graph_id, parent, child) of which a form of each end is an ancestor pair of the eval graph."""
    closed = transitive_closure(eval_edges).select(G, F.col("ancestor").alias("parent"), F.col("descendant").alias("child"))
    hit = term_pairs(pairs, keep=True).join(term_pairs(closed), [G, "term_u", "term_v"], "left_semi")
    return hit.select(G, "parent", "child").distinct()


def holdout_pairs(pool: DataFrame, evaluation: DataFrame, node_disjoint: bool = True) -> tuple[DataFrame, DataFrame]:
    """(kept pairs, counters per graph): pool edges that touch no eval node (``node_disjoint``) and are no
    ancestor pair of the eval graph."""
    raw = pool.select(G, "parent", "child").distinct()
    base = raw
    if node_disjoint:
        held = nodes_of(evaluation)
        for end in ("parent", "child"):
            raw = raw.join(held.select(G, F.col("node").alias(end)), [G, end], "left_anti")
    raw = written(raw.select(G, "parent", "child"), "pool")
    kept = written(raw.join(_leaking(raw, evaluation), [G, "parent", "child"], "left_anti"), "kept")
    n = lambda df, name: df.groupBy(G).agg(F.count("*").alias(name))
    stats = n(base, "pool_edges").join(n(raw, "after_node_disjoint"), G, "left").join(n(kept, "kept"), G, "left").na.fill(0)
    stats = stats.withColumn("dropped_node_overlap", F.col("pool_edges") - F.col("after_node_disjoint"))
    return kept, stats.withColumn("dropped_closure_leak", F.col("after_node_disjoint") - F.col("kept"))


def leakage_report(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(graph_id, violations, eval_terms, shared_terms, node_overlap): leaking train pairs, and the share of the
    eval graph's surface forms that training shows."""
    forms = lambda e: nodes_of(e).select(G, F.explode(parse_lemma("node")).alias("t")).distinct()
    terms = forms(evaluation).join(forms(train).withColumn("_in", F.lit(1)), [G, "t"], "left").groupBy(G).agg(F.count("*").alias("eval_terms"), F.count("_in").alias("shared_terms"))
    bad = _leaking(train, evaluation).groupBy(G).agg(F.count("*").alias("violations"))
    out = terms.join(bad, G, "left").select(G, F.coalesce("violations", F.lit(0)).alias("violations"), "eval_terms", "shared_terms")
    return out.withColumn("node_overlap", F.col("shared_terms") / F.col("eval_terms"))


def assert_no_leak(train: DataFrame, evaluation: DataFrame) -> None:
    bad = leakage_report(train, evaluation).where("violations > 0").select(G).limit(5).collect()
    if bad:
        raise ValueError(f"training pairs give away ancestor pairs of {[r[G] for r in bad]}")


def _primary(c: str) -> Column:
    return F.get(parse_lemma(c), F.lit(0))


def make_examples(train: DataFrame, candidates: int = 99, seed: int = 42) -> DataFrame:
    """(graph_id, target, candidates, completion) per node: up to ``candidates`` related nodes (ancestors and
    descendants), shuffled, then others up to that number; completion lines say which are related, or ``none``.

    Others are drawn by stepping through the graph's numbered nodes from a hashed start; enough steps are taken
    to make up for related ones and the target, so the quadratic table of unrelated pairs never exists.
    """
    nodes = numbered(nodes_of(train), [G], [F.col("node")], "_no", "_size").withColumn("_no", (F.col("_no") - 1).cast("long"))
    nodes = written(nodes, "nodes")
    closure = written(transitive_closure(train).where("ancestor <> descendant").select(G, "ancestor", "descendant"), "closure")
    rel = closure.select(G, F.col("descendant").alias("target"), F.col("ancestor").alias("other"), F.lit("up").alias("_way"))
    rel = rel.union(closure.select(G, F.col("ancestor"), F.col("descendant"), F.lit("down")))
    rel = rel.groupBy(G, "target", "other").agg(F.max("_way").alias("_way"))  # on a cycle, up goes first
    place = Window.partitionBy(G, "target").orderBy(hash_order(seed, "target", "other"), "other")
    rel = written(rel.withColumn("_r", F.row_number().over(place)).withColumn("_n", F.count("*").over(Window.partitionBy(G, "target"))), "related")
    kept = rel.where(F.col("_r") <= candidates)
    need = nodes.join(rel.groupBy(G, F.col("target").alias("node")).agg(F.max("_n").alias("_n")), [G, "node"], "left").na.fill(0, ["_n"])
    draws = F.least(F.col("_size"), F.col("_n") + candidates + 1)
    start = F.pmod(F.xxhash64(F.lit(seed), G, "node"), F.col("_size"))
    drawn = need.where(F.col("_n") < candidates).select(G, F.col("node").alias("target"), "_n", F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), draws - 1), lambda i: F.pmod(start + i, F.col("_size")))).alias("_step", "_no"))
    drawn = drawn.join(nodes.select(G, "_no", F.col("node").alias("other")), [G, "_no"]).where("other <> target")
    drawn = drawn.join(rel.select(G, "target", "other"), [G, "target", "other"], "left_anti")
    fill = Window.partitionBy(G, "target").orderBy("_step")
    negative = drawn.withColumn("_r", F.row_number().over(fill)).where(F.col("_r") + F.col("_n") <= candidates).select(G, "target", "other", F.lit(None).cast("string").alias("_way"))
    every = kept.select(G, "target", "other", "_way").union(negative)
    line = F.when(F.col("_way") == "up", F.concat(_primary("target"), F.lit(" <= "), _primary("other"))).when(F.col("_way") == "down", F.concat(_primary("other"), F.lit(" <= "), _primary("target")))
    item = F.struct(hash_order(seed + 1, "target", "other").alias("h"), _primary("other").alias("c"), line.alias("l"))
    grouped = every.groupBy(G, "target").agg(F.array_sort(F.collect_list(item)).alias("_i"))
    grouped = nodes.select(G, F.col("node").alias("target")).join(grouped, [G, "target"], "left")
    lines = F.array_join(F.filter(F.transform("_i", lambda x: x["l"]), lambda x: x.isNotNull()), "\n")
    shown = F.coalesce(F.transform("_i", lambda x: x["c"]), F.array().cast("array<string>"))
    return grouped.select(G, _primary("target").alias("target"), shown.alias("candidates"), F.coalesce(F.nullif(lines, F.lit("")), F.lit("none")).alias("completion"))


def render_prompts(examples: DataFrame, variant: str = "full") -> DataFrame:
    """(domain, prompt, completion) with the prompt that inference uses."""
    return examples.select(F.col(G).alias("domain"), prompt_text(F.col("target"), F.col("candidates"), variant).alias("prompt"), "completion")


def sft_manifest(sft: DataFrame, train: DataFrame, cap_words: int = 1024, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Per domain: examples, those with relations, train pairs, length quantiles in words, share over the cap."""
    if include is not None:
        sft = sft.where(F.col("domain").isin(include))
    if exclude:
        sft = sft.where(~F.col("domain").isin(exclude))
    words = F.size(F.filter(F.split(F.concat_ws(" ", "prompt", "completion"), r"\s+"), lambda x: x != ""))
    out = sft.withColumn("_w", words).groupBy("domain").agg(
        F.count("*").alias("examples"), F.count_if(F.col("completion") != "none").alias("with_relations"),
        F.percentile("_w", 0.5).alias("median_words"), F.max("_w").alias("max_words"), F.avg((F.col("_w") > cap_words).cast("double")).alias("over_cap"),
    )
    pairs = train.groupBy(F.col(G).alias("domain")).agg(F.count("*").alias("train_pairs"))
    return out.join(pairs, "domain", "left").na.fill(0, ["train_pairs"])
