"""Recorded model replies to edges. A reply is a row (run_id, target, chunk, text); a vocabulary is
(primary, node), primary in lower case and unique. Vocabularies are joined by key, whatever their size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.tables import written

KEY = ["run_id", "target", "chunk"]
#: What counts as a block of pairs, a pair and an object in a reply, and what is stripped from terms. A
#: block goes from the first [[ to the last ]]; a pair is two quoted terms in brackets; an object names parent, then child.
BLOCK = r"(?s)\[\s*\[.*\]\s*\]"
PAIR = r"""\[\s*["']([^"']+)["']\s*,\s*["']([^"']+)["']\s*\]"""
OBJECT = r'(?i)"parent"\s*:\s*"([^"]+)"\s*,\s*"child"\s*:\s*"([^"]+)"'
WHITE = " \t\n\r\x0b\f"


def _known(pairs: DataFrame, vocab: DataFrame) -> DataFrame:
    """(…, parent, child) with both terms replaced by the nodes they name; pairs of unknown terms vanish. Further columns
    stay. Vocabularies are sorted and never broadcast: their files, by which Spark would choose, can be a small part of
    what they are in memory."""
    up = vocab.select(F.col("primary").alias("_up"), F.col("node").alias("parent")).hint("merge")
    low = vocab.select(F.col("primary").alias("_low"), F.col("node").alias("child")).hint("merge")
    return pairs.join(up, "_up").join(low, "_low").drop("_up", "_low")


def arrow_pairs(resp: DataFrame) -> DataFrame:
    """Terms of ``child <= parent`` lines, repeats kept."""
    line = resp.select(*KEY, F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "\n")).alias("_l"))
    ends = line.select(*KEY, F.split("_l", "<=").alias("_p")).where(F.size("_p") == 2)
    strip = lambda c: F.btrim(F.btrim(c, F.lit(WHITE)), F.lit("-'\" "))
    return ends.select(*KEY, strip(F.get("_p", F.lit(1))).alias("_up"), strip(F.get("_p", F.lit(0))).alias("_low"))


def json_block(text: Column) -> Column:
    """The outermost [[...]] block as an array of JSON texts; null if there is none or it is no JSON array."""
    found = F.nullif(F.regexp_extract(text, BLOCK, 0), F.lit(""))
    return F.from_json(found, "array<string>")


def json_pairs(resp: DataFrame) -> DataFrame:
    """Terms of the two-element arrays of the JSON block, as (parent, child)."""
    item = resp.select(*KEY, F.explode(json_block(F.coalesce("text", F.lit("")))).alias("_i"))
    pair = item.select(*KEY, F.from_json("_i", "array<string>").alias("_p")).where(F.size("_p") == 2)
    strip = lambda i: F.btrim(F.get("_p", F.lit(i)), F.lit(WHITE))
    return pair.select(*KEY, strip(0).alias("_up"), strip(1).alias("_low"))


def regex_pairs(resp: DataFrame) -> DataFrame:
    """Terms of everything that looks like ["a", "b"], whether the rest is JSON or not."""
    text = F.coalesce("text", F.lit(""))
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(PAIR), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(PAIR), F.lit(2)).alias("b"))
    strip = lambda c: F.btrim(c, F.lit(WHITE))
    return resp.select(*KEY, F.explode(both).alias("_p")).select(*KEY, strip(F.col("_p")["a"]).alias("_up"), strip(F.col("_p")["b"]).alias("_low"))


def lowered(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("_up", F.lower("_up")).withColumn("_low", F.lower("_low"))


def parse_arrow_lines(resp: DataFrame, vocab: DataFrame) -> DataFrame:
    return _known(arrow_pairs(resp), vocab)


def parse_json_pairs(resp: DataFrame, vocab: DataFrame, case_sensitive: bool = True) -> DataFrame:
    pairs = json_pairs(resp)
    return _known(pairs if case_sensitive else lowered(pairs), vocab)


def parse_pair_regex(resp: DataFrame, vocab: DataFrame, drop_self: bool = False) -> DataFrame:
    found = _known(lowered(regex_pairs(resp)), vocab)
    return found.where("parent <> child") if drop_self else found


def parse_parent_child_objects(resp: DataFrame) -> DataFrame:
    """{"parent": x, "child": y} objects in lower case, without a vocabulary; empty and self pairs are dropped."""
    text = F.coalesce("text", F.lit(""))
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(OBJECT), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(OBJECT), F.lit(2)).alias("b"))
    low = lambda c: F.lower(F.btrim(c, F.lit(WHITE)))
    out = resp.select(*KEY, F.explode(both).alias("_p")).select(*KEY, low(F.col("_p")["a"]).alias("parent"), low(F.col("_p")["b"]).alias("child"))
    return out.where("parent <> '' and child <> '' and parent <> child")


def parse_diagnostics(resp: DataFrame, vocab: DataFrame) -> DataFrame:
    """Per reply: whether a block was found and is JSON, and what each way of parsing gets out of it."""
    text = F.coalesce("text", F.lit(""))
    resp = written(resp.select(*KEY, text.alias("text")), "replies")
    base = resp.select(*KEY, F.col("text").rlike(BLOCK).alias("regex_match"), json_block(F.col("text")).isNotNull().alias("json_ok"))
    strict, loose, line = json_pairs(resp), regex_pairs(resp), arrow_pairs(resp)
    ways = {"n_strict": strict, "n_json_ci": lowered(strict), "n_regex_ci": lowered(loose), "n_line": line}
    names = [*ways, "n_pairs_wellformed"]
    every = None
    for name, found in ways.items():
        one = found.select(*KEY, "_up", "_low", F.lit(name).alias("_way"))
        every = one if every is None else every.union(one)
    # Terms are looked up once for all ways, and a pair that repeats in a reply once.
    every = every.groupBy(*KEY, "_way", "_up", "_low").agg(F.count("*").alias("_n"))
    counted = _known(every, vocab).select(*KEY, "_way", "_n").union(loose.select(*KEY, F.lit(names[-1]), F.lit(1).cast("long")))
    counted = counted.groupBy(*KEY).agg(*[F.sum(F.when(F.col("_way") == name, F.col("_n"))).alias(name) for name in names])
    return base.join(counted, KEY, "left").na.fill(0, names)


def parse_loss_summary(diag: DataFrame) -> DataFrame:
    """One row: totals, edges lost to case and to broken JSON, unknown terms, and what that says."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    s = diag.agg(F.count("*").alias("n"), F.count_if("regex_match").alias("blocks"), F.count_if("json_ok").alias("json_ok"), *[total(c) for c in ("n_strict", "n_json_ci", "n_regex_ci", "n_line", "n_pairs_wellformed")])
    s = s.withColumn("case_loss", F.col("n_json_ci") - F.col("n_strict")).withColumn("json_fail_recovery", F.col("n_regex_ci") - F.col("n_json_ci"))
    s = s.withColumn("out_of_vocab", F.col("n_pairs_wellformed") - F.col("n_regex_ci"))
    verdict = (
        F.when((F.col("n_pairs_wellformed") == 0) & (F.col("n_line") == 0), "no_relations")
        .when((F.col("n_line") > F.col("n_regex_ci")) & (F.col("n_line") > F.col("n_strict")), "format_mismatch")
        .when(F.col("case_loss") + F.col("json_fail_recovery") > F.greatest(F.lit(1), F.col("n_strict")) * 0.15, "parsing_loss")
        .otherwise("not_parsing")
    )
    return s.withColumn("verdict", verdict)


PARSERS = {"arrow": parse_arrow_lines, "json": parse_json_pairs, "pairs": parse_pair_regex}


def assertions_to_edges(resp: DataFrame, vocab: DataFrame, fmt: str = "arrow") -> tuple[DataFrame, DataFrame]:
    """(assertions, salience) of replies (run_id, target, chunk, content, reasoning).

    assertions (run_id, target, parent, child): edges of the answer; the reasoning's only where the answer gave
    none. salience (run_id, parent, child, n): how often an edge is asserted in either.
    """
    parse = PARSERS[fmt]
    said = parse(resp.withColumn("text", F.col("content")), vocab).withColumn("_c", F.lit(0))
    thought = parse(resp.withColumn("text", F.col("reasoning")), vocab).withColumn("_c", F.lit(1))
    every = said.union(thought).withColumn("_first", F.min("_c").over(Window.partitionBy(*KEY)))
    salience = every.groupBy("run_id", "parent", "child").agg(F.count("*").alias("n"))
    return every.where("_c = _first").select("run_id", "target", "parent", "child").distinct(), salience
