"""Quality rules with host-level verdicts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import written

#: The white space that separates words, and the characters that count as symbols.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: Documents that the prior counts for: at most, at least, and where the hosts do not tell.
STRONGEST, WEAKEST, UNKNOWN = 1e6, 1.0, 2.0

#: Bits of a packed long that hold a word's position; the others hold a hash.
POSITION_BITS = 24


def _shared(hashes: Column, positions: Column, wide: Column) -> Column:
    """Those of the positions, sorted, whose hash is equal to that of another one. ``hashes`` runs along with
    ``positions``. Where positions fit POSITION_BITS, both share one long each, so that a primitive sort brings equal
    hashes together; in longer texts (``wide``) pairs are sorted."""
    packed = F.zip_with(hashes, positions, lambda h, i: F.shiftleft(h, POSITION_BITS).bitwiseOR(i.cast("long")))
    paired = F.zip_with(hashes, positions, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def repeated(s: Column) -> Column:
        # Equal hashes differ in their position bits alone.
        same = lambda x, y: F.coalesce(F.shiftright(x.bitwiseXOR(y), POSITION_BITS) == 0, F.lit(False))
        found = F.filter(s, lambda x, j: same(x, F.get(s, j + 1)) | same(x, F.get(s, j - 1)))
        return F.sort_array(F.transform(found, lambda x: x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")))

    def repeated_pairs(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        found = F.filter(s, lambda x, j: same(x, F.get(s, j + 1)) | same(x, F.get(s, j - 1)))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    short = F.transform(F.array(F.sort_array(packed)), repeated)[0]
    long = F.transform(F.array(F.sort_array(paired)), repeated_pairs)[0]
    return F.when(wide, long).otherwise(short)


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words covered by three-word windows that occur twice or more in the text."""
    wide = F.size(hashes) > F.lit(1 << POSITION_BITS)
    once = _shared(hashes, F.sequence(F.lit(0), F.size(hashes) - 1), wide)

    def confirmed(c: Column) -> Column:  # 40 hash bits can collide; an independent hash decides on what remains
        again = F.transform(c, lambda i: F.xxhash64(F.lit(1), F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
        return F.when(F.size(c) > 0, _shared(again, c, wide)).otherwise(c)

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    counted = F.transform(F.transform(F.array(once), confirmed), covered)[0]
    return F.when(F.size(hashes) == F.size(F.array_distinct(hashes)), F.lit(0).cast("long")).otherwise(counted)


def document_rules(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """``docs(doc_id, text, source)`` -> one row per input row: doc_id, source, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed.

    Null and empty texts have no words (all counts 0, base_failed true). Repeated rows give repeated results;
    extra columns are ignored; an empty table gives an empty one; texts of any length are counted exactly.
    """
    if min_words < 0 or max_repeat_percent < 0:
        raise ValueError("limits must not be negative")
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    base = docs.select(
        F.col("doc_id"),
        F.col("source"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")).alias("_words"),
    )
    windows = F.transform("_words", lambda x, i: F.xxhash64(x, F.get("_words", i + 1), F.get("_words", i + 2)))
    base = base.withColumn("_hashes", F.slice(windows, F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))))
    out = base.select(
        "doc_id", "source",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_words"), F.col("_hashes")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_verdicts(judged: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """``judged(source, base_failed)`` -> (source, n_docs, n_failed, rate, host_failed) per non-null source.

    Each host's failure rate is shrunk by a beta prior with the mean of all documents and a strength from the
    method of moments: the spread of the hosts' rates, each weighted by its documents, less what chance alone gives
    documents of one rate, is the correlation r within hosts, and the strength is 1/r - 1. So hosts of few
    documents say little about the prior and are pulled most. It is WEAKEST at least. No spread beyond chance gives STRONGEST; where
    nothing can be told (one host, or one document from each, or one verdict only), the strength is UNKNOWN.
    """
    hosts = judged.where("source is not null").groupBy("source").agg(F.count("*").alias("n_docs"), F.count(F.when(F.col("base_failed"), 1)).alias("n_failed"))
    n, f = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    prior = hosts.agg(F.count("*").alias("_k"), F.sum(n).alias("_n"), F.sum(n * n).alias("_nn"), F.sum(f).alias("_f"), F.sum(f * f / n).alias("_ff"))
    prior = prior.withColumn("_m", F.col("_f") / F.col("_n"))
    spread, chance = F.col("_ff") - F.col("_m") * F.col("_f"), F.col("_m") * (1 - F.col("_m"))
    room = F.col("_n") - F.col("_nn") / F.col("_n") - (F.col("_k") - 1)
    r = F.when((chance > 0) & (room > 0), (spread / F.nullif(chance, F.lit(0.0)) - (F.col("_k") - 1)) / F.nullif(room, F.lit(0.0)))
    strength = F.when(r.isNull(), UNKNOWN).when(r <= 1 / (1 + STRONGEST), STRONGEST).otherwise(F.greatest(1 / r - 1, F.lit(WEAKEST)))
    prior = prior.select("_m", strength.alias("_s"))
    rate = (F.col("n_failed") + F.col("_m") * F.col("_s")) / (F.col("n_docs") + F.col("_s"))
    # The prior is one row of two numbers.
    return hosts.join(F.broadcast(prior)).select("source", "n_docs", "n_failed", rate.alias("rate"), (rate > max_rate).alias("host_failed"))


def quality_rules(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, max_host_rate: float = 0.5) -> DataFrame:
    """Document rules with the verdict of each document's host: the columns of ``document_rules`` and
    host_rate, host_failed, kept. A document without a source is judged by its own rules alone. One row per row;
    null and empty texts fail; see ``document_rules`` for repeats, other columns and empty tables.

    Texts are read once; what is shuffled is one short row per document, and a host that holds much of the
    corpus is pre-aggregated and its join can be split.
    """
    judged = written(document_rules(docs, min_words, max_repeat_percent), "quality")
    hosts = written(host_verdicts(judged, max_host_rate).select("source", F.col("rate").alias("host_rate"), "host_failed"), "hosts")
    out = judged.join(hosts, "source", "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False)))
