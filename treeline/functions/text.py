"""Scalar text functions: terms, synonym-packed nodes, run labels, verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A term and a synonym list in parentheses after it.
PACKED = r"^([^(]+)\s*\((.*)\)$"
#: The reasons a false positive may have.
BUCKETS = ("ontology_strictness", "gt_missing", "not_isa", "wrong_parent", "genuine_error", "unclear")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_term(c: Column | str) -> Column:
    """Lower case; only letters, digits, _, white space and - are kept; runs of white space become one space."""
    kept = F.regexp_replace(F.lower(F.trim(_col(c))), r"[^\p{L}\p{N}_\s\-]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def _base(c: Column | str) -> Column:
    return F.lower(F.btrim(_col(c), F.lit(" \t\n\r\x0b\f")))


def _items(text: Column, sep: str) -> Column:
    return F.filter(F.transform(F.split(text, sep), lambda x: F.trim(x)), lambda x: x != "")


def primary_term(c: Column | str) -> Column:
    """``p`` of ``p (p, ...)``; anything else in lower case as it is."""
    s = _base(c)
    head = F.trim(F.regexp_extract(s, PACKED, 1))
    items = _items(F.regexp_extract(s, PACKED, 2), ",")
    return F.when(s.rlike(PACKED) & (F.get(items, 0) == head), head).otherwise(s)


def parse_lemma(c: Column | str) -> Column:
    """All surface forms of a node: of ``p (p, a, b)`` the list, of ``a|b`` its parts, else the node itself."""
    s = _base(c)
    head = F.trim(F.regexp_extract(s, PACKED, 1))
    items = _items(F.regexp_extract(s, PACKED, 2), ",")
    parts = F.when(F.contains(s, F.lit("|")), _items(s, r"\|")).otherwise(F.array(s))
    return F.when(s.rlike(PACKED), F.when(F.get(items, 0) == head, items).otherwise(F.array(s))).otherwise(parts)


def lemma_of(terms: Column) -> Column:
    """Clean terms, first of each kept: one as plain text, several as ``p (p, a, b)``, none as null."""
    clean = F.array_distinct(F.filter(F.transform(F.flatten(F.transform(terms, parse_lemma)), clean_term), lambda t: t != ""))
    packed = F.concat(F.get(clean, 0), F.lit(" ("), F.array_join(clean, ", "), F.lit(")"))
    return F.when(F.size(clean) == 0, F.lit(None).cast("string")).when(F.size(clean) == 1, F.get(clean, 0)).otherwise(packed)


def parse_label(method: Column | str) -> Column:
    """What a run label says: base_method, k, clawback, variant, top_n, rank_by, restructure, strategy."""
    m = _col(method)

    def number(pattern: str) -> Column:
        return F.regexp_extract(m, pattern, 1).try_cast("int")

    def has(part: str) -> Column:
        return F.contains(m, F.lit(part))

    clawback = F.coalesce(number(r"clawback=([0-9]+)"), F.lit(0))
    mode = F.when(has("+restructure_prune_only"), "prune_only").when(has("+restructure_ranked"), "ranked").when(has("+restructure"), "full").otherwise("none")
    strategy = (
        F.when(mode == "prune_only", "Prune-only").when(mode == "ranked", "Ranked").when(mode == "full", "Restructure")
        .when(clawback == 0, "Raw").otherwise(F.concat(F.lit("Clawback(k="), clawback.cast("string"), F.lit(")")))
    )
    return F.struct(
        F.trim(F.regexp_replace(m, r"\s*\(.*\)\s*", "")).alias("base_method"),
        number(r"(?:^|[^a-z])k=([0-9]+)").alias("k"),
        clawback.alias("clawback"),
        F.nullif(F.regexp_extract(m, r"\[([^\]]+)\]", 1), F.lit("")).alias("variant"),
        F.coalesce(number(r"_top([0-9]+)"), F.lit(0)).alias("top_n"),
        F.coalesce(F.nullif(F.regexp_extract(m, r"\+rank_([A-Za-z0-9_]+)", 1), F.lit("")), F.lit("combined")).alias("rank_by"),
        mode.alias("restructure"),
        strategy.alias("strategy"),
    )


def size_bucket(n: Column | str) -> Column:
    n = _col(n)
    return F.when(n <= 150, "0-150").when(n <= 1000, "151-1000").when(n <= 10000, "1001-10000").otherwise("10001+")


def decide_sever(text: Column | str) -> Column:
    """The last whole word ``keep`` or ``sever`` decides; neither means keep."""
    words = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(r"\b(keep|sever)\b"), F.lit(1))
    return F.coalesce(F.element_at(F.when(F.size(words) > 0, words), -1) == "sever", F.lit(False))


def parse_bucket(text: Column | str, buckets: tuple[str, ...] = BUCKETS) -> Column:
    """The reason whose last occurrence is right-most in the text; none: ``unclear``."""
    t = F.lower(F.coalesce(_col(text), F.lit("")))
    back = F.reverse(t)
    found = [F.when(F.contains(t, F.lit(b)), F.struct((F.length(t) - F.instr(back, b[::-1])).alias("at"), F.lit(b).alias("name"))) for b in buckets]
    best = F.array_max(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return F.coalesce(best["name"], F.lit("unclear"))


def hearst_sentence(child: Column | str, parent: Column | str) -> Column:
    return F.concat(F.lit("A "), _col(child), F.lit(" is a type of "), _col(parent), F.lit("."))
