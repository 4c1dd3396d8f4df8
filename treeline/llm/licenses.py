"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment
verifies them. DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import written
from treeline.llm.license_texts import TEMPLATES

#: Words are runs of ASCII letters and digits and of everything beyond ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE, CONTAINMENT = 5, 0.8
#: Chance at which a text window that matches as far as it must may be missed by every band.
MISS = 1e-4
#: Rows of template keys, and shingles of templates, up to which they are sent to every task (some 50 MB).
SENT = 1_000_000


@dataclass(frozen=True)
class WindowClass:
    """Windows of ``size`` shingles, every ``stride`` shingles, with ``bands`` bands of one minimum each."""

    size: int
    stride: int
    bands: int


def window_class(n_shingles: int) -> WindowClass:
    """The class for templates of ``n_shingles``: the largest power of two that fits, 32 at most.

    Templates of under 5 shingles must be contained whole, and every position has a window: one of them is
    equal to the template's, so one band finds it for certain. Above, the windows of text and template lie a
    quarter of a window apart at most, and up to a fifth of the template is missing, which leaves a Jaccard
    similarity of at least (0.8 - 1/4) / (2 - (0.8 - 1/4)) = 0.38 for the best window; the number of bands
    follows from the chance to miss that.
    """
    size = min(32, 1 << (n_shingles.bit_length() - 1))
    if size <= 4:
        return WindowClass(size, 1, 1)
    overlap = CONTAINMENT - 0.25
    return WindowClass(size, size // 4, math.ceil(math.log(MISS) / math.log(1 - overlap / (2 - overlap))))


#: The classes there are: one per power of two up to 32.
CLASSES = [window_class(1 << i) for i in range(6)]


def _mask(band: int) -> int:
    """A fixed pseudo-random 63-bit number per band: XOR with it permutes the hashes."""
    return (band * 0x9E3779B97F4A7C15 ^ band * band * 0xC2B2AE3D27D4EB4F) & (1 << 63) - 1


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def shingle_hashes(text: Column, *lengths: int) -> Column:
    """Hashes of the shingles of these numbers of words, length by length and in order, repeats included; a text has
    none that are longer than itself. Words are split once."""

    def hashed(w: Column, shingle: int) -> Column:
        h = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, shingle)]))
        return F.slice(h, F.lit(1), F.greatest(F.size(w) - (shingle - 1), F.lit(0)))

    return F.transform(F.array(words_of(text)), lambda w: F.concat(*[hashed(w, k) for k in lengths]))[0]


def _minima(hashes: Column, c: WindowClass, shingle: int) -> Column:
    """(start, least, key) of every window and band: the smallest hash under the band's permutation, given as the
    hash, and the same with shingle length, class and band as one key."""
    last = F.greatest(F.size(hashes) - c.size, F.lit(0))
    # The last window ends with the text, wherever the stride leads.
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(c.stride)), F.array(last)))

    def banded(mask: Column, band: Column) -> Column:
        mixed = F.array(F.transform(hashes, lambda h: h.bitwiseXOR(mask)))

        def of(m: Column) -> Column:
            least = lambda s: F.array_min(F.slice(m, s + 1, c.size)).bitwiseXOR(mask)
            found = F.transform(starts, lambda s: F.struct(s.alias("start"), least(s).alias("least")))
            return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["least"].alias("least"), F.xxhash64(F.lit(shingle), F.lit(c.size), band, x["least"]).alias("key")))

        return F.transform(mixed, of)[0]

    return F.flatten(F.transform(F.array(*[F.lit(_mask(b)) for b in range(c.bands)]), banded))


def template_shingles(templates: DataFrame) -> DataFrame:
    """``templates(license, text)`` -> license, shingle (words in a shingle: five, or all words of a shorter template),
    h (the hashes in order), n (their number). Null licences and templates without a word are left out."""
    t = templates.where("license is not null").withColumn("_n", F.size(words_of(F.col("text"))))
    parts = []
    for k in range(1, SHINGLE + 1):
        own = t.where(F.col("_n") >= k if k == SHINGLE else F.col("_n") == k)
        parts.append(own.select("license", F.lit(k).alias("shingle"), shingle_hashes(F.col("text"), k).alias("h")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.withColumn("n", F.size("h"))


def template_windows(shingled: DataFrame) -> DataFrame:
    """One row per template window and band: license, shingle, size, start, least, key."""
    out = None
    for c in CLASSES:
        fits = F.col("n") >= c.size if c.size == CLASSES[-1].size else (F.col("n") >= c.size) & (F.col("n") < 2 * c.size)
        for k in range(1, SHINGLE + 1):
            if k < SHINGLE and c.size > 1:
                continue
            own = shingled.where(fits & (F.col("shingle") == k)).select("license", "shingle", F.explode(_minima(F.col("h"), c, k)).alias("w"))
            own = own.select("license", "shingle", F.lit(c.size).alias("size"), "w.start", "w.least", "w.key")
            out = own if out is None else out.union(own)
    return out


def _sent(df: DataFrame, size: int) -> DataFrame:
    """To every task if it is small; otherwise the join is a shuffle."""
    return F.broadcast(df) if size <= SENT else df


def scan_licenses(docs: DataFrame, templates: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """One row per document row and template it holds: doc_id, license, containment, first_word, n_words.

    A text window and a template window that share a band key are a candidate; it is a match if the stretch
    of text where the template would lie (with windows to spare on either side) holds at least ``containment``
    of the template's distinct shingles. Of several matches of one template in a document the best is given, the
    first of equals; first_word and n_words are the stretch from the first to the last shingle that is held.
    A template of under five words is one shingle of all its words. Null and empty texts have no match; repeated
    rows match alike; other columns are ignored; without documents or templates the result is empty.

    A window's key is made of one of its own shingles. So a first pass keeps only the ids of texts that have a
    shingle which is some template window's; only those are cut into windows. Candidates are narrow rows, one for
    each place where a template may lie, and meet the hashes of text and template once.
    """
    shingled = written(template_shingles(templates), "templates")
    windows = written(template_windows(shingled), "template-windows")
    n_windows, n_shingles = windows.count(), shingled.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lengths = sorted(r["shingle"] for r in windows.select("shingle").distinct().collect())
    sizes = {(r["shingle"], r["size"]) for r in windows.select("shingle", "size").distinct().collect()}
    text = F.col("text")
    docs = docs.select("doc_id", "text").withColumns({"_a": F.xxhash64(text), "_b": F.xxhash64(F.lit(1), text)})
    ids = written(docs.select("doc_id", "_a", "_b"), "license-ids")
    if not lengths:
        return ids.select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("first_word"), F.lit(0).cast("long").alias("n_words")).limit(0)
    least = windows.select(F.col("least").alias("_x")).distinct()
    found = docs.select("_a", "_b", F.explode(shingle_hashes(text, *lengths)).alias("_x")).join(_sent(least, n_windows), "_x", "left_semi")
    suspects = written(found.select("_a", "_b").distinct(), "license-suspects")
    texts = docs.select("_a", "_b", "text").join(suspects, ["_a", "_b"], "left_semi")
    # Copies of a text are scanned once: one row is kept of each before it is cut into windows.
    texts = texts.groupBy("_a", "_b").agg(F.first("text").alias("text"))
    hashed = texts.select("_a", "_b", F.explode(F.array(*[F.struct(F.lit(k).alias("shingle"), shingle_hashes(text, k).alias("h")) for k in lengths])).alias("s"))
    hashed = written(hashed.select("_a", "_b", "s.*"), "license-hashes")
    parts = [hashed.where(F.col("shingle") == k).select("_a", "_b", F.explode(_minima(F.col("h"), c, k)).alias("w")) for c in CLASSES for k in lengths if (k, c.size) in sizes]
    cut = parts[0]
    for p in parts[1:]:
        cut = cut.union(p)
    known = _sent(windows.select("key", "license", "size", "start"), n_windows)
    # Where the template would begin, in steps of a window: the windows of one place give one row.
    pairs = cut.select("_a", "_b", F.col("w.start").alias("_at"), F.col("w.key").alias("key")).join(known, "key")
    pairs = pairs.select("_a", "_b", "license", "size", F.floor((F.col("_at") - F.col("start")) / F.col("size")).cast("int").alias("_cell")).distinct()
    pairs = written(pairs, "license-pairs")
    whole = shingled.select("license", "shingle", "n", F.array_distinct("h").alias("_own"))
    low = F.greatest((F.col("_cell") - 1) * F.col("size"), F.lit(0))
    pairs = pairs.join(shingled.select("license", "shingle", "n").transform(lambda t: _sent(t, n_shingles)), "license")
    pairs = pairs.join(hashed, ["_a", "_b", "shingle"]).select("_a", "_b", "license", low.alias("_low"), F.slice("h", low + 1, F.col("n") + 3 * F.col("size")).alias("_part"))
    pairs = pairs.join(_sent(whole, n_shingles), "license")
    pairs = pairs.withColumn("_held", F.array_intersect("_part", "_own")).withColumn("containment", F.size("_held") / F.size("_own"))
    pairs = pairs.where(F.col("containment") >= containment)
    back = F.reverse("_part")
    first = F.array_position("_part", F.get("_held", F.lit(0))) - 1
    last = F.size("_part") - F.array_position(back, F.get(F.array_intersect(back, F.col("_own")), F.lit(0)))
    pairs = pairs.select("_a", "_b", "license", "containment", (F.col("_low") + first).cast("long").alias("first_word"), (last - first + F.col("shingle")).cast("long").alias("n_words"))
    best = pairs.groupBy("_a", "_b", "license").agg(F.max(F.struct("containment", (-F.col("first_word")).alias("before"), (-F.col("n_words")).alias("short"))).alias("m"))
    best = written(best.select("_a", "_b", "license", "m.*"), "license-matches")
    return ids.join(best, ["_a", "_b"]).select("doc_id", "license", "containment", (-F.col("before")).alias("first_word"), (-F.col("short")).alias("n_words"))


def default_templates(spark) -> DataFrame:
    return spark.createDataFrame(sorted(TEMPLATES.items()), "license string, text string")
