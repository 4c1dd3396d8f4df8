"""Spelling variants of words, found through variable-length grams."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import LOWER_ASCII, written

#: Fixed value: what a word is made of.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Least code points and occurrences of a word.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A gram in more words than this is lengthened; more where needed to keep the dictionary within GRAMS grams.
FREQUENT, GRAMS = 100, 1_000_000
#: Longest gram.
LONGEST = 12
#: Distinct words that a task counts before it passes them on; it bounds memory and changes no result.
COUNTED = 300_000
#: Stand before and after a word while it is cut into grams.
BEGIN, END = "\x02", "\x03"


def occurrences(doc_id: int | None, text: str) -> Iterator[tuple[str, int]]:
    """(word, times) of a text: its runs, A-Z lower-cased. Where the crc32 of ``<doc_id>:<run>`` is divisible by 97, the
    run loses a code point. A null id counts as an empty one."""
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.encode("utf-8", "surrogatepass").translate(LOWER_ASCII).decode("utf-8", "surrogatepass"))).items():
        if len(run) < LEAST_LENGTH:
            continue
        h = zlib.crc32(run.encode(), seed)
        if h % 97 == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        yield run, n


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all texts; words of too few code points or occurrences are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_pydict({"word": list(found), "n": list(found.values())}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))
            found.clear()
            return b

        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                for word, n in occurrences(doc_id, text or ""):
                    found[word] += n
                if len(found) > COUNTED:
                    yield out()
        yield out()

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def cut(word: str, frequent: dict[str, int], longest: int) -> list[tuple[int, int]]:
    """The grams (start, end) of a padded word: from each place the shortest of two symbols or more that is not frequent
    (or as long as grams may be), without those that lie within the one before. What a gram is depends on its own
    symbols alone."""
    out, reach, m = [], -1, len(word)
    for p in range(m - 1):
        e = p + 2
        while e < m and e - p < longest and word[p:e] in frequent:
            e += 1
        if e > reach:
            out.append((p, e))
            reach = e
    return out


def affected(grams: list[tuple[int, int]], longest: int) -> int:
    """How many grams one edit can touch at most. An edit at i breaks the grams that hold i, and may make a gram that
    swallows others: all of these end less than ``longest`` places after i."""
    ends = [e for _, e in grams]
    return max(bisect_right(ends, e + longest - 1) - j for j, e in enumerate(ends))


def lists_of(word: str, frequent: dict[str, int]) -> Iterator[tuple[int, int]]:
    """(key, side) of the posting lists that a word has to be in.

    Words meet in classes by the shorter one's length (side 0; words one longer are side 1). Grams are at most half as
    long as the shorter padded word, so one edit never touches all of them. A near pair shares all grams that the edit
    leaves alone, and the rarest of these is among the rarest ``affected + 1`` of either word: no other lists are
    merged. All that lies on one side of a shared gram is shared as well, since there is one edit, so a gram has a list
    for what precedes it and one for what follows.
    """
    s = f"{BEGIN}{word}{END}"
    for size, side in ((len(word), 0), (len(word) - 1, 1)):
        if size < LEAST_LENGTH:
            continue
        longest = min(LONGEST, (size + 2) // 2)
        grams = cut(s, frequent, longest)
        rare = sorted(grams, key=lambda g: (frequent.get(s[g[0] : g[1]], 0), s[g[0] : g[1]], g[0]))
        for p, e in rare[: affected(grams, longest) + 1]:
            yield xxhash.xxh64_intdigest(f"{size}<{e - p}{s[:e]}".encode()) - (1 << 63), side
            yield xxhash.xxh64_intdigest(f"{size}>{e - p}{s[p:]}".encode()) - (1 << 63), side


def gram_dictionary(words: DataFrame, frequent_over: int = FREQUENT, limit: int = GRAMS) -> dict[str, int]:
    """The grams that are lengthened, with the number of places where they occur, from all words: level by level,
    so grams are counted only where the gram one shorter is frequent.

    The threshold rises with the words so that there can't be more than ``limit`` such grams, whatever the words are:
    each level has at most (places / threshold) of them.
    """
    spark = words.sparkSession
    places = words.agg(F.sum(F.length("word") + 2)).first()[0] or 0
    over = max(frequent_over, -(-places * (LONGEST - 1) // limit))
    frequent: dict[str, int] = {}
    level: dict[str, int] = {}
    for q in range(2, LONGEST):
        shared = spark.sparkContext.broadcast(set(level))

        def count(batches: Iterator[pa.RecordBatch], q: int = q, shared=shared) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            for b in batches:
                for word in b["word"].to_pylist():
                    s = f"{BEGIN}{word}{END}"
                    found.update(g for p in range(len(s) - q + 1) if (g := s[p : p + q])[:-1] in shared.value or q == 2)
                if len(found) > COUNTED:
                    yield pa.RecordBatch.from_pydict({"gram": list(found), "n": list(found.values())})
                    found.clear()
            yield pa.RecordBatch.from_pydict({"gram": list(found), "n": list(found.values())}, schema=pa.schema([("gram", pa.string()), ("n", pa.int64())]))

        rows = words.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > over).collect()
        level = {r.gram: r.n for r in rows}
        shared.unpersist()
        if not level:
            break
        frequent |= level
    return frequent


def near_words(words: DataFrame, frequent_over: int = FREQUENT, limit: int = GRAMS) -> DataFrame:
    """(word, n, near, near_n): each pair of ``words(word, n)`` that one inserted, deleted or replaced code point tells
    apart, both ways round."""
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(gram_dictionary(words, frequent_over, limit))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, keys, sides = [], [], []
            for i, word in enumerate(b["word"].to_pylist()):
                for key, side in lists_of(word, shared.value):
                    at.append(i)
                    keys.append(key)
                    sides.append(side)
            where = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sides, pa.int32()), b["word"].take(where), b["n"].take(where)], ["key", "side", "word", "n"])

    lists = words.select("word", "n").mapInArrow(post, "key long, side int, word string, n long")
    short = lists.where("side = 0").select("key", "word", "n")
    other = lists.select("key", F.col("side").alias("_side"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    # Spark sizes the lists like the words that they come from, of which each is on many: it would broadcast either.
    met = short.hint("merge").join(other, "key").where("(_side = 1 or word < near) and levenshtein(word, near, 1) = 1")
    pairs = met.select("word", "n", "near", "near_n").distinct()
    return pairs.union(pairs.select("near", "near_n", "word", "n"))


def spelling_variants(docs: DataFrame, frequent_over: int = FREQUENT, limit: int = GRAMS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs(doc_id, text)``.

    n_near counts the words that differ by exactly one code point; form is that of largest n (ties: smallest), if its n
    is at least twice the word's. root is where following forms ends, the word itself if it has none.

    Null and empty texts have no words, a null id counts as an empty one, rows that repeat are counted each, an empty
    table gives an empty one, and other columns don't matter. Words and texts may have any length.
    """
    words = written(word_counts(docs), "words")
    near = near_words(words, frequent_over, limit)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))).alias("best"))
    out = words.join(best.hint("merge"), "word", "left")
    has = -F.col("best.n") >= 2 * F.col("n")
    out = written(out.select("word", F.when(has, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, -F.col("best.n")).alias("form_n")), "forms")
    return out.join(_roots(out).hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form. Each round doubles how many forms are followed; n doubles along
    each, so there are few rounds. Tables of words are packed well in files, so Spark would broadcast ones of many rows."""
    root = written(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = root.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        root = written(root.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_more")), "roots")
        more = not root.where("_more").isEmpty()
        root = root.select("word", "root")
        if not more:
            return root


