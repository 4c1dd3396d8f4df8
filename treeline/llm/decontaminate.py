"""Benchmark decontamination with a generalised suffix automaton over words."""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Hashable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import LOWER_ASCII, set_aside, written

#: Everything below 0x80 that is no letter or digit separates words; bytes from 0x80 on are parts of words.
WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in LOWER_ASCII)

#: Item words in one automaton. A larger benchmark is streamed in blocks of items of about this size at most.
BLOCK_WORDS = 1_000_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


#: Marks of a state without an entry, and of one with several, which are kept in a dictionary.
NONE, MANY = -1, -2


class ItemAutomaton:
    """Suffix automaton of many word sequences. ``scan`` follows a document word by word, keeps the longest
    match that ends at each word, and reports where a window (``window`` item words, or a whole shorter item)
    ends and which items hold it.

    Most states have one transition and one item, so these lie in flat arrays of four bytes a state; only the others
    have a dictionary or a set. Words and items are numbered."""

    def __init__(self, items: Iterable[tuple[Hashable, list[bytes]]], window: int):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.names: list[Hashable] = []
        self.one, self.to = array("i", [NONE]), array("i", [NONE])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length, self.owner = array("i", [NONE]), array("i", [0]), array("i", [NONE])
        self.others: dict[int, set[int]] = {}
        ends = []
        for number, (name, texts) in enumerate(items):
            self.names.append(name)
            words = [self.words.setdefault(w, len(self.words)) for w in texts]
            last = 0
            for w in words:
                last = self._extend(last, w)
                self._own(last, (number,))
            if 0 < len(words) < window:
                ends.append((number, words))
        link, length = self.link, self.length
        order = array("i", np.argsort(-np.frombuffer(length, dtype=np.int32), kind="stable").astype(np.int32).tobytes())
        # Items are handed up the suffix links as far as states that hold a full window. The root comes last.
        for s in order:
            if (p := link[s]) > 0 and length[p] >= window:
                self._own(p, self._owners(s))
        #: For states whose match can hold a full window: the state of the last ``window`` words, which knows their items.
        self.full = array("i", [NONE]) * len(link)
        for s in reversed(order):
            if length[s] >= window:
                self.full[s] = s if length[link[s]] < window else self.full[link[s]]
        self.others = {s: found for s, found in self.others.items() if self.full[s] == s}
        #: Whole short items by state, and for each state the nearest one on its suffix links that has any.
        self.short: dict[int, list[tuple[int, int]]] = {}
        for number, words in ends:
            s = 0
            for w in words:
                s = self._next(s, w)
            self.short.setdefault(s, []).append((len(words), number))
        self.near = array("i", [0]) * len(link)
        for s in reversed(order):
            if s:
                self.near[s] = s if s in self.short else self.near[link[s]]

    def _owners(self, s: int) -> Iterable[int]:
        o = self.owner[s]
        return self.others[s] if o == MANY else () if o == NONE else (o,)

    def _own(self, s: int, numbers: Iterable[int]) -> None:
        for number in numbers:
            o = self.owner[s]
            if o == MANY:
                self.others[s].update(numbers)
                return
            if o == NONE:
                self.owner[s] = number
            elif o != number:
                self.owner[s] = MANY
                self.others[s] = {o, number}

    def _next(self, s: int, w: int) -> int:
        x = self.one[s]
        return self.to[s] if x == w else self.more[s].get(w, NONE) if x == MANY else NONE

    def _lead(self, s: int, w: int, t: int) -> None:
        x = self.one[s]
        if x == MANY:
            self.more[s][w] = t
        elif x in (NONE, w):
            self.one[s], self.to[s] = w, t
        else:
            self.more[s] = {x: self.to[s], w: t}
            self.one[s] = MANY

    def _state(self, length: int, like: int = NONE) -> int:
        """A new state, with the transitions of ``like``. What items hold it is filled in over suffix links in the end."""
        s = len(self.link)
        self.one.append(self.one[like] if like >= 0 else NONE)
        self.to.append(self.to[like] if like >= 0 else NONE)
        if self.one[s] == MANY:
            self.more[s] = dict(self.more[like])
        self.link.append(self.link[like] if like >= 0 else 0)
        self.length.append(length)
        self.owner.append(NONE)
        return s

    def _extend(self, last: int, w: int) -> int:
        link, length = self.link, self.length
        if (q := self._next(last, w)) >= 0:
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        cur = self._state(length[last] + 1)
        p = last
        while p >= 0 and (q := self._next(p, w)) < 0:
            self._lead(p, w, cur)
            p = link[p]
        if p >= 0:
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return cur

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, like=q)
        while p >= 0 and self._next(p, w) == q:
            self._lead(p, w, copy)
            p = self.link[p]
        self.link[q] = copy
        return copy

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Half-open word spans covered by windows, merged and sorted, and the items of those windows."""
        one, to, more, link, length, window, full, near = self.one, self.to, self.more, self.link, self.length, self.window, self.full, self.near
        spans: list[list[int]] = []
        found: set[int] = set()
        number = self.words.get
        s = n = 0
        for i, word in enumerate(words):
            w = number(word)
            if w is None:
                s = n = 0
                continue
            # Every item word leads on from the root, so this ends.
            while True:
                x = one[s]
                t = to[s] if x == w else more[s].get(w, NONE) if x == MANY else NONE
                if t >= 0:
                    break
                s = link[s]
                n = length[s]
            s = t
            n += 1
            hit = 0
            if n >= window:
                hit = window
                found.update(self._owners(full[s]))
            if near[s]:
                a, most = near[s], n
                while a > 0:
                    for m, item in self.short[a]:
                        if m <= most:
                            hit = max(hit, m)
                            found.add(item)
                    a = near[link[a]]
                    most = length[a]
            if hit:
                lo = i + 1 - hit
                while spans and spans[-1][0] >= lo:
                    spans.pop()
                if spans and spans[-1][1] >= lo:
                    spans[-1][1] = i + 1
                else:
                    spans.append([lo, i + 1])
        return spans, {self.names[i] for i in found}


def _blocks(items: DataFrame, block_words: int) -> list[int]:
    """Block numbers 0..n-1 so that a block holds about half of ``block_words`` words."""
    n_words = F.length("text") / 2
    total = items.agg(F.sum(n_words)).first()[0] or 0
    return list(range(int(total // (block_words / 2)) + 1))


#: The automaton that this worker built last, under its key: tasks of one block follow each other and share it.
_LAST: dict[str, ItemAutomaton] = {}


def _automaton(key: str, shared, window: int) -> ItemAutomaton:
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = ItemAutomaton(((ids, words_of(text)) for ids, text in shared.value), window)
    return _LAST[key]


def _scan_udf(shared, window: int):
    key = uuid.uuid4().hex

    @F.pandas_udf("n long, spans array<array<int>>, items array<string>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(key, shared, window)
        for texts in batches:
            out = []
            for t in texts:
                words = words_of(t)
                spans, found = automaton.scan(words)
                out.append((len(words), spans, sorted({x for ids in found for x in ids})))
            yield pd.DataFrame(out, columns=["n", "spans", "items"])

    return scan.asNondeterministic()


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs(..., text)`` with two more columns: ``_n_words`` (long) and ``_hits``, an array with one struct per
    block of items that occurs in the text: n, spans (array of [start, end) word positions) and items (array of
    item_id as strings). Names that start with ``_`` are the operator's own.

    ``items(item_id, text)``: null and empty texts have no window; an item without an id still marks words,
    but is not listed; items that share an id count as one. Documents of null or empty text have no words.
    Items are loaded block by block, each of a bounded number of words of distinct texts. With one block the documents stream past
    it, neither shuffled nor joined. With more, the documents are numbered and written once, every block reads
    their texts alone and gives the numbers and spans of the texts it hits, and these narrow rows are joined back.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    # Items that repeat a text are one text with several ids, so that a block does not grow with repeats.
    items = items.where("text is not null").groupBy("text").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    items = written(items, "items")
    blocks = _blocks(items, block_words)
    sc = docs.sparkSession.sparkContext

    def scan_of(b: int):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(len(blocks))) == b).collect()
        return _scan_udf(sc.broadcast([(tuple(r.ids), r.text) for r in rows]), window)

    if len(blocks) == 1:
        return docs.withColumn("_hits", F.array(scan_of(0)("text"))).withColumn("_n_words", F.col("_hits")[0]["n"])
    docs = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    # The first block also counts the words of every text.
    scans = [docs.select("_row", scan_of(b)("text").alias("_hit")).where(F.lit(b == 0) | (F.size("_hit.spans") > 0)) for b in blocks]
    narrow = written(reduce(DataFrame.union, scans), "hits")
    hits = narrow.groupBy("_row").agg(F.max("_hit.n").alias("_n_words"), F.collect_list(F.when(F.size("_hit.spans") > 0, F.col("_hit"))).alias("_hits"))
    return docs.join(hits, "_row").drop("_row")


def _cut(text: str | None, n_words: int, spans: list, max_coverage: float) -> str | None:
    """The text without its hit words, or null if more than ``max_coverage`` of its words are hit."""
    marks = sorted((int(a), int(b)) for a, b in spans)
    hit, end = 0, 0
    for a, b in marks:
        hit += max(0, b - max(a, end))
        end = max(end, b)
    if not marks:
        return text
    if hit > max_coverage * n_words:
        return None
    raw = text.encode()
    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(WORD_BYTES))]
    kept, pos = [], 0
    for a, b in marks:
        lo, hi = at[a][0], at[b - 1][1]
        if lo > pos:
            kept.append(raw[pos:lo])
        pos = max(pos, hi)
    return b"".join([*kept, raw[pos:]]).decode()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Cleaned documents with the columns of ``docs``: spans of words that occur in a benchmark window are cut
    out of the text, and a document of which more than ``max_coverage`` of the words are hit goes. Documents
    without hits stay as they are, null and empty texts included. Rows that repeat share a fate, and so do texts that
    tie; texts of any length are read whole; other columns stay, whatever their names. Without items every document
    stays, and an empty table gives an empty one."""
    original, docs = docs.columns, set_aside(docs)
    names = docs.columns
    found = find_contamination(docs, items, window, block_words).withColumn("_spans", F.flatten(F.transform("_hits", lambda h: h["spans"])))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, n: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_cut(*row, max_coverage) for row in zip(texts, n, spans, strict=True)], dtype=object)

    hit = found.withColumn("_hit", F.size("_spans") > 0)
    hit = hit.withColumn("_kept", F.when(F.col("_hit"), cut.asNondeterministic()(F.when(F.col("_hit"), F.col("text")), "_n_words", "_spans")).otherwise(F.col("text")))
    hit = hit.where(~F.col("_hit") | F.col("_kept").isNotNull())
    return hit.select(*[F.col("_kept").alias("text") if c == "text" else F.col(f"`{c}`") for c in names]).toDF(*original)


def contamination_digest(docs: DataFrame, items: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, coverage.

    Null and empty texts have no words and coverage 0. Every row gives a row, repeated rows and null ids included; items
    that share an id count as one, and ids are in string order. Texts of any length are read whole, other columns are
    ignored, and an empty table gives an empty one."""
    found = find_contamination(docs.select("doc_id", "text"), items, window, block_words)
    spans = F.array_sort(F.flatten(F.transform("_hits", lambda h: h["spans"])))
    end, total = F.lit(0), F.lit(0)
    walk = F.aggregate(
        spans,
        F.struct(end.alias("end"), total.alias("hit")),
        lambda acc, x: F.struct(F.greatest(acc["end"], x[1]).alias("end"), (acc["hit"] + F.greatest(F.lit(0), x[1] - F.greatest(acc["end"], x[0]))).alias("hit")),
    )
    items_of = F.array_sort(F.array_distinct(F.flatten(F.transform("_hits", lambda h: h["items"]))))
    out = found.select("doc_id", F.col("_n_words").alias("n_words"), walk["hit"].cast("long").alias("n_hit"), items_of.alias("_items"))
    return out.select(
        "doc_id", "n_words", "n_hit",
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.when(F.col("n_words") > 0, F.col("n_hit") / F.col("n_words")).otherwise(0.0).alias("coverage"),
    )
