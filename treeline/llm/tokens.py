"""Word-piece token counts by a linear longest-match automaton."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The vocabulary file of ranked byte pieces that the query uses; any other path can be given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Words whose counts a worker remembers before it starts afresh; it bounds memory and changes no result.
REMEMBERED = 100_000


class PieceCounter:
    """Counts the pieces of greedy longest-match-first word-piece tokenization in one pass over a word.

    The pieces form a trie of bytes. Where the trie cannot go on, the failure link of a node leads to the node
    of what is left once the longest pieces have been popped, and the link's popped-piece count is known in
    advance, so no piece is ever built. ``marker`` starts the pieces that continue a word (such as "##");
    without one, every piece may stand anywhere. A word that cannot be covered counts as one unknown token.
    """

    def __init__(self, pieces: list[bytes], marker: bytes = b""):
        self.go: dict[int, int] = {}
        self.leaf: set[int] = set()
        size = 1
        parents = [(-1, 0)]

        def path(s: bytes) -> int:
            nonlocal size
            v = 0
            for b in s:
                key = v << 8 | b
                if key not in self.go:
                    self.go[key] = size
                    parents.append((v, b))
                    size += 1
                v = self.go[key]
            return v

        for p in pieces:
            if p and p != marker:
                self.leaf.add(path(p))
        self.rest = path(marker)
        #: Failure node of each node (-1: none) and how many pieces are popped on the way there.
        self.fail, self.popped = [-1] * size, [0] * size
        level = [v for v in {0, self.rest}]
        seen = set(level)
        while level:
            below = []
            for u in level:
                for b in range(256):
                    v = self.go.get(u << 8 | b)
                    if v is None or v in seen:
                        continue
                    seen.add(v)
                    below.append(v)
                    if v in self.leaf:
                        self.fail[v], self.popped[v] = self.rest, 1
                        continue
                    z, n = self.fail[u], self.popped[u]
                    while z >= 0 and (z << 8 | b) not in self.go:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.go[z << 8 | b], n
            level = below

    def count(self, word: bytes) -> int:
        go, fail, popped, rest = self.go, self.fail, self.popped, self.rest
        u = n = 0
        for b in word:
            while (v := go.get(u << 8 | b)) is None:
                if fail[u] < 0:
                    return 1
                n += popped[u]
                u = fail[u]
            u = v
        while u != rest:
            if fail[u] < 0:
                return 1
            n += popped[u]
            u = fail[u]
        return n


def read_pieces(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a file with one base64 piece and its rank per line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


def token_counts(docs: DataFrame, pieces: list[bytes], marker: bytes = b"", prefix: bytes = b" ") -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, n_words, n_tokens). Words are runs without ASCII white space, each
    counted with ``prefix`` before it. Null and empty texts have none. Every row gives a row, repeated rows and
    null ids included; other columns are ignored. Texts and words of any length are counted whole, and an empty table
    gives an empty one.

    The vocabulary is fixed in size, so its automaton is broadcast; texts stream past it without a shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(PieceCounter(pieces, marker))

    @F.pandas_udf("n_words long, n_tokens long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count, known = shared.value.count, {}
        for texts in batches:
            rows = []
            for t in texts:
                words = t.encode().split() if t else ()
                total = 0
                for w in words:
                    n = known.get(w)
                    if n is None:
                        n = count(prefix + w)
                        if len(known) >= REMEMBERED:
                            known.clear()
                        if len(w) <= 64:
                            known[w] = n
                    total += n
                rows.append((len(words), total))
            yield pd.DataFrame(rows, columns=["n_words", "n_tokens"])

    return docs.select("doc_id", counted("text").alias("_c")).select("doc_id", "_c.n_words", "_c.n_tokens")


def document_tokens(spark: SparkSession, docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``token_counts`` with the vocabulary file at ``path``, which the driver reads: null and empty texts have no
    tokens, every row gives a row, other columns are ignored, and an empty table gives an empty one."""
    return token_counts(docs, read_pieces(path))
