"""Toxicity severity by cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import set_aside, written
from treeline.llm.decontaminate import words_of

#: Labelled documents that the model is fitted on, at most (a sample by hash where there are more).
FIT_ROWS = 20_000
#: Features kept, the least chi-squared statistic of one, and the lengths in bytes of word prefixes.
FEATURES, LEAST_CHI2, PREFIXES = 2000, 30.0, (4, 5, 6)
#: Words whose features a worker remembers before it starts afresh.
REMEMBERED = 50_000


def word_features(word: bytes) -> list[bytes]:
    """A word and its prefixes; a star marks a prefix."""
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) > n)]


@dataclass
class Severity:
    """P(grade >= k) = sigmoid(weights . x - thresholds[k-1]): one set of weights for all thresholds, which
    rise with k. ``features`` maps a feature to its column."""

    features: dict[bytes, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.array([30.0, 31.0]))

    def exceed(self, score: float) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(score - self.thresholds, -30, 30)))


def likelihood(p: np.ndarray, rows: tuple[np.ndarray, np.ndarray], grades: np.ndarray, weight: np.ndarray, n_features: int, n_grades: int, l2: float) -> tuple[float, np.ndarray]:
    """Penalised mean log-likelihood of the grades and its gradient. ``p`` holds the weights, the first threshold
    and the logarithms of the steps between thresholds; ``rows`` are (document, feature) index pairs."""
    at, col = rows
    w, gaps = p[:n_features], np.exp(p[n_features + 1 :])
    theta = p[n_features] + np.concatenate(([0.0], np.cumsum(gaps)))
    n, i = len(grades), np.arange(len(grades))
    z = np.bincount(at, weights=w[col], minlength=n)
    s = 1 / (1 + np.exp(-np.clip(z[:, None] - theta[None, :], -30, 30)))
    s = np.concatenate((np.ones((n, 1)), s, np.zeros((n, 1))), axis=1)
    d = s * (1 - s)
    lower, upper = grades - 1, grades
    prob = np.maximum(s[i, lower + 1] - s[i, upper + 1], 1e-12)
    dz = weight * (d[i, lower + 1] - d[i, upper + 1]) / prob
    g_theta = np.zeros(n_grades - 1)
    np.add.at(g_theta, lower[lower >= 0], -(weight * d[i, lower + 1] / prob)[lower >= 0])
    np.add.at(g_theta, upper[upper < n_grades - 1], (weight * d[i, upper + 1] / prob)[upper < n_grades - 1])
    g_theta /= weight.sum()
    gradient = np.concatenate((
        np.bincount(col, weights=dz[at], minlength=n_features) / weight.sum() - l2 * w,
        [g_theta.sum()],
        gaps * np.cumsum(g_theta[::-1])[::-1][1:],
    ))
    return float((weight * np.log(prob)).sum() / weight.sum() - l2 / 2 * (w * w).sum()), gradient


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_features: int, n_grades: int, weight: np.ndarray | None = None, l2: float = 1e-5, steps: int = 500, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds that maximise the penalised likelihood of the grades (Adam, full
    batch, so that the same rows give the same model). ``weight`` says how many documents each row stands for."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int64) if len(at) else np.zeros(0, dtype=np.int64)
    weight = np.ones(len(grades)) if weight is None else weight
    counts = np.bincount(grades, weights=weight, minlength=n_grades)
    above = np.clip(1 - np.cumsum(counts)[:-1] / weight.sum(), 1e-3, 1 - 1e-3)
    start = -np.log(above / (1 - above))
    p = np.concatenate((np.zeros(n_features), start[:1], np.log(np.maximum(np.diff(start), 1e-2))))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        _, g = likelihood(p, (at, col), grades, weight, n_features, n_grades, l2)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        p = p + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:n_features], p[n_features] + np.concatenate(([0.0], np.cumsum(np.exp(p[n_features + 1 :]))))


def fit_severity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, n_features: int = FEATURES) -> Severity:
    """A model of three grades from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``: 0 for toxic = 0, and
    for toxic = 1 grade 1 or 2, as the number of distinct toxic features in the document is at most or above the
    median of the toxic documents (the labels have no finer levels).

    At most about ``fit_rows`` labelled documents are used, half of either label, chosen by a hash of their id; in
    the likelihood each counts for as many as it stands for. Of rows that share an id one is used, and of several
    labels the worst. Null ids, texts and labels are left out. Without labels of both kinds the model calls
    nothing toxic.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    known = written(known, "labels")
    counts = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, fit_rows / 2 / max(counts.get(k, 0), 1)) for k in (0, 1)}
    mark = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30))
    known = known.where(mark < F.when(F.col("_toxic") == 1, int(share[1] * (1 << 30))).otherwise(int(share[0] * (1 << 30))))
    # The sample's ids are bounded by fit_rows: they go to the texts, and no text is shuffled but the sample's.
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text", "_toxic")).alias("_r")).select("_r._toxic", "_r.text")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 100):
                out = []
                for toxic, text in batch.iloc[i : i + 100].itertuples(index=False):
                    words = words_of(text)
                    out.append((int(toxic), len(words), list({f for w in set(words) for f in word_features(w)})))
                yield pd.DataFrame(out, columns=["_toxic", "_n", "_f"])

    rows = written(rows.mapInPandas(split, "_toxic int, _n long, _f array<binary>"), "toxicity")
    n1, n0 = (rows.where(f"_toxic = {k}").count() for k in (1, 0))
    if not n1 or not n0:
        return Severity()
    seen = rows.select("_toxic", F.explode("_f").alias("_f")).groupBy("_f").agg(F.sum("_toxic").alias("a"), F.count("*").alias("n"))
    a, b = F.col("a").cast("double"), (F.col("n") - F.col("a")).cast("double")
    c, d = n1 - a, n0 - b
    chi2 = (n1 + n0) * F.pow(a * d - b * c, 2) / ((a + b) * (c + d) * float(n1) * float(n0))
    scored = seen.where(f"n >= 5 and n < {n1 + n0}").select("_f", chi2.alias("chi2"), (a / n1 > b / n0).alias("bad")).where(F.col("chi2") >= LEAST_CHI2)
    best = scored.orderBy(F.desc("chi2"), "_f").limit(n_features).collect()
    columns = {bytes(r["_f"]): i for i, r in enumerate(best)}
    bad = {i for i, r in enumerate(best) if r["bad"]}
    shared = docs.sparkSession.sparkContext.broadcast(columns)

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for toxic, words, f in batch.itertuples(index=False):
                out.append((toxic, words, sorted(shared.value[bytes(x)] for x in f if bytes(x) in shared.value)))
            yield pd.DataFrame(out, columns=["_toxic", "_n", "_f"])

    # Bounded by fit_rows rows of at most n_features numbers.
    sample = rows.mapInPandas(chosen, "_toxic int, _n long, _f array<int>").collect()
    sample.sort(key=lambda r: (r["_toxic"], r["_n"], r["_f"]))
    load = np.array([sum(i in bad for i in r["_f"]) for r in sample])
    toxic = np.array([r["_toxic"] for r in sample])
    grades = np.where(toxic == 1, 1 + (load > np.median(load[toxic == 1])), 0)
    stands_for = np.where(toxic == 1, 1 / share[1], 1 / share[0])
    weights, thresholds = fit_ordinal([np.array(r["_f"], dtype=np.int64) for r in sample], grades, len(columns), 3, stands_for)
    return Severity(columns, weights, thresholds)


def score_severity(docs: DataFrame, model: Severity) -> DataFrame:
    """``docs`` with a column ``_severity`` (expected, p_toxic, grade). Whole texts are scored; null and empty
    ones have no features. The model is bounded by its number of features, so it is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected double, p_toxic double, grade int")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, known = shared.value, {}
        for texts in batches:
            out = np.zeros((len(texts), 3))
            for n, text in enumerate(texts):
                found: set[int] = set()
                for w in set(words_of(text)):
                    cols = known.get(w)
                    if cols is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        cols = known[w] = tuple(model.features[f] for f in word_features(w) if f in model.features)
                    found.update(cols)
                above = model.exceed(float(model.weights[sorted(found)].sum()) if found else 0.0)
                out[n] = above.sum(), above[0], (above >= 0.5).sum()
            yield pd.DataFrame({"expected": out[:, 0], "p_toxic": out[:, 1], "grade": out[:, 2].astype(np.int32)})

    return docs.withColumn("_severity", scored.asNondeterministic()("text"))


def toxicity(docs: DataFrame, labelled: DataFrame, labels: DataFrame, max_probability: float = 0.5) -> DataFrame:
    """Per document: doc_id, expected_severity (0 to 2), p_toxic, grade, rejected (p_toxic at or above the
    limit). The model is fitted on ``labelled(doc_id, text)`` with ``labels``. One row per row of ``docs``: null and
    empty texts have no features and the severity of none, rows that repeat a text share its severity, whole texts
    are scored however long, other columns are ignored, and an empty table gives an empty one."""
    out = score_severity(docs.select("doc_id", "text"), fit_severity(labelled, labels))
    p = F.col("_severity.p_toxic")
    return out.select("doc_id", F.col("_severity.expected").alias("expected_severity"), p.alias("p_toxic"), F.col("_severity.grade").alias("grade"), (p >= max_probability).alias("rejected"))


def remove_toxic(docs: DataFrame, labelled: DataFrame, labels: DataFrame, max_probability: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns, whatever their names. Null and empty texts have no
    features and the intercept's probability; rows that repeat a text share a fate; texts of any length are read
    whole; an empty table gives an empty one."""
    out = score_severity(set_aside(docs), fit_severity(labelled, labels))
    return out.where(F.col("_severity.p_toxic") < max_probability).drop("_severity").toDF(*docs.columns)
