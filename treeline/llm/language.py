"""Language identification with blended-spectrum presence kernels and Nyström kernel ridge regression."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.common import written

#: Documents the classifier is fitted on, per language and in all, and landmarks per language (samples by hash).
FIT_PER_LANGUAGE, FIT_ROWS, LANDMARKS = 250, 4000, 24
#: The blended spectrum takes n-grams of one to SPECTRUM characters; each is hashed into one of SLOTS.
SPECTRUM, SLOTS = 3, 1 << 18
#: Texts in one matrix product, and slots unpacked for it at a time: they bound memory, and cut no text.
BATCH_TEXTS, BATCH_SLOTS = 64, 1 << 13


def presence(text: str, spectrum: int = SPECTRUM, slots: int = SLOTS) -> np.ndarray:
    """Sorted distinct slots of the n-grams (n = 1..spectrum) of the whole text in lower case. Runs of
    characters that are no letters count as one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    ascii_other = (points < 128) & ~((points >= 97) & (points <= 122))
    points = np.where(ascii_other, np.uint64(32), points)
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = ~((points[1:] == 32) & (points[:-1] == 32))
    points = points[keep]
    seen = np.zeros(slots, dtype=bool)
    mixed = np.zeros(len(points), dtype=np.uint64)
    bits = np.uint64(64 - slots.bit_length() + 1)
    for n in range(1, spectrum + 1):
        if len(points) < n:
            break
        mixed = (mixed[: len(points) - n + 1] * np.uint64(0x100000001B3)) ^ points[n - 1 :]
        seen[((mixed + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> bits] = True
    return np.nonzero(seen)[0]


@dataclass
class LanguageModel:
    """Scores are K(x, landmarks) @ alpha with one column of alpha per language. ``slot_of`` numbers the slots
    that occur in a landmark, ``grams`` (slots x landmarks, eight landmarks to a byte) tells which landmark has
    which, ``scale`` is the square root of each landmark's number of slots."""

    languages: list[str]
    slot_of: np.ndarray
    grams: np.ndarray
    scale: np.ndarray
    alpha: np.ndarray

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Normalised kernel values of a batch of texts with the landmarks: matrix products over the slots that
        occur in the batch, so many at a time that what is unpacked stays small however many languages there are."""
        known = [at[at >= 0] for at in (self.slot_of[s] for s in sets)]
        text = np.repeat(np.arange(len(sets)), [len(at) for at in known])
        slots, column = np.unique(np.concatenate(known), return_inverse=True)
        shared = np.zeros((len(sets), len(self.scale)), dtype=np.float32)
        for lo in range(0, len(slots), BATCH_SLOTS):
            part = slots[lo : lo + BATCH_SLOTS]
            here = (column >= lo) & (column < lo + len(part))
            x = np.zeros((len(sets), len(part)), dtype=np.float32)
            x[text[here], column[here] - lo] = 1
            shared += x @ np.unpackbits(self.grams[part], axis=1, count=len(self.scale)).astype(np.float32)
        size = np.sqrt(np.maximum([len(s) for s in sets], 1))
        return shared / size[:, None] / self.scale[None, :]

    def predict(self, sets: list[np.ndarray]) -> np.ndarray:
        return self.kernel(sets) @ self.alpha


def pack(at: np.ndarray) -> bytes:
    """Slots as one bit each: at most 32 KB, however long the text."""
    seen = np.zeros(SLOTS, dtype=bool)
    seen[at] = True
    return np.packbits(seen).tobytes()


def unpack(bits: bytes) -> np.ndarray:
    return np.nonzero(np.unpackbits(np.frombuffer(bits, dtype=np.uint8)))[0]


def landmark_model(names: list[str], marks: list[np.ndarray]) -> LanguageModel:
    """A model of these landmarks that has learnt nothing yet."""
    slots = np.unique(np.concatenate(marks))
    slot_of = np.full(SLOTS, -1, dtype=np.int64)
    slot_of[slots] = np.arange(len(slots))
    grams = np.zeros((len(slots), (len(marks) + 7) // 8), dtype=np.uint8)
    for j, at in enumerate(marks):
        grams[slot_of[at], j // 8] |= 128 >> j % 8
    scale = np.sqrt(np.maximum([len(at) for at in marks], 1)).astype(np.float32)
    return LanguageModel(names, slot_of, grams, scale, np.zeros((len(marks), len(names))))


def solve(model: LanguageModel, languages: list[str], k_nm: np.ndarray, k_mm: np.ndarray, ridge: float = 1e-2) -> LanguageModel:
    """One-versus-rest kernel ridge regression in the Nyström space of the landmarks: minimises
    |K_nm a - y|^2 + ridge * n * a' K_mm a for each language's +1/-1 targets."""
    k_nm, k_mm = k_nm.astype(float), k_mm.astype(float)
    y = np.where(np.array(languages)[:, None] == np.array(model.languages)[None, :], 1.0, -1.0)
    # Every language weighs the same, however many documents it has.
    counts = Counter(languages)
    weight = np.array([1 / counts[x] for x in languages])
    left = k_nm.T @ (k_nm * weight[:, None]) + ridge * k_mm + 1e-8 * np.eye(len(k_mm))
    model.alpha = np.linalg.solve(left, k_nm.T @ (y * weight[:, None]))
    return model


def is_held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit_language(docs: DataFrame, per_language: int = FIT_PER_LANGUAGE, rows: int = FIT_ROWS, landmarks: int = LANDMARKS) -> LanguageModel | None:
    """Fits on ``docs(doc_id, text, lang)`` without the held-out documents; null ids, texts and languages are left
    out. At most ``per_language`` documents of each language, and as many fewer as keep them to ``rows`` in all, but
    two of each language there is; they are those of the smallest hashes of the id. Their kernel values with the landmarks
    are computed in the executors. The driver gets one number per fitted document and landmark, and the landmarks' slots
    as bits, so nothing it holds grows with the length of texts. No labelled document: no model."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(~is_held_out()).where(F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    quota = min(per_language, max(2, rows // len(counts)))
    spark = docs.sparkSession
    # So many more than the quota pass the toss that it is filled, and a rank cuts them to it.
    shares = spark.createDataFrame([(k, min(1.0, (2 * quota + 40) / n)) for k, n in counts.items()], "lang string, _share double")
    u = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    sample = known.join(F.broadcast(shares), "lang").withColumn("_u", u).where(F.col("_u") < F.col("_share"))
    first = Window.partitionBy("lang").orderBy("_u", F.xxhash64("text"))
    sample = sample.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= quota)

    @F.pandas_udf("binary")
    def slots(texts: pd.Series) -> pd.Series:
        return pd.Series([pack(presence(t)) for t in texts], dtype=object)

    sample = written(sample.select("lang", "_r", slots("text").alias("_slots")), "language")
    marks = sorted(sample.where(F.col("_r") <= landmarks).collect(), key=lambda r: (r["lang"], r["_r"]))
    if not marks:
        return None
    sets = [unpack(r["_slots"]) for r in marks]
    model = landmark_model(sorted({r["lang"] for r in marks}), sets)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("binary")
    def kernel(bits: pd.Series) -> pd.Series:
        parts = (bits.iloc[i : i + BATCH_TEXTS] for i in range(0, len(bits), BATCH_TEXTS))
        return pd.Series([row.astype(np.float32).tobytes() for part in parts for row in shared.value.kernel([unpack(b) for b in part])], dtype=object)

    got = sorted(sample.select("lang", "_r", kernel("_slots").alias("_k")).collect(), key=lambda r: (r["lang"], r["_r"]))
    k_nm = np.stack([np.frombuffer(r["_k"], dtype=np.float32) for r in got])
    k_mm = np.concatenate([model.kernel(sets[i : i + BATCH_TEXTS]) for i in range(0, len(sets), BATCH_TEXTS)])
    return solve(model, [r["lang"] for r in got], k_nm, k_mm)


def predict_language(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs`` with a column ``_language`` (lang_pred, score). Only the text is looked at, and all of it. Null
    texts and texts without a letter, or any text if there is no model, are ``und`` with score 0; otherwise the
    score is the logistic of the gap between the best and the second-best decision value (of one language: its
    own value)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in batches:
            names, scores = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            asked = [i for i, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
            for a in range(0, len(asked), BATCH_TEXTS):
                at = asked[a : a + BATCH_TEXTS]
                values = model.predict([presence(texts.iloc[i]) for i in at])
                best = values.argmax(axis=1)
                top = np.sort(values, axis=1)
                gap = top[:, -1] - top[:, -2] if values.shape[1] > 1 else top[:, -1]
                names[at] = np.array(model.languages, dtype=object)[best]
                scores[at] = 1 / (1 + np.exp(-4 * gap))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return docs.withColumn("_language", predicted.asNondeterministic()("text"))


def identify_languages(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; the model learns from the documents not held out.

    One row per row. Null texts and texts without a letter are ``und`` with score 0; a null id is not held out and
    not learnt from; rows that repeat a text have the same prediction; of equal values the first language by name
    wins; whole texts are read however long; other columns are ignored; an empty table gives an empty one.
    """
    out = predict_language(docs.select("doc_id", "text"), fit_language(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", is_held_out().alias("held_out"), F.col("_language.lang_pred").alias("lang_pred"), F.col("_language.score").alias("score"))
