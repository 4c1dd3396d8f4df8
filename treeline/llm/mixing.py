"""Mixing sources to target weights: token weights raked to marginals, documents sampled by them."""

from __future__ import annotations

import warnings
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import set_aside, written

MARGINS = ("source", "lang", "topic")
#: Topics, the documents up to which the driver fits them alone (of more, so many give the starts, and all the fit), and
#: the slots that words are hashed into.
N_TOPICS, TOPIC_SAMPLE, TERMS = 8, 2000, 512
#: Starts that the clustering chooses from, the least share of a topic, and the documents that the overall mean counts
#: for in the mean of a language.
STARTS, LEAST_TOPIC, PRIOR = 8, 0.02, 20
#: What vectors are multiplied by before they are summed as integers, so that no order of rows changes a sum.
SCALE = 1 << 30
#: Cells (combinations of levels that occur) that are raked on the driver; more are raked as tables.
CELLS = 200_000
#: Target shares are the observed ones to this power, unless targets are given: below 1 it lifts rare levels.
TEMPER = 0.8
#: Sweeps without a gain after which raking stops.
PATIENCE = 20
#: Words whose slots a worker remembers, texts in a block of ``_packed``, and texts for which a pass has a task.
WORDS, BLOCK, TASK = 100_000, 256, 1 << 14
OTHER, MISSING = "(other)", "(none)"


class _Slots(dict):
    """The slot of a word, none for those of under four characters; up to ``WORDS`` words are kept."""

    def __missing__(self, word: str) -> int | None:
        slot = zlib.crc32(word.encode("utf-8", "surrogatepass")) % TERMS if len(word) >= 4 else None
        if len(self) < WORDS:
            self[word] = slot
        return slot


_SLOT = _Slots()


def term_slots(text: str | None) -> tuple[int, dict[int, int]]:
    """(number of words, how often each of TERMS slots is hit by a lower-cased word of four or more characters)."""
    words = text.lower().split() if text else []
    slots: dict[int, int] = {}
    for w, n in Counter(words).items():
        slot = _SLOT[w]
        if slot is not None:
            slots[slot] = slots.get(slot, 0) + n
    return len(words), slots


@dataclass(frozen=True)
class Topics:
    """Unit centres of clusters of term vectors less the mean of their language, the weight of each slot, the mean of
    all vectors and those by language, and how many of the fitted documents each centre has."""

    centres: np.ndarray
    weight: np.ndarray
    mean: np.ndarray = field(default_factory=lambda: np.zeros(TERMS))
    means: dict[str, np.ndarray] = field(default_factory=dict)
    sizes: tuple[int, ...] = ()

    def vector(self, slots: dict[int, int]) -> np.ndarray:
        x = np.zeros(TERMS)
        x[list(slots)] = np.log1p(list(slots.values()))
        x *= self.weight
        return x / max(float(np.sqrt((x * x).sum())), 1e-12)

    def centred(self, slots: dict[int, int], lang: str | None) -> np.ndarray:
        """What a text says beyond its language."""
        return self.vector(slots) - self.means.get(lang, self.mean)

    def of(self, slots: dict[int, int], lang: str | None = None) -> str | None:
        """The nearest centre (ties: the first); null without a term or a centre."""
        return str(int((self.centres @ self.centred(slots, lang)).argmax())) if slots and len(self.centres) else None

    def rows(self, slots: list[np.ndarray], counts: list[np.ndarray], langs: list[str | None]) -> np.ndarray:
        """The unit vectors of what texts say beyond their languages."""
        x = np.zeros((len(slots), TERMS))
        if len(slots):
            at = np.repeat(np.arange(len(slots)), [len(r) for r in slots])
            x[at, np.concatenate(slots)] = np.log1p(np.concatenate(counts))
        x = _unit(x * self.weight)
        for lang in set(langs):
            x[[other == lang for other in langs]] -= self.means.get(lang, self.mean)
        return _unit(x)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=-1, keepdims=True)), 1e-12)


def _settle(x: np.ndarray, centres: np.ndarray, rounds: int) -> np.ndarray:
    """Centres after ``rounds`` of spherical k-means at most; one that loses all its rows stays where it is."""
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[own == k].sum(axis=0) for k in range(len(centres))])
        new = np.where((sums * sums).sum(axis=1, keepdims=True) > 0, _unit(sums), centres)
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def _starts(x: np.ndarray, n_topics: int, rounds: int) -> list[np.ndarray]:
    """STARTS sets of centres, each drawn from the rows and settled on them."""
    out = []
    for seed in range(STARTS):
        rng = np.random.default_rng(seed)
        chosen = [int(rng.integers(len(x)))]
        far = 1 - x @ x[chosen[0]]
        while len(chosen) < n_topics and far.max() > 1e-9:
            chance = np.maximum(far, 0)
            chosen.append(int(rng.choice(len(x), p=chance / chance.sum())))
            far = np.minimum(far, 1 - x @ x[chosen[-1]])
        out.append(_settle(x, x[chosen], rounds))
    return out


def cluster(rows: list[tuple[dict[int, int], str | None]], n_topics: int, rounds: int = 25) -> Topics:
    """Spherical k-means over (term counts, language). Each of STARTS starts draws its centres with a chance that grows
    with the distance from those before, and that with the least distance in the end wins. While a topic has less than
    LEAST_TOPIC of the rows, the smallest goes and its rows join the others. Draws are seeded, so the same rows give the
    same topics."""
    rows = [r for r in rows if r[0]]
    seen = np.bincount([s for r, _ in rows for s in r], minlength=TERMS) if rows else np.zeros(TERMS)
    weight = np.log((1 + len(rows)) / (1 + seen)) + 1e-9
    bare = Topics(np.zeros((0, TERMS)), weight)
    if not rows:
        return bare
    x, langs = np.stack([bare.vector(r) for r, _ in rows]), [lang for _, lang in rows]
    mean = x.mean(axis=0)
    means = {}
    for name in sorted({lang for lang in langs if lang is not None}):
        own = x[[lang == name for lang in langs]]
        means[name] = (own.sum(axis=0) + PRIOR * mean) / (len(own) + PRIOR)
    x = _unit(x - np.stack([means.get(lang, mean) for lang in langs]))
    found = max(_starts(x, n_topics, rounds), key=lambda centres: float((x @ centres.T).max(axis=1).sum()))
    while True:
        sizes = np.bincount((x @ found.T).argmax(axis=1), minlength=len(found))
        if len(found) == 1 or sizes.min() >= LEAST_TOPIC * len(x):
            return Topics(found, weight, mean, means, tuple(sizes.tolist()))
        found = _settle(x, np.delete(found, sizes.argmin(), axis=0), rounds)


def _language(docs: DataFrame) -> Column:
    return F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")


def with_terms(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_terms`` (tokens long, slots, counts), as ``term_slots`` gives them, and ``_lang``."""

    @F.pandas_udf("tokens long, slots array<int>, counts array<int>")
    def terms(texts: pd.Series) -> pd.DataFrame:
        found = [term_slots(t) for t in texts]
        return pd.DataFrame({"tokens": [n for n, _ in found], "slots": [list(f) for _, f in found], "counts": [list(f.values()) for _, f in found]})

    return docs.withColumn("_lang", _language(docs)).withColumn("_terms", terms.asNondeterministic()("text"))


def _tallied(terms: DataFrame, tally, key: str, arrays: bool = False) -> DataFrame:
    """(key, slot, n): the sums over all tasks of what ``tally`` makes of one: it takes batches (slots, counts, languages),
    as lists of rows or as Arrow ``arrays``, or the rows of ``_packed``, and gives {key: array of integers}."""
    columns = terms.columns
    kind = pa.schema([("key", pa.int32() if key == "int" else pa.string()), ("sums", pa.list_(pa.int64()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "scales" in columns:
            some = (r for b in batches for r in b.to_pylist())
        elif arrays:
            some = ((b["slots"], b["counts"], b["_lang"]) for b in batches if b.num_rows)
        else:
            some = (([np.asarray(r) for r in b["slots"].to_numpy(zero_copy_only=False)], list(b["counts"].to_numpy(zero_copy_only=False)), b["_lang"].to_pylist()) for b in batches if b.num_rows)
        for k, sums in tally(some).items():
            if sums.any():
                yield pa.RecordBatch.from_pydict({"key": [k], "sums": [sums.tolist()]}, schema=kind)

    return terms.mapInArrow(task, f"key {key}, sums array<long>").select("key", F.posexplode("sums").alias("slot", "v")).groupBy("key", "slot").agg(F.sum("v").alias("n"))


def _language_means(terms: DataFrame, weight: np.ndarray) -> Topics:
    """``Topics`` without centres, with the means of all vectors and those of each language: a row of TERMS numbers for
    each language on the driver."""
    bare = Topics(np.zeros((0, TERMS)), weight)

    def tally(batches):
        out = {}
        for slots, counts, langs in batches:
            x = np.rint(bare.rows(slots, counts, langs) * SCALE).astype(np.int64)
            for lang in set(langs):
                own = [other == lang for other in langs]
                out[lang] = out.get(lang, 0) + np.append(x[own].sum(axis=0), sum(own))
        return out

    sums = {}
    for r in _tallied(terms, tally, "string").collect():
        sums.setdefault(r["key"], np.zeros(TERMS + 1))[r["slot"]] = r["n"]
    whole = sum(sums.values())
    mean = whole[:TERMS] / SCALE / whole[TERMS]
    return Topics(bare.centres, weight, mean, {k: (v[:TERMS] / SCALE + PRIOR * mean) / (v[TERMS] + PRIOR) for k, v in sorted((k, v) for k, v in sums.items() if k is not None)})


@dataclass(frozen=True)
class Held:
    """Texts of a batch: the row, slot and value of each term of their unit vectors, these as a table, the place of each
    row's language in ``means`` (the last is that of all texts), and what rows less that mean are multiplied by."""

    row: np.ndarray
    slot: np.ndarray
    value: np.ndarray
    table: np.ndarray
    lang: np.ndarray
    means: np.ndarray
    scale: np.ndarray

    def near(self, centres: np.ndarray) -> np.ndarray:
        """Products of the rows of ``Topics.rows`` with ``centres``, without making these rows."""
        return (self.table @ centres.T - (self.means @ centres.T)[self.lang]) * self.scale[:, None]


def _held(base: Topics, means: np.ndarray, place: dict[str, int], slots: pa.Array, counts: pa.Array, langs: pa.Array) -> Held:
    n = len(slots)
    row, slot = np.repeat(np.arange(n), slots.value_lengths().to_numpy()), slots.flatten().to_numpy()
    value = np.log1p(counts.flatten().to_numpy()) * base.weight[slot]
    value /= np.maximum(np.sqrt(np.bincount(row, weights=value * value, minlength=n)), 1e-12)[row]
    table = np.zeros((n, TERMS))
    table[row, slot] = value
    codes = langs.dictionary_encode()
    known = np.array([place.get(x, len(means) - 1) for x in codes.dictionary.to_pylist()] + [len(means) - 1])
    lang = known[codes.indices.fill_null(len(known) - 1).to_numpy()]
    if len(means) <= 64:
        along = (table @ means.T)[np.arange(n), lang]
    else:
        along = np.bincount(row, weights=value * means[lang[row], slot], minlength=n)
    square = np.bincount(row, minlength=n).clip(0, 1) - 2 * along + (means * means).sum(axis=1)[lang]
    close = np.flatnonzero(square < 1e-4)  # differences of nearly equal numbers: added up anew
    square[close] = ((table[close] - means[lang[close]]) ** 2).sum(axis=1)
    return Held(row, slot, value, table, lang, means, 1 / np.maximum(np.sqrt(square), 1e-12))


def _places(base: Topics) -> tuple[dict[str, int], np.ndarray]:
    """({language: its row}, means): the means of the languages, and that of all texts last."""
    names = sorted(base.means)
    return {x: i for i, x in enumerate(names)}, np.stack([*(base.means[x] for x in names), base.mean])


def _packed(terms: DataFrame, base: Topics) -> DataFrame:
    """What ``_held`` makes of all rows, written: a row has the bytes of the arrays of up to BLOCK texts, so that a pass
    neither makes the vectors anew nor takes single numbers from Spark to Python."""
    place, means = _places(base)
    kind = pa.schema([(c, pa.binary()) for c in ("sizes", "slots", "terms", "langs", "scales")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                some = b.slice(i, BLOCK)
                x = _held(base, means, place, some["slots"], some["counts"], some["_lang"])
                sizes = np.bincount(x.row, minlength=len(x.lang))
                parts = (sizes.astype(np.int32), x.slot.astype(np.int16), x.value, x.lang.astype(np.int32), x.scale)
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in parts], schema=kind)

    return written(terms.mapInArrow(task, ", ".join(f"{c} binary" for c in kind.names)), "topic-blocks", **{"parquet.block.size": 8 << 20})


def _unpacked(block: dict[str, bytes], means: np.ndarray) -> Held:
    sizes, slot, value, lang, scale = (np.frombuffer(block[c], t) for c, t in (("sizes", np.int32), ("slots", np.int16), ("terms", float), ("langs", np.int32), ("scales", float)))
    row = np.repeat(np.arange(len(sizes)), sizes)
    table = np.zeros((len(sizes), TERMS))
    table.reshape(-1)[row * TERMS + slot] = value
    return Held(row, slot, value, table, lang, means, scale)


def _assigned(terms: DataFrame, base: Topics, starts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(sum of the vectors of each centre, how many they are, nearness of all to their centres) for each of ``starts``, from
    one pass over all rows, as they are or ``_packed``. A sum is that of the terms less the means of the languages times what their rows are
    multiplied by, which tasks add up apart."""
    place, means = _places(base)
    n_langs = len(means)

    def tally(batches):
        out = {(i, k): np.zeros(TERMS + 2 + n_langs, np.int64) for i, centres in enumerate(starts) for k in range(len(centres))}
        for rows in batches:
            x = _unpacked(rows, means) if isinstance(rows, dict) else _held(base, means, place, *rows)
            whole, scale = np.rint(x.value * x.scale[x.row] * SCALE), np.rint(x.scale * SCALE)  # sums of integers below 2^53 are exact
            for i, centres in enumerate(starts):
                near = np.round(x.near(centres), 9)  # ties go to the first, whatever the order of additions
                own, n = near.argmax(axis=1), len(centres)
                sums = np.bincount(own[x.row] * TERMS + x.slot, weights=whole, minlength=n * TERMS).reshape(n, TERMS)
                sizes = np.bincount(own, minlength=n)
                nearness = np.bincount(own, weights=np.rint(near[np.arange(len(own)), own] * SCALE), minlength=n)
                shares = np.bincount(own * n_langs + x.lang, weights=scale, minlength=n * n_langs).reshape(n, n_langs)
                for k in range(n):
                    out[i, k] += np.concatenate((sums[k], [sizes[k], nearness[k]], shares[k])).astype(np.int64)
        return {i * N_KEYS + k: v for (i, k), v in out.items()}

    sums = [np.zeros((len(centres), TERMS + 2 + n_langs)) for centres in starts]
    for r in _tallied(terms, tally, "int", arrays=True).collect():
        i, k = divmod(r["key"], N_KEYS)
        sums[i][k, r["slot"]] = r["n"]
    return [((x[:, :TERMS] - x[:, TERMS + 2 :] @ means) / SCALE, x[:, TERMS].astype(int), x[:, TERMS + 1].sum()) for x in sums]


#: Keys of a start: above any number of topics.
N_KEYS = 1 << 20


def cluster_all(terms: DataFrame, few: list[tuple[dict[int, int], str | None]], n_rows: int, n_topics: int, rounds: int = 25) -> Topics:
    """``cluster`` over all rows of ``terms(slots, counts, _lang)``, each with a term. Slots' weights, means, centres and
    sizes come from every row; ``few`` rows only give the centres that the rounds start from. A round is one aggregate
    of a few numbers per centre; sums are of integers, so that the same rows give the same topics however they lie."""
    seen = np.zeros(TERMS)
    for r in terms.select(F.explode("slots").alias("s")).groupBy("s").count().collect():
        seen[r["s"]] = r["count"]
    base = _language_means(terms, np.log((1 + n_rows) / (1 + seen)) + 1e-9)
    x = base.rows([np.array(list(r)) for r, _ in few], [np.array(list(r.values())) for r, _ in few], [lang for _, lang in few])
    starts = _starts(x, n_topics, rounds)
    # Every task of a pass gives a row for each number of each centre, so tasks are no more than texts or cores ask for.
    terms = _packed(terms, base).coalesce(max(terms.sparkSession.sparkContext.defaultParallelism, n_rows // TASK))
    scored = _assigned(terms, base, starts)
    best = max(range(len(starts)), key=lambda i: scored[i][2])
    centres, (sums, sizes, _) = starts[best], scored[best]
    while True:
        for _ in range(rounds):
            new = np.where((sums * sums).sum(axis=1, keepdims=True) > 0, _unit(sums), centres)
            if np.allclose(new, centres, atol=1e-6):
                break
            centres = new
            sums, sizes, _ = _assigned(terms, base, [centres])[0]
        if len(centres) == 1 or sizes.min() >= LEAST_TOPIC * n_rows:
            return Topics(centres, base.weight, base.mean, base.means, tuple(sizes.tolist()))
        centres = np.delete(centres, sizes.argmin(), axis=0)
        sums, sizes, _ = _assigned(terms, base, [centres])[0]


def fit_topics(docs: DataFrame, n_topics: int = N_TOPICS, sample: int = TOPIC_SAMPLE) -> Topics:
    """Topics of ``docs(doc_id, text)``, apart from what ``lang`` tells if there is such a column, fitted on every row
    that has a term; rows that are repeated count as often. Up to ``sample`` rows are clustered on the driver. Of more,
    as many, chosen by a hash of id and text, give the centres to start from. ``docs`` may have what ``with_terms`` adds."""
    if "_terms" not in docs.columns:
        docs = with_terms(docs)
    mark = F.col("_h") if "_h" in docs.columns else F.xxhash64("doc_id", "text", F.lit(9))
    terms = written(docs.select("_lang", "_terms.slots", "_terms.counts", mark.alias("_h")).where(F.size("slots") > 0), "topic-terms")
    n = terms.count()
    share = min(1.0, 4 * sample / max(n, 1))
    few = terms.where(F.pmod("_h", F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("_h", "_lang").limit(sample).collect()
    few = [(dict(zip(r["slots"], r["counts"], strict=True)), r["_lang"]) for r in few]
    return cluster(few, n_topics) if n <= sample else cluster_all(terms.drop("_h"), few, n, n_topics)


def describe_documents(docs: DataFrame, topics: Topics) -> DataFrame:
    """``docs`` with ``_mix`` (tokens long, topic string). Tokens are words; null and empty texts have none and no
    topic. What ``with_terms`` adds is used, and left out."""
    if "_terms" not in docs.columns:
        docs = with_terms(docs)
    shared = docs.sparkSession.sparkContext.broadcast(topics)

    @F.pandas_udf("tokens long, topic string")
    def described(batches: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
        for terms, langs in batches:
            own, topic = shared.value, np.full(len(terms), None, dtype=object)
            some = np.flatnonzero([len(r) > 0 for r in terms["slots"]])
            if len(some) and len(own.centres):
                x = own.rows(list(terms["slots"].iloc[some]), list(terms["counts"].iloc[some]), [None if pd.isna(x) else x for x in langs.iloc[some]])
                topic[some] = [str(k) for k in np.round(x @ own.centres.T, 9).argmax(axis=1)]
            yield pd.DataFrame({"tokens": terms["tokens"], "topic": topic})

    return docs.withColumn("_mix", described.asNondeterministic()("_terms", "_lang")).drop("_terms", "_lang")


def rake(cells: pd.DataFrame, targets: dict[str, dict[str, float]], sweeps: int = 500, close: float = 1e-10) -> dict[str, dict[str, float]]:
    """Iterative proportional fitting. ``cells`` has a column per margin and ``tokens``; the factors returned,
    one per margin and level, multiply to weights under which each margin's token shares are its targets.
    Levels without tokens keep the factor 1. Levels that the targets leave out keep their observed share, and the
    targets of the others that have tokens are scaled to fill the rest. Where margins contradict each other, so that
    the sweeps do not settle, the factors of the last sweep are returned with a warning."""
    tokens = cells["tokens"].to_numpy(float)
    total = tokens.sum()
    margins = {}
    for name, want in targets.items():
        codes, levels = pd.factorize(cells[name], sort=True)
        have = np.bincount(codes, weights=tokens, minlength=len(levels))
        goal = np.where(have > 0, np.array([want.get(x, 0.0) for x in levels], dtype=float), 0)
        left = np.where([x in want for x in levels], 0, have / max(total, 1))
        goal = left + goal / goal.sum() * (1 - left.sum()) if goal.sum() > 0 else left if left.sum() > 0 else have / max(total, 1)
        margins[name] = (codes, levels, goal / goal.sum() if goal.sum() > 0 else goal, np.ones(len(levels)))
    whole, gains = np.ones(len(cells)), []
    for _ in range(sweeps if total > 0 else 0):
        off = 0.0
        for codes, levels, goal, factor in margins.values():
            now = np.bincount(codes, weights=tokens * whole, minlength=len(levels)) / total
            step = np.divide(goal, now, out=np.ones(len(levels)), where=now > 0)
            off = max(off, float(np.abs(now - goal).max()))
            factor *= step
            whole = whole * step[codes]
        gains.append(off)
        if settled(gains, close):
            break
    return {name: dict(zip(levels, factor.tolist(), strict=True)) for name, (_, levels, _, factor) in margins.items()}


def settled(gains: list[float], close: float) -> bool:
    """Whether raking is done, given how far off each sweep was; warns where it stops short of ``close``."""
    if gains[-1] >= close and (len(gains) <= PATIENCE or gains[-1] < 0.99 * gains[-1 - PATIENCE]):
        return False
    if gains[-1] >= 1e-6:
        warnings.warn(f"raking stops while a share is off by {gains[-1]:.2g}: its targets can't all be met", stacklevel=3)
    return True


def tempered(cells: DataFrame, temper: float = TEMPER) -> DataFrame:
    """``cells(source, lang, topic, tokens)`` with ``goal``, a share of each cell: the share of its source, of its language
    in the source and of its topic in both, each to the power ``temper`` and scaled to one. Margins of this table
    never contradict each other, since the table itself meets them all."""
    def to(name: str) -> Column:
        return F.pow(F.col(name).cast("double"), F.lit(temper))

    pairs = cells.groupBy("source", "lang").agg(F.sum("tokens").alias("_sl"), F.sum(to("tokens")).alias("_topics"))
    sources = pairs.groupBy("source").agg(F.sum("_sl").alias("_s"), F.sum(to("_sl")).alias("_langs"))
    whole = sources.agg(F.sum(to("_s"))).first()[0] or 0.0
    share = to("_s") / F.lit(whole or 1.0) * F.try_divide(to("_sl"), "_langs") * F.try_divide(to("tokens"), "_topics")
    joined = cells.join(pairs, ["source", "lang"]).join(sources, "source")
    return joined.select(*MARGINS, "tokens", F.coalesce(share, F.lit(0.0)).alias("goal"))


def _goals(cells: DataFrame, name: str, want: dict[str, float] | None) -> DataFrame:
    """(level, goal, factor 1) for each level of a margin, by the rules of ``rake``."""
    have = cells.groupBy(F.col(name).alias("level")).agg(F.sum("tokens").cast("double").alias("have"), F.sum("goal").alias("want"))
    if want:
        given = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in want.items()], "level string, want double")
        have = have.drop("want").join(given, "level", "left")
    have = written(have.withColumn("want", F.when(F.col("have") > 0, F.col("want"))), "levels")
    row = have.agg(F.sum("have").alias("all"), F.sum("want").alias("want"), F.sum(F.when(F.col("want").isNull(), F.col("have"))).alias("left")).first()
    whole, wanted, left = row["all"] or 0.0, row["want"] or 0.0, (row["left"] or 0.0) / (row["all"] or 1.0)
    share = F.col("have") / F.lit(whole or 1.0)
    if wanted > 0:
        goal = F.coalesce(F.col("want") / F.lit(wanted) * F.lit(1 - left), share)
    else:
        goal = F.when(F.col("want").isNull(), share / F.lit(left)).otherwise(0.0) if left > 0 else share
    return written(have.select("level", goal.alias("goal"), F.lit(1.0).alias("factor")), "factors")


def _with_factors(rows: DataFrame, factors: dict[str, DataFrame], level: dict[str, Column], names: tuple[str, ...] = MARGINS) -> DataFrame:
    """``rows`` with ``_weight``, the product of the factors of their levels."""
    weight = F.lit(1.0)
    for name in names:
        own = factors[name].select(F.col("level").alias(f"_l_{name}"), F.col("factor").alias(f"_f_{name}"))
        rows = rows.join(own, level[name] == F.col(f"_l_{name}"), "left").drop(f"_l_{name}")
        weight = weight * F.coalesce(f"_f_{name}", F.lit(1.0))
    return rows.withColumn("_weight", weight).drop(*[f"_f_{m}" for m in names])


def rake_tables(cells: DataFrame, targets: dict[str, dict[str, float]], sweeps: int = 500, close: float = 1e-10) -> dict[str, DataFrame]:
    """``rake`` for any number of levels: ``cells(source, lang, topic, tokens, goal)`` stay a table, and the factors
    are tables (level, factor) that each sweep writes anew. A sweep is one aggregate by level per margin."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    factors = {name: _goals(cells, name, targets.get(name)) for name in MARGINS}
    gains = []
    for _ in range(sweeps if total > 0 else 0):
        off = 0.0
        for name in MARGINS:
            weighted = _with_factors(cells, factors, {m: F.col(m) for m in MARGINS})
            now = weighted.groupBy(F.col(name).alias("level")).agg((F.sum(F.col("tokens") * F.col("_weight")) / F.lit(total)).alias("now"))
            step = factors[name].select("level", "goal", "factor").join(now, "level")
            step = step.select("level", "goal", F.when(F.col("now") > 0, F.col("factor") * F.col("goal") / F.col("now")).otherwise(F.col("factor")).alias("factor"), F.abs(F.col("now") - F.col("goal")).alias("off"))
            factors[name] = written(step, "factors")
            off = max(off, factors[name].agg(F.max("off")).first()[0] or 0.0)
        gains.append(off)
        if settled(gains, close):
            break
    return factors


def _value(name: str) -> Column:
    return F.coalesce((F.col("_mix.topic") if name == "topic" else F.col(name)).cast("string"), F.lit(MISSING))


def _level(name: str, kept: list[str] | None) -> Column:
    return _value(name) if kept is None else F.when(_value(name).isin(kept), _value(name)).otherwise(OTHER)


def calibrate(described: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, levels: dict[str, int] | None = None) -> DataFrame:
    """``described(source, lang, _mix)`` with ``_weight`` and ``_probability``.

    The raked weights are divided by the largest, so that sampling with these probabilities gives, in
    expectation, exactly the target shares of tokens. Null sources and languages are a level of their own, and
    every level has its own weight. Margins without targets are those of the ``tempered`` cells, which agree
    with each other. Only if a caller gives ``levels``, those of a margin beyond the so many with most tokens are pooled. Up to ``CELLS`` cells are raked on the driver, more as tables.
    """
    kept = dict.fromkeys(MARGINS)
    for name in levels or {}:
        top = described.groupBy(_value(name).alias("v")).agg(F.sum("_mix.tokens").alias("n")).orderBy(F.desc("n"), "v").limit(levels[name])
        kept[name] = [r["v"] for r in top.collect()]
    level = {name: _level(name, kept[name]) for name in MARGINS}
    cells = written(described.groupBy(*[level[name].alias(name) for name in MARGINS]).agg(F.sum("_mix.tokens").alias("tokens")), "cells")
    table = written(tempered(cells, temper), "goals")
    if table.count() > CELLS:
        factors = rake_tables(table, targets or {})
        largest = _with_factors(table, factors, {m: F.col(m) for m in MARGINS}).agg(F.max("_weight")).first()[0]
    else:
        cells = pd.DataFrame(table.collect(), columns=[*MARGINS, "tokens", "goal"]).sort_values(list(MARGINS), ignore_index=True)
        found = rake(cells, {m: (targets or {}).get(m) or cells.groupby(m)["goal"].sum().to_dict() for m in MARGINS})
        largest = 0.0
        for row in cells.itertuples(index=False):
            largest = max(largest, float(np.prod([found[m][getattr(row, m)] for m in MARGINS])))
        spark = described.sparkSession
        factors = {m: F.broadcast(spark.createDataFrame([(k, float(v)) for k, v in found[m].items()], "level string, factor double")) for m in MARGINS}
    out = _with_factors(described, factors, level)
    return out.withColumn("_probability", F.least(F.col("_weight") / F.lit(largest or 1.0), F.lit(1.0)))


def _uniform(seed: int) -> Column:
    """A number in [0, 1) that depends on a document's id and text alone, not on how rows are dealt out."""
    return F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def mixture(docs: DataFrame, seed: int = 42, targets: dict | None = None) -> DataFrame:
    """Per document: doc_id, source, lang, topic, n_tokens, weight, probability, sampled. Rows that repeat id
    and text share a fate; null and empty texts have no tokens, no topic and the weight of their levels. Other
    columns are ignored; an empty table gives an empty one."""
    some = docs.select("doc_id", "text", "source", "lang").withColumn("_u", _uniform(seed))
    mark = F.xxhash64("doc_id", "text", F.lit(9))
    small = written(with_terms(some).withColumn("_h", mark).drop("text"), "terms")
    out = calibrate(written(describe_documents(small, fit_topics(small)), "mixture"), targets)
    return out.select(
        "doc_id", "source", "lang", F.col("_mix.topic").alias("topic"), F.col("_mix.tokens").alias("n_tokens"),
        F.col("_weight").alias("weight"), F.col("_probability").alias("probability"), (F.col("_u") < F.col("_probability")).alias("sampled"),
    )


def sample_mixture(docs: DataFrame, seed: int = 42, targets: dict | None = None) -> DataFrame:
    """The sampled rows of ``docs`` with their columns and ``sampling_weight``, as in ``mixture``. An input column
    called sampling_weight is replaced; any other is kept."""
    original = [c for c in docs.columns if c != "sampling_weight"]
    docs = set_aside(docs.drop("sampling_weight"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    terms = written(with_terms(docs).withColumn("_u", _uniform(seed)), "terms")
    out = calibrate(describe_documents(terms, fit_topics(terms)), targets)
    return out.where(F.col("_u") < F.col("_probability")).select(*names, F.col("_weight").alias("sampling_weight")).toDF(*original, "sampling_weight")
