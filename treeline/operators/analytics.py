"""Tables of results: merging, ranking, paired tests, curves, informativeness."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions.stats import ordinal_ranks, quantiles, running_totals, stars, t_test_p, value_ranks
from treeline.functions.text import parse_label
from treeline.operators.graph import G
from treeline.tables import written

RUN = ["dataset", "use_synsets", "explode_nodes", "method"]


def upsert_results(store: DataFrame, new: DataFrame) -> DataFrame:
    """Runs of ``new`` replace the metrics they give in ``store`` (key: dataset, scenario, method); a null leaves
    what is there, so a model is only overwritten by a model."""
    values = [c for c in store.columns if c not in RUN]
    fresh = new.select(*RUN, *[(F.col(c) if c in new.columns else F.lit(None)).alias(f"_{c}") for c in values])
    return store.join(fresh, RUN, "full").select(*RUN, *[F.coalesce(f"_{c}", c).alias(c) for c in values])


def scenario(use_synsets: Column, explode_nodes: Column) -> Column:
    parts = F.concat_ws("+", F.when(use_synsets, "Syn"), F.when(explode_nodes, "Exp"))
    return F.when(parts == "", "").otherwise(F.concat(F.lit(" ("), parts, F.lit(")")))


def merge_with_profile(results: DataFrame, profile: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, missing): runs with their dataset's profile (names match without .csv) and a scenario label, and
    the datasets without one."""
    r = results.withColumn("dataset", F.regexp_replace("dataset", r"\.csv$", ""))
    label = F.concat("dataset", scenario(F.col("use_synsets"), F.col("explode_nodes")))
    return r.join(profile, "dataset").withColumn("scenario", label), r.select("dataset").distinct().join(profile.select("dataset"), "dataset", "left_anti")


def method_by_scenario(runs: DataFrame, metric: str, scenarios: list[str]) -> DataFrame:
    """Mean of the metric per method (rows) and scenario (columns), with the mean of each row's values."""
    wide = runs.groupBy("method").pivot("scenario", scenarios).agg(F.avg(metric))
    have = F.filter(F.array(*[F.col(f"`{s}`") for s in scenarios]), lambda x: x.isNotNull())
    return wide.withColumn("row_mean", F.aggregate(have, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(have), F.lit(0)))


def synonym_pairs(runs: DataFrame, metric: str, family: str = "our method") -> DataFrame:
    """Per dataset that has runs with both synonyms and exploded nodes, and method of the family: the metric's mean of
    plain runs and of those side by side, and the difference. (dataset, method, plain, syn_exp, delta)"""
    both, neither = F.col("use_synsets") & F.col("explode_nodes"), ~F.col("use_synsets") & ~F.col("explode_nodes")
    asked = runs.where(both).select("dataset").distinct()
    own = runs.where(F.lower("method").contains(family.lower())).join(asked, "dataset", "left_semi")
    out = own.groupBy("dataset", "method").agg(F.avg(F.when(neither, F.col(metric))).alias("plain"), F.avg(F.when(both, F.col(metric))).alias("syn_exp"))
    return out.where("plain is not null or syn_exp is not null").withColumn("delta", F.col("syn_exp") - F.col("plain"))


def method_variance(runs: DataFrame, metric: str, by: str = "method") -> DataFrame:
    c = F.col(metric)
    return runs.groupBy(by).agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_samp(c).alias("variance"), F.stddev_samp(c).alias("sd"),
        F.min(c).alias("low"), F.max(c).alias("high"), F.median(c).alias("median"),
    )


def best_per_scenario(runs: DataFrame, metric: str, by: str = "scenario", family: str | None = None) -> DataFrame:
    """The best run per scenario (ties: the first method by name); ``family``: the best of each value of that
    column instead of each scenario's only."""
    keys = [by] + ([family] if family else [])
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(metric), "method"))
    return runs.withColumn("_r", rank).where("_r = 1").drop("_r")


def spearman_by_method(runs: DataFrame, metric: str, against: list[str], by: str = "method") -> DataFrame:
    """(method, metric, n, rho): Spearman correlation of the metric with each column, over three rows at least."""
    long = runs.select(by, F.col(metric).alias("_y"), F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in against])).alias("_v"))
    long = long.select(by, F.col("_v.name").alias("metric"), F.col("_v.x").alias("_x"), "_y").where("_x is not null and _y is not null")
    ranked = long.join(value_ranks(long, [by, "metric"], "_x", "_a"), [by, "metric", "_x"]).join(value_ranks(long, [by, "metric"], "_y", "_b"), [by, "metric", "_y"])
    return ranked.groupBy(by, "metric").agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("rho")).where("n > 2")


def runtime_scaling(runs: DataFrame) -> DataFrame:
    """(method, n, slope, intercept) of log10 runtime on log10 nodes, over the median runtime of each base method
    and dataset. ``runs`` is (dataset, method, nodes, runtime)."""
    base = runs.select("dataset", parse_label("method")["base_method"].alias("method"), "nodes", "runtime").where("runtime > 0 and nodes > 0")
    mid = base.groupBy("method", "dataset", "nodes").agg(F.median("runtime").alias("_t"))
    y, x = F.log10("_t"), F.log10(F.col("nodes").cast("double"))
    return mid.groupBy("method").agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def melt_metrics(runs: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """Mean of each metric by group, one row per metric."""
    long = runs.unpivot(by, metrics, "type", "value")
    return long.groupBy(*by, "type").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))


def paired_delta_test(runs: DataFrame, category: str, metric: str, reference: str, key: str = "dataset", sign: int = 1, within: str | None = None) -> DataFrame:
    """Per category: n, mean difference from the reference over shared keys (``sign`` -1: reference minus
    category), paired t, degrees of freedom, two-sided p and stars. Under two pairs or no spread: no t. A key
    with several runs of a category has their mean. ``within``: each value of that column (such as a base model)
    has a reference of its own, and a row per category."""
    own = [within] if within else []
    mean = runs.where(F.col(metric).isNotNull()).groupBy(*own, key, category).agg(F.avg(metric).alias("_m"))
    base = mean.where(F.col(category) == reference).select(*own, key, F.col("_m").alias("_ref"))
    delta = mean.where(F.col(category) != reference).join(base, [*own, key]).select(*own, category, ((F.col("_m") - F.col("_ref")) * sign).alias("_d"))
    out = delta.groupBy(*own, category).agg(F.count("*").alias("n"), F.avg("_d").alias("mean_delta"), F.var_samp("_d").alias("_v"))
    t = F.when((F.col("n") > 1) & (F.col("_v") > 0), F.col("mean_delta") / F.sqrt(F.col("_v") / F.col("n")))
    out = out.withColumn("t", t).withColumn("df", F.col("n") - 1)
    out = out.withColumn("p", t_test_p("t", F.col("df").cast("double")))
    return out.select(*own, category, "n", "mean_delta", "t", "df", "p", stars(F.col("p")).alias("stars"))


def model_gap(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """Per dataset of two models' runs: which side has it, the difference (a - b), its size and the winner."""
    j = a.select("dataset", F.col(metric).alias("_a")).join(b.select("dataset", F.col(metric).alias("_b")), "dataset", "full")
    side = F.when(F.col("_a").isNull(), "only_b").when(F.col("_b").isNull(), "only_a").otherwise("shared")
    d = F.col("_a") - F.col("_b")
    return j.select("dataset", side.alias("side"), d.alias("gap"), F.abs(d).alias("abs_gap"), F.when(d > 0, "a").when(d < 0, "b").when(d == 0, "tie").alias("winner"))


def gap_change(first: DataFrame, second: DataFrame) -> DataFrame:
    """How much smaller the second method's cross-model gap is than the first's, per shared dataset."""
    x, y = (df.where("side = 'shared'").select("dataset", F.col("abs_gap").alias(n)) for df, n in ((first, "gap_first"), (second, "gap_second")))
    return x.join(y, "dataset").withColumn("delta_gap", F.col("gap_first") - F.col("gap_second"))


def last_run_per_dataset(runs: DataFrame, keys: tuple[str, ...] = ("dataset", "method")) -> DataFrame:
    """The last run (by ordinal) of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ordinal")))
    return runs.withColumn("_r", rank).where("_r = 1").drop("_r")


def mixed_models(runs: DataFrame, by: str = "file") -> DataFrame:
    """Files whose runs name more than one model."""
    return runs.groupBy(by).agg(F.count_distinct("model").alias("n_models")).where("n_models > 1")


def pruned_run_means(runs: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Mean metrics of prune-only runs by (top_n, rank_by); runs without one of them are left out."""
    lab = runs.withColumn("_l", parse_label("method")).where("_l.restructure = 'prune_only'").dropna(subset=list(metrics))
    return lab.groupBy(F.col("_l.top_n").alias("k"), F.col("_l.rank_by").alias("rank_by")).agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics])


def clawback_curve(runs: DataFrame, metric: str, by: str = "scenario") -> DataFrame:
    """The metric by clawback size per scenario, with the value at 0, the change from it, and the size where it
    peaks (ties: the smallest)."""
    lab = runs.withColumn("clawback", parse_label("method")["clawback"]).groupBy(by, "clawback").agg(F.avg(metric).alias("value"))
    w = Window.partitionBy(by)
    base = F.max(F.when(F.col("clawback") == 0, F.col("value"))).over(w)
    peak = F.max(F.struct("value", (-F.col("clawback")).alias("s"))).over(w)
    out = lab.withColumn("baseline", base).withColumn("_p", peak)
    return out.select(by, "clawback", "value", "baseline", (F.col("value") - F.col("baseline")).alias("delta"), (-F.col("_p.s")).alias("peak_clawback"))


def heuristic_informativeness(diag: DataFrame, feature: str, bins: int = 5, discrete: bool = False, ratio: bool = False) -> DataFrame:
    """False-positive rate and support by bin of a feature (quantile bins, equal edges merged; or its values; or,
    for a ratio, bins of equal width from 0 to 1, each with its upper end and the first with 0, values outside left
    out), with the overall rate and the point-biserial correlation."""
    d = diag.where(F.col(feature).isNotNull()).select(F.col(feature).cast("double").alias("_x"), F.col("is_fp").cast("double").alias("_y"))
    d = d.join(F.broadcast(d.agg(F.avg("_y").alias("baseline"), F.corr("_x", "_y").alias("r"))))  # one row
    cuts = [] if discrete or ratio else sorted({q for q in quantiles(d, "_x", [i / bins for i in range(1, bins)]) if q is not None})
    low = F.col("_x") if discrete else sum((F.when(F.col("_x") > q, 1).otherwise(0) for q in cuts), F.lit(0)).cast("double")
    if ratio:
        d = d.where("_x between 0 and 1")
        low = F.greatest(F.ceil(F.col("_x") * bins) - 1, F.lit(0)).cast("double")
    return d.groupBy(low.alias("bin"), "baseline", "r").agg(F.count("*").alias("support"), F.avg("_y").alias("fp_rate"))


def scale_retention(runs: DataFrame, metric: str) -> DataFrame:
    """(dataset, method, sub, full, retention): a dataset's FULL value over its SUB value (0 gives null)."""
    r = runs.select(F.regexp_extract("dataset", r"^(.*)_(SUB|FULL)$", 1).alias("base"), F.regexp_extract("dataset", r"^(.*)_(SUB|FULL)$", 2).alias("_s"), "method", F.col(metric).alias("_v")).where("base <> ''")
    out = r.groupBy(F.col("base").alias("dataset"), "method").agg(F.avg(F.when(F.col("_s") == "SUB", F.col("_v"))).alias("sub"), F.avg(F.when(F.col("_s") == "FULL", F.col("_v"))).alias("full"))
    return out.where("sub is not null and full is not null").withColumn("retention", F.col("full") / F.nullif(F.col("sub"), F.lit(0.0)))


def roc_auc(scored: DataFrame, score: str, label: str, by: str = G) -> DataFrame:
    """(by, auc): chance that a positive outranks a negative, ties counting half; null without both."""
    # Rows are counted by score first.
    both = scored.groupBy(by, score).agg(F.count_if(F.col(label) == 1).cast("double").alias("_p"), F.count_if(F.col(label) == 0).cast("double").alias("_n"))
    both = running_totals(both, [by], [F.col(score)], {"_upto": F.col("_n")})
    won = both.withColumn("_w", F.col("_p") * (F.col("_upto") - F.col("_n") / 2)).groupBy(by).agg(F.sum("_w").alias("_w"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    return won.select(by, F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_w") / F.nullif(F.col("_p") * F.col("_n"), F.lit(0.0))).alias("auc"))


def logistic(names: list[str], weights: str) -> Column:
    """The probability that ``weights`` (one per name, and the intercept) give."""
    at = lambda i: F.element_at(weights, i + 1)
    z = sum((F.col(n) * at(i) for i, n in enumerate(names)), at(len(names)))
    return 1 / (1 + F.exp(-z))


def logistic_folds(features: DataFrame, names: list[str], l2: float = 0.01, steps: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """(graph_id, weights): for each graph the logistic regression of is_fp on all other graphs, and with a null graph_id
    that on all of them. Half of ``l2`` times the squared weights is added to the mean loss, the intercept is free.
    Weights are null where the labels have one value.

    All folds take their Newton steps together: gradients and Hessians of every fold come from one aggregate over the
    rows, so passes are as many as the slowest fold's steps. There is a row of a few numbers per graph on the driver.
    """
    rows = written(features.select(G, *names, F.col("is_fp").cast("double").alias("_y")), "folds")
    own = {r[G]: (r["n"], r["f"]) for r in rows.groupBy(G).agg(F.count("*").alias("n"), F.sum("_y").alias("f")).collect()}
    n, f = (sum(x[i] for x in own.values()) for i in (0, 1))
    size = {None: (n, f)} | {g: (n - m, f - k) for g, (m, k) in own.items()}
    keys = list(size)
    open_ = {i for i, g in enumerate(keys) if 0 < size[g][1] < size[g][0]}
    d = len(names) + 1
    weights = {i: np.zeros(d) for i in open_}
    penalty = np.diag([l2] * (d - 1) + [0.0])
    x = [*(F.col(c) for c in names), F.lit(1.0)]
    fold = "fold int, graph string, weights array<double>"
    while open_ and (steps := steps - 1) >= 0:
        asked = rows.sparkSession.createDataFrame([(i, keys[i], weights[i].tolist()) for i in sorted(open_)], fold)
        met = rows.join(F.broadcast(asked), F.col("graph").isNull() | (F.col("graph") != F.col(G).cast("string")))
        met = met.withColumn("_p", logistic(names, "weights")).withColumn("_v", F.col("_p") * (1 - F.col("_p")))
        slope = [F.sum((F.col("_p") - F.col("_y")) * x[i]).alias(f"g{i}") for i in range(d)]
        curve = [F.sum(F.col("_v") * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(d) for j in range(i, d)]
        for r in met.groupBy("fold").agg(*slope, *curve).collect():
            m, w = size[keys[r.fold]][0], weights[r.fold]
            g = np.array([r[f"g{i}"] for i in range(d)]) / m + penalty @ w
            h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) / m + penalty
            step = np.linalg.lstsq(h, g, rcond=None)[0]
            weights[r.fold] = w - step * min(1, 5 / max(np.abs(step).max(), 1e-300))
            if np.abs(g).max() < tolerance:
                open_.discard(r.fold)
    kind = f"{G} {dict(features.dtypes)[G]}, weights array<double>"
    return rows.sparkSession.createDataFrame([(g, weights[i].tolist() if i in weights else None) for i, g in enumerate(keys)], kind)


def learned_suspicion(features: DataFrame, names: list[str], l2: float = 0.01) -> DataFrame:
    """(graph_id, parent, child, p_fp, p_in_sample): probabilities of a false positive from a logistic regression
    on all other graphs, and from one on all of them. Labels of one value give 0.5. ``features`` has is_fp."""
    folds = written(logistic_folds(features, names, l2), "fold-weights")
    whole = folds.where(F.col(G).isNull()).select(F.col("weights").alias("_all"))
    own = features.join(F.broadcast(folds.where(F.col(G).isNotNull())), G).join(F.broadcast(whole))  # a row per graph, and one
    p = lambda w: F.coalesce(logistic(names, w), F.lit(0.5))
    return own.select(G, "parent", "child", p("weights").alias("p_fp"), p("_all").alias("p_in_sample"))


def perplexity_features(edges: DataFrame, ppl: DataFrame) -> DataFrame:
    """Edges (graph_id, parent, child as primary terms) with the forward perplexity, its ratio to the reverse one
    and the ranks of both: what is missing ranks as 0.0 forward and 1.0 in ratio."""
    ppl = written(ppl.select("child", "parent", "ppl"), "perplexities")
    fwd = ppl.select("child", "parent", F.col("ppl").alias("forward"))
    rev = ppl.select(F.col("child").alias("parent"), F.col("parent").alias("child"), F.col("ppl").alias("_rev"))
    e = edges.join(fwd, ["child", "parent"], "left").join(rev, ["child", "parent"], "left").withColumn("ratio", F.col("forward") / F.nullif(F.col("_rev"), F.lit(0.0)))
    e = e.withColumn("_f", F.coalesce("forward", F.lit(0.0))).withColumn("_q", F.coalesce("ratio", F.lit(1.0)))
    e = written(e, "ratios")  # read by the counts of the groups, the bounds of the ranges and the ranges
    ranked = ordinal_ranks(e, [G], {name: [F.col(c), F.col("parent"), F.col("child")] for name, c in (("f_forward", "_f"), ("f_ratio", "_q"))})
    return ranked.select(G, "parent", "child", "forward", "ratio", "f_forward", "f_ratio")


def reasoning_effort(log: DataFrame, f1: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(by dataset and variant, by variant) of a reply log (dataset, variant, reasoning_chars, edges, produced):
    replies, mean length, productive share, edges and the run's F1; and the upper medians of the length of
    productive and of empty replies."""
    own = log.groupBy("dataset", "variant").agg(F.count("*").alias("n"), F.avg("reasoning_chars").alias("mean_chars"), F.avg(F.col("produced").cast("double")).alias("productive"), F.sum("edges").alias("edges"))
    own = own.join(f1.select("dataset", "variant", "f1"), ["dataset", "variant"], "left")
    # Rows are counted by length first.
    place = log.groupBy("variant", "produced", "reasoning_chars").agg(F.count("*").alias("_c"))
    place = running_totals(place, ["variant", "produced"], [F.col("reasoning_chars")], {"_r": F.col("_c")}, {"_n": F.col("_c")})
    at = F.floor(F.col("_n") / 2) + 1
    mid = place.where((F.col("_r") >= at) & (F.col("_r") - F.col("_c") < at))
    pick = lambda flag, name: F.max(F.when(F.col("produced") == flag, F.col("reasoning_chars"))).alias(name)
    return own, mid.groupBy("variant").agg(pick(True, "median_productive"), pick(False, "median_empty"))
