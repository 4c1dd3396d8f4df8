"""Running sums, ranks and quantiles over groups of any size, and the p-value of a t statistic."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from treeline.tables import written


#: Rows of a group up to which one task orders it; a larger group is dealt by ranges. Results are the same.
WINDOW_ROWS = 1_000_000


def largest_group(df: DataFrame, by: list[str]) -> int:
    return df.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0


def running_totals(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], wholes: dict[str, Column] | None = None, largest: int | None = None) -> DataFrame:
    """``df`` with sums over the rows of the group up to each row, in the given order, and sums over whole groups.
    ``largest`` is the size of the largest group, if it is known.

    Where a group is too large for one task, rows are dealt by ranges of the group and the order and summed within
    their range; what the ranges before hold comes from a row per range and group. The ranges are written before they
    are summed, since bounds are sampled anew each time.
    """
    wholes, group = wholes or {}, Window.partitionBy(*by)
    upto = lambda w: w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if (largest_group(df, by) if largest is None else largest) <= WINDOW_ROWS:
        return df.select("*", *[F.sum(c).over(upto(group)).alias(n) for n, c in sums.items()], *[F.sum(c).over(group).alias(n) for n, c in wholes.items()])
    placed = written(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = placed.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums.values())], *[F.sum(c).alias(f"_w{i}") for i, c in enumerate(wholes.values())])
    ahead = [(F.sum(f"_s{i}").over(group.orderBy("_range")) - F.col(f"_s{i}")).alias(f"_before{i}") for i in range(len(sums))]
    before = counts.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], F.col("_range").alias("_at"), *ahead, *[F.sum(f"_w{i}").over(group).alias(f"_whole{i}") for i in range(len(wholes))])
    within = upto(Window.partitionBy(*by, "_range"))
    own = placed.select("*", *[F.sum(c).over(within).alias(f"_own{i}") for i, c in enumerate(sums.values())])
    out = _with_before(own, before, by)
    return out.select(*df.columns, *[(F.col(f"_before{i}") + F.col(f"_own{i}")).alias(n) for i, n in enumerate(sums)], *[F.col(f"_whole{i}").alias(n) for i, n in enumerate(wholes)])


def _with_before(rows: DataFrame, before: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with what ``before(_0, _1, ..., _at)`` says of their group and range. It is written, so that Spark knows how
    small it is before it would shuffle the rows for the join."""
    same = F.col("_range") == F.col("_at")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_{i}"))
    return rows.join(written(before, "before"), same)


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str = "rank", size: str | None = None, largest: int | None = None) -> DataFrame:
    """``df`` with the number from 1 of each row in its group, in the given order (equal rows in any order), and the
    ``size`` of the group. Ranges of large groups are numbered where they are sorted, so rows are shuffled once."""
    largest = largest_group(df, by) if largest is None else largest
    if largest <= WINDOW_ROWS:
        one = F.lit(1)
        return running_totals(df, by, order, {name: one}, {size: one} if size else None, largest).withColumn(name, F.col(name).cast("int"))
    # The lower 33 bits count the rows of a partition.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    placed = written(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_place", place), "ranges")
    counts = placed.groupBy(*by, "_range").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    group = Window.partitionBy(*by)
    ahead = F.sum("_n").over(group.orderBy("_range")) - F.col("_n") - F.col("_first")
    before = counts.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], F.col("_range").alias("_at"), ahead.alias("_ahead"), F.sum("_n").over(group).alias("_whole"))
    out = _with_before(placed, before, by)
    return out.select(*df.columns, (F.col("_place") + F.col("_ahead") + 1).cast("int").alias(name), *([F.col("_whole").alias(size)] if size else []))


def ordinal_ranks(df: DataFrame, by: list[str], orders: dict[str, list[Column]]) -> DataFrame:
    """``df`` with a rank per name and order: (number - 1) / (rows - 1) in the group; a single row has 1. Equal values
    get different ranks, by the order."""
    largest = largest_group(df, by)
    for name, order in orders.items():
        df = numbered(df, by, order, "_row", "_rows", largest)
        rank = F.when(F.col("_rows") == 1, F.lit(1.0)).otherwise((F.col("_row") - 1) / (F.col("_rows") - 1))
        df = df.withColumn(name, rank).drop("_row", "_rows")
    return df


def value_ranks(df: DataFrame, by: list[str], value: str, name: str = "rank") -> DataFrame:
    """(by, value, name): the average rank of each distinct value. Rows are counted by value before anything is ordered."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    counts = running_totals(counts, by, [F.col(value)], {"_upto": F.col("_n")})
    return counts.select(*by, value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name))


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles of a column without nulls, between two values by linear interpolation; none for an empty table."""
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    counts = running_totals(counts, [], [F.col(value)], {"_upto": F.col("_n")}, {"_all": F.col("_n")})
    place = [(F.col("_all") - 1) * p for p in shares]
    at = lambda i: F.max(F.when((i < F.col("_upto")) & (i >= F.col("_upto") - F.col("_n")), F.col(value)))
    ends = counts.agg(F.max("_all").alias("n"), *[at(f(p)).alias(f"{k}{i}") for i, p in enumerate(place) for k, f in (("low", F.floor), ("high", F.ceil))]).first()
    if not ends["n"]:
        return [None] * len(shares)
    part = [(ends["n"] - 1) * p % 1 for p in shares]
    return [ends[f"low{i}"] + part[i] * (ends[f"high{i}"] - ends[f"low{i}"]) for i in range(len(shares))]


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 301):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def two_sided_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(DoubleType())
def t_test_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """One value per comparison, long after aggregation."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else two_sided_p(a, b) for a, b in zip(t, df, strict=True)], dtype="float64")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")
