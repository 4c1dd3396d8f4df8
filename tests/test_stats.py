"""Numbers and ranks over groups that spread over several tasks."""

import random

from pyspark.sql import functions as F

from treeline.functions import stats
from treeline.functions.stats import numbered, ordinal_ranks


def test_numbers_of_large_small_and_null_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["big"] * 8 + ["small", None]), rng.choice([None, *range(40)]), i) for i in range(3000)] + [("single", 5, -1)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    got = {(r.g, r.i): (r["n"], r["size"]) for r in numbered(df, ["g"], [F.desc("v"), F.col("i")], "n", "size").collect()}
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        # Descending, nulls last.
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        assert [got[g, r[2]] for r in order] == [(k + 1, len(order)) for k in range(len(order))]


def test_numbers_of_repeated_rows_and_of_nothing(spark):
    same = spark.createDataFrame([("a", 1)] * 50, "g string, v int")
    assert sorted(r["n"] for r in numbered(same, ["g"], [F.col("v")], "n").collect()) == list(range(1, 51))
    assert numbered(same.where("v > 1"), ["g"], [F.col("v")], "n").count() == 0


def test_ordinal_ranks(spark):
    df = spark.createDataFrame([("a", 3.0, "x"), ("a", 1.0, "y"), ("a", 3.0, "b"), ("o", 9.0, "z")], "g string, v double, t string")
    got = {r.t: (r.up, r.down) for r in ordinal_ranks(df, ["g"], {"up": [F.col("v"), F.col("t")], "down": [F.desc("v"), F.col("t")]}).collect()}
    assert got == {"y": (0.0, 1.0), "b": (0.5, 0.0), "x": (1.0, 0.5), "z": (1.0, 1.0)}


def test_numbers_over_ranges_shuffle_the_rows_once(spark, monkeypatch):
    monkeypatch.setattr(stats, "WINDOW_ROWS", 100)
    rng = random.Random(4)
    rows = [(rng.choice(["big"] * 6 + ["mid", None]), rng.choice([None, *range(9)]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    out = numbered(df, ["g"], [F.col("v"), F.col("i")], "n", "size")
    got = {(r.g, r.i): (r["n"], r["size"]) for r in out.collect()}
    for g in {r[0] for r in rows}:
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[g, r[2]] for r in order] == [(k + 1, len(order)) for k in range(len(order))]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan  # what was written in ranges is not shuffled again
