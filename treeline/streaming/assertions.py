"""Edge assertions from replies as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators.replies import parse_arrow_lines


def running_salience(replies: DataFrame, vocab: DataFrame) -> DataFrame:
    """A streaming table (run_id, target, chunk, text) to running counts of each asserted edge: stream-static
    joins for the vocabulary and one keyed aggregate, whose state is one row per edge. Write it in ``update`` or
    ``complete`` mode; over a finished stream the counts are those of the batch."""
    return parse_arrow_lines(replies, vocab).groupBy("run_id", "parent", "child").agg(F.count("*").alias("n"))
