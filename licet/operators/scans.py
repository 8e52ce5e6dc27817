"""Query operators on a column (row_id, value): GET, SUM, BETWEEN, FILTER, COUNT and sums over ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import total
from .rows import ranges


def check_bounds(low: int, high: int) -> None:
    if low > high:
        raise ValueError(f"low {low} is above high {high}")


def check_rows(left: int, right: int, rows: int) -> None:
    if not 0 <= left <= right <= rows:
        raise ValueError(f"rows [{left}, {right}) are outside the column of {rows}")


def get(df: DataFrame, row: int, rows: int) -> DataFrame:
    """The row's value (null for a null row); outside the column: an error."""
    if not 0 <= row < rows:
        raise ValueError(f"row {row} is outside the column of {rows}")
    return df.where(F.col("row_id") == row).select("value")


def sum_rows(df: DataFrame, left: int, right: int) -> DataFrame:
    return df.where((F.col("row_id") >= left) & (F.col("row_id") < right)).agg(total(F.col("value")).alias("sum"))


def matches(df: DataFrame, low: int, high: int) -> DataFrame:
    """Rows whose value lies in [low, high]; nulls never match."""
    check_bounds(low, high)
    return df.where(F.col("value").between(low, high))


def between_rows(df: DataFrame, left: int, right: int, low: int, high: int) -> DataFrame:
    return ranges(matches(df.where((F.col("row_id") >= left) & (F.col("row_id") < right)), low, high))


def filter_between(df: DataFrame, low: int, high: int) -> DataFrame:
    return ranges(matches(df, low, high))


def filter_equals(df: DataFrame, value: int) -> DataFrame:
    return ranges(df.where(F.col("value") == value))


def count_equals(df: DataFrame, value: int) -> DataFrame:
    return df.agg(F.count_if(F.col("value") == value).alias("count"))


def count_runs(runs: DataFrame, value: int) -> DataFrame:
    """COUNT EQUALS over runs (value, start, end): lengths instead of rows."""
    return runs.where(F.col("value") == value).agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("count"))


def sum_run_rows(runs: DataFrame, left: int, right: int) -> DataFrame:
    """SUM of rows [left, right) over runs: value times overlap."""
    overlap = F.least(F.col("end"), F.lit(right)) - F.greatest(F.col("start"), F.lit(left))
    return runs.where((F.col("end") > left) & (F.col("start") < right)).agg(total(F.col("value").cast("decimal(38,0)") * overlap).alias("sum"))


def sum_over_ranges(df: DataFrame, spans: DataFrame) -> DataFrame:
    """Sum of the values in ordered, disjoint [start, end) ranges, by block buckets.

    A range is cut at the blocks' edges, so the join is on the block, whatever
    the ranges' number and lengths.
    """
    from .rows import BLOCK, block

    cut = spans.withColumn("_b", F.explode(F.sequence(block(BLOCK, "start"), F.floor((F.col("end") - 1) / BLOCK)))).select("_b", "start", "end")
    rows = df.withColumn("_b", block(BLOCK))
    hit = (F.col("row_id") >= F.col("start")) & (F.col("row_id") < F.col("end"))
    return rows.join(cut, "_b").where(hit).agg(total(F.col("value")).alias("sum"), F.count(F.lit(1)).alias("matched_rows"))


def predicate_sum(df: DataFrame, low: int, high: int) -> DataFrame:
    """The flagship on aligned columns (row_id, selector, value): matched rows and their sum in one pass."""
    check_bounds(low, high)
    return df.where(F.col("selector").between(low, high)).agg(total(F.col("value")).alias("sum"), F.count(F.lit(1)).alias("matched_rows"))


def half_open(low: int, high: int) -> tuple[int, int]:
    """Inclusive bounds as [low, high + 1), checked."""
    check_bounds(low, high)
    if high >= 2**63 - 1:
        raise OverflowError("the upper bound has no successor")
    return low, high + 1


def fused_sum_over_ranges(df: DataFrame, spans: DataFrame) -> DataFrame:
    """:func:`sum_over_ranges` as one pass over the whole column: every row is visited, the condition stands
    inside the aggregate.  A row meets its range by the last start at or before it, inside blocks of rows."""
    from pyspark.sql import Window

    from .rows import BLOCK, block

    cut = spans.withColumn("_b", F.explode(F.sequence(block(BLOCK, "start"), F.floor((F.col("end") - 1) / BLOCK))))
    marks = cut.select("_b", F.greatest("start", F.col("_b") * BLOCK).alias("row_id"), F.lit(None).cast("long").alias("value"), F.col("end").alias("_end"))
    both = df.select(block(BLOCK).alias("_b"), "row_id", "value", F.lit(None).cast("long").alias("_end")).unionByName(marks)
    w = Window.partitionBy("_b").orderBy("row_id", F.col("_end").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    inside = F.col("row_id") < F.last("_end", True).over(w)
    rows = both.withColumn("_in", F.coalesce(inside, F.lit(False)) & F.col("_end").isNull())
    return rows.agg(total(F.when(F.col("_in"), F.col("value"))).alias("sum"), F.count_if("_in").alias("matched_rows"))


def predicate_truth(df: DataFrame, low: int, high: int) -> DataFrame:
    """Of aligned (row_id, selector, value): every matching range with its own sum (the whole sum is theirs)."""
    check_bounds(low, high)
    from .rows import before

    hits = df.where(F.col("selector").between(low, high))
    spans = ranges(hits.select("row_id"))
    numbered = before(hits.select("row_id", "value").withColumn("_new", F.lit(1).cast("long")), F.coalesce("value", F.lit(0)), "_sum", inclusive=True)
    ends = numbered.select((F.col("row_id") + 1).alias("end"), F.col("_sum").alias("_to"))
    starts = numbered.select(F.col("row_id").alias("start"), (F.col("_sum") - F.coalesce("value", F.lit(0))).alias("_from"))
    return spans.join(starts, "start").join(ends, "end").select("start", "end", (F.col("_to") - F.col("_from")).alias("sum"))


def answer_checksum(answer: DataFrame) -> DataFrame:
    """One number of an answer: the rows of its ranges, else its value, sum or count (nothing: 0)."""
    if "start" in answer.columns:
        return answer.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).cast("long").alias("checksum"))
    return answer.agg(F.coalesce(F.sum(answer.columns[0]), F.lit(0)).cast("long").alias("checksum"))
