"""Corpora of columns: a catalogue (group, source, name) over (row_id, value) columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import selector_kind

LEAST_ROWS = 1024


def catalogued(columns: list[tuple[str, str, str, DataFrame]]) -> DataFrame:
    """One long table (group, source, name, row_id, value)."""
    each = [df.select(F.lit(g).alias("group"), F.lit(s).alias("source"), F.lit(n).alias("name"), "row_id", "value") for g, s, n, df in columns]
    return reduce(DataFrame.unionByName, each)


def census_corpus(long: DataFrame, most_rows: int | None = None) -> DataFrame:
    """All columns in the order of (group, source, name), each once (``place``), with their rows;
    a study may take the first ``most_rows`` of each."""
    rows = long if most_rows is None else long.where(F.col("row_id") < most_rows)
    each = rows.groupBy("group", "source", "name").agg(F.countDistinct("row_id").alias("rows"))
    return each.withColumn("place", F.row_number().over(Window.orderBy("group", "source", "name")))  # one row a column


def predicate_corpus(long: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """(group, source, kind, selector, value, rows): of every source with a selector of ``least`` rows, its value
    columns of as many rows.  The selector is a column with "timestamp" in its name, else the source's first name."""
    each = long.groupBy("group", "source", "name").agg(F.count(F.lit(1)).alias("rows"))
    pick = F.min(F.struct(~F.contains("name", F.lit("timestamp")), F.col("name").alias("selector"), F.col("rows").alias("n"))).alias("_s")
    both = each.join(each.groupBy("group", "source").agg(pick), ["group", "source"])
    both = both.where((F.col("name") != F.col("_s.selector")) & (F.col("rows") == F.col("_s.n")) & (F.col("rows") >= least))
    return both.select("group", "source", selector_kind(F.col("_s.selector")).alias("kind"), F.col("_s.selector").alias("selector"), F.col("name").alias("value"), "rows")


def aligned(long: DataFrame, group: str, source: str, selector: str, value: str) -> DataFrame:
    """A pair of the corpus as (row_id, selector, value): one pass over the source, no join."""
    rows = long.where((F.col("group") == group) & (F.col("source") == source) & F.col("name").isin(selector, value))
    take = lambda n: F.max(F.when(F.col("name") == n, F.col("value")))
    return rows.groupBy("row_id").agg(take(selector).alias("selector"), take(value).alias("value"))
