"""Predicates chosen from a column's order: centred quantile windows and quartiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import at_ranks

#: Selectivities in thousandths and their labels.
SELECTIVITIES = {1: "0.1%", 10: "1%", 100: "10%", 500: "50%"}


def picks(df: DataFrame, ranks: list[int]) -> DataFrame:
    """(rank, value) of the given ranks in the order of non-null values."""
    return at_ranks(df.where("value IS NOT NULL").select("value", "row_id"), "value", ranks, "row_id")


def quantile_windows(df: DataFrame, rows: int) -> DataFrame:
    """(low, high, labels): windows of the selectivities; equal ones collapse, their labels joined by ``+``."""
    places = []
    for i, (k, label) in enumerate(SELECTIVITIES.items()):
        width = max(1, rows * k // 1000)
        start = (rows - width) // 2
        places.append((i, label, start, start + width - 1))
    spark = df.sparkSession
    want = spark.createDataFrame(places, "i int, label string, a long, b long")
    got = picks(df, sorted({x for p in places for x in p[2:]}))
    out = want.join(got.select(F.col("rank").alias("a"), F.col("value").alias("low")), "a").join(got.select(F.col("rank").alias("b"), F.col("value").alias("high")), "b")
    labels = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "label"))), lambda s: s["label"]), "+")
    return out.groupBy("low", "high").agg(labels.alias("labels"))


def quartiles(df: DataFrame, rows: int) -> DataFrame:
    """Values at sorted index n div 4 and 3 n div 4."""
    a, b = rows // 4, 3 * rows // 4
    return picks(df, [a, b]).agg(F.max(F.when(F.col("rank") == a, F.col("value"))).alias("q1"), F.max(F.when(F.col("rank") == b, F.col("value"))).alias("q3"))


def window_bounds(df: DataFrame, rows: int, thousandths: int = 100) -> tuple[int, int]:
    """Low and high of one centred window; two values reach the driver."""
    width = max(1, rows * thousandths // 1000)
    start = (rows - width) // 2
    got = {r.rank: r.value for r in picks(df, [start, start + width - 1]).collect()}
    return got[start], got[start + width - 1]


#: Shares of a column that the widths of row queries take, beside one row.
WIDTHS = (1000, 100, 10, 2, 1)


def widths(rows: int) -> list[int]:
    """Widths of row queries, each once: one row, a thousandth (one row at least) and so on up to all rows."""
    return sorted({1, *(max(1, rows // d) if d >= 100 else rows // d for d in WIDTHS)})


#: Widths and percentages of the crossover study.
CROSSOVER_WIDTHS, CROSSOVER_SHARES = (1, 4, 16, 64, 256), (1, 5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100)


def crossover_widths(rows: int) -> list[int]:
    return sorted({*CROSSOVER_WIDTHS, *(max(1, rows * p // 100) for p in CROSSOVER_SHARES)})
