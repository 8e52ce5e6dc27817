"""Column encodings as transforms between DataFrames of physical fields."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import unzigzag, zigzag
from .rows import BLOCK, before, block, ranked, segments

MINIBLOCK = 128
#: Row ids at most whose regular rows are the bits of a number above 0; patched rows at most that the driver sends to every task.
BITS, FEW = 62, 1 << 18


class EncodeError(ValueError):
    """The values do not meet an encoding's conditions."""


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise EncodeError(what)


def bitpack(df: DataFrame) -> tuple[DataFrame, int]:
    """Codes (row_id, code) and their width; negative or null values are an error."""
    r = df.agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_if(F.col("value").isNull()).alias("nulls"), F.count(F.lit(1)).alias("n")).first()
    _need(r.n > 0, "a column without rows")
    _need(not r.nulls, "nulls need the nullable encoding")
    _need(r.lo >= 0, "negative values cannot be bit-packed")
    return df.select("row_id", F.col("value").alias("code")), int(r.hi).bit_length()


def frame_of_reference(df: DataFrame) -> tuple[DataFrame, int]:
    """(row_id, value - base) and the base, the least value; the difference may need 64 bits and is a decimal."""
    base = df.agg(F.min("value")).first()[0]
    _need(base is not None, "a column without values")
    return df.select("row_id", (F.col("value").cast("decimal(20,0)") - F.lit(base).cast("decimal(20,0)")).alias("value")), base


def undo_frame_of_reference(child: DataFrame, base: int) -> DataFrame:
    return child.select("row_id", (F.col("value").cast("decimal(21,0)") + F.lit(base).cast("decimal(20,0)")).cast("long").alias("value"))


def delta(df: DataFrame, restart: int, unsigned: bool = False) -> tuple[DataFrame, DataFrame]:
    """Codes (row_id, code) and anchors (block, anchor); steps never cross a restart."""
    _need(restart > 0 and restart % MINIBLOCK == 0, "a restart is a positive multiple of 128")
    w = Window.partitionBy("_b").orderBy("row_id")
    rows = df.withColumn("_b", block(restart))
    step = F.coalesce(F.col("value") - F.lag("value").over(w), F.lit(0).cast("long"))
    rows = rows.select("row_id", "_b", "value", step.alias("_step"))
    if unsigned:
        _need(not rows.agg(F.bool_or(F.col("_step") < 0)).first()[0], "a negative step inside a block")
    codes = rows.select("row_id", (F.col("_step") if unsigned else zigzag(F.col("_step"))).alias("code"))
    anchors = df.where(F.col("row_id") % restart == 0).select(block(restart).alias("block"), F.col("value").alias("anchor"))
    return codes, anchors


def undo_delta(codes: DataFrame, anchors: DataFrame, restart: int, unsigned: bool = False) -> DataFrame:
    w = Window.partitionBy("block").orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0)
    step = F.col("code") if unsigned else unzigzag(F.col("code"))
    rows = codes.withColumn("block", block(restart)).withColumn("_sum", F.sum(step).over(w))
    return rows.join(anchors, "block").select("row_id", (F.col("anchor") + F.col("_sum")).alias("value"))


def dictionary(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row_id, id) and the sorted table (id, value)."""
    table = ranked(df.select("value").distinct(), "value", "id")
    return df.join(table, "value").select("row_id", "id"), table.select("id", "value")


def undo_dictionary(ids: DataFrame, table: DataFrame) -> DataFrame:
    """An id that the table lacks is an error."""
    out = ids.join(table.withColumn("_known", F.lit(True)), "id", "left")
    return out.select("row_id", F.when(F.col("_known"), F.col("value")).otherwise(F.raise_error(F.lit("an id outside the dictionary")).cast("long")).alias("value"))


def run_length(df: DataFrame, every: int = 32, width: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Runs (run_id, value, start, end, length) and the sparse index (run_id, start) of every k-th run, with a sentinel."""
    _need(every > 0, "an index interval is positive")
    runs = ranked(segments(df, "value", width), "start", "run_id").select("run_id", "value", "start", "end", (F.col("end") - F.col("start")).alias("length"))
    index = runs.where(F.col("run_id") % every == 0).select("run_id", "start")
    last = runs.agg((F.max("run_id") + 1).alias("run_id"), F.max("end").alias("start"))
    return runs, index.unionByName(last)


def undo_run_length(runs: DataFrame) -> DataFrame:
    return runs.select(F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("row_id"), "value")


def _highest(bits: str, width: int) -> Column:
    """The greatest row id of the bits of a group ``_b``, null if there is none."""
    return F.when(F.col(bits) > 0, F.col("_b") * width + F.length(F.bin(bits)) - 1)


def _lowest(bits: str, width: int) -> Column:
    return F.when(F.col(bits) > 0, F.col("_b") * width + F.length(F.bin(F.col(bits).bitwiseAND(-F.col(bits)))) - 1)


def _around(edge: DataFrame) -> DataFrame:
    """(_b, _bits, _before, _after): the greatest ``_l`` of all earlier groups and the least ``_f`` of all later ones.

    As :func:`folded`, both ways at once; a row for ``BLOCK`` groups is sent to every task."""
    edge = edge.withColumn("_u", block(BLOCK, "_b"))

    def both(df: DataFrame, order: str, lo: str, hi: str, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(lo, F.max("_l").over(w.orderBy(order))).withColumn(hi, F.min("_f").over(w.orderBy(F.desc(order))))

    far = both(edge.groupBy("_u").agg(F.max("_l").alias("_l"), F.min("_f").alias("_f")), "_u", "_x", "_y").select("_u", "_x", "_y")
    near = both(edge, "_b", "_before", "_after", "_u").join(F.broadcast(far), "_u")
    return near.select("_b", "_bits", F.coalesce("_before", "_x").alias("_before"), F.coalesce("_after", "_y").alias("_after"))


def _searched(rows: DataFrame, regular: Column, other: DataFrame, width: int, few: bool) -> DataFrame:
    """(row_id, value) of the rows ``other``, each with the value of the nearest of the regular ``rows``, over any gap."""
    sent = F.broadcast if few else lambda d: d

    def grouped(d: DataFrame) -> DataFrame:
        return d.withColumn("_b", block(width)).withColumn("_at", (F.col("row_id") - F.col("_b") * width).cast("int"))

    bits = grouped(rows).groupBy("_b").agg(F.bit_or(F.when(regular, F.expr("shiftleft(1L, _at)")).otherwise(0)).alias("_bits"))
    edge = bits.select("_b", "_bits", _highest("_bits", width).alias("_l"), _lowest("_bits", width).alias("_f"))
    near = sent(grouped(other)).join(_around(edge), "_b")
    near = near.withColumn("_less", F.expr("_bits & (shiftleft(1L, _at) - 1)")).withColumn("_more", F.expr("_bits & ~(shiftleft(1L, _at) - 1)"))
    near = near.select("row_id", F.coalesce(_highest("_less", width), "_before").alias("_x"), F.coalesce(_lowest("_more", width), "_after").alias("_y"))
    left = F.col("_y").isNull() | (F.col("row_id") - F.col("_x") <= F.col("_y") - F.col("row_id"))
    near = near.select("row_id", F.when(left, F.col("_x")).otherwise(F.col("_y")).alias("_near"))
    return _valued(rows.where(regular), sent(near))


def _valued(plain: DataFrame, near: DataFrame) -> DataFrame:
    return plain.select(F.col("row_id").alias("_near"), "value").join(near, "_near").select("row_id", "value")


def _beside(ids: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The row id of ``lo`` to ``hi`` nearest to each of the rising ``ids`` that is not one of them (the left one of two as near)."""
    last = np.append(np.diff(ids) != 1, True)
    first = np.append(True, last[:-1])
    run = np.cumsum(first) - 1
    left, right = ids[first][run] - 1, ids[last][run] + 1
    return np.where((left >= lo) & ((ids - left <= right - ids) | (right > hi)), left, right)


def _found(df: DataFrame, regular: Column, lo: int, hi: int, width: int) -> DataFrame:
    """:func:`_searched` for up to ``FEW`` patched rows, as rows of the driver: it asks for the row id just beside
    their run, and searches only where the column, from ``lo`` to ``hi``, lacks that one."""
    spark = df.sparkSession
    ids = np.unique(df.where(~regular).select("row_id").toArrow()["row_id"].to_numpy())
    near = spark.createDataFrame(pa.table({"row_id": ids, "_near": _beside(ids, lo, hi)}))
    found = _valued(df.where(regular), F.broadcast(near)).toArrow()
    rest = np.setdiff1d(ids, found["row_id"].to_numpy())
    if len(rest):
        more = _searched(df, regular, spark.createDataFrame(pa.table({"row_id": rest})), width, True).toArrow()
        found = pa.concat_tables([found, more])
    return spark.createDataFrame(found)


def patch(df: DataFrame, width: int = BITS) -> tuple[DataFrame, DataFrame]:
    """From (row_id, value, is_patch): the main column, in which a patched row
    has the nearest regular value (the left one of two as near, 0 if there is
    none), and the exceptions (row_id, value).

    Regular rows pass through as they are.  The values of up to ``FEW`` patched rows are found at once and sent to
    every task, so the main column is one scan; for more of them both sides of a join are sorted.  Where a run of them
    has no row beside it, which of ``width`` row ids are regular is told by the bits of a number; the search sees no more of them.
    """
    _need(0 < width <= BITS, f"a width is 1 to {BITS} row ids")
    regular = F.coalesce(~F.col("is_patch"), F.lit(False))
    other, exceptions = df.where(~regular), df.where("is_patch").select("row_id", "value")
    r = df.agg(F.count_if(~regular).alias("n"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi")).first()
    if r.n > FEW:
        found = _searched(df, regular, other.select("row_id"), width, False)
        main = other.select("row_id").join(found, "row_id", "left").select("row_id", F.coalesce("value", F.lit(0)).alias("value"))
        return df.where(regular).select("row_id", "value").unionByName(main), exceptions
    if not r.n:
        return df.select("row_id", "value"), F.broadcast(exceptions)
    found = F.broadcast(_found(df, regular, r.lo, r.hi, width).select(F.col("row_id").alias("_id"), F.col("value").alias("_v")))
    main = df.join(found, F.when(~regular, F.col("row_id")) == F.col("_id"), "left")
    return main.select("row_id", F.when(regular, F.col("value")).otherwise(F.coalesce("_v", F.lit(0))).alias("value")), F.broadcast(exceptions)


def undo_patch(main: DataFrame, exceptions: DataFrame) -> DataFrame:
    e = exceptions.select("row_id", F.col("value").alias("_e"), F.lit(True).alias("_hit"))
    return main.join(e, "row_id", "left").select("row_id", F.when(F.col("_hit"), F.col("_e")).otherwise(F.col("value")).alias("value"))


def nullable(df: DataFrame, interval: int = 128, keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Validity (row_id, valid, rank: valid rows before), interval ranks, and the compacted child (row_id, value).
    ``keep`` writes the ranked rows, of which all three are made, and reads them."""
    _need(interval > 0 and interval % 8 == 0, "a rank interval is a positive multiple of 8")
    rows = before(df, F.col("value").isNotNull().cast("long"), "rank")
    rows = keep(rows) if keep else rows
    validity = rows.select("row_id", F.col("value").isNotNull().alias("valid"), "rank")
    child = rows.where("value IS NOT NULL").select(F.col("rank").alias("row_id"), "value")
    return validity, validity.where(F.col("row_id") % interval == 0).select((F.col("row_id") / interval).cast("long").alias("interval"), "rank"), child


def undo_nullable(validity: DataFrame, child: DataFrame) -> DataFrame:
    c = child.select(F.col("row_id").alias("rank"), "value")
    return validity.withColumn("rank", F.when(F.col("valid"), F.col("rank"))).join(c, "rank", "left").select("row_id", "value")
