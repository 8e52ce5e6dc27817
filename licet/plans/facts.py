"""The invariant calculus: typed facts, their evidence and assumptions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rows import BLOCK, block, folded
from . import store
from .recipe import Recipe, decoder


#: Row ids of which the least and greatest value are compared with the next ones' before any order is made.
SPAN = 1024


@dataclass(frozen=True)
class Fact:
    scope: str  # AllRows, NonNullRows, Mapping, Physical
    prop: str  # NonDecreasing, PiecewiseNonDecreasing, NullPlacement, UnsignedRange, OrderPreserving, ...
    param: int | str | None = None
    evidence: str = field(default="Structural", compare=False)  # or Checked, Descriptor
    assumes: frozenset[str] = field(default=frozenset(), compare=False)


@dataclass(frozen=True)
class Checked:
    """What one aggregate over the rows has shown; ``source`` keeps it from licensing other data."""

    rows: int
    nulls: str
    non_decreasing: bool
    source: str = ""


def null_placement(n: int, nn: int, lo: int | None, hi: int | None) -> str:
    if nn == n:
        return "NoNulls"
    if nn and hi == n - 1 and hi - lo + 1 == nn:
        return "First"
    if nn and lo == 0 and hi - lo + 1 == nn:
        return "Last"
    return "Arbitrary"


def monotone(df: DataFrame, width: int = BLOCK) -> DataFrame:
    """One row: rows, non-null rows, their first and last row id, whether values never fall.

    Two levels: steps inside blocks, then the last value before each block.
    """
    rows = df.withColumn("_b", block(width))
    w = Window.partitionBy("_b").orderBy("row_id")
    fell = F.col("value") < F.last("value", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    value = F.when(F.col("value").isNotNull(), F.struct("row_id", "value"))
    each = rows.withColumn("_fell", F.coalesce(fell, F.lit(False))).groupBy("_b").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("nn"), F.bool_or("_fell").alias("fell"), F.min(value).alias("f"), F.max(value).alias("l")
    )
    each = folded(each, "l", F.max, "_prior")  # row ids grow, so the greatest is the last
    each = each.withColumn("_jump", F.coalesce(F.col("f.value") < F.col("_prior")["value"], F.lit(False)))
    return each.agg(F.sum("n").alias("n"), F.sum("nn").alias("nn"), F.min("f.row_id").alias("lo"), F.max("l.row_id").alias("hi"), (~F.bool_or(F.col("fell") | F.col("_jump"))).alias("non_decreasing"))


def descending(df: DataFrame, width: int = SPAN) -> DataFrame:
    """One row as :func:`monotone`'s without the order inside spans of ``width`` row ids: values fall if a span's
    greatest one is above the least of the next span that has any.  No row is sorted or sent on."""
    value, at = F.col("value"), F.when(F.col("value").isNotNull(), F.col("row_id"))
    each = df.withColumn("_b", block(width)).groupBy("_b").agg(
        F.count(F.lit(1)).alias("n"), F.count(value).alias("nn"), F.min(at).alias("lo"), F.max(at).alias("hi"), F.min(value).alias("least"), F.max(value).alias("most")
    )
    each = folded(each.withColumn("l", F.when(F.col("nn") > 0, F.struct("_b", "most"))), "l", F.max, "_prior")
    fell = F.coalesce(F.col("least") < F.col("_prior")["most"], F.lit(False))
    return each.agg(F.sum("n").alias("n"), F.sum("nn").alias("nn"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_or(fell).alias("fell"))


def check_column(df: DataFrame) -> Checked:
    """Rows are put in order only where spans of them do not fall already."""
    r = descending(df).first()
    if r.fell or not r.nn:
        return Checked(r.n or 0, null_placement(r.n or 0, r.nn or 0, r.lo, r.hi), False, store.identity(df))
    r = monotone(df).first()
    return Checked(r.n or 0, null_placement(r.n or 0, r.nn or 0, r.lo, r.hi), bool(r.non_decreasing) and bool(r.nn), store.identity(df))


def piecewise(df: DataFrame, width: int) -> DataFrame:
    """(blk, non_decreasing) for each block."""
    w = Window.partitionBy("blk").orderBy("row_id")
    rows = df.withColumn("blk", block(width))
    fell = F.col("value") < F.last("value", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_f", F.coalesce(fell, F.lit(False))).groupBy("blk").agg((~F.bool_or("_f")).alias("non_decreasing"))


_ARITHMETIC = frozenset({"CheckedArithmetic"})


def _node(r: Recipe, length: int, numbers: dict[str, int], at: int = 0) -> list[Fact]:
    """Facts of a node's own output, from its structure, its child's facts and the encoded fields' numbers."""
    length = numbers.get(f"{at} rows", length)
    below = _node(r.child, length, numbers, at + 1) if r.child and r.kind != "Frame" else []
    order = [f for f in below if f.prop == "NonDecreasing" and f.scope == "AllRows"]
    if r.kind == "BitPack":
        return [Fact("AllRows", "UnsignedRange", numbers.get(f"{at} width")), Fact("Physical", "Miniblock", 128)]
    if r.kind == "FOR":
        maps = [Fact("Mapping", p, assumes=_ARITHMETIC) for p in ("OrderPreserving", "Injective", "AffineShift")]
        return maps + [Fact("AllRows", "NonDecreasing", assumes=f.assumes | _ARITHMETIC) for f in order]
    if r.kind in ("Delta", "UnsignedDelta"):
        out = [Fact("Physical", "RestartBound", r.interval)]
        if r.kind == "UnsignedDelta" and any(f.prop == "UnsignedRange" for f in below):
            whole = r.interval >= length
            out.append(Fact("AllRows", "NonDecreasing" if whole else "PiecewiseNonDecreasing", None if whole else r.interval, assumes=_ARITHMETIC))
        return out
    if r.kind == "Dictionary":
        sort = frozenset({"SortedUniqueDictionary"})
        return [Fact("Mapping", p, assumes=sort) for p in ("OrderPreserving", "Injective")] + [Fact("AllRows", "NonDecreasing", assumes=f.assumes | sort) for f in order]
    if r.kind == "RLE":
        lengths = frozenset({"PositiveRunLengths"})
        return [Fact("Physical", "RunIndex", r.interval, assumes=lengths)] + [Fact("AllRows", "NonDecreasing", assumes=f.assumes | lengths) for f in order]
    if r.kind == "Patch":
        return [Fact("Physical", "PatchIndex", r.interval)]
    if r.kind == "Nullable":
        return [Fact("Physical", "ValidityRank", r.interval)] + [Fact("NonNullRows", "NonDecreasing", assumes=f.assumes) for f in order]
    return below


def derive(r: Recipe, length: int, checked: Checked | None = None, numbers: dict[str, int] | None = None) -> list[Fact]:
    """Facts of the root: structural ones, then what was checked, then the layout's frame.

    They hold for columns that were encoded by the recipe (``numbers`` are of that encoding); the encode driver
    fails on values that do not meet it.
    """
    out = _node(decoder(r), length, numbers or {})
    if checked is not None:
        trusted = frozenset({"TrustedDescriptor"})
        out.append(Fact("AllRows", "NullPlacement", checked.nulls, "Checked", trusted))
        if checked.non_decreasing:
            out.append(Fact("AllRows" if checked.nulls == "NoNulls" else "NonNullRows", "NonDecreasing", None, "Checked", trusted))
    if r.kind == "Frame":
        out.append(Fact("Physical", "EnclosingFrame", 0, "Descriptor"))
    return list(dict.fromkeys(out))
