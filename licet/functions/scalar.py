"""Scalar and ingest functions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALES = range(5)


def zigzag(v: Column) -> Column:
    """(v << 1) ^ (v >> 63): small magnitudes to small codes."""
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(c: Column) -> Column:
    return F.shiftrightunsigned(c, 1).bitwiseXOR(-(c.bitwiseAND(F.lit(1).cast("long"))))


def bit_width(most: Column) -> Column:
    """Bits of the largest code; 0 for 0."""
    return F.when(most == 0, 0).otherwise(F.length(F.bin(most))).cast("long")


def parse_ts(t: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss[.f]`` as epoch seconds."""
    return F.unix_timestamp(F.substring(t, 1, 19), "yyyy-MM-dd HH:mm:ss")


def text_decimals(t: Column) -> Column:
    """Fraction digits without trailing zeros; null for anything but a plain decimal."""
    plain = t.rlike(r"^[+-]?\d+(\.\d*)?$")
    return F.when(plain, F.length(F.rtrim(F.regexp_extract(t, r"\.(\d*)$", 1), F.lit("0")))).cast("int")


def scaled_text(t: Column, scale: int) -> Column:
    """Exact fixed point from decimal text."""
    return (t.cast(f"decimal(38,{scale})") * F.lit(10**scale).cast("decimal(20,0)")).cast("long")


def verified_scale(df: DataFrame, column: str) -> int | None:
    """The least scale up to 4 at which every value is exact; None: abstain."""
    v = F.col(column)
    tests = []
    for s in SCALES:
        p = float(10**s)
        ok = v.isNull() | (~F.isnan(v) & (F.abs(v) != float("inf")) & (F.abs(v * p) < 9.2e18) & (F.round(v * p) / p == v))
        tests.append(F.bool_and(ok).alias(f"s{s}"))
    row = df.agg(*tests).first()
    return next((s for s in SCALES if row[f"s{s}"]), None)


def scaled(v: Column, scale: int) -> Column:
    return F.round(v * float(10**scale)).cast("long")


def total(v: Column) -> Column:
    """Checked sum; 0 over no rows or nulls only."""
    return F.coalesce(F.sum(v.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


def selectivity_bucket(s: Column) -> Column:
    return F.when(s <= 0.002, "0.1%").when(s <= 0.02, "1%").when(s <= 0.2, "10%").otherwise("50%")


def splitmix64(x):
    """Wrapping 64-bit mixer over a numpy uint64 array (ANSI integers would overflow)."""
    import numpy as np

    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def selector_kind(name: Column) -> Column:
    return F.when(F.contains(name, F.lit("timestamp")), "timestamp").otherwise("identifier")
