"""Ordered columns as DataFrames (row_id, value), without global windows.

Whatever depends on the order of rows works in two or three levels: inside
blocks of row ids, then across the few rows that stand for a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def block(width: int = BLOCK, column: str = "row_id") -> Column:
    return F.floor(F.col(column) / width)


def file_rows(df: DataFrame) -> DataFrame:
    """Rows of one or more Parquet files with ``row_id``: files in the order of their paths.

    One row per file reaches the driver (its offset).
    """
    df = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    counts = df.groupBy("_path").agg((F.max("_row") + 1).alias("n")).orderBy("_path").collect()
    spark, at, rows = df.sparkSession, 0, []
    for r in counts:
        rows.append((r._path, at))
        at += r.n
    if len(rows) <= 1:
        return df.withColumn("row_id", F.col("_row")).drop("_path", "_row")
    return df.join(spark.createDataFrame(rows, "_path string, _at long"), "_path").withColumn("row_id", F.col("_at") + F.col("_row")).drop("_path", "_row", "_at")


def _merge(segments: DataFrame, width: int | None, value: str | None) -> DataFrame:
    """Joins neighbouring segments inside each ``width`` (None: of the whole)."""
    parts = [block(width, "start")] if width else []
    w = Window.partitionBy(*parts).orderBy("start")
    same = F.lag("end").over(w) == F.col("start")
    if value:
        same = same & F.lag(value).over(w).eqNullSafe(F.col(value))
    new = segments.select("*", *(p.alias("_p") for p in parts), (~F.coalesce(same, F.lit(False))).cast("long").alias("_new"))
    by = ["_p"] if parts else []
    run = new.withColumn("_g", F.sum("_new").over(Window.partitionBy(*by).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)))
    keep = [F.first(value).alias(value)] if value else []
    return run.groupBy(*by, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), *keep).select("start", "end", *([value] if value else []))


def segments(df: DataFrame, value: str | None = None, width: int = BLOCK) -> DataFrame:
    """Maximal runs of neighbouring rows (of equal ``value``) as [start, end)."""
    rows = df.select(F.col("row_id").alias("start"), (F.col("row_id") + 1).alias("end"), *([value] if value else []))
    out = _merge(rows, width, value)
    for wide in (width * width, None):
        narrow = width if wide else width * width
        edge = (F.col("start") % narrow == 0) | (F.col("end") % narrow == 0)
        out = out.where(~edge).unionByName(_merge(out.where(edge), wide, value))
    return out


def ranges(hits: DataFrame, width: int = BLOCK) -> DataFrame:
    """Coalesced half-open ranges of the row ids in ``hits``."""
    return segments(hits, None, width)


def folded(blocks: DataFrame, value: str, fold, name: str, later: bool = False) -> DataFrame:
    """``blocks`` with ``name``: ``fold`` (sum, min or max) of ``value`` over all earlier (or later) blocks ``_b``.

    Two levels, so that the only window over everything has a row for ``BLOCK`` blocks.
    """
    edge = Window.rowsBetween(Window.unboundedPreceding, -1)
    order = F.desc if later else F.asc  # backwards: a frame that ends at the last row is folded anew for every row
    blocks = blocks.withColumn("_u", block(BLOCK, "_b"))
    far = blocks.groupBy("_u").agg(fold(value).alias("_v")).withColumn("_far", fold("_v").over(edge.orderBy(order("_u")))).drop("_v")
    near = fold(value).over(edge.partitionBy("_u").orderBy(order("_b")))
    both = blocks.withColumn("_near", near).join(far, "_u")
    if fold is F.sum:
        out = F.coalesce("_near", F.lit(0)) + F.coalesce("_far", F.lit(0))
    else:  # the nearer one, if there is one
        out = F.coalesce("_near", "_far")
    return both.withColumn(name, out).drop("_u", "_near", "_far")


def before(df: DataFrame, add: Column, name: str, width: int = BLOCK, inclusive: bool = False) -> DataFrame:
    """``df`` with ``name``: the sum of ``add`` over all earlier rows (and this one, if inclusive)."""
    df = df.withColumn("_b", block(width)).withColumn("_x", add)
    carry = folded(df.groupBy("_b").agg(F.sum("_x").alias("_s")), "_s", F.sum, "_c").drop("_s")
    w = Window.partitionBy("_b").orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return df.withColumn("_in", F.coalesce(F.sum("_x").over(w), F.lit(0))).join(carry, "_b").withColumn(name, F.col("_c") + F.col("_in")).drop("_b", "_x", "_in", "_c")


#: Rows of a part of an order, and parts at most.
PART, PARTS = 1 << 20, 512


def parted(df: DataFrame, column: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``_p``: the part of the order by ``column``, cut at approximate
    quantiles (at most ``PARTS`` values reach the driver), by binary search.
    There are as many parts as ``PART`` rows each need, or ``parts``."""
    r = df.select(F.percentile_approx(column, [i / PARTS for i in range(1, PARTS)], 10 * PARTS).alias("q"), F.count(F.lit(1)).alias("n")).first()
    parts = min(PARTS, parts or -(-r.n // PART) or 1)
    cuts = sorted({(r.q or [])[PARTS * i // parts - 1] for i in range(1, parts)}) if r.q else []

    def place(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(column) <= F.lit(cuts[mid]), place(lo, mid)).otherwise(place(mid + 1, hi))

    return df.withColumn("_p", place(0, len(cuts)))


def ranked(df: DataFrame, column: str, name: str, *ties: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``name``, the 0-based rank by ``column`` and ``ties``: counts
    of earlier parts of the order plus ranks inside a part."""
    df = parted(df, column, parts)
    first = df.groupBy("_p").count()
    first = first.select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_c"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(column, *ties)) - 1
    return df.withColumn("_r", inside).join(F.broadcast(first), "_p").withColumn(name, F.col("_c") + F.col("_r")).drop("_p", "_c", "_r")  # PARTS rows


def at_ranks(df: DataFrame, column: str, ranks: list[int], *ties: str, parts: int | None = None) -> DataFrame:
    """(rank, ``column``) at a few ranks: only the parts that hold them are sorted."""
    df = parted(df, column, parts)
    begins, at = {}, 0
    for r in sorted(df.groupBy("_p").count().collect()):
        begins[r._p] = (at, at + r["count"])
        at += r["count"]
    held = {p: [k - a for k in ranks if a <= k < b] for p, (a, b) in begins.items()}
    held = {p: k for p, k in held.items() if k}
    begin = F.lit(0).cast("long")
    for p in held:
        begin = F.when(F.col("_p") == p, F.lit(begins[p][0])).otherwise(begin)
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(column, *ties)) - 1
    rank = (begin + inside).cast("long")
    return df.where(F.col("_p").isin(list(held))).withColumn("rank", rank).where(F.col("rank").isin(ranks)).select("rank", column)


def span_union(spans: DataFrame, gap: int = 0, *by: str) -> DataFrame:
    """Merges [start, end) spans that overlap or lie at most ``gap`` apart, per ``by``.

    In parts of the order by start: the reach of earlier parts and the islands
    that they begin are carried over, a row for each part (and ``by``).
    """
    one = spans.groupBy(*by, "start").agg(F.max("end").alias("end"))
    one = parted(one, "start")
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    w = Window.partitionBy(*by, "_p").orderBy("start")
    keys = [*by, "_p"]

    def carried(df: DataFrame, value: Column, fold) -> DataFrame:
        each = df.groupBy(*keys).agg(value.alias("_v")).withColumn("_carry", fold("_v").over(earlier)).drop("_v")
        same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
        cond = same[0]
        for c in same[1:]:
            cond = cond & c
        return df.alias("l").join(each.alias("r"), cond).select("l.*", "r._carry")

    here = carried(one, F.max("end"), F.max)
    reach = F.greatest(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carry"))
    new = here.withColumn("_new", F.when(F.col("start") <= reach + gap, 0).otherwise(1)).drop("_carry")
    run = carried(new, F.sum("_new"), F.sum)
    inside = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    run = run.withColumn("_g", F.coalesce("_carry", F.lit(0)) + inside)
    return run.groupBy(*by, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")
