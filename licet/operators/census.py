"""Facts over many columns: a long table (col, row_id, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rows import block

SMALL = 256


def column_stats(long: DataFrame) -> DataFrame:
    """Per column rows, nulls, distinct values and whether these are few (<= 256, or 8 times under the non-null rows)."""
    out = long.groupBy("col").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value").isNull()).alias("nulls"), F.countDistinct("value").alias("uniq"))
    return out.withColumn("small_domain", (F.col("uniq") <= SMALL) | (8 * F.col("uniq") <= F.col("rows") - F.col("nulls")))


def page_stats(long: DataFrame, page: int = 1024) -> DataFrame:
    """Per column and page: rows, nulls, whether values never fall."""
    rows = long.withColumn("page", block(page))
    w = Window.partitionBy("col", "page").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    fell = F.coalesce(F.col("value") < F.last("value", True).over(w), F.lit(False))
    return rows.withColumn("_f", fell).groupBy("col", "page").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value").isNull()).alias("nulls"), (~F.bool_or("_f")).alias("monotone"))


def monotone_pages(long: DataFrame, page: int = 1024) -> DataFrame:
    return page_stats(long, page).groupBy("col").agg(F.count(F.lit(1)).alias("pages"), F.count_if("monotone").alias("monotone_pages"))


def rank_displacement(df: DataFrame) -> DataFrame:
    """Largest distance of a non-null row from its place in the stable order by value."""
    from .rows import before, ranked

    dense = before(df, F.col("value").isNotNull().cast("long"), "_pos").where("value IS NOT NULL").select("row_id", "value", "_pos")
    return ranked(dense, "value", "_rank", "row_id").agg(F.max(F.abs(F.col("_rank") - F.col("_pos"))).alias("max_displacement"))


def segment_coverage(df: DataFrame, least: int = 128) -> DataFrame:
    """Non-null rows in maximal non-decreasing runs of at least ``least`` rows."""
    from .rows import before

    dense = before(df, F.col("value").isNotNull().cast("long"), "_pos").where("value IS NOT NULL").select(F.col("_pos").alias("row_id"), "value")
    prior = dense.select((F.col("row_id") + 1).alias("row_id"), F.col("value").alias("_prior"))
    falls = dense.join(prior, "row_id", "left").withColumn("_fall", F.coalesce(F.col("value") < F.col("_prior"), F.lit(False)).cast("long"))
    run = before(falls, F.col("_fall"), "_run", inclusive=True)
    return run.groupBy("_run").count().agg(F.coalesce(F.sum(F.when(F.col("count") >= least, F.col("count"))), F.lit(0)).alias("covered"), F.count(F.lit(1)).alias("runs"))


def rollup(stats: DataFrame) -> DataFrame:
    return stats.groupBy("source").agg(F.count(F.lit(1)).alias("columns"), F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.count_if("small_domain").alias("small_domains"))


def smallest_layout(candidates: DataFrame) -> DataFrame:
    """Per column the candidate (col, recipe, bytes) of fewest bytes, then first name."""
    return candidates.groupBy("col").agg(F.min(F.struct("bytes", "recipe")).alias("_m")).select("col", F.col("_m.recipe").alias("recipe"), F.col("_m.bytes").alias("bytes"))


def natural_runs(df: DataFrame) -> DataFrame:
    """Runs of equal neighbours and how many rows one stands for."""
    from .rows import segments

    runs = segments(df, "value").agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("rows"))
    return runs.select("runs", (F.col("rows") / F.nullif(F.col("runs"), F.lit(0))).alias("reduction"))


def size_by_group(sizes: DataFrame) -> DataFrame:
    """Per group of (group, rows, minimal, ready): median bits a value of both layouts, and the median premium."""
    bits = [F.percentile(F.col(c) * 8 / F.col("rows"), 0.5).alias(f"{c}_bits") for c in ("minimal", "ready")]
    return sizes.groupBy("group").agg(F.count(F.lit(1)).alias("columns"), *bits, F.percentile(F.col("ready") / F.col("minimal"), 0.5).alias("premium"))


def pairs(long: DataFrame) -> DataFrame:
    """(source, selector, value) of the columns of each source: the selector is "timestamp" or else the
    first in the order ``place``; values are the others with as many rows."""
    each = long.groupBy("source", "place", "col").agg(F.count(F.lit(1)).alias("n"))
    pick = each.groupBy("source").agg(F.min(F.struct(F.col("col") != "timestamp", F.col("place"), F.col("col").alias("selector"), F.col("n").alias("_n"))).alias("_s"))
    both = each.join(pick, "source").where((F.col("col") != F.col("_s.selector")) & (F.col("n") == F.col("_s._n")))
    return both.select("source", F.col("_s.selector").alias("selector"), F.col("col").alias("value"))


def revalidated(df: DataFrame, facts: list) -> DataFrame:
    """(fact, holds): every order fact about ``df`` held against its values."""
    from ..plans.facts import monotone, piecewise

    out = None
    for f in facts:
        if f.prop == "NonDecreasing":
            rows = df if f.scope == "AllRows" else df.where("value IS NOT NULL")
            one = monotone(rows).select(F.lit(f"{f.scope} {f.prop}").alias("fact"), F.col("non_decreasing").alias("holds"))
        elif f.prop == "PiecewiseNonDecreasing":
            one = piecewise(df, f.param).agg(F.bool_and("non_decreasing").alias("holds")).select(F.lit(f"{f.scope} {f.prop} {f.param}").alias("fact"), "holds")
        else:
            continue
        out = one if out is None else out.unionByName(one)
    return out if out is not None else df.sparkSession.createDataFrame([], "fact string, holds boolean")


#: Distances that the summary counts, page sizes, and the restart and index intervals of the menu.
DISPLACED, PAGES = (0, 1, 4, 16, 64, 256), (1024, 16_384)
READY_RESTART = 256


def menu(nullable: bool, rows: int) -> list[tuple[str, object, bool]]:
    """The 14 candidates of a column: label, recipe and whether it is ready for access (no frame, restarts of at most 256 rows)."""
    from ..plans.recipe import Recipe, bitpack

    b, whole = bitpack(), -(-rows // 128) * 128
    direct = [
        ("FOR(BitPack)", Recipe("FOR", b)), ("Delta@256(BitPack)", Recipe("Delta", b, 256)), ("UnsignedDelta@256(BitPack)", Recipe("UnsignedDelta", b, 256)),
        ("UnsignedDelta@whole(BitPack)", Recipe("UnsignedDelta", b, whole)), ("Dictionary(BitPack)", Recipe("Dictionary", b)),
        ("Dictionary(RLE(BitPack))", Recipe("Dictionary", Recipe("RLE", b, 32))), ("RLE(FOR(BitPack))", Recipe("RLE", Recipe("FOR", b), 32)),
    ]
    out = []
    for label, recipe in direct:
        r = Recipe("Nullable", recipe, 256) if nullable else recipe
        restart = max((n.interval for n in r.nodes() if n.kind in ("Delta", "UnsignedDelta")), default=0)
        out += [(label, r, restart <= READY_RESTART), (f"Frame({label})", Recipe("Frame", r), False)]
    return out


def dense_stats(long: DataFrame) -> DataFrame:
    """Per column what the sizes of all candidates follow from: of its values in order, without nulls, their
    number, bounds, distinct ones, runs, and the steps inside blocks of 256 and over all."""
    rows = long.withColumn("_b", block(1 << 16))
    each = rows.groupBy("col", "_b").agg(F.count("value").alias("_n"), F.max(F.when(F.col("value").isNotNull(), F.struct("row_id", "value"))).alias("_l"))
    w = Window.partitionBy("col").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("col", "_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"), F.max("_l").over(w)["value"].alias("_last"))
    o = Window.partitionBy("col", "_b").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    here = rows.withColumn("_in", F.count("value").over(o)).withColumn("_p", F.last("value", True).over(o)).join(each, ["col", "_b"])
    step = F.col("value") - F.coalesce("_p", "_last")
    dense = here.where("value IS NOT NULL").select("col", "value", (F.col("_before") + F.col("_in")).alias("_at"), step.alias("_step"))
    inside = F.when(F.col("_at") % 256 > 0, F.col("_step"))
    s = lambda c: (F.coalesce(F.min(c), F.lit(0)), F.coalesce(F.max(c), F.lit(0)))
    (lo256, hi256), (lo, hi) = s(inside), s(F.col("_step"))
    stats = dense.groupBy("col").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.countDistinct("value").alias("u"),
        (F.count_if(F.col("_step") != 0) + 1).alias("runs"), lo256.alias("smin"), hi256.alias("smax"), lo.alias("tmin"), hi.alias("tmax"),
    )
    return stats.join(long.groupBy("col").agg(F.count(F.lit(1)).alias("rows")), "col")


def candidates(long: DataFrame) -> DataFrame:
    """(col, recipe, framed, access_ready, admitted, bytes) of the menu of every column with a value.

    ``bytes``: modelled, of the fields; null where the values do not meet the encoding, and of frames, whose size
    only a compressor knows.
    """
    from ..functions.scalar import bit_width

    c = dense_stats(long)
    pack = lambda n, most: F.ceil(n / 128) * F.greatest(F.lit(8), 16 * bit_width(most))
    n, u, runs, range_ = F.col("n"), F.col("u"), F.col("runs"), F.col("hi") - F.col("lo")
    zigzag = F.greatest(2 * F.col("smax"), -2 * F.col("smin") - 1, F.lit(0))
    run_bytes = 4 * runs + 8 * (F.ceil(runs / 32) + 1)
    sizes = {
        "FOR(BitPack)": 8 + pack(n, range_), "Delta@256(BitPack)": 8 * F.ceil(n / 256) + pack(n, zigzag),
        "UnsignedDelta@256(BitPack)": F.when(F.col("smin") >= 0, 8 * F.ceil(n / 256) + pack(n, F.col("smax"))),
        "UnsignedDelta@whole(BitPack)": F.when(F.col("tmin") >= 0, 8 + pack(n, F.col("tmax"))),
        "Dictionary(BitPack)": 8 * u + pack(n, u - 1), "Dictionary(RLE(BitPack))": 8 * u + run_bytes + pack(runs, u - 1),
        "RLE(FOR(BitPack))": run_bytes + 8 + pack(runs, range_),
    }
    nulls = F.when(n < F.col("rows"), F.ceil(F.col("rows") / 8) + 4 * (F.ceil(F.col("rows") / 256) + 1)).otherwise(0)
    ready = {k: F.lit(True) if "whole" not in k else F.ceil(F.col("rows") / 128) * 128 <= READY_RESTART for k in sizes}
    rows = [F.struct(F.lit(k).alias("recipe"), F.lit(False).alias("framed"), ready[k].alias("access_ready"), size.isNotNull().alias("admitted"), (size + nulls).cast("long").alias("bytes")) for k, size in sizes.items()]
    rows += [F.struct(F.lit(f"Frame({k})").alias("recipe"), F.lit(True).alias("framed"), F.lit(False).alias("access_ready"), size.isNotNull().alias("admitted"), F.lit(None).cast("long").alias("bytes")) for k, size in sizes.items()]
    return c.select("col", F.inline(F.array(*rows)))


def layouts(long: DataFrame) -> DataFrame:
    """Per column the smallest unframed candidate of all, and of those ready for access: by bytes, then name."""
    c = candidates(long).where("bytes IS NOT NULL")
    pick = lambda cond: F.min(F.when(cond, F.struct("bytes", "recipe")))
    out = c.groupBy("col").agg(pick(F.lit(True)).alias("_s"), pick(F.col("access_ready")).alias("_r"))
    return out.select("col", F.col("_s.recipe").alias("smallest"), F.col("_s.bytes").alias("smallest_bytes"), F.col("_r.recipe").alias("ready"), F.col("_r.bytes").alias("ready_bytes"))


def summary(long: DataFrame) -> DataFrame:
    """(metric, value) of a corpus of columns: shares of ordered columns, rows and pages, and of small domains."""
    from functools import reduce

    whole = dense_stats(long).select("col", (F.col("tmin") >= 0).alias("monotone"), "n", "u", "rows")
    small = (F.col("u") <= SMALL) | (8 * F.col("u") <= F.col("n"))
    m = F.col("monotone")
    share = lambda cond: F.avg(cond.cast("double"))
    out = [whole.agg(
        F.count(F.lit(1)).cast("double").alias("columns"), F.sum("rows").cast("double").alias("rows"), F.count_if(m).cast("double").alias("global_monotone_columns"),
        share(m).alias("global_monotone_column_fraction"), (F.sum(F.when(m, F.col("n")).otherwise(0)) / F.sum("n")).alias("global_monotone_row_fraction"),
        F.count_if(small).cast("double").alias("small_domain_columns"), share(small).alias("small_domain_column_fraction"),
    )]
    out += [page_stats(long, p).agg(share(F.col("monotone")).alias(f"page_{p}_monotone_fraction")) for p in PAGES]
    melted = [t.select(F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in t.columns)))) for t in out]
    return reduce(DataFrame.unionByName, melted)


def page_displacement(long: DataFrame, page: int = 1024) -> DataFrame:
    """Per column and page the largest distance of a value from its place in the stable order of its page's values."""
    dense = long.where("value IS NOT NULL").withColumn("page", block(page))
    w = Window.partitionBy("col", "page")
    place = dense.select("col", "page", (F.row_number().over(w.orderBy("row_id")) - F.row_number().over(w.orderBy("value", "row_id"))).alias("_d"))
    return place.groupBy("col", "page").agg(F.max(F.abs("_d")).cast("long").alias("max_displacement"))
