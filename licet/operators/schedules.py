"""Read schedules over byte ranges (page, start, end), as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import span_union

#: Policies and their gaps in bytes.
GAPS = {"sorted_closure": 0, "coalesce_512b": 512, "coalesce_4k": 4096, "coalesce_64k": 65536}
#: Bytes of a file whose islands one task orders.
WINDOW = 1 << 28


def policies(reads: DataFrame) -> DataFrame:
    """(policy, reads, bytes) of each page's own reads, coalesced reads, and one read of it all.

    The reads are merged once at gap 0; islands further than a gap apart stay apart at every smaller
    gap, so each policy counts the islands' distances, in one pass.
    """
    from .rows import folded

    size = F.col("end") - F.col("start")
    measure = (F.count(F.lit(1)).alias("reads"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    per_page = span_union(reads, 0, "page").agg(*measure).select(F.lit("per_page").alias("policy"), "reads", "bytes")
    whole = reads.agg(F.count_if(F.col("end") > F.col("start")).alias("n"), F.max("end").alias("end"))
    out = per_page.unionByName(whole.select(F.lit("full_file").alias("policy"), F.least("n", F.lit(1)).alias("reads"), F.coalesce("end", F.lit(0)).alias("bytes")))
    # islands in blocks of bytes: the end before an island is that of the block's earlier one, or of an earlier block
    islands = span_union(reads.select("start", "end")).withColumn("_b", F.floor(F.col("start") / WINDOW))
    ends = folded(islands.groupBy("_b").agg(F.max("end").alias("_e")), "_e", F.max, "_before").select("_b", "_before")
    here = Window.partitionBy("_b").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("start") - F.coalesce(F.max("end").over(here), F.col("_before"))
    apart = islands.join(ends, "_b").withColumn("_gap", gap)
    total = apart.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), *(F.struct(F.count_if(F.col("_gap") <= g).alias("n"), F.coalesce(F.sum(F.when(F.col("_gap") <= g, F.col("_gap"))), F.lit(0)).alias("bytes")).alias(name) for name, g in GAPS.items()))
    rows = F.inline(F.array(*(F.struct(F.lit(name).alias("policy"), (F.col("n") - F.col(name)["n"]).alias("reads"), (F.col("bytes") + F.col(name)["bytes"]).alias("bytes")) for name in GAPS)))
    return out.unionByName(total.select(rows))


def access_metrics(reads: DataFrame, grain: int) -> DataFrame:
    """Bytes asked for, bytes delivered in whole grains, each once, and transfer operations of sorted reads (start, end)."""
    size = F.col("end") - F.col("start")
    grains = reads.select((F.floor(F.col("start") / grain) * grain).alias("start"), (F.ceil(F.col("end") / grain) * grain).alias("end"))
    asked = reads.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("logical"))
    return asked.join(span_union(grains).agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("delivered"), F.count(F.lit(1)).alias("operations")), F.lit(True))


#: Multiplier and rotation of the order of random reads.
MULTIPLIER, ROTATE = 6_364_136_223_846_793_005, 17


def shuffled_key(page: int) -> int:
    """A page's place in a fixed random order."""
    x = page * MULTIPLIER % 2**64
    return (x << ROTATE | x >> (64 - ROTATE)) % 2**64


def shuffled(page: str) -> Column:
    """:func:`shuffled_key` of a column of pages from 0 on, as a decimal."""
    whole = F.lit(str(2**64)).cast("decimal(20,0)")
    x = (F.col(page).cast("decimal(17,0)") * F.lit(MULTIPLIER).cast("decimal(19,0)")).cast("decimal(38,0)") % whole
    low, high = F.lit(2 ** (64 - ROTATE)).cast("decimal(15,0)"), F.lit(2**ROTATE).cast("decimal(6,0)")
    return ((x % low).cast("decimal(15,0)") * high + F.floor(x / low)).cast("decimal(20,0)")
