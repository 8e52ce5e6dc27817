"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are shuffled by a hash and laid end to end; this
stream of words is cut into blocks of equal length.  Slot i of the schedule
takes the point ``frac((i + 1/2) * golden ratio)`` and maps it through the
cumulative weights to a source; the slots of a source are ranked, and rank r
takes the source's block ``r mod blocks`` in its pass ``r div blocks``.  A
prefix of the schedule of any length has nearly the wanted shares.

Sizes are words ``[^\\x20\\x09-\\x0D]+``.  Sources in the order of their code
points (null last) get the weights 5, 2, 1, repeating, by default.  A target
above ``passes`` times its source's size stops there; the excess is shared
again by weight until none is above.

Cases: null and empty texts have size 0 and take nothing; a null source is a
source; an empty table gives an empty result; of rows that agree in id and
text each takes its own words; extra columns pass through :func:`repeated`.
One row per source reaches the driver: sources are the entries of a mixing
list, which people write, not something that grows with the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text

GOLDEN = 0.6180339887498949
WEIGHTS = (5.0, 2.0, 1.0)
PASSES = 3
#: Blocks of all sources together, about; a block has MOST_WORDS at most.
BLOCKS = 20_000
MOST_WORDS = 1 << 20
#: Blocks that a source has at least, if it has as many words.
LEAST_BLOCKS = 256
#: Documents in a bucket of a source's shuffled order, and slots in one of the schedule.
BUCKET = 20_000


def n_words(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


@dataclass
class Source:
    name: str | None
    size: int
    weight: float
    target: float = 0.0
    block: int = 1
    blocks: int = 0


def targets(sources: list[Source], total: float, passes: int = PASSES) -> None:
    """Share ``total`` by weight; what lies above ``passes`` times a size is shared again."""
    open_ = [s for s in sources if s.size > 0 and s.weight > 0]
    for s in sources:
        s.target = 0.0
    rest = float(total)
    while open_:
        unit = rest / sum(s.weight for s in open_)
        full = [s for s in open_ if unit * s.weight > passes * s.size]
        if not full:
            for s in open_:
                s.target = unit * s.weight
            return
        for s in full:
            s.target = float(passes * s.size)
            rest -= s.target
        open_ = [s for s in open_ if s not in full]


def plan(docs: DataFrame, weights=WEIGHTS, passes: int = PASSES) -> list[Source]:
    """The sources with sizes and targets, from ``source`` and ``size`` of all documents."""
    rows = docs.groupBy("source").agg(F.sum("size").alias("size")).orderBy(F.col("source").asc_nulls_last()).collect()
    found = [Source(r.source, r.size or 0, float(weights[i % len(weights)])) for i, r in enumerate(rows)]
    total = sum(s.size for s in found)
    targets(found, total, passes)
    block = max(1, min(MOST_WORDS, total // BLOCKS))
    for s in found:
        if s.size:
            s.block = max(1, min(block, s.size // LEAST_BLOCKS))
            s.blocks = -(-s.size // s.block)
    return found


def _table(spark, sources: list[Source]) -> DataFrame:
    rows = [(i, s.name, s.size, s.target, s.block, s.blocks) for i, s in enumerate(sources)]
    return spark.createDataFrame(rows, "_s int, _name string, source_size long, target double, _block long, _blocks long")


def schedule(spark, sources: list[Source], passes: int = PASSES) -> DataFrame:
    """Rows ``slot, _s, rank, pass, block``: what each slot of the mix takes."""
    wanted = [s.target / s.size * s.blocks if s.size else 0.0 for s in sources]
    total = sum(wanted)
    slots = round(total)
    ends, run = [], 0.0
    for w in wanted:
        run += w
        ends.append(run / total if total else 1.0)
    point = (F.col("id") + 0.5) * GOLDEN
    at = F.size(F.filter(F.array(*(F.lit(float(e)) for e in ends[:-1])), lambda e: e <= point - F.floor(point))) if len(ends) > 1 else F.lit(0)
    # ranks by two levels: the slots of a source before a bucket, and in it
    out = spark.range(slots).select(F.col("id").alias("slot"), at.alias("_s"), F.floor(F.col("id") / BUCKET).alias("_b"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = out.groupBy("_s", "_b").count().withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("_s", "_b").orderBy("slot")
    rank = F.col("_base") + F.row_number().over(within) - 1
    sized = _table(spark, sources).select("_s", "_blocks")
    out = out.join(base, ["_s", "_b"]).withColumn("rank", rank).drop("_b", "_base").join(sized, "_s")
    out = out.withColumn("pass", F.floor(F.col("rank") / F.col("_blocks"))).withColumn("block", F.col("rank") % F.col("_blocks")).drop("_blocks")
    return out.where(F.col("pass") < passes)


def laid_out(docs: DataFrame, sources: list[Source], seed: int = 42) -> DataFrame:
    """``_start`` of every document in its source's shuffled stream of words.

    Positions come from two levels, sums of hash buckets and sums inside one,
    so no source needs to fit into one task.
    """
    spark = docs.sparkSession
    most = max([1, *(s.size for s in sources)])
    count = docs.count()
    parts = 1
    while count > parts * BUCKET and most > 1:
        parts *= 2
    h = F.xxhash64(F.lit(seed), "doc_id", "_hash")
    docs = docs.join(_table(spark, sources), F.col("source").eqNullSafe(F.col("_name"))).drop("_name").withColumn("_order", h).withColumn("_part", F.pmod(F.col("_order"), F.lit(parts)))
    before = Window.partitionBy("_s").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = docs.groupBy("_s", "_part").agg(F.sum("size").alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy("_s", "_part").orderBy("_order", "doc_id", "_hash", "size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("_base") + F.sum("size").over(within) - F.col("size")
    return docs.join(base, ["_s", "_part"]).withColumn("_start", start).drop("_part", "_base", "_order")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words("text").alias("size"), F.xxhash64("text").alias("_hash"))


def mixed(docs: DataFrame, weights=WEIGHTS, passes: int = PASSES, seed: int = 42) -> DataFrame:
    """Per document ``doc_id, source, size, source_size, target, taken`` (and ``_hash`` of the text)."""
    spark = docs.sparkSession
    docs = text.written(sized(docs), "sizes")
    sources = plan(docs, weights, passes)
    placed = laid_out(docs, sources, seed)
    first, last = F.floor(F.col("_start") / F.col("_block")), F.floor((F.col("_start") + F.col("size") - 1) / F.col("_block"))
    # a document's parts in the blocks of its source
    parts = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    end = F.least(F.col("_start") + F.col("size"), (F.col("block") + 1) * F.col("_block"))
    parts = parts.withColumn("_words", end - F.greatest(F.col("_start"), F.col("block") * F.col("_block")))
    taken = schedule(spark, sources, passes).groupBy("_s", "block").agg(F.count(F.lit(1)).alias("_times"))
    keys = ["doc_id", "source", "size", "source_size", "target", "_hash"]
    some = parts.join(taken, ["_s", "block"], "left").groupBy(*keys, "_start").agg(F.sum(F.col("_words") * F.coalesce("_times", F.lit(0))).alias("taken")).drop("_start")
    none = placed.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none)


def repeated(docs: DataFrame, weights=WEIGHTS, passes: int = PASSES, seed: int = 42) -> DataFrame:
    """The mix as documents: one row per whole repeat, and one with the first
    words of a document that is taken in part (its source's last pass ends
    inside it).  Rows that agree in id and text are one document here, whose
    words are all that they take together, with the other columns of one of
    them.  Documents without words are not taken.
    """
    cols = docs.columns
    hash_, left, size, id_, h, n = text.unused(docs, "_hash", "_left", "_size", "_id", "_h", "_n")
    takes = mixed(docs, weights, passes, seed).groupBy(F.col("doc_id").alias(id_), F.col("_hash").alias(h))
    takes = text.written(takes.agg(F.sum("taken").alias(left), F.max("size").alias(size), F.count(F.lit(1)).alias(n)).where(F.col(left) > 0), "takes")
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(hash_) == F.col(h))
    docs = docs.withColumn(hash_, F.xxhash64("text"))
    out = docs.join(takes.where(F.col(n) == 1), same)
    if not takes.where(F.col(n) > 1).isEmpty():
        out = out.unionByName(docs.join(takes.where(F.col(n) > 1), same).dropDuplicates([id_, h]))
    out = out.withColumn(left, F.explode(F.sequence(F.col(left), F.lit(1).cast("long"), -F.col(size))))
    head = F.regexp_extract(F.col("text"), r"^[\x20\x09-\x0D]*", 0)
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), F.least(left, size).cast("int")), "")
    whole = F.col(left) >= F.col(size)
    out = out.withColumn("text", F.when(whole, F.col("text")).otherwise(F.concat(head, part)))
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return out.select(*cols)


def op5(spark, sf_dir: str) -> DataFrame:
    return mixed(text.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def mixed_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mix of the kept documents."""
    return repeated(docs)
