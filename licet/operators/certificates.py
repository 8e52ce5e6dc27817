"""Block sidecars: Bloom filters, minima and maxima, sparse fences; candidate blocks and exact refinement."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import splitmix64
from .rows import block, ranges


def minmax(df: DataFrame, block_rows: int) -> DataFrame:
    """(blk, lo, hi); null where the block has nulls only.  16 modelled bytes a block."""
    return df.groupBy(block(block_rows).alias("blk")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def minmax_probe(sidecar: DataFrame, targets: list[int]) -> DataFrame:
    """Blocks whose span holds a target."""
    hit = F.exists(F.array(*(F.lit(t).cast("long") for t in targets)), lambda t: (F.col("lo") <= t) & (F.col("hi") >= t))
    return sidecar.where(hit if targets else F.lit(False)).select("blk")


def bloom_size(block_rows: int, bits_per_value: int) -> tuple[int, int]:
    """Bits of a block (a multiple of 256) and hash functions."""
    bits = -(-block_rows * bits_per_value // 256) * 256
    return bits, min(16, max(1, int(math.floor(bits_per_value * math.log(2) + 0.5))))


def _bits(values: np.ndarray, bits: int, k: int) -> np.ndarray:
    a = splitmix64(values.astype(np.int64).view(np.uint64))
    b = splitmix64(a) | np.uint64(1)
    return (a[:, None] + np.arange(k, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(bits)


def bloom(df: DataFrame, block_rows: int, bits_per_value: int = 11) -> DataFrame:
    """(blk, filter): one filter for each block; nulls are not in it."""
    bits, k = bloom_size(block_rows, bits_per_value)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(bits, dtype=np.uint8)
        values = group["value"].dropna().to_numpy(dtype=np.int64)
        out[_bits(values, bits, k).ravel().astype(np.int64)] = 1
        return pd.DataFrame({"blk": [group["blk"].iloc[0]], "filter": [np.packbits(out).tobytes()]})

    return df.select(block(block_rows).alias("blk"), F.col("value")).where("value IS NOT NULL").groupBy("blk").applyInPandas(build, "blk long, filter binary")


def bloom_probe(sidecar: DataFrame, targets: list[int], block_rows: int, bits_per_value: int = 11) -> DataFrame:
    bits, k = bloom_size(block_rows, bits_per_value)
    wanted = _bits(np.array(targets, dtype=np.int64), bits, k).astype(np.int64) if targets else np.zeros((0, k), np.int64)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hit = []
            for raw in b["filter"]:
                f = np.unpackbits(np.frombuffer(raw, np.uint8))
                hit.append(bool(len(wanted)) and bool(f[wanted].all(axis=1).any()))
            yield b.loc[hit, ["blk"]]

    return sidecar.mapInPandas(probe, "blk long")


def fence(df: DataFrame, budget: int, rows: int) -> tuple[DataFrame, int]:
    """Every stride-th entry of a dense non-decreasing column for ``budget`` bytes (16 each); else ValueError."""
    from ..plans.facts import check_column

    facts = check_column(df)
    if facts.nulls != "NoNulls" or not facts.non_decreasing:
        raise ValueError("a fence needs a dense non-decreasing column")
    stride = max(1, -(-rows // max(1, budget // 16)))
    return df.where(F.col("row_id") % stride == 0).select((F.col("row_id") / stride).cast("long").alias("entry"), "value"), stride


def fence_probe(entries: DataFrame, target: int) -> DataFrame:
    """Candidate stride blocks of an equality probe: from the entry before the first >= target to the last <= target."""
    b = entries.agg(F.max(F.when(F.col("value") < target, F.col("entry"))).alias("lo"), F.min(F.when(F.col("value") > target, F.col("entry"))).alias("hi"), F.max("entry").alias("last"))
    lo, hi = F.coalesce("lo", F.lit(0)), F.coalesce("hi", F.col("last") + 1)
    return b.where(lo < hi).select(F.explode(F.sequence(lo, hi - 1)).alias("blk"))


def intersect_candidates(a: DataFrame, b: DataFrame, a_rows: int, b_rows: int) -> DataFrame:
    if a_rows != b_rows:
        raise ValueError("candidates of different block sizes do not intersect")
    return a.select("blk").intersect(b.select("blk"))


def refine(df: DataFrame, candidates: DataFrame, block_rows: int, targets: list[int]) -> DataFrame:
    """Exact ranges of the targets among the candidate blocks."""
    rows = df.withColumn("blk", block(block_rows)).join(candidates.select("blk").distinct(), "blk", "left_semi")
    return ranges(rows.where(F.col("value").isin([int(t) for t in targets])).select("row_id"))


def false_positives(df: DataFrame, candidates: DataFrame, block_rows: int, targets: list[int]) -> DataFrame:
    real = df.where(F.col("value").isin([int(t) for t in targets])).select(block(block_rows).alias("blk")).distinct()
    return candidates.select("blk").distinct().join(real, "blk", "left_anti")


def candidate_rows(candidates: DataFrame, block_rows: int, rows: int) -> DataFrame:
    width = F.least(F.lit(rows), (F.col("blk") + 1) * block_rows) - F.col("blk") * block_rows
    return candidates.select("blk").distinct().agg(F.coalesce(F.sum(width), F.lit(0)).alias("rows"))


def query_set(df: DataFrame) -> DataFrame:
    """(name, value): the rarest, the most frequent and an absent value.

    Ties: rare by (count, value), frequent by (-count, value); absent is the
    least gap's low + 1, else max + 1, else min - 1.
    """
    counts = df.where("value IS NOT NULL").groupBy("value").count()
    pick = counts.agg(F.min(F.struct("count", "value"))["value"].alias("eq_rare"), F.min(F.struct(-F.col("count"), F.col("value")))["value"].alias("eq_frequent"), F.min("value").alias("_min"))
    # the least value whose successor is not there; below the least one where the greatest has none
    one = F.lit(1).cast("long")
    after = counts.select(F.try_subtract("value", one).alias("value"))
    last = counts.select("value").join(after, "value", "left_anti").agg(F.min("value").alias("_last"))
    both = pick.join(last, F.lit(True), "inner").withColumn("eq_absent", F.coalesce(F.try_add("_last", one), F.try_subtract("_min", one)))
    return both.selectExpr("stack(3, 'eq_rare', eq_rare, 'eq_frequent', eq_frequent, 'eq_absent', eq_absent) AS (name, value)")


def mixed_targets(df: DataFrame) -> list[int]:
    """The targets of the query "in_mixed": rare, frequent and absent, sorted; three values reach the driver."""
    return sorted({r.value for r in query_set(df).collect() if r.value is not None})


def fence_probe_in(entries: DataFrame, targets: list[int]) -> DataFrame:
    """Candidate stride blocks of several targets."""
    out = entries.select(F.col("entry").alias("blk")).limit(0)
    for t in sorted(set(targets)):
        out = out.unionByName(fence_probe(entries, t))
    return out.distinct()


#: Modelled bytes of a block's minimum and maximum, and of a fence's entry.
ENTRY = 16


def modelled_bytes(candidates: DataFrame, metadata_bytes: int, block_rows: int, rows: int) -> DataFrame:
    """What a probe reads: the sidecar, and 8 bytes for each candidate row."""
    return candidate_rows(candidates, block_rows, rows).select((F.lit(metadata_bytes) + 8 * F.col("rows")).cast("long").alias("bytes"))


def write_with_bloom(df: DataFrame, path: str, column: str, distinct: int) -> None:
    """Parquet with the format's own Bloom filter of a column: equality filters on it skip row groups."""
    key = f"#{column}"
    df.write.option("parquet.bloom.filter.enabled" + key, "true").option("parquet.bloom.filter.expected.ndv" + key, str(distinct)).parquet(path)
