"""A bounded sample of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(column: str, divisor: int):
    """crc32 of the id as text, modulo ``divisor`` (null ids: -1)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % divisor, F.lit(-1))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seen) -> list[tuple[str, int]]:
    """Up to ``per_class`` texts of each class, as (text, label), in a fixed order.

    ``seen`` is a condition on doc_id that training rows meet.  The ids are
    picked from the labels by hash order, so the sample is uniform and the same
    in every run; at most ``2 * per_class`` ids are broadcast and that many
    whole texts collected.  Null texts count as empty; ids labelled twice with
    different classes are left out.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("_label")).where(F.col("doc_id").isNotNull() & F.col("_label").isin(0, 1) & seen)
    once = known.groupBy("doc_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_most")).where("_label = _most")
    here = docs.select("doc_id", F.col("text").alias("_text"))
    ids = []
    for value in (0, 1):
        # twice as many as wanted: some labelled ids may have no document here
        order = [F.xxhash64("doc_id"), F.col("doc_id")]
        ids += [(r.doc_id, value) for r in once.where(F.col("_label") == value).orderBy(*order).limit(2 * per_class).select("doc_id").collect()]
    if not ids:
        return []
    spark = docs.sparkSession
    few = spark.createDataFrame(ids, "doc_id long, _label int")
    rows = here.join(F.broadcast(few), "doc_id").select("doc_id", "_text", "_label", F.xxhash64("doc_id").alias("_h"))
    got: dict[int, tuple[int, str, int]] = {}
    for value in (0, 1):
        for r in rows.where(F.col("_label") == value).orderBy("_h", "doc_id").limit(per_class).collect():
            got[r.doc_id] = (r._h, r._text or "", value)
    return [(text, value) for _, text, value in sorted(got.values())]
