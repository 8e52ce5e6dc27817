"""Ways to read a predicate and sum from Parquet: what is decoded and what the scan may skip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import total
from ..operators import scans


def full(pair: DataFrame, low: int, high: int) -> DataFrame:
    """Both columns of every row are decoded; the condition stands inside the aggregate, so nothing is pushed down."""
    scans.check_bounds(low, high)
    hit = F.col("selector").between(low, high)
    return pair.agg(total(F.when(hit, F.col("value"))).alias("sum"), F.count_if(hit).alias("matched_rows"))


def row_filter(pair: DataFrame, low: int, high: int) -> DataFrame:
    """The condition reaches the scan, whose page indexes skip row ranges where the file is sorted."""
    return scans.predicate_sum(pair, low, high)


def page_candidates(pair: DataFrame, low: int, high: int, page_rows: int) -> DataFrame:
    """Pages of (row_id, selector) whose minima and maxima meet the predicate."""
    scans.check_bounds(low, high)
    page = F.floor(F.col("row_id") / page_rows)
    each = pair.groupBy(page.alias("page")).agg(F.min("selector").alias("lo"), F.max("selector").alias("hi"))
    return each.where((F.col("lo") <= high) & (F.col("hi") >= low))


def page_filter(pair: DataFrame, low: int, high: int, page_rows: int) -> DataFrame:
    """Candidate pages by a semi-join, then the exact condition."""
    here = pair.withColumn("page", F.floor(F.col("row_id") / page_rows))
    return scans.predicate_sum(here.join(page_candidates(pair, low, high, page_rows), "page", "left_semi"), low, high)


def row_selection(pair: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows are known: only the value is read."""
    return scans.sum_over_ranges(pair.select("row_id", "value"), spans)


def boundary_search(pair: DataFrame, low: int, high: int, page_rows: int) -> DataFrame:
    """Pages by their minima and maxima; where these ascend, the candidates are one run of pages, whose row range reaches the scan.

    ``sum``, ``matched_rows``, ``candidate_pages`` and ``boundary_order_used``; without ascending pages
    each page is tested (:func:`page_filter`).
    """
    from ..operators.rows import folded

    scans.check_bounds(low, high)
    page = F.floor(F.col("row_id") / page_rows)
    pages = pair.groupBy(page.alias("_b")).agg(F.min("selector").alias("lo"), F.max("selector").alias("hi"))
    dense = pages.where("lo IS NOT NULL").withColumn("_key", F.struct("_b", "lo", "hi"))
    falls = folded(dense, "_key", F.max, "_prior").agg(F.bool_or((F.col("lo") < F.col("_prior")["lo"]) | (F.col("hi") < F.col("_prior")["hi"])).alias("falls"))
    hit = (F.col("hi") >= low) & (F.col("lo") <= high)
    span = pages.where(hit).agg(F.min("_b").alias("a"), F.max("_b").alias("b"), F.count(F.lit(1)).alias("n"))
    r = span.join(falls, F.lit(True)).first()
    if r.falls:
        out = page_filter(pair, low, high, page_rows)
    else:
        a, b = (r.a * page_rows, (r.b + 1) * page_rows) if r.n else (0, 0)
        out = scans.predicate_sum(pair.where((F.col("row_id") >= a) & (F.col("row_id") < b)), low, high)
    return out.withColumn("candidate_pages", F.lit(r.n).cast("long")).withColumn("boundary_order_used", F.lit(not r.falls))


def read_counts(df: DataFrame) -> dict[str, int]:
    """Runs ``df`` and returns what its scans read: rows that they gave out, files and the files' bytes."""
    query = df._jdf.queryExecution()
    df._jdf.collectToPython()
    out = {"rows": 0, "files": 0, "bytes": 0}
    todo = [query.executedPlan()]
    while todo:
        plan = todo.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(plan.plan())
            continue
        metrics = plan.metrics()
        if metrics.contains("numFiles"):
            for key, metric in (("rows", "numOutputRows"), ("files", "numFiles"), ("bytes", "filesSize")):
                out[key] += metrics.apply(metric).value()
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out
