"""The strategy ladder: from a query and facts to a licensed plan, and its lowering to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scans
from ..operators.rows import _merge, block, ranges, span_union
from . import encoded
from .encoded import Encoded
from .plan import Op, Plan, Query, check_authorization, validate_plan
from .recipe import Recipe, decoder

def column(rows: DataFrame, recipe: Recipe, keep: bool = False) -> Encoded:
    """The column encoded: facts are about its fields.  ``keep``: fields are written once and read from then on."""
    return encoded.stored(rows, recipe) if keep else encoded.encode(rows, recipe)


def _validate(q: Query, rows: int) -> None:
    if q.kind == "Get" and not 0 <= q.left < rows:
        raise ValueError(f"row {q.left} is outside the column of {rows}")
    if q.kind in ("Sum", "Between"):
        scans.check_rows(q.left, q.right, rows)
    if q.kind == "Count" and q.equals is None:
        raise ValueError("COUNT BETWEEN is not supported")
    if q.kind in ("Between", "Filter") and q.equals is None:
        scans.check_bounds(q.low, q.high)


def compile_query(q: Query, c: Encoded) -> Plan:
    """First match wins; without a fact the plan scans."""
    _validate(q, c.checked.rows)
    root = decoder(c.recipe).kind
    find = lambda test: next((f for f in c.facts if test(f)), None)
    scan = Op({"Get": "DecodeRow", "Sum": "AggregateEncoded", "Count": "CountExact"}.get(q.kind, "MaterializeRows"))
    op = scan
    if q.kind == "Filter":
        order = find(lambda f: f.prop == "NonDecreasing")
        piece = find(lambda f: f.prop == "PiecewiseNonDecreasing" and f.scope == "AllRows")
        keeps = find(lambda f: f.prop == "OrderPreserving")
        if order and c.checked.nulls in ("NoNulls", "First", "Last"):
            op = Op("SearchMonotone", None, (order,))
        elif piece:
            op = Op("SearchPiecewise", piece.param, (piece,))
        elif root == "Dictionary" and keeps:
            op = Op("TranslateDictionaryRange", None, (keeps,))
    elif q.kind == "Count" and root == "RLE" and (runs := find(lambda f: f.prop == "RunIndex")):
        op = Op("CountRuns", None, (runs,))
    plan = Plan(q, (op,), "ExactRanges" if q.kind in ("Between", "Filter") else "ExactScalar", c.checked.source)
    validate_plan(plan)
    check_authorization(plan, c.facts, c.checked.source)
    return plan


def lower(plan: Plan, c: Encoded) -> DataFrame:
    """The plan as a DataFrame; the licence is checked again."""
    check_authorization(plan, c.facts, c.checked.source)
    q, op = plan.query, plan.ops[0]
    low, high = (q.equals, q.equals) if q.equals is not None else (q.low, q.high)
    if op.name == "SearchMonotone":
        lo, hi = search(c, low, high)
        return c.rows.sparkSession.range(1).select(F.lit(lo).alias("start"), F.lit(hi).alias("end")).where("start < end")
    if op.name == "SearchPiecewise":
        return piecewise_ranges(encoded.decode(c), op.param, low, high)
    if op.name == "TranslateDictionaryRange":
        return translated(c, low, high)
    if op.name == "CountRuns":
        return scans.count_runs(c.fields["0 runs"], q.equals)
    if q.kind == "Get":
        return scans.get(encoded.decode(c, q.left, q.left + 1), q.left, c.checked.rows)
    if q.kind == "Sum":
        if decoder(c.recipe).kind == "RLE":  # a run's value times its rows: exact, and no run is skipped
            return scans.sum_run_rows(c.fields["0 runs"], q.left, q.right)
        return scans.sum_rows(encoded.decode(c, q.left, q.right), q.left, q.right)
    if q.kind == "Between":
        return scans.between_rows(encoded.decode(c, q.left, q.right), q.left, q.right, low, high)
    if q.kind == "Count":
        return scans.count_equals(encoded.decode(c), q.equals)
    return scans.filter_between(encoded.decode(c), low, high)


def translated(c: Encoded, low: int, high: int) -> DataFrame:
    """Ranges of the ids that stand for values in [low, high]; over runs of ids, whole runs."""
    lo, hi = encoded.id_bounds(c, low, high)
    below = decoder(c.recipe).child
    if lo >= hi:  # no id: no row is read
        return c.rows.sparkSession.createDataFrame([], "start long, end long")
    if below.kind == "RLE":
        hits = c.fields["1 runs"].where((F.col("value") >= lo) & (F.col("value") < hi)).select("start", "end")
        return span_union(hits)
    ids = encoded._decode(c, below, 1, None, None)
    return ranges(ids.where((F.col("value") >= lo) & (F.col("value") < hi)))


def run(q: Query, c: Encoded) -> DataFrame:
    return lower(compile_query(q, c), c)


def search(c: Encoded, low: int, high: int, stride: int = encoded.STRIDE) -> tuple[int, int]:
    """The one matching range of a non-decreasing column, by two boundary searches.

    The top (evenly spaced values that the driver has of a stored column; of
    others, a fence read by one aggregate) gives the strides in which the
    boundaries lie; one job reads only those strides' rows.
    """
    nulls, rows = c.checked.nulls, c.checked.rows
    if "values" in c.tops:
        stride, (begin, end) = c.tops["values"][0], encoded.bracket(c, low, high)
    else:
        fence = c.rows.where(F.col("row_id") % stride == 0)
        early = F.coalesce(F.col("value") < low, F.lit(nulls == "First"))
        late = F.coalesce(F.col("value") > high, F.lit(nulls == "Last"))
        e = fence.agg(F.max(F.when(early, F.col("row_id"))).alias("a"), F.min(F.when(late, F.col("row_id"))).alias("b")).first()
        begin, end = e.a or 0, rows if e.b is None else e.b
    if begin >= end:
        return begin, begin
    # of the strides between the first and the last one, all values match
    first, last = min(begin + stride + 1, end), max(begin, end - stride - 1)
    row = F.col("row_id")
    if first < last and _plain(c):
        here = encoded.decode(c).where(((row >= begin) & (row < first)) | ((row >= last) & (row < end)))
    elif first < last:
        here = encoded.decode(c, begin, first).unionByName(encoded.decode(c, last, end))
    else:
        first = last = begin
        here = encoded.decode(c, begin, end)
    less = F.coalesce(F.col("value") < low, F.lit(nulls == "First"))
    more = F.coalesce(F.col("value") > high, F.lit(nulls == "Last"))
    got = here.agg(F.count_if(less).alias("less"), F.count_if(more).alias("more")).first()
    lo, hi = begin + got.less, end - got.more
    return (lo, hi) if lo < hi else (lo, lo)


def piecewise_ranges(rows: DataFrame, width: int, low: int, high: int) -> DataFrame:
    """Per block the one matching range, then neighbours joined.  Order inside
    the blocks makes matches contiguous; every row is still read."""
    hit = F.col("value").between(low, high)
    each = rows.groupBy(block(width).alias("blk")).agg(F.min(F.when(hit, F.col("row_id"))).alias("start"), (F.max(F.when(hit, F.col("row_id"))) + 1).alias("end")).where("start IS NOT NULL")
    out = each.select("start", "end")
    for wide in (width << 16, None):
        narrow = width if wide else width << 16
        edge = (F.col("start") % narrow == 0) | (F.col("end") % narrow == 0)
        out = out.where(~edge).unionByName(_merge(out.where(edge), wide, None))
    return out


def licensed_predicate_sum(selector: Encoded, aligned: DataFrame, low: int, high: int) -> DataFrame:
    """The flagship: a licensed range on the selector, then the sum of the aligned
    values; ``aligned`` has row_id, selector, value.  The row range reaches the scan."""
    plan = compile_query(Query("Filter", low=low, high=high), selector)
    if plan.ops[0].name != "SearchMonotone":
        return scans.predicate_sum(aligned, low, high)
    # outside the bracket of a stored column nothing matches, and in it the predicate is exact: one job
    lo, hi = encoded.bracket(selector, low, high) if "values" in selector.tops else search(selector, low, high)
    return scans.predicate_sum(aligned.where((F.col("row_id") >= lo) & (F.col("row_id") < hi)), low, high)


def gets(c: Encoded, rows: list[int]) -> list[int | None]:
    """The values of a few rows by one job; columns of plain codes are read at these rows only."""
    for i in rows:
        _validate(Query("Get", i), c.checked.rows)
    here = encoded.decode(c) if _plain(c) else encoded.decode(c, min(rows), max(rows) + 1)
    got = {r.row_id: r.value for r in here.where(F.col("row_id").isin(rows)).collect()}
    return [got[i] for i in rows]


def _plain(c: Encoded) -> bool:
    """Rows that are decoded one by one, so that a condition on them reaches the scan."""
    return [r.kind for r in decoder(c.recipe).nodes()] in (["BitPack"], ["FOR", "BitPack"])
