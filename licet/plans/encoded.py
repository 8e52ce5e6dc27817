"""The encode driver: a recipe applied to a column, its physical fields, the facts that they prove, and decoding.

:func:`encode` walks the recipe, turns the column into a DataFrame for each
physical field, and fails where values do not meet an encoding's conditions; so
a structural fact is never about a label.  :func:`stored` writes the fields
once, sorted by their ids, with what a planner needs on the driver (numbers,
facts, and the *top*: at most ``TOP`` evenly spaced entries of each ordered
field); queries read the fields afterwards, not the source.

:func:`decode` reads rows [left, right) only: every node asks its child for the
rows that it needs (:func:`chain` says which), so the ranges reach the scans.

Cases: no rows, only nulls, nulls without the nullable encoding, negative codes
and falling values under an unsigned delta are errors.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import codecs
from ..operators.codecs import EncodeError
from . import layout, store
from .facts import Checked, Fact, check_column, derive
from .recipe import Recipe, decoder, validate

#: Entries of an ordered field that the driver keeps at most, and the least distance between them.
TOP, STRIDE = 1 << 16, 1024
#: Rows of a stored file, about.
FILE = 1 << 20


@dataclass
class Encoded:
    """``fields`` and ``numbers`` are named by their node's depth in the recipe and what they are."""

    recipe: Recipe
    rows: DataFrame
    checked: Checked
    fields: dict[str, DataFrame]
    numbers: dict[str, int]
    facts: list[Fact] = field(default_factory=list)
    tops: dict[str, tuple[int, list]] = field(default_factory=dict)  # of a field: stride, entries


def encode(df: DataFrame, recipe: Recipe, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> Encoded:
    """``df`` is (row_id, value), with ``is_patch`` under Patch.  ``keep`` writes a column that takes windows to
    make under a name, and reads it: what is below it in the recipe looks at it several times."""
    validate(recipe)
    checked = check_column(df.select("row_id", "value"))
    if not checked.rows:
        raise EncodeError("a column without rows")
    out = Encoded(recipe, df.select("row_id", "value"), checked, {}, {})
    _encode(df, decoder(recipe), checked.rows, 0, out, keep)
    out.facts = derive(recipe, checked.rows, checked, out.numbers)
    return out


def _long(df: DataFrame) -> DataFrame:
    """Differences that need more than 64 bits are an error (as is ANSI's cast)."""
    return df.select("row_id", F.col("value").cast("long").alias("value"))


def _encode(df: DataFrame, r: Recipe, rows: int, at: int, out: Encoded, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> None:
    out.numbers[f"{at} rows"] = rows
    if r.kind != "Nullable" and at == 0 and out.checked.nulls != "NoNulls":
        raise EncodeError("nulls need the nullable encoding")
    plain = df.select("row_id", "value")
    if r.kind == "BitPack":
        codes, out.numbers[f"{at} width"] = codecs.bitpack(plain)
        out.fields[f"{at} codes"] = codes
        return
    if r.kind == "FOR":
        child, out.numbers[f"{at} base"] = codecs.frame_of_reference(plain)
        return _encode(_long(child), r.child, rows, at + 1, out, keep)
    if r.kind in ("Delta", "UnsignedDelta"):
        codes, anchors = codecs.delta(plain, r.interval, r.kind == "UnsignedDelta")
        out.fields[f"{at} anchors"] = anchors
        codes = codes.select("row_id", F.col("code").alias("value"))
        return _encode(keep(codes, f"{at} main") if keep else codes, r.child, rows, at + 1, out, keep)
    if r.kind == "Dictionary":
        ids, table = codecs.dictionary(plain)
        out.fields[f"{at} table"] = table
        out.numbers[f"{at} entries"] = table.count()
        return _encode(ids.select("row_id", F.col("id").cast("long").alias("value")), r.child, rows, at + 1, out, keep)
    if r.kind == "RLE":
        runs, index = codecs.run_length(plain, r.interval)
        out.fields[f"{at} runs"], out.fields[f"{at} index"] = runs.select("run_id", "value", "start", "end"), index
        n = out.numbers[f"{at} runs"] = runs.count()
        # the run values stand in the runs; their encoding is checked, not stored once more
        below = Encoded(r.child, runs, out.checked, {}, {})
        _encode(runs.select(F.col("run_id").alias("row_id"), "value"), r.child, n, at + 1, below, keep)
        out.numbers |= below.numbers
        return None
    if r.kind == "Patch":
        if "is_patch" not in df.columns:
            df = df.withColumn("is_patch", F.lit(False))
        main, exceptions = codecs.patch(df)
        out.fields[f"{at} exceptions"] = exceptions
        out.numbers[f"{at} exceptions"] = exceptions.count()
        main = _long(main)
        return _encode(keep(main, f"{at} main") if keep else main, r.child, rows, at + 1, out, keep)
    validity, ranks, child = codecs.nullable(plain, r.interval, (lambda f: keep(f, f"{at} main")) if keep else None)
    n = child.count()
    if not n:
        raise EncodeError("a column of nulls only")
    out.fields[f"{at} validity"], out.fields[f"{at} ranks"] = validity, ranks
    return _encode(child, r.child, n, at + 1, out, keep)


_ORDER = {"codes": "row_id", "anchors": "block", "table": "id", "runs": "run_id", "index": "run_id", "exceptions": "row_id", "validity": "row_id", "ranks": "interval"}
_kept: dict[tuple, Encoded] = {}


def stored(df: DataFrame, recipe: Recipe) -> Encoded:
    """:func:`encode`, written once for each input and recipe in this session; a changed input is encoded anew."""
    spark = df.sparkSession
    key = (spark.sparkContext.applicationId, store.identity(df), recipe.name())
    if key not in _kept:
        uri, passing = store.folder(spark), []

        def keep(f: DataFrame, name: str) -> DataFrame:
            passing.append(f"{uri}/{name.replace(' ', '-')}")
            f.write.option("compression", "lz4").parquet(passing[-1])
            return spark.read.schema(f.schema).parquet(passing[-1])

        out = encode(df, recipe, keep)
        # a frame is one compressed whole
        packed = "zstd" if recipe.kind == "Frame" else "lz4"
        for name, f in out.fields.items():
            order = _ORDER[name.split()[1]]
            path = f"{uri}/{name.replace(' ', '-')}"
            f.repartitionByRange(max(1, -(-out.checked.rows // FILE)), order).sortWithinPartitions(order).write.option("compression", packed).option("parquet.page.row.count.limit", STRIDE).parquet(path)
            out.fields[name] = spark.read.schema(f.schema).parquet(path)
        store.dropped(spark, passing)
        _tops(out)
        _kept[key] = out
    return _kept[key]


def _tops(c: Encoded) -> None:
    """Entries that the driver keeps of ordered fields: of the root's values if they never fall, and of dictionaries."""
    if c.checked.non_decreasing and c.checked.nulls in ("NoNulls", "First", "Last"):
        stride = max(STRIDE, -(-c.checked.rows // TOP))
        c.tops["values"] = stride, _pick(decode(c), "row_id", "value", stride, c.checked.rows)
    r = decoder(c.recipe)
    if r.kind == "Dictionary":
        n = c.numbers["0 entries"]
        stride = max(1, -(-n // TOP))
        c.tops["table"] = stride, _pick(c.fields["0 table"], "id", "value", stride, n)


def _pick(df: DataFrame, order: str, value: str, stride: int, n: int) -> list:
    got = {r[0]: r[1] for r in df.where(F.col(order) % stride == 0).select(order, value).collect()}  # TOP rows at most
    return [got[i] for i in range(0, n, stride)]


# --------------------------------------------------------------------- decoding


def chain(c: Encoded, left: int = 0, right: int | None = None) -> dict[str, tuple[int, int]]:
    """What rows [left, right) need of each field: its own ids, as [from, to); None of a field: found when it is read."""
    r, at, out = decoder(c.recipe), 0, {}
    right = c.checked.rows if right is None else right
    span: tuple[int, int] | None = (left, right)
    while r is not None:
        if r.kind == "BitPack":
            out[f"{at} codes"] = span
        elif r.kind in ("Delta", "UnsignedDelta"):
            if span:
                out[f"{at} anchors"] = (span[0] // r.interval, -(-span[1] // r.interval))
                span = (span[0] // r.interval * r.interval, span[1])
            else:
                out[f"{at} anchors"] = None
        elif r.kind == "Dictionary":
            out[f"{at} table"] = (0, c.numbers[f"{at} entries"])
        elif r.kind == "RLE":
            out[f"{at} index"] = (0, -(-c.numbers[f"{at} runs"] // r.interval) + 1)
            out[f"{at} runs"] = None
            return out
        elif r.kind == "Patch":
            out[f"{at} exceptions"] = span
        elif r.kind == "Nullable":
            out[f"{at} validity"] = span
            out[f"{at} ranks"] = (span[0] // r.interval, -(-span[1] // r.interval)) if span else None
            span = None
        r, at = r.child, at + 1
    return out


def _within(df: DataFrame, column: str, left: int | None, right: int | None) -> DataFrame:
    if left is not None:
        df = df.where(F.col(column) >= left)
    return df if right is None else df.where(F.col(column) < right)


def decode(c: Encoded, left: int | None = None, right: int | None = None) -> DataFrame:
    """(row_id, value) of rows [left, right), from the fields; the whole column by default."""
    return _decode(c, decoder(c.recipe), 0, left, right)


def _decode(c: Encoded, r: Recipe, at: int, left: int | None, right: int | None) -> DataFrame:
    f = lambda name: c.fields[f"{at} {name}"]
    if r.kind == "BitPack":
        return _within(f("codes"), "row_id", left, right).select("row_id", F.col("code").alias("value"))
    if r.kind == "FOR":
        return codecs.undo_frame_of_reference(_decode(c, r.child, at + 1, left, right), c.numbers[f"{at} base"])
    if r.kind in ("Delta", "UnsignedDelta"):
        first = None if left is None else left // r.interval * r.interval
        anchors = _within(f("anchors"), "block", None if left is None else left // r.interval, None if right is None else -(-right // r.interval))
        codes = _decode(c, r.child, at + 1, first, right).select("row_id", F.col("value").alias("code"))
        return _within(codecs.undo_delta(codes, anchors, r.interval, r.kind == "UnsignedDelta"), "row_id", left, None)
    if r.kind == "Dictionary":
        return codecs.undo_dictionary(_decode(c, r.child, at + 1, left, right).select("row_id", F.col("value").alias("id")), f("table"))
    if r.kind == "RLE":
        runs = f("runs")
        if left is not None:
            runs = runs.where(F.col("end") > left).withColumn("start", F.greatest("start", F.lit(left)))
        if right is not None:
            runs = runs.where(F.col("start") < right).withColumn("end", F.least("end", F.lit(right)))
        return codecs.undo_run_length(runs)
    if r.kind == "Patch":
        return codecs.undo_patch(_decode(c, r.child, at + 1, left, right), _within(f("exceptions"), "row_id", left, right))
    validity = _within(f("validity"), "row_id", left, right)
    first = last = None
    if left is not None or right is not None:  # the ranks of a range: two numbers
        e = validity.where("valid").agg(F.min("rank").alias("a"), F.max("rank").alias("b")).first()
        first, last = (e.a, e.b + 1) if e.a is not None else (0, 0)
    return codecs.undo_nullable(validity, _decode(c, r.child, at + 1, first, last))


def bracket(c: Encoded, low: int, high: int) -> tuple[int, int]:
    """Rows [from, to) outside which an ordered column has no value in [low, high]: from the top, without a job."""
    stride, top = c.tops["values"]
    n, nulls = c.checked.rows, c.checked.nulls
    # nulls lie before all values or after them
    key = [(0 if nulls == "First" else 2, 0) if v is None else (1, v) for v in top]
    before = bisect.bisect_left(key, (1, low))
    after = bisect.bisect_right(key, (1, high))
    return max(0, before - 1) * stride, min(n, after * stride)


def id_bounds(c: Encoded, low: int, high: int) -> tuple[int, int]:
    """Ids [from, to) of a root dictionary whose values lie in [low, high]."""
    stride, top = c.tops["table"] if "table" in c.tops else (None, None)
    table = c.fields["0 table"]
    if stride == 1:
        return bisect.bisect_left(top, low), bisect.bisect_right(top, high)
    if stride:  # only the entries between two of the top
        table = table.where(F.col("id").between(max(0, bisect.bisect_left(top, low) - 1) * stride, bisect.bisect_right(top, high) * stride))
    b = table.where(F.col("value").between(low, high)).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    return (0, 0) if b.lo is None else (b.lo, b.hi + 1)


def field_bytes(c: Encoded) -> list[tuple[str, int]]:
    """(kind, modelled bytes) of the fields in page order."""
    return layout.recipe_fields(decoder(c.recipe), c.numbers)
