"""The engine's rules, planner, codecs and statistics."""

import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from licet.functions import scalar, statistics
from licet.operators import census, certificates, codecs, rows, scans
from licet.plans import bridge, compiler, encoded, facts, layout
from licet.plans.plan import NotLicensed, Op, Plan, Query, check_authorization
from licet.plans.recipe import Recipe, bitpack, validate
from licet.queries import QUERIES
from licet.sources import readers

FOR = Recipe("FOR", bitpack())
U256 = Recipe("UnsignedDelta", bitpack(), 256)
quick = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "row_id long, value long")


def spans(df):
    return sorted((r.start, r.end) for r in df.collect())


def scan_spans(values, low, high):
    out = []
    for i, v in enumerate(values):
        if v is not None and low <= v <= high:
            if out and out[-1][1] == i:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((i, i + 1))
    return out


def values_of(df):
    return [r.value for r in df.orderBy("row_id").collect()]


# ---------------------------------------------------------------- calculus


def props(recipe, n, checked=None):
    return {(f.scope, f.prop, f.param) for f in facts.derive(recipe, n, checked)}


def test_rules():
    assert ("AllRows", "NonDecreasing", None) in props(Recipe("UnsignedDelta", bitpack(), 512), 512)
    assert ("AllRows", "PiecewiseNonDecreasing", 256) in props(U256, 512)
    assert not any(p == "NonDecreasing" or p == "PiecewiseNonDecreasing" for _, p, _ in props(Recipe("Delta", bitpack(), 256), 100))
    assert not any("NonDecreasing" in p for _, p, _ in props(Recipe("UnsignedDelta", FOR, 256), 100))  # no range on the direct child
    assert ("Mapping", "OrderPreserving", None) in props(Recipe("Dictionary", bitpack()), 10)
    assert ("NonNullRows", "NonDecreasing", None) in props(Recipe("Nullable", Recipe("UnsignedDelta", bitpack(), 512), 128), 512)
    assert ("Physical", "EnclosingFrame", 0) in props(Recipe("Frame", FOR), 10)
    assert not any("NonDecreasing" in p for _, p, _ in props(Recipe("Patch", U256, 4), 10))
    for bad in (Recipe("Delta", bitpack(), 100), Recipe("Nullable", Recipe("Nullable", FOR, 8), 8), Recipe("RLE", bitpack()), Recipe("FOR")):
        with pytest.raises(ValueError):
            validate(bad)


@pytest.mark.parametrize("values, placement, op", [([None, None, 10, 20, 30], "First", "SearchMonotone"), ([10, 20, 30, None, None], "Last", "SearchMonotone"), ([10, None, 20, None, 30], "Arbitrary", "MaterializeRows")])
def test_null_placement_and_plan(spark, values, placement, op):
    c = compiler.column(frame(spark, values), Recipe("Nullable", FOR, 128))
    q = Query("Filter", low=15, high=30)
    assert c.checked.nulls == placement and compiler.compile_query(q, c).ops[0].name == op
    assert spans(compiler.run(q, c)) == scan_spans(values, 15, 30)


def test_authorization():
    proven = facts.derive(U256, 512)
    order = facts.Fact("AllRows", "NonDecreasing")
    piece = facts.Fact("AllRows", "PiecewiseNonDecreasing", 256)
    plan = lambda *ops: Plan(Query("Filter"), ops, "ExactRanges")
    check_authorization(plan(Op("SearchPiecewise", 256, (piece,))), proven)
    for bad in (Op("SearchMonotone"), Op("SearchMonotone", None, (order,)), Op("SearchMonotone", None, (piece,)), Op("SearchPiecewise", 128, (piece,)), Op("MaterializeRows", None, (piece,))):
        with pytest.raises(NotLicensed):
            check_authorization(plan(bad), proven)
    with pytest.raises(NotLicensed):
        check_authorization(plan(), proven)
    with pytest.raises(NotLicensed):
        check_authorization(plan(Op("MaterializeRows")), proven, "other data")


def test_query_errors(spark):
    c = compiler.column(frame(spark, [3, 1, 2]), FOR)
    for q in (Query("Get", 3), Query("Filter", low=2, high=1), Query("Count", low=1, high=2), Query("Sum", 2, 1), Query("Sum", 0, 4)):
        with pytest.raises(ValueError):
            compiler.compile_query(q, c)
    with pytest.raises(OverflowError):
        scans.half_open(0, 2**63 - 1)
    assert scans.half_open(2, 4) == (2, 5)


# ------------------------------------------------- plans against plain scans


@quick
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=300), st.integers(-60, 60), st.integers(0, 40), st.sampled_from(["", "First", "Last"]))
def test_monotone_equals_scan(spark, values, low, more, nulls):
    values = sorted(values)
    values = [None] * 3 + values if nulls == "First" else values + [None] * 3 if nulls == "Last" else values
    c = compiler.column(frame(spark, values), FOR if not nulls else Recipe("Nullable", FOR, 128))
    assert compiler.search(c, low, low + more, 16) is not None
    lo, hi = compiler.search(c, low, low + more, 16)
    assert ([(lo, hi)] if lo < hi else []) == scan_spans(values, low, low + more)


@quick
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=300), st.integers(2, 40))
def test_islands_by_levels(spark, values, width):
    df = frame(spark, values)
    assert spans(rows.ranges(df.where("value > 0"), width)) == scan_spans(values, 1, 99)
    runs = sorted((r.start, r.end, r.value) for r in rows.segments(df, "value", width).collect())
    assert runs[0][0] == 0 and runs[-1][1] == len(values) and all(a[1] == b[0] and a[2] != b[2] for a, b in zip(runs, runs[1:]))
    assert all(set(values[a:b]) == {v} for a, b, v in runs)


def test_piecewise_and_runs(spark):
    saw = [7 * (i % 256) for i in range(1000)]
    c = compiler.column(frame(spark, saw), U256)
    q = Query("Filter", low=100, high=900)
    assert compiler.compile_query(q, c).ops[0].name == "SearchPiecewise" and spans(compiler.run(q, c)) == scan_spans(saw, 100, 900)
    values = [7] * 5 + [9] * 3 + [7] * 7 + [9]
    runs, index = codecs.run_length(frame(spark, values), 2)
    c = compiler.column(frame(spark, values), Recipe("RLE", bitpack(), 2))
    q = Query("Count", equals=7)
    assert compiler.compile_query(q, c).ops[0].name == "CountRuns" and compiler.run(q, c).first()[0] == 12
    assert sorted(tuple(r) for r in index.collect()) == [(0, 0), (2, 8), (4, 16)]


def test_licensed_scan_reads_fewer_rows(spark, tmp_path):
    n = 200_000
    spark.range(n).selectExpr("id AS row_id", "id * 3 AS selector", "id % 10 AS value").repartition(1).sortWithinPartitions("row_id").write.option("parquet.page.row.count.limit", 1000).parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    c = compiler.column(t.selectExpr("row_id", "selector AS value"), FOR)
    out = compiler.licensed_predicate_sum(c, t, 3000, 6000)
    assert (out.first()["matched_rows"], int(out.first()["sum"])) == (1001, sum(i % 10 for i in range(1000, 2001)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(row_id,1000)" in plan and "LessThan(row_id,2001)" in plan


# ------------------------------------------------------------------- codecs


@quick
@given(st.lists(st.one_of(st.none(), st.integers(-1000, 1000)), min_size=1, max_size=200), st.integers(0, 5))
def test_round_trips(spark, values, patches):
    df = frame(spark, values)
    if any(v is not None for v in values):
        validity, _, child = codecs.nullable(df, 8)
        assert values_of(codecs.undo_nullable(validity, child)) == values
    dense = [v or 0 for v in values]
    df = frame(spark, dense)
    assert values_of(codecs.undo_frame_of_reference(*codecs.frame_of_reference(df))) == dense
    assert values_of(codecs.undo_delta(*codecs.delta(df, 128), 128)) == dense
    assert values_of(codecs.undo_dictionary(*codecs.dictionary(df))) == dense
    assert values_of(codecs.undo_run_length(codecs.run_length(df, 2, 16)[0])) == dense
    marked = spark.createDataFrame([(i, v, i % 7 < patches) for i, v in enumerate(dense)], "row_id long, value long, is_patch boolean")
    main, exceptions = codecs.patch(marked, 16)
    assert values_of(codecs.undo_patch(main, exceptions)) == dense
    regular = {i: v for i, v in enumerate(dense) if i % 7 >= patches}
    want = [regular[min(regular, key=lambda j: (abs(j - i), j))] for i in range(len(dense))] if regular else [0] * len(dense)
    assert values_of(main) == want


def test_patching_takes_no_square_of_a_block(spark):
    """A frame from the next row to the last is folded anew for every row: no plan of a patched column may have one."""
    marked = frame(spark, [5, 6, 7]).withColumn("is_patch", F.col("row_id") == 1)
    main, exceptions = codecs.patch(marked)
    stored = encoded.encode(marked, Recipe("Patch", FOR, 32)).fields.values()
    for df in (main, codecs.undo_patch(main, exceptions), *stored):
        assert "unboundedfollowing" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_the_nearest_value_may_lie_many_blocks_away(spark):
    """Blocks of one row, in three blocks of blocks; the rows between are patched or absent."""
    at = [0, 1, 5, rows.BLOCK - 1, rows.BLOCK, rows.BLOCK + 9, 2 * rows.BLOCK + 3, 2 * rows.BLOCK + 4]
    regular = {1: 10, rows.BLOCK + 9: 20, 2 * rows.BLOCK + 4: 30}
    marked = spark.createDataFrame([(i, regular.get(i, 99), i not in regular) for i in at], "row_id long, value long, is_patch boolean")
    got = {r.row_id: r.value for r in codecs.patch(marked, 1)[0].collect()}
    assert got == {i: regular[min(regular, key=lambda j: (abs(j - i), j))] for i in at}


def test_a_stored_patch_is_made_once(spark, monkeypatch):
    """The child of a patched column asks for its least and greatest value, and is written in order: not by windows each time."""
    seen, plain = [], codecs.bitpack
    monkeypatch.setattr(codecs, "bitpack", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df))
    marked = frame(spark, [5, 1006, 7]).withColumn("is_patch", F.col("row_id") == 1)
    c = encoded.stored(marked, Recipe("Patch", FOR, 32))
    assert seen and not any("Window" in p for p in seen)
    assert values_of(encoded.decode(c)) == [5, 1006, 7] and c.numbers["2 width"] == 2 and c.numbers["0 exceptions"] == 1


@pytest.mark.parametrize("name", ["decode_chain", "enc_recipe_numbers", "filter_recipe_patch", "sum_recipe_patch", "dec_patch", "enc_patch"])
def test_queries_of_patched_columns_take_no_square_of_a_block(spark, monkeypatch, name):
    """The plan of the result and, where a column is stored, of what its encoding runs."""
    seen, plain = [], codecs.bitpack
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().lower()
    monkeypatch.setattr(encoded, "_kept", {})
    monkeypatch.setattr(codecs, "bitpack", lambda df: seen.append(plan(df)) or plain(df))
    frames, patch = [], codecs.patch
    monkeypatch.setattr(codecs, "patch", lambda *a: frames.append(patch(*a)) or frames[-1])
    result = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert frames and not any("unboundedfollowing" in p for p in (plan(result), *(plan(f) for f in frames[-1]), *seen))


@pytest.mark.parametrize("few", [0, 1 << 18])
@pytest.mark.parametrize("width", [1, 3, 62])
def test_patching_finds_the_nearest_over_gaps(spark, monkeypatch, few, width):
    """Both joins, row ids with gaps, marks that are null (not regular, no exception either), nulls among the values."""
    monkeypatch.setattr(codecs, "FEW", few)
    ids = [i for i in range(700) if i * i % 11 < 7 or 200 < i < 210]
    mark = {i: None if i % 53 == 0 else i % 5 < 2 or 300 < i < 500 for i in ids}
    data = [(i, None if i % 19 == 0 else 3 * i, mark[i]) for i in ids]
    main, exceptions = codecs.patch(spark.createDataFrame(data, "row_id long, value long, is_patch boolean"), width)
    regular = {i: v for i, v, m in data if m is False}
    want = {i: v if m is False else regular[min(regular, key=lambda j: (abs(j - i), j))] or 0 for i, v, m in data}
    assert {r.row_id: r.value for r in main.collect()} == want and main.count() == len(data)
    assert sorted(exceptions.collect()) == [(i, v) for i, v, m in data if m]


@pytest.mark.parametrize("name", ["enc_patch", "dec_patch"])
def test_patching_sends_no_regular_row(spark, name):
    """Few exceptions go to the rows: neither these nor their values are sorted, joined by sorting or put in windows."""
    p = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in p and "SortAggregate" not in p


def test_a_patched_column_is_one_scan(spark):
    """The rows are read once for the result, and neither dealt, sorted nor put in windows: only what was found goes to them."""
    p = QUERIES["enc_patch"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert p.count("FileScan") == 1 and not re.search("Window|Sort|Exchange (hash|range|Single)|Aggregate", p)


@pytest.mark.parametrize("marked, searched", [({3, 4, 5, 9}, False), ({3, 4, 5, 6, 197}, False), ({0, 1, 7}, False), ({20, 198, 199}, False), (set(), False), ({7, 101}, True), (set(range(200)), True)])
def test_patching_searches_only_where_no_row_is_beside(spark, monkeypatch, marked, searched):
    """Runs of patched rows, with a tie in the middle of one; the first and last rows; none; beside row 100, which is absent; all."""
    made, plain = [], codecs._around
    monkeypatch.setattr(codecs, "_around", lambda edge: made.append(1) or plain(edge))
    ids = [i for i in range(200) if i != 100]
    main, exceptions = codecs.patch(spark.createDataFrame([(i, 5 * i, i in marked) for i in ids], "row_id long, value long, is_patch boolean"))
    regular = [i for i in ids if i not in marked]
    want = [5 * min(regular, key=lambda j: (abs(j - i), j)) if regular else 0 for i in ids]
    assert values_of(main) == want and values_of(codecs.undo_patch(main, exceptions)) == [5 * i for i in ids]
    assert bool(made) == searched


@pytest.mark.parametrize("values", [[3, None, 1], [None, 5, 5, 4, None], [1, 2, 3], [None, None], [7] * 3 + [None]])
def test_order_is_made_only_where_spans_do_not_fall(spark, monkeypatch, values):
    wide = [v for v in values for _ in range(facts.SPAN)]
    got = facts.check_column(frame(spark, wide))
    nn = [v for v in wide if v is not None]
    fell = nn != sorted(nn)
    assert got.non_decreasing == (bool(nn) and not fell) and got.rows == len(wide)
    want = facts.monotone(frame(spark, wide)).first()
    assert got.nulls == facts.null_placement(want.n, want.nn, want.lo, want.hi)
    made, plain = [], facts.monotone
    monkeypatch.setattr(facts, "monotone", lambda df: made.append(1) or plain(df))
    assert not facts.check_column(frame(spark, wide[::-1] if nn and not fell and nn[0] < nn[-1] else wide)).non_decreasing or nn == sorted(nn)
    assert bool(made) == (bool(nn) and not fell and nn[0] == nn[-1])


@pytest.mark.parametrize("name", ["Delta@128(BitPack)", "Nullable@8(FOR(BitPack))"])
def test_stored_windows_run_once(spark, monkeypatch, name):
    seen, plain = [], codecs.bitpack
    monkeypatch.setattr(codecs, "bitpack", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df))
    values = [5, 9, 7, 8] if "Delta" in name else [5, None, 7, None]
    c = encoded.stored(frame(spark, values), bridge.parse_recipe(name))
    assert seen and not any("Window" in p for p in seen) and values_of(encoded.decode(c)) == values


def test_encode_errors_and_extremes(spark):
    big = [-(2**63), -1, 0, 2**63 - 1]
    child, base = codecs.frame_of_reference(frame(spark, big))
    assert values_of(codecs.undo_frame_of_reference(child, base)) == big and base == -(2**63)
    for bad in (lambda: codecs.bitpack(frame(spark, [1, -1])), lambda: codecs.bitpack(frame(spark, [1, None])), lambda: codecs.delta(frame(spark, [2, 1]), 128, True), lambda: codecs.delta(frame(spark, [1]), 100), lambda: codecs.frame_of_reference(frame(spark, [None]))):
        with pytest.raises(codecs.EncodeError):
            bad()
    assert codecs.bitpack(frame(spark, [0, 8]))[1] == 4


# -------------------------------------------------------------- certificates


@quick
@given(st.lists(st.one_of(st.none(), st.integers(-100, 100)), min_size=1, max_size=400), st.lists(st.integers(-110, 110), min_size=1, max_size=3))
def test_no_match_is_dropped(spark, values, targets):
    df = frame(spark, values)
    want = sorted(i for i, v in enumerate(values) if v in targets)
    for candidates in (certificates.minmax_probe(certificates.minmax(df, 32), targets), certificates.bloom_probe(certificates.bloom(df, 32), targets, 32)):
        assert [i for a, b in spans(certificates.refine(df, candidates, 32, targets)) for i in range(a, b)] == want


def test_fence(spark):
    values = [i // 17 for i in range(1000)]
    df = frame(spark, values)
    entries, stride = certificates.fence(df, 512, len(values))
    for t in (-1, 0, 7, 58, 99):
        got = spans(certificates.refine(df, certificates.fence_probe(entries, t), stride, [t]))
        assert got == scan_spans(values, t, t)
    for bad in ([1, 3, 2], [1, None, 2]):
        with pytest.raises(ValueError):
            certificates.fence(frame(spark, bad), 64, 3)
    with pytest.raises(ValueError):
        certificates.intersect_candidates(entries, entries, 4, 8)


# ----------------------------------------------- golden example, layout, model


def test_golden_example(spark):
    n = range(16)
    status, meter = [1, 1, 1, 2, 2, 2, 2, 1, 1, 3, 3, 3, 2, 2, 1, 1], [10, 11, 11, 12, 12, 12, 13, 14, 13, 14, 15, 15, 16, 17, 16, 18]
    time = compiler.column(frame(spark, [1700000000 + 60 * i for i in n]), Recipe("UnsignedDelta", bitpack(), 128))
    assert spans(compiler.run(Query("Filter", low=1700000180, high=1700000360), time)) == [(3, 7)]
    assert compiler.run(Query("Sum", 4, 12), compiler.column(frame(spark, meter), FOR)).first()[0] == 108
    df = frame(spark, status)
    c = compiler.column(df, Recipe("Dictionary", Recipe("RLE", bitpack(), 4)))
    q = Query("Filter", low=2, high=2)
    assert compiler.compile_query(q, c).ops[0].name == "TranslateDictionaryRange" and spans(compiler.run(q, c)) == [(3, 7), (12, 14)]
    assert spans(compiler.run(Query("Filter", low=50, high=60), c)) == []
    sparse = compiler.column(frame(spark, [{3: 7, 7: 7, 12: 9}.get(i) for i in n]), Recipe("Nullable", Recipe("Dictionary", Recipe("RLE", bitpack(), 2)), 8))
    assert compiler.compile_query(Query("Filter", low=7, high=9), sparse).ops[0].name == "MaterializeRows"
    assert compiler.run(Query("Get", 7), sparse).first()[0] == 7 and compiler.run(Query("Get", 8), sparse).first()[0] is None
    assert sorted(r.blk for r in certificates.minmax_probe(certificates.minmax(df, 4), [3]).collect()) == [2]


def test_layout():
    assert layout.schedule([(100, 120), (125, 140), (300, 310)], 8) == ([(100, 140), (300, 310)], 45, 50)
    lay = layout.Layout({"data": 64, "index": 1}, {"data": 1000, "index": 16, "frame": 10}, [{"index", "frame"}], {"data": ["index"]})
    assert lay.closure({"data": [(70, 75)]}) == {"data": [(64, 128)], "index": [(0, 16)], "frame": [(0, 10)]}


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 20)).map(lambda t: (t[0], t[0] + t[1])), max_size=20))
def test_merge_covers_exactly(s):
    assert {i for a, b in layout.merge(s) for i in range(a, b)} == {i for a, b in s for i in range(a, b)}


def test_statistics():
    assert statistics.median([3, 1, 2]) == 2 and statistics.median([4, 1, 2, 3]) == 2.5
    assert math.isclose(statistics.sign_test(9, 12), 0.072998046875)
    assert math.isclose(statistics.wilcoxon_exact([math.exp(-x) for x in (1, 2, 3, 4, 5)]), 0.0625)
    with pytest.raises(ValueError):
        statistics.wilcoxon_exact([1.0, 2.0])
    low, high = statistics.bootstrap_median([1.0, 2.0, 3.0, 4.0, 5.0])
    assert 1 <= low <= 3 <= high <= 5 and statistics.bootstrap_median([2.0, 2.0]) == (2.0, 2.0)
    assert statistics.cluster_bootstrap_median({"a": [1.0], "b": [1.0, 1.0]}) == (1.0, 1.0)
    x = [[float(i), float(i % 3)] for i in range(20)]
    model = statistics.fit_cost(x, [math.exp(1 + 0.1 * a + 0.5 * b) for a, b in x])
    assert max(abs(p - math.exp(1 + 0.1 * a + 0.5 * b)) / p for p, (a, b) in zip(statistics.predict_cost(model, x), x)) < 1e-4
    assert scalar.fnv1a(b"") == 0xCBF29CE484222325


def test_cluster_bootstrap_takes_all_groups(spark):
    groups: dict[int, dict[int, list[float]]] = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").collect():
        groups.setdefault(r.user_id % 10, {}).setdefault(r.event_id % 50, []).append((3 + r.event_id % 30) / (3 + r.user_id % 40))
    families = [[statistics.median(v) for _, v in sorted(groups[page].items())] for page in sorted(groups)]
    assert sum(map(len, families)) > 50
    state, out = 0x6A09E667F3BCC909, []
    for _ in range(2000):
        pick = []
        for _ in families:
            state = statistics.xorshift(state)
            inside = families[state % len(families)]
            for _ in inside:
                state = statistics.xorshift(state)
                pick.append(inside[state % len(inside)])
        out.append(statistics.median(pick))
    out.sort()
    got = QUERIES["cluster_bootstrap_interval"](spark, "/root/testdata/sf0.001").first()
    assert math.isclose(got.low, out[50]) and math.isclose(got.high, out[1950])


# -------------------------------------------------------------------- sources


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,value\n2014-02-14 14:27:00,0.50\n2014-02-14 14:32:00,1.25\n")
    got, scale = readers.exact_text(readers.csv_series(spark, str(tmp_path / "a.csv")))
    assert scale == 2 and [(r.row_id, r.ts, r.value) for r in got.orderBy("row_id").collect()] == [(0, 1392388020, 50), (1, 1392388320, 125)]
    (tmp_path / "h.txt").write_text("Date;Time;P\n16/12/2006;17:24:00;4.216\n16/12/2006;17:25:00;?\n")
    assert [(r.ts, r.P) for r in readers.household(spark, str(tmp_path / "h.txt")).orderBy("row_id").collect()] == [(1166289840, "4.216"), (1166289900, None)]
    (tmp_path / "t.csv").write_text("\n".join("" if i % 5 == 0 else str(i) for i in range(200)) + "\n")
    got = readers.tokens(spark, str(tmp_path / "t.csv")).orderBy("row_id").collect()
    assert len(got) == 200 and got[5].value is None and got[7].value == "7"
    (tmp_path / "m.txt").write_text("1 0.5 0.25\n2 1.5 2.5\n")
    assert [r.value for r in readers.matrix(spark, str(tmp_path / "m.txt")).orderBy("place").collect()] == [0.5, 0.25, 1.5, 2.5]
    cols = readers.parquet_columns(spark, "/root/testdata/sf0.001/events.parquet")
    assert {"event_id", "ts", "user_id", "value"} <= set(cols) and cols["value"].where("row_id = 0").count() == 1
    p = readers.profile(spark, "Trend", 1000, "some", True)
    assert p.where("value IS NULL").count() == 59 and p.where("is_patch").count() == 1
    df = readers.synthetic(spark, "linear", 500)
    for write, read in ((readers.write_parquet, spark.read.parquet), (readers.write_orc, spark.read.orc)):
        path = str(tmp_path / write.__name__)
        write(df, path)
        assert sorted(map(tuple, read(path).collect())) == [(i, 20 + 2 * i) for i in range(500)]
    stats = census.column_stats(df.selectExpr("'a' AS col", "row_id", "value")).first()
    assert stats.uniq == 500 and not stats.small_domain
