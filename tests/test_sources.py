"""Raw pages, read arms, schedules, the bridge and the census's further operators."""

import json

import numpy as np
import pytest

from licet.functions import statistics
from licet.operators import census, certificates, predicates, rows, schedules
from licet.plans import bridge, layout
from licet.sources import arms, raw


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "row_id long, value long")


@pytest.mark.parametrize("values", [[5], [None], [1, None, -3, 2**63 - 1, -(2**63)], list(range(20)), [None] * 17])
def test_raw_page(values):
    valid = np.array([v is not None for v in values])
    page = raw.pack(np.array([v or 0 for v in values], dtype=np.int64), valid)
    got, ok = raw.unpack(page)
    assert [int(v) if k else None for v, k in zip(got, ok)] == values
    for bad in (page[:19], b"X" + page[1:], page + b"0", page[:-1]):
        with pytest.raises(ValueError):
            raw.unpack(bad)


def test_raw_frame(spark):
    values = [None if i % 7 == 0 else 2**62 + i for i in range(1000)]
    got = raw.from_raw(raw.to_raw(frame(spark, values), 128), 128).orderBy("row_id").collect()
    assert [(r.row_id, r.value) for r in got] == list(enumerate(values))
    assert raw.to_raw(frame(spark, values).limit(0)).count() == 0


def test_arms_agree(spark):
    df = spark.range(5000).selectExpr("id AS row_id", "nullif(id * 7919 % 997, 13) AS selector", "nullif(id % 31, 4) AS value")
    want = arms.row_filter(df, 5, 60).first()
    assert arms.full(df, 5, 60).first() == want and arms.page_filter(df, 5, 60, 256).first() == want
    spans = rows.ranges(df.where("selector BETWEEN 5 AND 60"))
    assert arms.row_selection(df, spans).first() == want
    with pytest.raises(ValueError):
        arms.page_candidates(df, 2, 1, 256)


@pytest.mark.parametrize("gap", [0, 9])
def test_span_union_in_parts(spark, gap):
    rng = np.random.default_rng(3)
    spans = [(int(s), int(s) + int(n) * (40 if i % 60 == 0 else 1)) for i, (s, n) in enumerate(zip(rng.integers(0, 40_000, 2000), rng.integers(1, 30, 2000)))]
    spans += spans[:50]
    got = rows.span_union(spark.createDataFrame(spans, "start long, end long"), gap).collect()
    assert sorted((r.start, r.end) for r in got) == layout.merge(spans, gap)


def test_schedule_policies(spark):
    reads = [(0, 100, 120), (0, 118, 140), (1, 300, 310), (1, 900, 1000)]
    got = {r.policy: (r.reads, int(r.bytes)) for r in schedules.policies(spark.createDataFrame(reads, "page long, start long, end long")).collect()}
    assert got["per_page"] == (3, 150) and got["sorted_closure"] == (3, 150) and got["full_file"] == (1, 1000)
    assert got["coalesce_512b"] == (2, 310) or got["coalesce_512b"] == (1, 900)
    none = spark.createDataFrame([], "page long, start long, end long")
    assert all((r.reads, r.bytes) == (0, 0) for r in schedules.policies(none).collect())
    assert len({schedules.shuffled_key(p) for p in range(1000)}) == 1000


def test_bridge(spark):
    df = frame(spark, [10, 20, 20, 30, 50])
    ask = lambda **r: json.loads(bridge.serve(df, json.dumps(r)))
    name = "Dictionary(RLE@32(BitPack))"
    assert bridge.parse_recipe(name).name() == name
    assert "FOR" in ask(op="recipes")["recipes"]
    assert any(f["property"] == "NonDecreasing" for f in ask(op="facts", recipe="FOR(BitPack)")["facts"])
    q = {"kind": "filter_between", "low": 20, "high": 30}
    plan = ask(op="compile", recipe="FOR(BitPack)", query=q)
    assert plan["ops"][0]["op"] == "SearchMonotone" and len(plan["signature"]) == 16
    assert ask(op="run", recipe="FOR(BitPack)", query=q)["answer"] == [{"start": 1, "end": 4}]
    assert ask(op="run", recipe="FOR(BitPack)", query={"kind": "sum"})["answer"] == [{"sum": 130}]
    assert ask(op="run", recipe="FOR(BitPack)", query={"kind": "filter_equals", "value": 20})["answer"] == [{"start": 1, "end": 3}]
    for bad in ("BitPack(FOR)", "FOR", "Nope(BitPack)", "FOR(BitPack"):
        with pytest.raises(ValueError):
            bridge.parse_recipe(bad)
    for bad in ({"kind": "get"}, {"kind": "nope"}, {"kind": "get", "row": 9}, {"kind": "between", "low": 3, "high": 1}):
        with pytest.raises(ValueError):
            bridge.serve(df, json.dumps({"op": "run", "recipe": "FOR(BitPack)", "query": bad}))


def test_absent_value(spark):
    absent = lambda v: {r.name: r.value for r in certificates.query_set(frame(spark, v)).collect()}["eq_absent"]
    top = 2**63 - 1
    assert absent([1, 2, 5]) == 3 and absent([1, 2, None]) == 3 and absent([top, top - 1]) == top - 2 and absent([-(2**63)]) == -(2**63) + 1


def test_census_more(spark):
    assert census.natural_runs(frame(spark, [1, 1, None, None, 2, 1])).first()["runs"] == 4
    assert predicates.widths(5) == [0, 1, 2, 5] and predicates.widths(20_000) == [1, 20, 200, 2000, 10_000, 20_000]
    t = spark.createDataFrame([("s", "a", 0), ("s", "a", 0), ("s", "timestamp", 1), ("s", "timestamp", 1), ("s", "b", 2), ("u", "x", 0)], "source string, col string, place int")
    assert [tuple(r) for r in census.pairs(t).collect()] == [("s", "timestamp", "a")]


def test_cost_from_aggregates(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 3)), np.exp(rng.normal(size=60))
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")
    got, want = statistics.fit_cost_frame(df, ["a", "b", "c"], "y"), statistics.fit_cost(x, y)
    assert np.allclose(got["weights"], want["weights"]) and np.allclose(got["mean"], want["mean"])
    with pytest.raises(ValueError):
        statistics.fit_cost_frame(df.limit(3), ["a", "b", "c"], "y")
