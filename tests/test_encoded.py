"""The encode driver, decoding of row ranges, stored columns, pages, sinks and corpora."""

import glob
import json

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from licet.functions import statistics
from licet.operators import schedules
from licet.operators.codecs import EncodeError
from licet.plans import bridge, compiler, encoded, layout
from licet.plans.plan import Op, Plan, Query, validate_plan
from licet.sources import arms, pages, readers

quick = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "row_id long, value long")


def spans(values, low, high):
    out = []
    for i, v in enumerate(values):
        if v is not None and low <= v <= high:
            if out and out[-1][1] == i:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((i, i + 1))
    return out


def test_a_licence_needs_values_that_meet_the_encoding(spark):
    """5, 1, 5, 1 ... is no unsigned delta: no facts of the name may license a search."""
    df = frame(spark, [5, 1] * 10)
    ask = {"op": "run", "query": {"kind": "filter_equals", "value": 5}}
    with pytest.raises(EncodeError):
        bridge.serve(df, json.dumps(ask | {"recipe": "UnsignedDelta(BitPack)"}))
    got = json.loads(bridge.serve(df, json.dumps(ask | {"recipe": "FOR(BitPack)"})))
    assert [(r["start"], r["end"]) for r in got["answer"]] == [(i, i + 1) for i in range(0, 20, 2)]


@pytest.mark.parametrize("recipe, values", [("Nullable(FOR(BitPack))", [None, None]), ("FOR(BitPack)", [1, None]), ("BitPack", [-1]), ("FOR(BitPack)", []), ("FOR(BitPack)", [-(2**63), 2**63 - 1])])
def test_what_no_recipe_takes(spark, recipe, values):
    with pytest.raises(Exception, match="nulls|without rows|negative|OVERFLOW|overflow|CAST"):
        encoded.encode(frame(spark, values), bridge.parse_recipe(recipe))


NAMES = ["BitPack", "FOR(BitPack)", "Delta@128(BitPack)", "Dictionary(BitPack)", "Dictionary(RLE@4(BitPack))", "RLE@4(FOR(BitPack))", "FOR(Delta@128(BitPack))", "Patch@4(FOR(BitPack))", "Frame(FOR(BitPack))"]


@quick
@given(st.lists(st.integers(0, 30), min_size=1, max_size=200), st.sampled_from(NAMES), st.integers(0, 200), st.integers(0, 200), st.integers(0, 30), st.integers(0, 10), st.booleans())
def test_every_recipe_and_query_against_the_values(spark, values, name, a, b, low, more, nulls):
    if nulls and not name.startswith("Frame"):
        name, values = f"Nullable@8({name})", [None if i % 7 == 3 else v for i, v in enumerate(values)] + [1]
    left, right = sorted((a % (len(values) + 1), b % (len(values) + 1)))
    df = frame(spark, values)
    c = encoded.encode(df, bridge.parse_recipe(name))
    assert [r.value for r in encoded.decode(c).orderBy("row_id").collect()] == values
    assert [r.value for r in encoded.decode(c, left, right).orderBy("row_id").collect()] == values[left:right]
    assert compiler.run(Query("Sum", left, right), c).first()[0] == sum(v or 0 for v in values[left:right])
    got = sorted(map(tuple, compiler.run(Query("Filter", low=low, high=low + more), c).select("start", "end").collect()))
    assert got == spans(values, low, low + more)
    assert compiler.run(Query("Count", equals=low), c).first()[0] == values.count(low)
    i = left % len(values)
    assert compiler.run(Query("Get", i), c).first().value == values[i]


def test_bridge_serves_every_recipe(spark):
    df = frame(spark, [3, 3, 7, 7, 7, 9])
    for name in NAMES:
        # sums and single rows: the property test above
        for q, want in (({"kind": "filter_equals", "value": 7}, [{"start": 2, "end": 5}]), ({"kind": "count_equals", "value": 7}, [{"count": 3}])):
            got = json.loads(bridge.serve(df, json.dumps({"op": "run", "recipe": name, "query": q})))
            assert got["answer"] == want, (name, q)
    made = json.loads(bridge.serve(df, json.dumps({"op": "encode", "recipe": "Dictionary(BitPack)"})))
    assert made["numbers"]["0 entries"] == 3 and made["fields"][0] == {"kind": "dictionary", "bytes": 24}


def test_stored_columns_are_reused_until_the_input_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    frame(spark, list(range(0, 9000, 3))).coalesce(1).write.parquet(path)
    recipe = bridge.parse_recipe("FOR(BitPack)")
    read = lambda: spark.read.parquet(path).select("row_id", "value")
    c = encoded.stored(read(), recipe)
    assert encoded.stored(read(), recipe) is c
    assert encoded.stored(read().selectExpr("row_id", "value + 1 AS value"), recipe) is not c
    assert sorted(map(tuple, compiler.run(Query("Filter", low=3000, high=3010), c).collect())) == [(1000, 1004)]
    assert c.tops["values"][0] == encoded.STRIDE and len(c.tops["values"][1]) == 3
    spark.catalog.clearCache()
    frame(spark, [5, 6]).coalesce(1).write.mode("overwrite").parquet(path)
    assert encoded.stored(read(), recipe).checked.rows == 2


def test_plans_are_validated():
    for bad in (Plan(Query("Get"), (), "ExactScalar"), Plan(Query("Get"), (Op("Guess"),), "ExactScalar"), Plan(Query("Get"), (Op("DecodeRow", 3),), "ExactScalar"), Plan(Query("Filter"), (Op("MaterializeRows"),), "ExactScalar")):
        with pytest.raises(ValueError):
            validate_plan(bad)


def test_access_counts_each_byte_once():
    assert layout.access([(0, 10), (5, 20), (100, 110)], 8) == {"logical": 35, "delivered": 24 + 16, "operations": 3}
    assert layout.access([(0, 8), (0, 8)]) == {"logical": 16, "delivered": 8, "operations": 1}


def test_damaged_pages_are_rejected():
    values, valid = np.array([3, 0, -(2**63), 2**63 - 1, 5]), np.array([True, False, True, True, True])
    raw = pages.pack(values, valid)
    back, there = pages.unpack(raw)
    assert (there == valid).all() and (back[valid] == values[valid]).all()
    for i in range(len(raw)):
        with pytest.raises(ValueError):
            pages.unpack(raw[:i] + bytes([raw[i] ^ 1]) + raw[i + 1 :])
    for cut in (0, 10, len(raw) - 1):
        with pytest.raises(ValueError):
            pages.unpack(raw[:cut])


def test_sinks_write_the_encodings_they_name(spark, tmp_path):
    df = readers.synthetic(spark, "linear", 20_000)
    for write in (readers.write_parquet_dictionary, readers.write_parquet_delta):
        write(df, str(tmp_path / write.__name__))
    column = lambda name: pq.ParquetFile(glob.glob(str(tmp_path / name / "*.parquet"))[0]).metadata.row_group(0).column(1)
    a, b = column("write_parquet_dictionary"), column("write_parquet_delta")
    assert a.compression == "SNAPPY" and "DELTA_BINARY_PACKED" in b.encodings and b.compression == "ZSTD"
    readers.write_pair(df.selectExpr("row_id", "value AS timestamp", "value"), str(tmp_path / "pair"), 100)
    assert sum(pq.ParquetFile(f).metadata.num_rows for f in glob.glob(str(tmp_path / "pair" / "*.parquet"))) == 20_000
    readers.write_results(df.limit(3), str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).columns == ["row_id", "value"]


def test_token_directory(spark, tmp_path):
    (tmp_path / "t__c0_price.csv").write_text("\n".join("" if i % 9 == 0 else f"{i}.25" for i in range(200)) + "\n")
    (tmp_path / "t__c1_timestamp.csv").write_text("\n".join(str(1000 + i) for i in range(200)) + "\n")
    (tmp_path / "t__c2_short.csv").write_text("1\n2\n")
    (tmp_path / "t__c3_words.csv").write_text("x\n" * 200)
    got = {(c["source"], c["name"]): c for c in readers.token_directory(spark, str(tmp_path))}
    assert set(got) == {("t", "c0_price"), ("t", "timestamp")}
    assert got["t", "c0_price"]["scale"] == 2 and got["t", "c0_price"]["rows"].where("row_id = 3").first().value == 325
    assert got["t", "timestamp"]["rows"].where("row_id = 3").first().value == 1003


def test_read_counts(spark, tmp_path):
    spark.range(50_000).selectExpr("id AS row_id", "id * 2 AS selector", "id % 10 AS value").coalesce(1).write.option("parquet.page.row.count.limit", 1000).parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    few, all_ = arms.read_counts(arms.row_filter(t, 2000, 4000)), arms.read_counts(arms.full(t, 2000, 4000))
    assert all_["rows"] == 50_000 and few["rows"] < 5_000 and few["bytes"] == all_["bytes"] > 0


def test_shuffled_order(spark):
    got = spark.range(50).select("id", schedules.shuffled("id").alias("k")).collect()
    assert all(int(r.k) == schedules.shuffled_key(r.id) for r in got)


def test_cost_model_in_two_ways(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 50, (300, len(statistics.FEATURES))).astype(float)
    y = np.exp(2 + x @ np.linspace(0.001, 0.02, x.shape[1]))
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], ", ".join(f"{f} double" for f in statistics.FEATURES) + ", ns double")
    a, b = statistics.fit_cost(x, y), statistics.fit_cost_frame(df, list(statistics.FEATURES), "ns")
    assert np.allclose(a["weights"], b["weights"], atol=1e-6) and np.allclose(statistics.predict_cost(a, x), y, rtol=1e-4)
    with pytest.raises(ValueError):
        statistics.fit_cost(x[:10], y[:10])
