"""Queries of the engine's own operators, with equivalent SQL.

``e`` is an ordered column made from ``events`` (row_id = event_id); a column
is given once for Spark and once for SQL where the dialects differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar, statistics
from .operators import census, certificates, codecs, predicates, rows, scans, schedules
from .plans import bridge, compiler, encoded, facts, layout
from .plans.plan import Query
from .plans.recipe import Recipe, bitpack
from .sources import arms, raw

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TS = ("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)", "epoch_us(ts)")
COLUMNS = {
    "ts": TS,
    "cents": ("CAST(round(value * 100) AS BIGINT)",) * 2,
    "user": ("user_id",) * 2,
    "holes": ("CASE WHEN event_id % 17 = 0 THEN NULL ELSE user_id END",) * 2,
    "nulls_first": ("CASE WHEN event_id < 100 THEN NULL ELSE 7 * event_id END",) * 2,
    "nulls_last": ("CASE WHEN event_id >= {nine_tenths} THEN NULL ELSE 7 * event_id END", "CASE WHEN event_id >= (SELECT 9 * count(*) // 10 FROM events) THEN NULL ELSE 7 * event_id END"),
    "saw": ("4000000 + 7 * (event_id % 256)",) * 2,
    "patched": ("1000000 + 7 * event_id + CASE WHEN event_id % 997 = 503 THEN 1000000000 ELSE 0 END",) * 2,
    "steps": ("user_id % 7",) * 2,
}
DICT = Recipe("Dictionary", bitpack())
FOR = Recipe("FOR", bitpack())
RUN = Recipe("RLE", bitpack(), 32)


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def col(spark: SparkSession, d: str, name: str) -> DataFrame:
    made, e = COLUMNS[name][0], events(spark, d)
    if "{nine_tenths}" in made:
        made = made.format(nine_tenths=9 * e.count() // 10)
    return e.selectExpr("event_id AS row_id", f"CAST({made} AS BIGINT) AS value")


def sql_col(name: str) -> str:
    return f"(SELECT event_id AS row_id, CAST({COLUMNS[name][1]} AS BIGINT) AS value FROM events)"


def chats(spark: SparkSession, d: str) -> DataFrame:
    """conv_id as a column of runs, in the order of conversation and turn."""
    key = spark.sparkContext.applicationId, d
    if key not in _chats:  # ranking looks at the rows once, to cut their order
        c = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn")
        _chats[key] = rows.ranked(c, "conv_id", "row_id", "turn").select("row_id", F.col("conv_id").alias("value"))
    return _chats[key]


_chats: dict[tuple[str, str], DataFrame] = {}


CHATS = "(SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_id, conv_id AS value FROM conversations)"


def islands(matches: str) -> str:
    return f"SELECT CAST(min(row_id) AS BIGINT) AS \"start\", CAST(max(row_id) + 1 AS BIGINT) AS \"end\" FROM (SELECT row_id, row_id - row_number() OVER (ORDER BY row_id) AS g FROM ({matches})) GROUP BY g"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def big(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in (names or df.columns)})


def ntile_bounds(c: str, k: int) -> str:
    """SQL of (low, high): the centred window of k thousandths."""
    w = f"greatest(1, n * {k} // 1000)"
    return f"""SELECT max(value) FILTER (r = (n - {w}) // 2) AS low, max(value) FILTER (r = (n - {w}) // 2 + {w} - 1) AS high
      FROM (SELECT value, row_number() OVER (ORDER BY value, row_id) - 1 AS r, count(*) OVER () AS n FROM {c} WHERE value IS NOT NULL)"""


# ------------------------------------------------------------ flagship, scans


@query("flagship_predicate_sum", f"""WITH b AS ({ntile_bounds(sql_col('ts'), 100)})
SELECT CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT)), 0) AS BIGINT) AS sum, count(*) AS matched_rows
FROM events, b WHERE epoch_us(ts) BETWEEN low AND high""")
def flagship(spark, d):
    c = compiler.column(col(spark, d, "ts"), FOR, keep=True)
    n = c.checked.rows
    width = max(1, n * 100 // 1000)
    start = (n - width) // 2
    if c.checked.non_decreasing:
        low, high = compiler.gets(c, [start, start + width - 1])
    else:
        low, high = predicates.window_bounds(c.rows, n)
    both = events(spark, d).selectExpr("event_id AS row_id", f"{TS[0]} AS selector", f"{COLUMNS['cents'][0]} AS value")
    return big(compiler.licensed_predicate_sum(c, both, low, high))


@query("predicate_sum_scan", f"""WITH b AS ({ntile_bounds('(SELECT l_orderkey * 8 + l_linenumber AS row_id, epoch_us(l_shipdate) AS value FROM lineitem)', 100)})
SELECT CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS sum, count(*) AS matched_rows FROM lineitem, b WHERE epoch_us(l_shipdate) BETWEEN low AND high""")
def predicate_scan(spark, d):
    ship = TS[0].replace("ts)", "l_shipdate)")
    t = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey * 8 + l_linenumber AS row_id", f"{ship} AS selector", "CAST(l_quantity AS BIGINT) AS value")
    c = t.select("row_id", F.col("selector").alias("value"))
    low, high = predicates.window_bounds(c, c.count())
    return big(scans.predicate_sum(t, low, high))


def _run(name, q, recipe=FOR):
    return lambda spark, d: compiler.run(q, compiler.column(col(spark, d, name), recipe, keep=True))


query("get_row", f"SELECT value FROM {sql_col('cents')} WHERE row_id = 500")(_run("cents", Query("Get", 500)))
query("get_null_row", f"SELECT value FROM {sql_col('holes')} WHERE row_id = 510")(_run("holes", Query("Get", 510), Recipe("Nullable", FOR, 128)))
query("sum_rows", f"SELECT CAST(coalesce(sum(value), 0) AS BIGINT) AS sum FROM {sql_col('cents')} WHERE row_id >= 333 AND row_id < 777")(lambda s, d: big(_run("cents", Query("Sum", 333, 777))(s, d)))
query("sum_rows_empty", f"SELECT CAST(coalesce(sum(value), 0) AS BIGINT) AS sum FROM {sql_col('cents')} WHERE row_id >= 5 AND row_id < 5")(lambda s, d: big(_run("cents", Query("Sum", 5, 5))(s, d)))
query("between_rows_ranges", islands(f"SELECT row_id FROM {sql_col('cents')} WHERE row_id >= 200 AND row_id < 800 AND value BETWEEN 2000 AND 9000"))(_run("cents", Query("Between", 200, 800, 2000, 9000)))
query("filter_between_ranges", islands(f"SELECT row_id FROM {sql_col('cents')} WHERE value BETWEEN 2000 AND 9000"))(_run("cents", Query("Filter", low=2000, high=9000)))
query("filter_equals_ranges", islands(f"SELECT row_id FROM {sql_col('steps')} WHERE value = 3"))(lambda s, d: scans.filter_equals(col(s, d, "steps"), 3))
query("count_equals_scan", f"SELECT count(*) AS count FROM {sql_col('steps')} WHERE value = 3")(_run("steps", Query("Count", equals=3)))


@query("count_equals_runs", f"SELECT count(*) AS count FROM {CHATS} WHERE value = 7")
def count_runs(spark, d):
    return big(compiler.run(Query("Count", equals=7), compiler.column(chats(spark, d), RUN, keep=True)))


@query("sum_rows_on_runs", f"SELECT CAST(coalesce(sum(value), 0) AS BIGINT) AS sum FROM {CHATS} WHERE row_id >= 11 AND row_id < 60")
def sum_runs(spark, d):
    return big(scans.sum_run_rows(codecs.run_length(chats(spark, d))[0], 11, 60))


query("filter_monotone_search", islands(f"SELECT row_id FROM {sql_col('ts')} WHERE value BETWEEN (SELECT value FROM {sql_col('ts')} WHERE row_id = 300) AND (SELECT value FROM {sql_col('ts')} WHERE row_id = 640)"))(
    lambda s, d: (lambda c: compiler.run(Query("Filter", **dict(zip(("low", "high"), compiler.gets(c, [300, 640])))), c))(compiler.column(col(s, d, "ts"), FOR, keep=True))
)
query("filter_monotone_nulls_first", islands(f"SELECT row_id FROM {sql_col('nulls_first')} WHERE value BETWEEN 900 AND 4000"))(_run("nulls_first", Query("Filter", low=900, high=4000), Recipe("Nullable", FOR, 128)))
query("filter_monotone_nulls_last", islands(f"SELECT row_id FROM {sql_col('nulls_last')} WHERE value BETWEEN 900 AND 9000"))(_run("nulls_last", Query("Filter", low=900, high=9000), Recipe("Nullable", FOR, 128)))
query("filter_piecewise_search", islands(f"SELECT row_id FROM {sql_col('saw')} WHERE value BETWEEN 4000350 AND 4001300"))(_run("saw", Query("Filter", low=4000350, high=4001300), Recipe("UnsignedDelta", bitpack(), 256)))


@query("filter_dictionary_translate", islands(f"SELECT row_id FROM {sql_col('user')} WHERE value BETWEEN 20 AND 60"))
def translate(spark, d):
    return compiler.run(Query("Filter", low=20, high=60), compiler.column(col(spark, d, "user"), DICT, keep=True))


SPANS = "(SELECT 100 * i AS \"start\", 100 * i + 37 AS \"end\" FROM range(9) t(i))"
query("sum_over_ranges", f"SELECT CAST(coalesce(sum(value), 0) AS BIGINT) AS sum, count(*) AS matched_rows FROM {sql_col('cents')} JOIN {SPANS} ON row_id >= \"start\" AND row_id < \"end\"")(
    lambda s, d: big(scans.sum_over_ranges(col(s, d, "cents"), s.range(9).select((F.col("id") * 100).alias("start"), (F.col("id") * 100 + 37).alias("end"))))
)


@query("known_selection_sum", f"SELECT CAST(coalesce(sum(v.value), 0) AS BIGINT) AS sum, count(*) AS matched_rows FROM {sql_col('cents')} v JOIN {sql_col('steps')} s USING (row_id) WHERE s.value = 3")
def known_selection(spark, d):
    return big(scans.sum_over_ranges(col(spark, d, "cents"), scans.filter_equals(col(spark, d, "steps"), 3)))


@query("selectivity_predicates", f"""WITH s(i, label, k) AS (VALUES (0, '0.1%', 1), (1, '1%', 10), (2, '10%', 100), (3, '50%', 500)),
c AS (SELECT value, row_number() OVER (ORDER BY value, row_id) - 1 AS r, count(*) OVER () AS n FROM {sql_col('user')}),
w AS (SELECT i, label, greatest(1, n * k // 1000) AS width, n FROM s, (SELECT max(n) AS n FROM c)),
p AS (SELECT i, label, (SELECT value FROM c WHERE r = (w.n - width) // 2) AS low, (SELECT value FROM c WHERE r = (w.n - width) // 2 + width - 1) AS high FROM w)
SELECT low, high, string_agg(label, '+' ORDER BY i) AS labels FROM p GROUP BY low, high""")
def selectivities(spark, d):
    c = col(spark, d, "user")
    return predicates.quantile_windows(c, c.count())


@query("quartile_bounds", f"SELECT max(value) FILTER (r = n // 4) AS q1, max(value) FILTER (r = 3 * n // 4) AS q3 FROM (SELECT value, row_number() OVER (ORDER BY value, row_id) - 1 AS r, count(*) OVER () AS n FROM {sql_col('cents')})")
def quartile_bounds(spark, d):
    c = col(spark, d, "cents")
    return predicates.quartiles(c, c.count())


# ------------------------------------------------------------------- encodings

query("enc_bit_width", f"SELECT CAST(length(bin(max(value))) AS BIGINT) AS width FROM {sql_col('user')}")(lambda s, d: col(s, d, "user").agg(scalar.bit_width(F.max("value")).alias("width")))
FOR_SQL = f"SELECT row_id, value - (SELECT min(value) FROM {sql_col('cents')}) AS value FROM {sql_col('cents')}"
query("enc_for", FOR_SQL)(lambda s, d: big(codecs.frame_of_reference(col(s, d, "cents"))[0], "value"))
STEP = "coalesce(value - lag(value) OVER (PARTITION BY row_id // 256 ORDER BY row_id), 0)"
query("enc_delta_zigzag", f"SELECT row_id, CASE WHEN s >= 0 THEN 2 * s ELSE -2 * s - 1 END AS code FROM (SELECT row_id, {STEP} AS s FROM {sql_col('cents')})")(lambda s, d: codecs.delta(col(s, d, "cents"), 256)[0])
query("enc_delta_unsigned", f"SELECT row_id, {STEP} AS code FROM {sql_col('saw')}")(lambda s, d: codecs.delta(col(s, d, "saw"), 256, True)[0])
query("enc_dictionary", f"SELECT row_id, dense_rank() OVER (ORDER BY value) - 1 AS id FROM {sql_col('user')}")(lambda s, d: big(codecs.dictionary(col(s, d, "user"))[0], "id"))
RUNS = f"(SELECT min(row_id) AS \"start\", max(row_id) + 1 AS \"end\", value, count(*) AS length FROM (SELECT row_id, value, sum(c) OVER (ORDER BY row_id) AS g FROM (SELECT row_id, value, CASE WHEN value IS DISTINCT FROM lag(value) OVER (ORDER BY row_id) OR row_id = 0 THEN 1 ELSE 0 END AS c FROM {CHATS})) GROUP BY g, value)"
query("enc_rle", f"SELECT row_number() OVER (ORDER BY \"start\") - 1 AS run_id, value, \"start\", \"end\", length FROM {RUNS}")(lambda s, d: big(codecs.run_length(chats(s, d))[0]))
query("enc_rle_index", f"WITH r AS (SELECT row_number() OVER (ORDER BY \"start\") - 1 AS run_id, \"start\", \"end\" FROM {RUNS}) SELECT run_id, \"start\" FROM r WHERE run_id % 4 = 0 UNION ALL SELECT max(run_id) + 1, max(\"end\") FROM r")(lambda s, d: big(codecs.run_length(chats(s, d), 4)[1]))


def patched(spark, d):
    return col(spark, d, "patched").withColumn("is_patch", F.col("row_id") % 997 == 503)


# patched rows are alone, so the left neighbour is the nearest regular value
query("enc_patch", f"SELECT row_id, CASE WHEN row_id % 997 = 503 THEN lag(value) OVER (ORDER BY row_id) ELSE value END AS value FROM {sql_col('patched')}")(lambda s, d: codecs.patch(patched(s, d))[0])
query("enc_nullable_rank", f"SELECT row_id // 128 AS interval, CAST(coalesce(r, 0) AS BIGINT) AS rank FROM (SELECT row_id, sum(CASE WHEN value IS NULL THEN 0 ELSE 1 END) OVER (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {sql_col('holes')}) WHERE row_id % 128 = 0")(lambda s, d: big(codecs.nullable(col(s, d, "holes"))[1]))

SAME = "SELECT row_id, value FROM {}"


@query("dec_for", SAME.format(sql_col("cents")))
def dec_for(spark, d):
    return codecs.undo_frame_of_reference(*codecs.frame_of_reference(col(spark, d, "cents")))


@query("dec_delta", SAME.format(sql_col("cents")))
def dec_delta(spark, d):
    return codecs.undo_delta(*codecs.delta(col(spark, d, "cents"), 256), 256)


@query("dec_delta_unsigned", SAME.format(sql_col("saw")))
def dec_delta_unsigned(spark, d):
    return codecs.undo_delta(*codecs.delta(col(spark, d, "saw"), 256, True), 256, True)


@query("dec_dictionary", SAME.format(sql_col("user")))
def dec_dictionary(spark, d):
    return codecs.undo_dictionary(*codecs.dictionary(col(spark, d, "user")))


query("dec_rle", SAME.format(CHATS))(lambda s, d: codecs.undo_run_length(codecs.run_length(chats(s, d))[0]))
query("dec_patch", SAME.format(sql_col("patched")))(lambda s, d: codecs.undo_patch(*codecs.patch(patched(s, d))))


@query("dec_nullable", SAME.format(sql_col("holes")))
def dec_nullable(spark, d):
    validity, _, child = codecs.nullable(col(spark, d, "holes"))
    return codecs.undo_nullable(validity, child)


# ------------------------------------------------------------ scalar functions


@query("scale_verified_decimal", "SELECT 2 AS scale, event_id AS row_id, CAST(round(value * 100) AS BIGINT) AS value FROM events")
def scale_verified(spark, d):
    e = events(spark, d)
    s = scalar.verified_scale(e, "value")
    return e.select(F.lit(s).alias("scale"), F.col("event_id").alias("row_id"), scalar.scaled(F.col("value"), s).alias("value"))


query("scale_from_text", "SELECT o_orderkey AS row_id, CAST(CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS DECIMAL(20,4)) * 10000 AS BIGINT) AS value FROM orders")(
    lambda s, d: s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("row_id"), scalar.scaled_text(F.col("o_totalprice").cast("decimal(20,2)").cast("string"), 4).alias("value"))
)
query("text_decimals", "SELECT o_orderkey AS row_id, CAST(length(rtrim(split_part(CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS VARCHAR), '.', 2), '0')) AS INTEGER) AS decimals FROM orders")(
    lambda s, d: s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("row_id"), scalar.text_decimals(F.col("o_totalprice").cast("decimal(20,2)").cast("string")).alias("decimals"))
)
query("parse_ts", "SELECT event_id AS row_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS value FROM events")(lambda s, d: events(s, d).select(F.col("event_id").alias("row_id"), scalar.parse_ts(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("value")))
query("zigzag_roundtrip", f"SELECT row_id, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS code, v AS value FROM (SELECT row_id, value - 5000 AS v FROM {sql_col('cents')})")(
    lambda s, d: col(s, d, "cents").select("row_id", scalar.zigzag(F.col("value") - 5000).alias("code"), scalar.unzigzag(scalar.zigzag(F.col("value") - 5000)).alias("value"))
)

# ----------------------------------------------------------------------- facts


@query("fact_null_placement", "SELECT * FROM (VALUES ('holes', 'Arbitrary'), ('nulls_first', 'First'), ('nulls_last', 'Last'), ('ts', 'NoNulls')) t(col, placement)")
def placement(spark, d):
    names = ("holes", "nulls_first", "nulls_last", "ts")
    return spark.createDataFrame([(n, facts.check_column(col(spark, d, n)).nulls) for n in names], "col string, placement string")


@query("fact_non_decreasing", " UNION ALL ".join(f"SELECT '{n}' AS col, bool_and(coalesce(value >= p, true)) AS non_decreasing FROM (SELECT value, lag(value) OVER (ORDER BY row_id) AS p FROM {sql_col(n)} WHERE value IS NOT NULL)" for n in ("ts", "cents", "nulls_first")))
def non_decreasing(spark, d):
    out = None
    for n in ("ts", "cents", "nulls_first"):
        one = facts.monotone(col(spark, d, n)).select(F.lit(n).alias("col"), "non_decreasing")
        out = one if out is None else out.unionByName(one)
    return out


query("fact_piecewise", f"SELECT blk, bool_and(coalesce(value >= p, true)) AS non_decreasing FROM (SELECT row_id // 256 AS blk, value, lag(value) OVER (PARTITION BY row_id // 256 ORDER BY row_id) AS p FROM {sql_col('saw')}) GROUP BY blk")(lambda s, d: facts.piecewise(col(s, d, "saw"), 256))

# ---------------------------------------------------------------------- census

CENSUS = ("ts", "cents", "user", "holes", "saw")
LONG = "(" + " UNION ALL ".join(f"SELECT '{n}' AS col, * FROM {sql_col(n)}" for n in CENSUS) + ")"


def long(spark, d):
    expr = ", ".join(f"'{n}', CAST({COLUMNS[n][0]} AS BIGINT)" for n in CENSUS)
    return events(spark, d).selectExpr("event_id AS row_id", f"stack({len(CENSUS)}, {expr}) AS (col, value)")


STATS = f"SELECT col, count(*) AS rows, count(*) - count(value) AS nulls, count(DISTINCT value) AS uniq, count(DISTINCT value) <= 256 OR 8 * count(DISTINCT value) <= count(value) AS small_domain FROM {LONG} GROUP BY col"
query("census_column_stats", f"SELECT col, rows, nulls, uniq FROM ({STATS})")(lambda s, d: census.column_stats(long(s, d)).drop("small_domain"))
query("census_small_domain", f"SELECT col, small_domain FROM ({STATS})")(lambda s, d: census.column_stats(long(s, d)).select("col", "small_domain"))
PAGES = f"SELECT col, row_id // 1024 AS page, count(*) AS rows, count(*) - count(value) AS nulls, bool_and(coalesce(value >= p, true)) AS monotone FROM (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY col, row_id // 1024 ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM {LONG}) GROUP BY col, page"
query("census_page_stats", PAGES)(lambda s, d: census.page_stats(long(s, d)))
query("census_monotone_pages", f"SELECT col, count(*) AS pages, count(*) FILTER (monotone) AS monotone_pages FROM ({PAGES}) GROUP BY col")(lambda s, d: census.monotone_pages(long(s, d)))
query("census_rank_displacement", f"SELECT max(abs(r - p)) AS max_displacement FROM (SELECT row_number() OVER (ORDER BY value, row_id) AS r, row_number() OVER (ORDER BY row_id) AS p FROM {sql_col('holes')} WHERE value IS NOT NULL)")(lambda s, d: big(census.rank_displacement(col(s, d, "holes"))))
query("census_segment_coverage", f"SELECT CAST(coalesce(sum(n) FILTER (n >= 128), 0) AS BIGINT) AS covered, count(*) AS runs FROM (SELECT count(*) AS n FROM (SELECT sum(f) OVER (ORDER BY row_id) AS g FROM (SELECT row_id, CASE WHEN value < lag(value) OVER (ORDER BY row_id) THEN 1 ELSE 0 END AS f FROM {sql_col('saw')} WHERE value IS NOT NULL)) GROUP BY g)")(lambda s, d: big(census.segment_coverage(col(s, d, "saw"))))
query("census_source_rollup", f"SELECT CASE WHEN col IN ('ts', 'saw') THEN 'made' ELSE 'given' END AS source, count(*) AS columns, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(nulls) AS BIGINT) AS nulls, count(*) FILTER (small_domain) AS small_domains FROM ({STATS}) GROUP BY source")(
    lambda s, d: census.rollup(census.column_stats(long(s, d)).withColumn("source", F.when(F.col("col").isin("ts", "saw"), "made").otherwise("given")))
)


# ---------------------------------------------------------------- certificates

MINMAX = f"SELECT row_id // 128 AS blk, min(value) AS lo, max(value) AS hi FROM {sql_col('user')} GROUP BY blk"
query("minmax_build", MINMAX)(lambda s, d: certificates.minmax(col(s, d, "user"), 128))
query("minmax_probe_eq", f"SELECT blk FROM ({MINMAX}) WHERE lo <= 3 AND hi >= 3")(lambda s, d: certificates.minmax_probe(certificates.minmax(col(s, d, "user"), 128), [3]))
query("minmax_probe_in", f"SELECT blk FROM ({MINMAX}) WHERE (lo <= 1 AND hi >= 1) OR (lo <= 100000 AND hi >= 100000)")(lambda s, d: certificates.minmax_probe(certificates.minmax(col(s, d, "user"), 128), [1, 100000]))


def _fence(spark, d):
    c = col(spark, d, "nulls_first").where("value IS NOT NULL").select((F.col("row_id") - 100).alias("row_id"), "value")
    return c, certificates.fence(c, 512, c.count())


FENCE_C = f"(SELECT row_id - 100 AS row_id, value FROM {sql_col('nulls_first')} WHERE value IS NOT NULL)"
FENCE = f"(SELECT row_id // stride AS entry, value FROM {FENCE_C}, (SELECT (count(*) + 31) // 32 AS stride FROM {FENCE_C}) WHERE row_id % stride = 0)"
query("fence_build", f"SELECT entry, value FROM {FENCE}")(lambda s, d: big(_fence(s, d)[1][0]))
query("fence_probe", f"WITH f AS (SELECT * FROM {FENCE}), b AS (SELECT coalesce(max(entry) FILTER (value < 3507), 0) AS lo, coalesce(min(entry) FILTER (value > 3507), max(entry) + 1) AS hi FROM f) SELECT entry AS blk FROM f, b WHERE entry >= lo AND entry < hi")(lambda s, d: big(certificates.fence_probe(_fence(s, d)[1][0], 3507)))


@query("fence_refined", islands(f"SELECT row_id FROM {FENCE_C} WHERE value = 3507"))
def fence_refined(spark, d):
    c, (entries, stride) = _fence(spark, d)
    return certificates.refine(c, certificates.fence_probe(entries, 3507), stride, [3507])


@query("candidates_intersect", f"SELECT blk FROM ({MINMAX}) WHERE lo <= 3 AND hi >= 3 INTERSECT SELECT row_id // 128 FROM {sql_col('user')} WHERE value = 5")
def candidates_intersect(spark, d):
    c = col(spark, d, "user")
    exact = c.where("value = 5").select(rows.block(128).alias("blk")).distinct()
    return certificates.intersect_candidates(certificates.minmax_probe(certificates.minmax(c, 128), [3]), exact, 128, 128)


def _refined(targets):
    def f(spark, d):
        c = col(spark, d, "holes")
        return certificates.refine(c, certificates.minmax_probe(certificates.minmax(c, 128), targets), 128, targets)

    return f


query("refine_eq", islands(f"SELECT row_id FROM {sql_col('holes')} WHERE value = 7"))(_refined([7]))
query("refine_in", islands(f"SELECT row_id FROM {sql_col('holes')} WHERE value IN (1, 7, 193)"))(_refined([1, 7, 193]))


@query("false_positive_blocks", f"SELECT blk FROM ({MINMAX}) WHERE lo <= 3 AND hi >= 3 EXCEPT SELECT row_id // 128 FROM {sql_col('user')} WHERE value = 3")
def false_positive_blocks(spark, d):
    c = col(spark, d, "user")
    return certificates.false_positives(c, certificates.minmax_probe(certificates.minmax(c, 128), [3]), 128, [3])


@query("candidate_rows", f"SELECT CAST(coalesce(sum(least(n, (blk + 1) * 128) - blk * 128), 0) AS BIGINT) AS rows FROM ({MINMAX}), (SELECT count(*) AS n FROM events) WHERE lo <= 3 AND hi >= 3")
def candidate_rows(spark, d):
    c = col(spark, d, "user")
    return big(certificates.candidate_rows(certificates.minmax_probe(certificates.minmax(c, 128), [3]), 128, c.count()))


COUNTS = f"(SELECT value, count(*) AS n FROM {sql_col('holes')} WHERE value IS NOT NULL GROUP BY value)"
query("cert_query_set", f"SELECT 'eq_rare' AS name, (SELECT value FROM {COUNTS} ORDER BY n, value LIMIT 1) AS value UNION ALL SELECT 'eq_frequent', (SELECT value FROM {COUNTS} ORDER BY n DESC, value LIMIT 1) UNION ALL SELECT 'eq_absent', (SELECT min(value) + 1 FROM {COUNTS} WHERE value + 1 NOT IN (SELECT value FROM {COUNTS}))")(lambda s, d: certificates.query_set(col(s, d, "holes")))


@query("bloom_probe_refined", islands(f"SELECT row_id FROM {sql_col('holes')} WHERE value IN (7, 193, 10000)"))
def bloom_probe_refined(spark, d):
    c = col(spark, d, "holes")
    side = certificates.bloom(c, 128)
    return certificates.refine(c, certificates.bloom_probe(side, [7, 193, 10000], 128), 128, [7, 193, 10000])


# ------------------------------------------------------- planning and statistics

READS = "(SELECT event_id * 64 AS \"start\", event_id * 64 + 16 + user_id % 80 AS \"end\" FROM events)"


def reads(spark, d):
    return events(spark, d).selectExpr("event_id * 64 AS start", "event_id * 64 + 16 + user_id % 80 AS end")


def merged(gap: int) -> str:
    return f"SELECT min(\"start\") AS \"start\", max(\"end\") AS \"end\" FROM (SELECT *, sum(f) OVER (ORDER BY \"start\", \"end\") AS g FROM (SELECT *, CASE WHEN \"start\" <= max(\"end\") OVER (ORDER BY \"start\", \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS f FROM {READS})) GROUP BY g"


query("span_union", merged(0))(lambda s, d: rows.span_union(reads(s, d)))
query("coalesce_ranges", merged(64))(lambda s, d: rows.span_union(reads(s, d), 64))
query("schedule_bytes", f"SELECT CAST((SELECT sum(\"end\" - \"start\") FROM ({merged(0)})) AS BIGINT) AS required, CAST((SELECT sum(\"end\" - \"start\") FROM ({merged(64)})) AS BIGINT) AS scheduled")(
    lambda s, d: rows.span_union(reads(s, d)).agg(F.sum(F.col("end") - F.col("start")).alias("required")).join(rows.span_union(reads(s, d), 64).agg(F.sum(F.col("end") - F.col("start")).alias("scheduled")), F.lit(True))
)
TIMES = "(SELECT user_id % 10 AS page, event_id % 50 AS rows, 3 + user_id % 40 AS selective, 3 + event_id % 30 AS fused, 3 + user_id % 37 AS predicted_selective, 3 + event_id % 31 AS predicted_fused FROM events)"


def times(spark, d):
    return events(spark, d).selectExpr("user_id % 10 AS page", "event_id % 50 AS rows", "3 + user_id % 40 AS selective", "3 + event_id % 30 AS fused", "3 + user_id % 37 AS predicted_selective", "3 + event_id % 31 AS predicted_fused")


query("crossover_point", f"SELECT page, min(rows) FILTER (fused < selective) AS crossover_rows FROM {TIMES} GROUP BY page")(lambda s, d: statistics.crossover(times(s, d), ["page"]))
query("guard_regret", f"SELECT guard, round(avg(CASE WHEN predicted_fused * guard < predicted_selective THEN fused ELSE selective END / CAST(least(fused, selective) AS DOUBLE)), 9) AS regret FROM {TIMES}, (SELECT CAST(unnest([1.0, 1.05, 1.1, 1.15, 1.2, 1.25, 1.3, 1.4, 1.5]) AS DOUBLE) AS guard) GROUP BY guard")(lambda s, d: statistics.guard_regret(times(s, d)).select("guard", F.round("regret", 9).alias("regret")))
query("policy_times", f"SELECT CAST(sum(selective) AS BIGINT) AS selective, CAST(sum(fused) AS BIGINT) AS fused, CAST(sum(CASE WHEN predicted_fused * 1.1 < predicted_selective THEN fused ELSE selective END) AS BIGINT) AS cost, CAST(sum(least(fused, selective)) AS BIGINT) AS oracle FROM {TIMES}")(
    lambda s, d: times(s, d).agg(F.sum("selective").alias("selective"), F.sum("fused").alias("fused"), F.sum(F.when(statistics.guarded_choice(1.1) == "fused", F.col("fused")).otherwise(F.col("selective"))).alias("cost"), F.sum(F.least("fused", "selective")).alias("oracle"))
)
query("ecdf", f"SELECT page, selective, row_number() OVER (PARTITION BY page ORDER BY selective) / count(*) OVER (PARTITION BY page) AS share FROM (SELECT DISTINCT page, selective FROM {TIMES})")(lambda s, d: statistics.ecdf(times(s, d).select("page", "selective").distinct(), ["page"], "selective"))
query("median_by_source", f"SELECT page, median(selective) AS median FROM {TIMES} GROUP BY page")(lambda s, d: times(s, d).groupBy("page").agg(F.percentile("selective", 0.5).alias("median")))
query("lower_empirical_quantile", f"SELECT page, value FROM (SELECT page, selective AS value, row_number() OVER (PARTITION BY page ORDER BY selective) - 1 AS i, count(*) OVER (PARTITION BY page) AS n FROM {TIMES}) WHERE i = (n - 1) * 95 // 100")(lambda s, d: statistics.lower_quantile(times(s, d).withColumnRenamed("selective", "value"), ["page"], "value", 95, 100))
query("selectivity_bucket", "SELECT b AS bucket, count(*) AS n FROM (SELECT CASE WHEN s <= 0.002 THEN '0.1%' WHEN s <= 0.02 THEN '1%' WHEN s <= 0.2 THEN '10%' ELSE '50%' END AS b FROM (SELECT event_id % 1000 / 1000.0 AS s FROM events)) GROUP BY b")(lambda s, d: events(s, d).select(scalar.selectivity_bucket((F.col("event_id") % 1000) / 1000.0).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")))
query("discovery_share", f"SELECT page, round(1 - median(fused / CAST(fused + selective AS DOUBLE)), 9) AS share FROM {TIMES} GROUP BY page")(lambda s, d: times(s, d).groupBy("page").agg(F.round(1 - F.percentile(F.col("fused") / (F.col("fused") + F.col("selective")), 0.5), 9).alias("share")))
query("arm_wins", f"SELECT page, count(*) FILTER (fused < selective) AS wins, min(fused / CAST(selective AS DOUBLE)) AS least, max(fused / CAST(selective AS DOUBLE)) AS most FROM {TIMES} GROUP BY page")(lambda s, d: times(s, d).groupBy("page").agg(F.count_if(F.col("fused") < F.col("selective")).alias("wins"), F.min(F.col("fused") / F.col("selective")).alias("least"), F.max(F.col("fused") / F.col("selective")).alias("most")))


# ------------------------------------------------- sources, arms and schedules

query("raw_roundtrip", SAME.format(sql_col("holes")))(lambda s, d: raw.from_raw(raw.to_raw(col(s, d, "holes"), 4096), 4096))
query("raw_page_bytes", f"SELECT page, CAST(20 + CASE WHEN nn < n THEN (n + 7) // 8 ELSE 0 END + 8 * nn AS BIGINT) AS bytes FROM (SELECT row_id // 512 AS page, count(*) AS n, count(value) AS nn FROM {sql_col('nulls_first')} GROUP BY page)")(
    lambda s, d: raw.to_raw(col(s, d, "nulls_first"), 512).select("page", F.length("raw").cast("long").alias("bytes"))
)
ARM = f"SELECT CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT)), 0) AS BIGINT) AS sum, count(*) AS matched_rows FROM events WHERE user_id BETWEEN 10 AND 40"


def pair(spark, d):
    return events(spark, d).selectExpr("event_id AS row_id", "user_id AS selector", f"{COLUMNS['cents'][0]} AS value")


query("arm_full", ARM)(lambda s, d: big(arms.full(pair(s, d), 10, 40)))
query("arm_row_filter", ARM)(lambda s, d: big(arms.row_filter(pair(s, d), 10, 40)))
query("arm_page_filter", ARM)(lambda s, d: big(arms.page_filter(pair(s, d), 10, 40, 1024)))
query("arm_row_selection", ARM)(lambda s, d: big(arms.row_selection(pair(s, d), scans.filter_between(col(s, d, "user"), 10, 40))))
query("arm_page_candidates", "SELECT event_id // 1024 AS page, min(user_id) AS lo, max(user_id) AS hi FROM events GROUP BY page HAVING min(user_id) <= 40 AND max(user_id) >= 10")(lambda s, d: arms.page_candidates(pair(s, d), 10, 40, 1024))
PAGED = f"(SELECT \"start\" // 4096 AS page, * FROM {READS})"


def _policy(name: str, gap: int) -> str:
    return f"SELECT '{name}' AS policy, count(*) AS reads, CAST(coalesce(sum(\"end\" - \"start\"), 0) AS BIGINT) AS bytes FROM ({merged(gap)})"


PER_PAGE = f"SELECT page, min(\"start\") AS \"start\", max(\"end\") AS \"end\" FROM (SELECT *, sum(f) OVER (PARTITION BY page ORDER BY \"start\", \"end\") AS g FROM (SELECT *, CASE WHEN \"start\" <= max(\"end\") OVER (PARTITION BY page ORDER BY \"start\", \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM {PAGED})) GROUP BY page, g"
query("schedule_policies", " UNION ALL ".join(_policy(n, g) for n, g in schedules.GAPS.items()) + f" UNION ALL SELECT 'per_page', count(*), CAST(sum(\"end\" - \"start\") AS BIGINT) FROM ({PER_PAGE}) UNION ALL SELECT 'full_file', 1, max(\"end\") FROM {READS}")(
    lambda s, d: big(schedules.policies(reads(s, d).withColumn("page", F.floor(F.col("start") / 4096))), "reads", "bytes")
)
query("query_widths", "SELECT DISTINCT CAST(w AS BIGINT) AS width FROM (SELECT unnest([1, greatest(1, n // 1000), greatest(1, n // 100), n // 10, n // 2, n]) AS w FROM (SELECT count(*) AS n FROM events))")(
    lambda s, d: s.createDataFrame([(w,) for w in predicates.widths(events(s, d).count())], "width long")
)

# ------------------------------------------------------------ more of the census

query("census_natural_runs", f"SELECT count(*) AS runs, CAST(sum(length) AS DOUBLE) / count(*) AS reduction FROM {RUNS}")(lambda s, d: census.natural_runs(chats(s, d)))
SIZES = "(SELECT user_id % 7 AS \"group\", 1000 + event_id % 9 AS rows, 700 + event_id % 50 AS minimal, 800 + user_id % 90 AS ready FROM events)"
query("size_by_group", f"SELECT \"group\", count(*) AS columns, round(median(minimal * 8 / CAST(rows AS DOUBLE)), 9) AS minimal_bits, round(median(ready * 8 / CAST(rows AS DOUBLE)), 9) AS ready_bits, round(median(ready / CAST(minimal AS DOUBLE)), 9) AS premium FROM {SIZES} GROUP BY \"group\"")(
    lambda s, d: (lambda t: t.select("group", "columns", *(F.round(c, 9).alias(c) for c in ("minimal_bits", "ready_bits", "premium"))))(
        census.size_by_group(events(s, d).selectExpr("user_id % 7 AS group", "1000 + event_id % 9 AS rows", "700 + event_id % 50 AS minimal", "800 + user_id % 90 AS ready"))
    )
)
SOURCED = f"(SELECT CASE WHEN col IN ('cents', 'ts') THEN 'one' ELSE 'two' END AS source, CASE col WHEN 'ts' THEN 'timestamp' ELSE col END AS col, CASE col WHEN 'cents' THEN 0 WHEN 'saw' THEN 1 ELSE 2 END AS place FROM {LONG})"
query("pair_building", f"""WITH e AS (SELECT source, col, place, count(*) AS n FROM {SOURCED} GROUP BY ALL), s AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY source ORDER BY col <> 'timestamp', place, col) = 1)
SELECT e.source, s.col AS selector, e.col AS value FROM e JOIN s ON e.source = s.source AND e.col <> s.col AND e.n = s.n""")(
    lambda s, d: census.pairs(long(s, d).selectExpr("CASE WHEN col IN ('cents', 'ts') THEN 'one' ELSE 'two' END AS source", "CASE col WHEN 'ts' THEN 'timestamp' ELSE col END AS col", "CASE col WHEN 'cents' THEN 0 WHEN 'saw' THEN 1 ELSE 2 END AS place"))
)


@query("facts_revalidated", f"""SELECT 'AllRows PiecewiseNonDecreasing 256' AS fact, bool_and(coalesce(value >= p, true)) AS holds FROM (SELECT value, lag(value) OVER (PARTITION BY row_id // 256 ORDER BY row_id) AS p FROM {sql_col('saw')})
UNION ALL SELECT 'NonNullRows NonDecreasing', bool_and(coalesce(value >= p, true)) FROM (SELECT value, lag(value) OVER (ORDER BY row_id) AS p FROM {sql_col('nulls_first')} WHERE value IS NOT NULL)""")
def facts_revalidated(spark, d):
    out = None
    for name, recipe in (("saw", Recipe("UnsignedDelta", bitpack(), 256)), ("nulls_first", Recipe("Nullable", FOR, 256))):
        c = col(spark, d, name)
        one = census.revalidated(c, compiler.column(c, recipe).facts)
        out = one if out is None else out.unionByName(one)
    return out


query("fence_probe_in", f"WITH f AS (SELECT * FROM {FENCE}), t AS (SELECT unnest([7, 3507, 5000]) AS v), b AS (SELECT v, coalesce(max(entry) FILTER (value < v), 0) AS lo, coalesce(min(entry) FILTER (value > v), max(entry) + 1) AS hi FROM f, t GROUP BY v) SELECT DISTINCT entry AS blk FROM f, b WHERE entry >= lo AND entry < hi")(
    lambda s, d: big(certificates.fence_probe_in(_fence(s, d)[1][0], [7, 3507, 5000]))
)


@query("in_mixed_refined", islands(f"SELECT row_id FROM {sql_col('holes')} WHERE value IN (SELECT value FROM {COUNTS} ORDER BY n, value LIMIT 1) OR value IN (SELECT value FROM {COUNTS} ORDER BY n DESC, value LIMIT 1)"))
def in_mixed_refined(spark, d):
    c = col(spark, d, "holes")
    targets = certificates.mixed_targets(c)
    return certificates.refine(c, certificates.bloom_probe(certificates.bloom(c, 128), targets, 128), 128, targets)


@query("plan_strategies", "SELECT * FROM (VALUES ('nulls_first', 'SearchMonotone'), ('saw', 'SearchPiecewise'), ('user', 'TranslateDictionaryRange'), ('cents', 'MaterializeRows')) t(col, op)")
def plan_strategies(spark, d):
    """What the planner picks for a FILTER, as the bridge reports it."""
    import json

    recipes = {"nulls_first": "Nullable(FOR(BitPack))", "saw": "UnsignedDelta(BitPack)", "user": "Dictionary(BitPack)", "cents": "FOR(BitPack)"}
    ask = {n: json.dumps({"op": "compile", "recipe": r, "query": {"kind": "filter_between", "low": 1, "high": 9}}) for n, r in recipes.items()}
    return spark.createDataFrame([(n, json.loads(bridge.serve(col(spark, d, n), q))["ops"][0]["op"]) for n, q in ask.items()], "col string, op string")


@query("cluster_bootstrap_interval")
def cluster_bootstrap_interval(spark, d):
    """No SQL: a pseudo-random resampling in two stages."""
    each = times(spark, d).groupBy("page", "rows").agg(F.percentile(F.col("fused") / F.col("selective"), 0.5).alias("m")).orderBy("page", "rows").collect()
    families: dict[str, list[float]] = {}
    for r in each:
        families.setdefault(str(r.page), []).append(r.m)
    return spark.createDataFrame([statistics.cluster_bootstrap_median(families)], "low double, high double")


@query("cost_model_weights")
def cost_model_weights(spark, d):
    """No SQL: a ridge regression, fitted from two aggregates."""
    names = ["page", "rows", "predicted_selective"]
    model = statistics.fit_cost_frame(times(spark, d), names, "selective")
    return spark.createDataFrame([(n, float(w)) for n, w in zip(["constant", *names], model["weights"])], "feature string, weight double")


from . import studies  # noqa: E402, F401  (registers its queries here)
