"""Queries of recipes, pages, corpora, the census and the studies, with equivalent SQL.  Registered beside those of ``queries``."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import statistics
from .operators import census, certificates, codecs, predicates, scans, schedules
from .operators.rows import span_union
from .plans import bridge, compiler, encoded, layout, store
from .plans.plan import Query
from .plans.recipe import Recipe, bitpack
from .queries import CENSUS, CHATS, COLUMNS, LONG, MINMAX, READS, SAME, TIMES, big, chats, col, events, islands, long, merged, query, reads, sql_col, times
from .sources import arms, corpus, pages, readers

# ------------------------------------------------------------- recipes, whole

#: Recipes by name, each with a column that meets it.
RECIPES = {
    "bitpack": ("user", "BitPack"), "for": ("cents", "FOR(BitPack)"), "delta": ("cents", "Delta@256(BitPack)"), "unsigned_delta": ("saw", "UnsignedDelta@256(BitPack)"),
    "for_delta": ("cents", "FOR(Delta@256(BitPack))"), "dictionary": ("user", "Dictionary(BitPack)"), "dictionary_rle": ("steps", "Dictionary(RLE@32(BitPack))"),
    "rle_for": ("steps", "RLE@32(FOR(BitPack))"), "patch": ("patched", "Patch@32(FOR(BitPack))"), "nullable_for": ("holes", "Nullable@256(FOR(BitPack))"),
    "nullable_dictionary": ("holes", "Nullable@256(Dictionary(BitPack))"), "nullable_first": ("nulls_first", "Nullable@256(UnsignedDelta@256(BitPack))"), "frame": ("ts", "Frame(FOR(BitPack))"),
}


def kept(spark, d, name: str):
    column, recipe = RECIPES[name]
    df = col(spark, d, column)
    if "Patch" in recipe:
        df = df.withColumn("is_patch", F.col("row_id") % 997 == 503)
    return compiler.column(df, bridge.parse_recipe(recipe), keep=True)


for _name, (_column, _) in RECIPES.items():
    query(f"dec_recipe_{_name}", SAME.format(sql_col(_column)))(lambda s, d, n=_name: encoded.decode(kept(s, d, n)))
    query(f"dec_rows_{_name}", f"SELECT row_id, value FROM {sql_col(_column)} WHERE row_id >= 300 AND row_id < 777")(lambda s, d, n=_name: encoded.decode(kept(s, d, n), 300, 777))
    query(f"sum_recipe_{_name}", f"SELECT CAST(coalesce(sum(value), 0) AS BIGINT) AS sum FROM {sql_col(_column)} WHERE row_id >= 130 AND row_id < 900")(lambda s, d, n=_name: big(compiler.run(Query("Sum", 130, 900), kept(s, d, n))))
    query(f"filter_recipe_{_name}", islands(f"SELECT row_id FROM {sql_col(_column)} WHERE value BETWEEN (SELECT min(value) FROM {sql_col(_column)}) AND (SELECT value FROM {sql_col(_column)} WHERE row_id = 301)"))(
        lambda s, d, n=_name: (lambda c: compiler.run(Query("Filter", low=c.rows.agg(F.min("value")).first()[0], high=compiler.run(Query("Get", 301), c).first().value), c))(kept(s, d, n))
    )

query("enc_bitpack", f"SELECT row_id, value AS code, (SELECT length(bin(max(value))) FROM {sql_col('user')}) AS width FROM {sql_col('user')}")(
    lambda s, d: (lambda codes, width: codes.withColumn("width", F.lit(width).cast("long")))(*codecs.bitpack(col(s, d, "user")))
)


@query("enc_recipe_runs", f"""WITH r AS (SELECT row_id, value, sum(c) OVER (ORDER BY row_id) AS g FROM (SELECT row_id, value, CASE WHEN value IS DISTINCT FROM lag(value) OVER (ORDER BY row_id) OR row_id = 0 THEN 1 ELSE 0 END AS c FROM {sql_col('steps')})),
t AS (SELECT value, dense_rank() OVER (ORDER BY value) - 1 AS id FROM (SELECT DISTINCT value FROM {sql_col('steps')}))
SELECT row_number() OVER (ORDER BY min(row_id)) - 1 AS run_id, id AS value, min(row_id) AS "start", max(row_id) + 1 AS "end" FROM r JOIN t USING (value) GROUP BY g, id""")
def enc_recipe_runs(spark, d):
    """The runs of ids of Dictionary(RLE(BitPack)), a field two levels down."""
    return big(kept(spark, d, "dictionary_rle").fields["1 runs"])


@query("enc_recipe_numbers", f"""SELECT 'for' AS recipe, '0 base' AS number, min(value) AS value FROM {sql_col('cents')} UNION ALL SELECT 'for', '1 width', length(bin(max(value) - min(value))) FROM {sql_col('cents')}
UNION ALL SELECT 'dictionary', '0 entries', count(DISTINCT value) FROM {sql_col('user')} UNION ALL SELECT 'nullable_for', '1 rows', count(value) FROM {sql_col('holes')} UNION ALL SELECT 'patch', '0 exceptions', count(*) FROM events WHERE event_id % 997 = 503""")
def enc_recipe_numbers(spark, d):
    want = {"for": ("0 base", "1 width"), "dictionary": ("0 entries",), "nullable_for": ("1 rows",), "patch": ("0 exceptions",)}
    return spark.createDataFrame([(r, n, int(kept(spark, d, r).numbers[n])) for r, names in want.items() for n in names], "recipe string, number string, value long")


@query("unsigned_range_width", f"SELECT CAST(length(bin(max(value))) AS BIGINT) AS width FROM {sql_col('user')}")
def unsigned_range_width(spark, d):
    """The width that the fact of a packed column carries."""
    return spark.createDataFrame([(f.param,) for f in kept(spark, d, "bitpack").facts if f.prop == "UnsignedRange"], "width long")


@query("decode_chain", "SELECT * FROM (VALUES ('for', '1 codes', 300, 777), ('delta', '0 anchors', 1, 4), ('delta', '1 codes', 256, 777), ('patch', '0 exceptions', 300, 777), ('patch', '2 codes', 300, 777)) t(recipe, field, \"from\", \"to\")")
def decode_chain(spark, d):
    """What rows 300 to 777 need of each field: whole restart blocks of a delta, the rows themselves of others."""
    rows = [(n, f, *span) for n in ("for", "delta", "patch") for f, span in encoded.chain(kept(spark, d, n), 300, 777).items()]
    return spark.createDataFrame(rows, "recipe string, field string, from int, to int")


#: The table of sixteen rows, and its recipes.
EXAMPLE = {
    "event_time": ([1_700_000_000 + 60 * i for i in range(16)], "UnsignedDelta@128(BitPack)"),
    "meter": ([10, 11, 11, 12, 12, 12, 13, 14, 13, 14, 15, 15, 16, 17, 16, 18], "FOR(BitPack)"),
    "status": ([1, 1, 1, 2, 2, 2, 2, 1, 1, 3, 3, 3, 2, 2, 1, 1], "Dictionary(RLE@4(BitPack))"),
    "sparse_event": ([None, None, None, 7, None, None, None, 7, None, None, None, None, 9, None, None, None], "Nullable@8(Dictionary(RLE@2(BitPack)))"),
    "reading": ([100, 101, 102, 103, 104, 105, 106, 107, 108, 10_000, 110, 111, 112, 113, 114, 115], "Patch@4(FOR(BitPack))"),
}


def example(spark) -> DataFrame:
    rows = [(i, *(v[i] for v, _ in EXAMPLE.values())) for i in range(16)]
    return spark.createDataFrame(rows, "row_id long, " + ", ".join(f"{n} long" for n in EXAMPLE))


@query("modelled_page_bytes", "SELECT 480 AS event_time, 384 AS meter, 608 AS status, 720 AS sparse_event, 704 AS reading")
def modelled_page_bytes(spark, d):
    """Of the sixteen rows' columns as they are encoded; the sizes are those of the format's golden pages."""
    table, out = example(spark), []
    for name, (_, recipe) in EXAMPLE.items():
        df = table.select("row_id", F.col(name).alias("value"), (F.lit(name == "reading") & (F.col("row_id") == 9)).alias("is_patch"))
        c = compiler.column(df, bridge.parse_recipe(recipe))
        out.append(layout.page_bytes(encoded.field_bytes(c), layout.dependencies(c.recipe)))
    return spark.createDataFrame([tuple(out)], ", ".join(f"{n} int" for n in EXAMPLE))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v) for v in r) + ")" for r in rows)


@query("example_tables", " UNION ALL ".join(f"SELECT '{f}' AS format, * FROM (VALUES {_values([(i, *(v[i] for v, _ in EXAMPLE.values())) for i in range(16)])}) t(row_id, {', '.join(EXAMPLE)})" for f in ("csv", "orc", "parquet")))
def example_tables(spark, d):
    """The sixteen rows written and read back in three formats."""
    uri, table, out = store.folder(spark), example(spark), None
    for kind in ("csv", "orc", "parquet"):
        path = f"{uri}/{kind}"
        w = table.coalesce(1).write
        w.csv(path, header=True) if kind == "csv" else getattr(w, kind)(path)
        r = spark.read.schema(table.schema)
        one = (r.csv(path, header=True) if kind == "csv" else getattr(r, kind)(path)).select(F.lit(kind).alias("format"), "*")
        out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------------------------------ query shapes

SPANS = "(SELECT 100 * i AS \"start\", 100 * i + 37 AS \"end\" FROM range((SELECT count(*) // 100 FROM events)) t(i))"


def spans(spark, d) -> DataFrame:
    n = events(spark, d).count() // 100
    return spark.range(n).select((F.col("id") * 100).alias("start"), (F.col("id") * 100 + 37).alias("end"))


SUM_SPANS = f"SELECT CAST(coalesce(sum(value), 0) AS BIGINT) AS sum, count(*) AS matched_rows FROM {sql_col('cents')} WHERE row_id % 100 < 37 AND row_id < 100 * (SELECT count(*) // 100 FROM events)"
query("sum_over_all_ranges", SUM_SPANS)(lambda s, d: big(scans.sum_over_ranges(col(s, d, "cents"), spans(s, d))))
query("fused_sum_over_ranges", SUM_SPANS)(lambda s, d: big(scans.fused_sum_over_ranges(col(s, d, "cents"), spans(s, d))))


def pair(spark, d, selector: str = "user") -> DataFrame:
    return events(spark, d).selectExpr("event_id AS row_id", f"CAST({COLUMNS[selector][0]} AS BIGINT) AS selector", f"{COLUMNS['cents'][0]} AS value")


query("predicate_truth", f"SELECT CAST(min(row_id) AS BIGINT) AS \"start\", CAST(max(row_id) + 1 AS BIGINT) AS \"end\", CAST(sum(value) AS BIGINT) AS sum FROM (SELECT event_id AS row_id, {COLUMNS['cents'][1]} AS value, event_id - row_number() OVER (ORDER BY event_id) AS g FROM events WHERE user_id BETWEEN 10 AND 40) GROUP BY g")(
    lambda s, d: big(scans.predicate_truth(pair(s, d), 10, 40))
)
query("answer_checksum", f"SELECT count(*) AS checksum FROM {sql_col('cents')} WHERE value BETWEEN 2000 AND 9000")(lambda s, d: scans.answer_checksum(compiler.run(Query("Filter", low=2000, high=9000), kept(s, d, "for"))))
query("crossover_widths", "SELECT DISTINCT CAST(w AS BIGINT) AS width FROM (SELECT unnest([1, 4, 16, 64, 256]) AS w UNION ALL SELECT greatest(1, n * unnest([1, 5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100]) // 100) FROM (SELECT count(*) AS n FROM events))")(
    lambda s, d: s.createDataFrame([(w,) for w in predicates.crossover_widths(events(s, d).count())], "width long")
)


def _boundary(selector: str, low: str, high: str) -> str:
    c = COLUMNS[selector][1]
    return f"""WITH b AS (SELECT {low} AS low, {high} AS high), p AS (SELECT event_id // 256 AS page, min({c}) AS lo, max({c}) AS hi FROM events GROUP BY page),
o AS (SELECT coalesce(bool_and(coalesce(lo >= pl AND hi >= ph, true)), true) AS used FROM (SELECT lo, hi, lag(lo) OVER (ORDER BY page) AS pl, lag(hi) OVER (ORDER BY page) AS ph FROM p))
SELECT CAST(coalesce(sum({COLUMNS['cents'][1]}), 0) AS BIGINT) AS sum, count(*) AS matched_rows, (SELECT count(*) FROM p, b WHERE hi >= low AND lo <= high) AS candidate_pages, (SELECT used FROM o) AS boundary_order_used FROM events, b WHERE {c} BETWEEN low AND high"""


query("arm_boundary_search", _boundary("ts", f"(SELECT value FROM {sql_col('ts')} WHERE row_id = 300)", f"(SELECT value FROM {sql_col('ts')} WHERE row_id = 640)"))(
    lambda s, d: big(arms.boundary_search(pair(s, d, "ts"), *(col(s, d, "ts").where(f"row_id = {i}").first().value for i in (300, 640)), 256), "sum", "matched_rows", "candidate_pages")
)
query("arm_boundary_unordered", _boundary("user", "10", "40"))(lambda s, d: big(arms.boundary_search(pair(s, d), 10, 40, 256), "sum", "matched_rows", "candidate_pages"))
query("cert_modelled_bytes", f"SELECT CAST(16 * (SELECT count(*) FROM ({MINMAX})) + 8 * coalesce(sum(least(n, (blk + 1) * 128) - blk * 128), 0) AS BIGINT) AS bytes FROM ({MINMAX}), (SELECT count(*) AS n FROM events) WHERE lo <= 3 AND hi >= 3")(
    lambda s, d: (lambda c, side: certificates.modelled_bytes(certificates.minmax_probe(side, [3]), certificates.ENTRY * side.count(), 128, c.count()))(col(s, d, "user"), certificates.minmax(col(s, d, "user"), 128))
)


@query("parquet_bloom_probe", islands(f"SELECT row_id FROM {sql_col('user')} WHERE value = 193"))
def parquet_bloom_probe(spark, d):
    """An equality on a file with the format's own Bloom filter."""
    path = f"{store.folder(spark)}/bloom"
    certificates.write_with_bloom(col(spark, d, "user"), path, "value", 10_000)
    return scans.filter_equals(spark.read.parquet(path), 193)


# ------------------------------------------------------------------ pages, reads

query("page_roundtrip", SAME.format(sql_col("holes")))(lambda s, d: pages.from_pages(pages.to_pages(col(s, d, "holes"), 4096), 4096))
PAGE_BYTES = f"""SELECT page, CAST(44 + CASE WHEN nn < n THEN (n + 7) // 8 ELSE 0 END + (nn * w + 7) // 8 AS BIGINT) AS bytes FROM (SELECT row_id // 512 AS page, count(*) AS n, count(value) AS nn,
CASE WHEN count(value) = 0 OR max(value) = min(value) THEN 0 ELSE length(bin(max(value) - min(value))) END AS w FROM {sql_col('nulls_first')} GROUP BY page)"""
query("page_bytes", PAGE_BYTES)(lambda s, d: pages.to_pages(col(s, d, "nulls_first"), 512).select("page", F.length("raw").cast("long").alias("bytes")))
query("page_bundle", f"SELECT page, CAST(coalesce(sum((bytes + 63) // 64 * 64) OVER (ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", bytes FROM ({PAGE_BYTES})")(
    lambda s, d: pages.bundle(pages.to_pages(col(s, d, "nulls_first"), 512))
)
GRAINS = READS.replace('event_id * 64 AS "start", event_id * 64 + 16 + user_id % 80 AS "end"', 'event_id * 64 // 256 * 256 AS "start", (event_id * 64 + 16 + user_id % 80 + 255) // 256 * 256 AS "end"')
query("access_metrics", f"SELECT (SELECT CAST(sum(\"end\" - \"start\") AS BIGINT) FROM {READS}) AS logical, CAST(sum(\"end\" - \"start\") AS BIGINT) AS delivered, count(*) AS operations FROM ({merged(0).replace(READS, GRAINS)})")(
    lambda s, d: schedules.access_metrics(reads(s, d), 256)
)
query("shuffled_order", "SELECT page, CAST((k % 140737488355328) * 131072 + k // 140737488355328 AS VARCHAR) AS key FROM (SELECT page, page::HUGEINT * 6364136223846793005 % 18446744073709551616 AS k FROM (SELECT DISTINCT user_id AS page FROM events))")(
    lambda s, d: events(s, d).select(F.col("user_id").cast("long").alias("page")).distinct().select("page", schedules.shuffled("page").cast("string").alias("key"))
)

# ----------------------------------------------------------------- corpora, census

query("synthetic_columns", " UNION ALL ".join(f"SELECT '{n}' AS name, r AS row_id, CAST({f} AS BIGINT) AS value FROM range(2000) t(r)" for n, f in readers.SYNTHETIC.items()))(
    lambda s, d: _union(readers.synthetic(s, n, 2000).select(F.lit(n).alias("name"), "*") for n in readers.SYNTHETIC)
)
query("noisy_lcg", "WITH RECURSIVE g(row_id, x) AS (SELECT 0, (42::HUGEINT * 6364136223846793005 + 1) % 18446744073709551616 UNION ALL SELECT row_id + 1, (x * 6364136223846793005 + 1) % 18446744073709551616 FROM g WHERE row_id < 999) SELECT CAST(row_id AS BIGINT) AS row_id, CAST(x % 1000000 AS BIGINT) AS value FROM g".replace("(x * 6364136223846793005 + 1)", "((x * 6364136223 % 18446744073709551616 * 1000000000 + x * 846793005 + 1))"))(
    lambda s, d: readers.lcg(s, 1000, 256)
)
_DUCK = {"Runs": "2000000 + [10, 20, 10, 30][(r // 37) % 4 + 1]", "ManyRuns": "2000000 + ((r // 8) * 37) % 1024", "SmallDomain": "3000000 + [0, 1, 7, 2, 1][r % 5 + 1]"}
query("heldout_profiles", " UNION ALL ".join(
    f"SELECT '{n}' AS profile, '{k}' AS nulls, r AS row_id, CASE WHEN {gone} THEN NULL ELSE CAST({_DUCK.get(n, f)} AS BIGINT) + CASE WHEN r % 997 = 503 THEN 1000000000 ELSE 0 END END AS value FROM range(2000) t(r)"
    for n, f in readers.PROFILES.items() for k, gone in (("", "false"), ("some", "r % 17 = 0"), ("First", "r < 125"), ("Last", "r >= 1875"))
))(lambda s, d: _union(readers.profile(s, n, 2000, k, True).select(F.lit(n).alias("profile"), F.lit(k).alias("nulls"), "row_id", "value") for n in readers.PROFILES for k in ("", "some", "First", "Last")))


def _union(frames) -> DataFrame:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out


CORPUS = f"(SELECT CASE WHEN col IN ('ts', 'cents', 'user') THEN 'events' ELSE 'made' END AS \"group\", CASE WHEN col IN ('ts', 'saw') THEN 'a' ELSE 'b' END AS source, CASE col WHEN 'ts' THEN 'timestamp' ELSE col END AS name, row_id, value FROM {LONG})"


def catalogue(spark, d) -> DataFrame:
    return long(spark, d).selectExpr("CASE WHEN col IN ('ts', 'cents', 'user') THEN 'events' ELSE 'made' END AS group", "CASE WHEN col IN ('ts', 'saw') THEN 'a' ELSE 'b' END AS source", "CASE col WHEN 'ts' THEN 'timestamp' ELSE col END AS name", "row_id", "value")


query("census_corpus", f"SELECT \"group\", source, name, count(*) AS rows, CAST(row_number() OVER (ORDER BY \"group\", source, name) AS INTEGER) AS place FROM {CORPUS} GROUP BY \"group\", source, name")(lambda s, d: corpus.census_corpus(catalogue(s, d)))
_ALL = CORPUS.replace("CASE WHEN col IN ('ts', 'cents', 'user') THEN 'events' ELSE 'made' END", "'all'").replace("CASE WHEN col IN ('ts', 'saw') THEN 'a' ELSE 'b' END", "'one'")
query("predicate_corpus", f"""WITH e AS (SELECT "group", source, name, count(*) AS rows FROM {_ALL} GROUP BY ALL), s AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY "group", source ORDER BY NOT contains(name, 'timestamp'), name) = 1)
SELECT e."group", e.source, CASE WHEN contains(s.name, 'timestamp') THEN 'timestamp' ELSE 'identifier' END AS kind, s.name AS selector, e.name AS value, e.rows FROM e JOIN s ON e."group" = s."group" AND e.source = s.source AND e.name <> s.name AND e.rows = s.rows WHERE e.rows >= 1000""")(
    lambda s, d: corpus.predicate_corpus(catalogue(s, d).withColumns({"group": F.lit("all"), "source": F.lit("one")}), 1000)
)
query("corpus_pair_sum", f"SELECT CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS sum, count(*) AS matched_rows FROM events WHERE user_id BETWEEN 10 AND 40")(
    lambda s, d: big(scans.predicate_sum(corpus.aligned(catalogue(s, d).withColumns({"group": F.lit("all"), "source": F.lit("one")}), "all", "one", "user", "cents"), 10, 40))
)
PAGES16 = f"SELECT col, row_id // 16384 AS page, count(*) AS rows, count(*) - count(value) AS nulls, bool_and(coalesce(value >= p, true)) AS monotone FROM (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY col, row_id // 16384 ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM {LONG}) GROUP BY col, page"
query("census_page_stats_16384", PAGES16)(lambda s, d: census.page_stats(long(s, d), 16_384))
query("census_page_displacement", f"SELECT col, page, max(abs(a - b)) AS max_displacement FROM (SELECT col, row_id // 1024 AS page, row_number() OVER (PARTITION BY col, row_id // 1024 ORDER BY row_id) AS a, row_number() OVER (PARTITION BY col, row_id // 1024 ORDER BY value, row_id) AS b FROM {LONG} WHERE value IS NOT NULL) GROUP BY col, page")(
    lambda s, d: census.page_displacement(long(s, d))
)
DENSE = f"""d AS (SELECT col, value, row_number() OVER w - 1 AS pos, value - lag(value) OVER w AS step FROM {LONG} WHERE value IS NOT NULL WINDOW w AS (PARTITION BY col ORDER BY row_id)),
m AS (SELECT col, count(*) AS n, min(value) AS lo, max(value) AS hi, count(DISTINCT value) AS u, count(*) FILTER (step <> 0) + 1 AS runs, coalesce(min(step) FILTER (pos % 256 > 0), 0) AS smin, coalesce(max(step) FILTER (pos % 256 > 0), 0) AS smax,
coalesce(min(step), 0) AS tmin, coalesce(max(step), 0) AS tmax FROM d GROUP BY col), c AS (SELECT m.*, rows FROM m JOIN (SELECT col, count(*) AS rows FROM {LONG} GROUP BY col) USING (col))"""


def _pack(n: str, most: str) -> str:
    return f"({n} + 127) // 128 * greatest(8, 16 * CASE WHEN {most} = 0 THEN 0 ELSE length(bin({most})) END)"


_RUNS = "4 * runs + 8 * ((runs + 31) // 32 + 1)"
_SIZES = {
    "FOR(BitPack)": f"8 + {_pack('n', '(hi - lo)')}", "Delta@256(BitPack)": f"8 * ((n + 255) // 256) + {_pack('n', 'greatest(2 * smax, -2 * smin - 1, 0)')}",
    "UnsignedDelta@256(BitPack)": f"CASE WHEN smin >= 0 THEN 8 * ((n + 255) // 256) + {_pack('n', 'greatest(smax, 0)')} END", "UnsignedDelta@whole(BitPack)": f"CASE WHEN tmin >= 0 THEN 8 + {_pack('n', 'greatest(tmax, 0)')} END",
    "Dictionary(BitPack)": f"8 * u + {_pack('n', '(u - 1)')}", "Dictionary(RLE(BitPack))": f"8 * u + {_RUNS} + {_pack('runs', '(u - 1)')}", "RLE(FOR(BitPack))": f"{_RUNS} + 8 + {_pack('runs', '(hi - lo)')}",
}
_NULLS = "CASE WHEN n < rows THEN (rows + 7) // 8 + 4 * ((rows + 255) // 256 + 1) ELSE 0 END"
MENU = " UNION ALL ".join(
    f"SELECT col, '{k}' AS recipe, false AS framed, {'(rows + 127) // 128 * 128 <= 256' if 'whole' in k else 'true'} AS access_ready, ({v}) IS NOT NULL AS admitted, CAST(({v}) + {_NULLS} AS BIGINT) AS bytes FROM c UNION ALL SELECT col, 'Frame({k})', true, false, ({v}) IS NOT NULL, CAST(NULL AS BIGINT) FROM c"
    for k, v in _SIZES.items()
)
query("census_candidate_menu", f"WITH {DENSE} {MENU}")(lambda s, d: census.candidates(long(s, d)))
query("layout_selection", f"WITH {DENSE}, f AS (SELECT * FROM ({MENU}) WHERE bytes IS NOT NULL) SELECT * FROM (SELECT col, recipe AS smallest, bytes AS smallest_bytes FROM f QUALIFY row_number() OVER (PARTITION BY col ORDER BY bytes, recipe) = 1) JOIN (SELECT col, recipe AS ready, bytes AS ready_bytes FROM f WHERE access_ready QUALIFY row_number() OVER (PARTITION BY col ORDER BY bytes, recipe) = 1) USING (col)")(
    lambda s, d: census.layouts(long(s, d))
)
_SMALL = "(u <= 256 OR 8 * u <= n)"
query("census_summary", f"""WITH {DENSE}, s AS (SELECT tmin >= 0 AS mono, {_SMALL} AS small, * FROM c)
SELECT metric, round(value, 9) AS value FROM (SELECT 'columns' AS metric, CAST(count(*) AS DOUBLE) AS value FROM s UNION ALL SELECT 'rows', CAST(sum(rows) AS DOUBLE) FROM s UNION ALL SELECT 'global_monotone_columns', CAST(count(*) FILTER (mono) AS DOUBLE) FROM s
UNION ALL SELECT 'global_monotone_column_fraction', avg(CAST(mono AS DOUBLE)) FROM s UNION ALL SELECT 'global_monotone_row_fraction', CAST(coalesce(sum(n) FILTER (mono), 0) AS DOUBLE) / sum(n) FROM s
UNION ALL SELECT 'small_domain_columns', CAST(count(*) FILTER (small) AS DOUBLE) FROM s UNION ALL SELECT 'small_domain_column_fraction', avg(CAST(small AS DOUBLE)) FROM s
UNION ALL SELECT 'page_16384_monotone_fraction', avg(CAST(monotone AS DOUBLE)) FROM ({PAGES16}) UNION ALL SELECT 'page_1024_monotone_fraction', avg(CAST(monotone AS DOUBLE)) FROM ({PAGES16.replace('16384', '1024')}))""")(
    lambda s, d: census.summary(long(s, d)).select("metric", F.round("value", 9).alias("value"))
)
DISPLACED = f"(SELECT col, max(abs(a - b)) AS x FROM (SELECT col, row_number() OVER (PARTITION BY col ORDER BY row_id) AS a, row_number() OVER (PARTITION BY col ORDER BY value, row_id) AS b FROM {LONG} WHERE value IS NOT NULL) GROUP BY col)"


@query("census_k_displaced", f"SELECT k AS within, round(count(*) FILTER (x <= k) / CAST(count(*) AS DOUBLE), 9) AS fraction FROM {DISPLACED}, (SELECT unnest([0, 1, 4, 16, 64, 256]) AS k) GROUP BY k")
def census_k_displaced(spark, d):
    """Shares of columns whose values lie within k places of their order."""
    each = _union(census.rank_displacement(col(spark, d, n)) for n in CENSUS)
    return each.select(F.explode(F.array(*(F.lit(k) for k in census.DISPLACED))).alias("within"), "max_displacement").groupBy("within").agg(F.round(F.avg((F.col("max_displacement") <= F.col("within")).cast("double")), 9).alias("fraction"))


# -------------------------------------------------------------------- statistics

CLASSED = f"(SELECT page % 3 AS class, page AS source, selective / CAST(fused AS DOUBLE) AS a, fused / CAST(selective AS DOUBLE) AS b FROM {TIMES})"
query("source_class_rollup", f"SELECT class, count(*) AS sources, CAST(sum(cells) AS BIGINT) AS cells, round(median(a), 9) AS a, round(median(b), 9) AS b FROM (SELECT class, source, count(*) AS cells, median(a) AS a, median(b) AS b FROM {CLASSED} GROUP BY class, source) GROUP BY class")(
    lambda s, d: (lambda t: t.select("class", "sources", "cells", F.round("a", 9).alias("a"), F.round("b", 9).alias("b")))(
        statistics.rollup(times(s, d).select((F.col("page") % 3).alias("class"), F.col("page").alias("source"), (F.col("selective") / F.col("fused")).alias("a"), (F.col("fused") / F.col("selective")).alias("b")), ["class", "source"], ["a", "b"])
    )
)
REGRET = f"(SELECT CASE WHEN predicted_fused * 1.1 < predicted_selective THEN fused ELSE selective END / CAST(least(fused, selective) AS DOUBLE) AS regret, (predicted_fused * 1.1 < predicted_selective) = (fused < selective) AS \"right\" FROM {TIMES})"
query("regret_evaluation", f"SELECT round(avg(CAST(\"right\" AS DOUBLE)), 9) AS accuracy, round(avg(regret), 9) AS mean, round(median(regret), 9) AS median, round((SELECT regret FROM (SELECT regret, row_number() OVER (ORDER BY regret) - 1 AS i, count(*) OVER () AS n FROM {REGRET}) WHERE i = least(n - 1, n * 95 // 100)), 9) AS p95, round(max(regret), 9) AS max FROM {REGRET}")(
    lambda s, d: (lambda t: t.select(*(F.round(c, 9).alias(c) for c in ("accuracy", "mean", "median", "p95", "max"))))(
        statistics.regret_summary(times(s, d).select(
            (F.when(F.col("predicted_fused") * 1.1 < F.col("predicted_selective"), F.col("fused")).otherwise(F.col("selective")) / F.least("fused", "selective")).alias("regret"),
            ((F.col("predicted_fused") * 1.1 < F.col("predicted_selective")) == (F.col("fused") < F.col("selective"))).alias("right"),
        ))
    )
)
query("best_guard", f"SELECT guard FROM (SELECT guard, avg(CASE WHEN predicted_fused * guard < predicted_selective THEN fused ELSE selective END / CAST(least(fused, selective) AS DOUBLE)) AS r FROM {TIMES}, (SELECT CAST(unnest([1.0, 1.05, 1.1, 1.15, 1.2, 1.25, 1.3, 1.4, 1.5]) AS DOUBLE) AS guard) GROUP BY guard) ORDER BY round(r, 12), guard DESC LIMIT 1")(
    lambda s, d: statistics.guard_regret(times(s, d)).withColumn("_r", F.round("regret", 12)).orderBy("_r", F.desc("guard")).limit(1).select("guard")
)


@query("preflight_features", f"""SELECT rows + 1 AS selected_rows, CAST(rows + 1 AS BIGINT) AS decoded_rows, CAST(CASE WHEN selective % 3 > 0 THEN 4096 + 8 * fused ELSE 512 + (greatest(4096 + 8 * fused - 512, 0) * (rows + 1) + 49) // 50 END AS BIGINT) AS delivered_bytes,
CAST(1 + selective % 3 + fused % 5 AS BIGINT) AS transfer_operations, CAST(selective % 3 AS BIGINT) AS frames_decoded FROM {TIMES}""")
def preflight_features(spark, d):
    """What a selective plan of each cell costs before it runs."""
    t = times(spark, d)
    made = statistics.preflight_free(F.col("rows") + 1, F.lit(50), 4096 + 8 * F.col("fused"), F.lit(512), F.col("selective") % 3, F.col("fused") % 5, False)
    return big(t.select(*(c.alias(n) for n, c in made.items())))


XS = "xor(x, (x & 2251799813685247::UBIGINT) << 13)", "xor(a, a >> 7)", "xor(b, (b & 140737488355327::UBIGINT) << 17)"
STEP = f"SELECT i + 1, {XS[2]} FROM (SELECT i, {XS[1]} AS b FROM (SELECT i, {XS[0]} AS a FROM g WHERE i < 2000 * (SELECT count(*) FROM v)))"
_PICKS = "g(i, x) AS (SELECT 0, 7640891576956012809::UBIGINT UNION ALL {}), q AS (SELECT median(m) AS m FROM g JOIN v ON v.k = g.x % (SELECT count(*) FROM v) WHERE i > 0 GROUP BY (i - 1) // (SELECT count(*) FROM v)), o AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS r FROM q)".format(STEP)
query("bootstrap_interval", f"WITH RECURSIVE v AS (SELECT row_number() OVER (ORDER BY page) - 1 AS k, median(fused / CAST(selective AS DOUBLE)) AS m FROM {TIMES} GROUP BY page), {_PICKS} SELECT max(m) FILTER (r = 50) AS low, max(m) FILTER (r = 1950) AS high FROM o")(
    lambda s, d: s.createDataFrame([statistics.bootstrap_median([r.m for r in times(s, d).groupBy("page").agg(F.percentile(F.col("fused") / F.col("selective"), 0.5).alias("m")).orderBy("page").collect()])], "low double, high double")
)
_MEANS = f"(SELECT row_number() OVER (ORDER BY abs(ln(m))) AS rank, m, count(*) OVER () AS n FROM (SELECT avg(fused / CAST(selective AS DOUBLE)) AS m FROM {TIMES} GROUP BY page))"
query("signed_rank_tests", f"""WITH x AS (SELECT * FROM {_MEANS}), t AS (SELECT count(*) AS n, CAST(coalesce(sum(rank) FILTER (m > 1), 0) AS BIGINT) AS plus, count(*) FILTER (m < 1) AS wins FROM x),
w AS (SELECT mask, CAST(coalesce(sum(rank) FILTER (mask >> CAST(rank - 1 AS INTEGER) & 1 = 1), 0) AS BIGINT) AS s, bit_count(mask) AS ones FROM x, (SELECT unnest(range(CAST(pow(2, (SELECT n FROM t)) AS BIGINT))) AS mask) GROUP BY mask)
SELECT least(1.0, 2.0 * count(*) FILTER (s <= least(plus, n * (n + 1) // 2 - plus)) / count(*)) AS wilcoxon, CAST(count(*) FILTER (ones >= wins) AS DOUBLE) / count(*) AS sign FROM w, t""")(
    lambda s, d: _ranks(s, [r.m for r in times(s, d).groupBy("page").agg(F.avg(F.col("fused") / F.col("selective")).alias("m")).orderBy("page").collect()])
)


def _ranks(spark, ratios) -> DataFrame:
    """Exact tests on all ratios, ties and parity included (which the signed ranks reject)."""
    return spark.createDataFrame([(statistics.wilcoxon_exact(ratios), statistics.sign_test(sum(x < 1 for x in ratios), len(ratios)))], "wilcoxon double, sign double")


@query("plan_signature", None)
def plan_signature(spark, d):
    """No SQL: a hash of four plans of a column, the same whatever data they are for."""
    c = kept(spark, d, "for")
    plans = [compiler.compile_query(q, c) for q in (Query("Get", 3), Query("Sum", 1, 9), Query("Between", 1, 9, 2, 5), Query("Filter", low=2, high=5))]
    return spark.createDataFrame([(bridge.signature(plans),)], "signature string")


@query("bridge_run", "SELECT 'dictionary' AS recipe, 'filter_equals' AS kind, CAST(count(*) AS BIGINT) AS checksum FROM events WHERE user_id = 7 UNION ALL SELECT 'dictionary_rle', 'count_equals', count(*) FROM events WHERE user_id % 7 = 3 UNION ALL SELECT 'rle_for', 'count_equals', count(*) FROM events WHERE user_id % 7 = 3 UNION ALL SELECT 'unsigned_delta', 'filter_between', count(*) FROM events WHERE 4000000 + 7 * (event_id % 256) BETWEEN 4000350 AND 4001300")
def bridge_run(spark, d):
    """Requests as JSON, for recipes whose plans read their fields."""
    asks = {"dictionary": {"kind": "filter_equals", "value": 7}, "dictionary_rle": {"kind": "count_equals", "value": 3}, "rle_for": {"kind": "count_equals", "value": 3}, "unsigned_delta": {"kind": "filter_between", "low": 4000350, "high": 4001300}}
    out = [(name, q["kind"], scans.answer_checksum(bridge.answer(col(spark, d, RECIPES[name][0]), {"recipe": RECIPES[name][1], "query": q})).first()[0]) for name, q in asks.items()]
    json.dumps(out)
    return spark.createDataFrame(out, "recipe string, kind string, checksum long")
