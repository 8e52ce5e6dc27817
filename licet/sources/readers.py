"""Sources and sinks of ordered columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import parse_ts, scaled, scaled_text, text_decimals, verified_scale
from ..operators.rows import file_rows


def _single(files: list[str]) -> None:
    if len(files) > 1:
        raise ValueError("row order of several text files is not defined; read them one by one")


def csv_series(spark: SparkSession, path: str) -> DataFrame:
    """``timestamp,value`` with a header: row_id, ts (epoch seconds), value text."""
    df = spark.read.csv(path, header=True, schema="timestamp string, value string")
    _single(df.inputFiles())
    return _numbered(df).select("row_id", parse_ts(F.col("timestamp")).alias("ts"), "value")


def _numbered(df: DataFrame) -> DataFrame:
    """Row numbers of one text file: splits are in file order, so partition then position inside it."""
    part = df.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    counts = {r._p: r.n for r in part.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}
    at, cases = 0, F.lit(0).cast("long")
    for p in sorted(counts):
        cases = F.when(F.col("_p") == p, F.lit(at)).otherwise(cases)
        at += counts[p]
    return part.withColumn("row_id", cases + F.col("_i")).drop("_p", "_i")


def household(spark: SparkSession, path: str) -> DataFrame:
    """``;``-separated text with ``?`` or nothing for null and day-first dates."""
    df = spark.read.csv(path, header=True, sep=";", nullValue="?")
    _single(df.inputFiles())
    first, second, *rest = df.columns
    ts = F.unix_timestamp(F.concat_ws(" ", first, second), "d/M/yyyy H:mm:ss").alias("ts")
    return _numbered(df).select("row_id", ts, *rest)


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """One value a line; an empty line is null; at least 128 rows."""
    df = spark.read.text(path)
    _single(df.inputFiles())
    df = _numbered(df).select("row_id", F.nullif(F.trim("value"), F.lit("")).alias("value"))
    if df.count() < 128:
        raise ValueError("a column has at least 128 rows")
    return df


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """A whitespace matrix without its first column (labels), row after row."""
    df = _numbered(spark.read.text(path)).select("row_id", F.split(F.trim("value"), r"\s+").alias("cells"))
    cells = F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0)))
    return df.select("row_id", F.posexplode(cells).alias("j", "text")).select(F.struct("row_id", "j").alias("place"), F.col("text").cast("double").alias("value"))


def parquet_columns(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Integer, timestamp and exactly scalable double columns as (row_id, value); others are left out."""
    df = spark.read.parquet(path)
    rows = file_rows(df)
    out = {}
    for name, kind in df.dtypes:
        if kind in ("int", "bigint"):
            v = F.col(name).cast("long")
        elif kind in ("timestamp", "timestamp_ntz"):
            v = F.unix_micros(F.col(name).cast("timestamp"))
        elif kind == "double" and (s := verified_scale(df, name)) is not None:
            v = scaled(F.col(name), s)
        else:
            continue
        out[name] = rows.select("row_id", v.alias("value"))
    return out


def exact_text(df: DataFrame, column: str = "value") -> tuple[DataFrame, int] | None:
    """Decimal text as scaled integers at the least shared scale up to 4, else None."""
    r = df.agg(F.max(text_decimals(F.col(column))).alias("s"), F.count_if(F.col(column).isNotNull() & text_decimals(F.col(column)).isNull()).alias("odd")).first()
    if r.odd or (r.s or 0) > 4:
        return None
    return df.withColumn(column, scaled_text(F.col(column), r.s or 0)), r.s or 0


def token_directory(spark: SparkSession, path: str) -> list[dict]:
    """The columns of a folder of ``<table>__c<i>_<name>.csv`` files, one value a line, in the order of their names.

    Each is {"source", "name", "rows", "scale"}; a column called timestamp (or ending so) has epoch seconds.
    Columns of under 128 rows, and those that are no exact decimals, are left out.  One entry a file reaches the driver.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = sorted(s.getPath().toString() for s in where.getFileSystem(conf).listStatus(where) if s.getPath().getName().endswith(".csv"))
    out = []
    for f in found:
        stem = f.rsplit("/", 1)[1][: -len(".csv")]
        table, _, column = stem.rpartition("__") if "__" in stem else ("table", "", stem)
        if "__" in stem:
            table, column = stem.split("__", 1)
        try:
            rows = tokens(spark, f)
        except ValueError:
            continue
        if column == "timestamp" or column.endswith("_timestamp"):
            out.append({"source": table, "name": "timestamp", "rows": rows.select("row_id", F.expr("try_cast(value AS BIGINT)").alias("value")), "scale": 0})
        elif got := exact_text(rows):
            out.append({"source": table, "name": column, "rows": got[0], "scale": got[1]})
    return out


def lcg(spark: SparkSession, rows: int, block_rows: int = 4096) -> DataFrame:
    """The noisy synthetic column: x = 42, then x * 6364136223846793005 + 1 modulo 2^64, of which the last six digits count.

    Every block of rows begins at its own place of the sequence, found by powers, so blocks need not follow each other.
    """
    import numpy as np
    import pandas as pd

    a, mask = 6364136223846793005, (1 << 64) - 1

    def jump(n: int) -> tuple[int, int]:
        """n steps at once: x -> m * x + c."""
        m, c, fm, fc = 1, 0, a, 1
        while n:
            if n & 1:
                m, c = m * fm & mask, (c * fm + fc) & mask
            fm, fc, n = fm * fm & mask, (fc * fm + fc) & mask, n >> 1
        return m, c

    def make(batches):
        for b in batches:
            for first in b["id"]:
                first = int(first)
                n = min(block_rows, rows - first)
                m, c = jump(first + 1)
                x, out = (m * 42 + c) & mask, np.empty(n, dtype=np.int64)
                for i in range(n):
                    out[i] = x % 1_000_000
                    x = (x * a + 1) & mask
                yield pd.DataFrame({"row_id": np.arange(first, first + n), "value": out})

    return spark.range(0, rows, block_rows).mapInPandas(make, "row_id long, value long")


#: Row formulas of the synthetic columns (r: the row).
SYNTHETIC = {
    "constant": "42", "linear": "20 + 2 * r", "quadratic": "r * r + 2 * r + 4", "small_domain": "r % 7",
    "sparse_zero": "CASE WHEN r % 97 = 0 THEN r ELSE 0 END", "nullable_fee": "CASE WHEN r % 5 = 0 THEN NULL ELSE 100 + r % 13 END",
}
#: Profiles of held-out data; :func:`profile` has those of nulls and patches.
PROFILES = {
    "Trend": "1000000 + 7 * r + r % 5", "Runs": "2000000 + element_at(array(10, 20, 10, 30), CAST((r DIV 37) % 4 + 1 AS INT))",
    "ManyRuns": "2000000 + ((r DIV 8) * 37) % 1024", "SmallDomain": "3000000 + element_at(array(0, 1, 7, 2, 1), CAST(r % 5 + 1 AS INT))",
    "Sawtooth": "4000000 + 7 * (r % 256)",
}


def synthetic(spark: SparkSession, name: str, rows: int) -> DataFrame:
    return spark.range(rows).selectExpr("id AS r").selectExpr("r AS row_id", f"CAST({SYNTHETIC[name]} AS BIGINT) AS value")


def profile(spark: SparkSession, name: str, rows: int, nulls: str = "", patched: bool = False) -> DataFrame:
    """Held-out data: ``nulls`` is "", "some", "First" or "Last"; patched rows are 1e9 higher."""
    gone = {"": "false", "some": "r % 17 = 0", "First": f"r < {rows // 16}", "Last": f"r >= {rows - rows // 16}"}[nulls]
    hit = "r % 997 = 503" if patched else "false"
    return spark.range(rows).selectExpr("id AS r").selectExpr("r AS row_id", f"CASE WHEN {gone} THEN NULL ELSE CAST({PROFILES[name]} AS BIGINT) + CASE WHEN {hit} THEN 1000000000 ELSE 0 END END AS value", f"({hit}) AND NOT ({gone}) AS is_patch")


def write_csv(df: DataFrame, path: str) -> None:
    df.orderBy("row_id").select("value").write.csv(path, header=True, nullValue="", emptyValue="")


def write_parquet(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """Sorted by row, so that column indexes prune row ranges."""
    df.repartitionByRange("row_id").sortWithinPartitions("row_id").write.option("compression", compression).parquet(path)


def write_parquet_dictionary(df: DataFrame, path: str) -> None:
    """Dictionary pages under Snappy."""
    df.repartitionByRange("row_id").sortWithinPartitions("row_id").write.option("parquet.enable.dictionary", "true").option("compression", "snappy").parquet(path)


def write_parquet_delta(df: DataFrame, path: str) -> None:
    """Binary-packed deltas (pages of version 2 without dictionaries) under Zstandard at level 3."""
    out = df.repartitionByRange("row_id").sortWithinPartitions("row_id").write.option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false")
    out.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "3").parquet(path)


def write_orc(df: DataFrame, path: str) -> None:
    df.repartitionByRange("row_id").sortWithinPartitions("row_id").write.option("compression", "none").orc(path)


def write_pair(df: DataFrame, path: str, page_rows: int) -> None:
    """(row_id, timestamp, value) in pages of ``page_rows`` rows with page statistics, 64 of them to a row group."""
    out = df.repartitionByRange("row_id").sortWithinPartitions("row_id").write.option("parquet.page.row.count.limit", page_rows)
    out.option("parquet.block.row.count.limit", 64 * page_rows).parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    """A study's result as CSV with a header."""
    df.write.csv(path, header=True)
