"""Raw 64-bit pages: a column as binaries of fixed row ranges, and back."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rows import BLOCK, block

#: The magic, then the rows (u64) and the bitmap's bytes (u32), little endian.
MAGIC, HEAD = b"RAWI64V1", "<QI"
_START = len(MAGIC) + struct.calcsize(HEAD)


def pack(values: np.ndarray, valid: np.ndarray) -> bytes:
    """Header, validity bitmap (low bit first; none if every row has a value), then the values that are there."""
    bits = b"" if valid.all() else np.packbits(valid, bitorder="little").tobytes()
    return MAGIC + struct.pack(HEAD, len(valid), len(bits)) + bits + values[valid].astype("<i8").tobytes()


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where null) and validity; anything but a whole page is an error."""
    if len(raw) < _START or raw[: len(MAGIC)] != MAGIC:
        raise ValueError("not a raw page")
    n, size = struct.unpack_from(HEAD, raw, len(MAGIC))
    if size not in (0, -(-n // 8)) or _START + size > len(raw):
        raise ValueError("a malformed validity bitmap")
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, size, _START), bitorder="little") if size else np.ones(n, np.uint8)
    if bits[n:].any():
        raise ValueError("a validity bit beyond the rows")
    valid = bits[:n].astype(bool)
    if len(raw) != _START + size + 8 * int(valid.sum()):
        raise ValueError("a page's values do not match its validity")
    values = np.zeros(n, dtype=np.int64)
    values[valid] = np.frombuffer(raw, "<i8", offset=_START + size)
    return values, valid


def to_raw(df: DataFrame, page_rows: int = BLOCK) -> DataFrame:
    """(page, raw) of a column (row_id, value) with all its rows; a task holds one page at a time."""

    def build(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("row_id")
        first = int(g["page"].iloc[0]) * page_rows
        if not np.array_equal(g["row_id"].to_numpy(), np.arange(first, first + len(g))):
            raise ValueError("a page lacks rows")
        raw = pack(g["value"].to_numpy(), g["valid"].to_numpy(dtype=bool))
        return pd.DataFrame({"page": [g["page"].iloc[0]], "raw": [raw]})

    # nulls as 0 and a flag: pandas would make doubles of nullable longs
    rows = df.select(block(page_rows).alias("page"), "row_id", F.coalesce("value", F.lit(0).cast("long")).alias("value"), F.col("value").isNotNull().alias("valid"))
    return rows.groupBy("page").applyInPandas(build, "page long, raw binary")


def from_raw(pages: DataFrame, page_rows: int = BLOCK) -> DataFrame:
    """The column (row_id, value) of :func:`to_raw`'s pages."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for page, raw in zip(b["page"], b["raw"]):
                values, valid = unpack(bytes(raw))
                yield pd.DataFrame({"row_id": page * page_rows + np.arange(len(values)), "value": values, "valid": valid})

    got = pages.mapInPandas(read, "row_id long, value long, valid boolean")
    return got.select("row_id", F.when(F.col("valid"), F.col("value")).alias("value"))
