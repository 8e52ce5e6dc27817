"""Checksummed pages of a column: frame of reference and real bit packing, and a bundle of them at aligned offsets."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import fnv1a
from ..operators.rows import block, folded

#: The head: magic, version, flags (1: nulls), rows, values, base, width, body's checksum, head's checksum.
MAGIC, VERSION, HEAD, ALIGN = b"LICETPG1", 1, "<8sHHIIqBxxxIQ", 64
_HEAD = struct.calcsize(HEAD)


def pack(values: np.ndarray, valid: np.ndarray) -> bytes:
    """A page of the values that are there, as differences from the least in as few bits as the largest needs."""
    dense = values[valid]
    base = int(dense.min()) if len(dense) else 0
    codes = (dense.astype(np.int64) - np.int64(base)).view(np.uint64) if len(dense) else np.zeros(0, np.uint64)
    width = int(codes.max(initial=0)).bit_length()
    bits = (codes[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
    flags = 0 if valid.all() else 1
    body = (np.packbits(valid, bitorder="little").tobytes() if flags else b"") + np.packbits(bits.ravel(), bitorder="little").tobytes()
    head = [MAGIC, VERSION, flags, len(valid), len(dense), base, width, zlib.crc32(body)]
    return struct.pack(HEAD, *head, fnv1a(struct.pack(HEAD, *head, 0))) + body


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where null) and validity; a damaged page is an error."""
    if len(raw) < _HEAD:
        raise ValueError("a page shorter than its head")
    *head, check = struct.unpack_from(HEAD, raw)
    magic, version, flags, rows, dense, base, width, crc = head
    if magic != MAGIC or version != VERSION or flags > 1 or width > 64:
        raise ValueError("not a page of this kind")
    if fnv1a(struct.pack(HEAD, *head, 0)) != check or struct.pack(HEAD, *head, check) != raw[:_HEAD]:
        raise ValueError("a damaged head")
    null_bytes = -(-rows // 8) if flags else 0
    if len(raw) != _HEAD + null_bytes + -(-dense * width // 8) or zlib.crc32(raw[_HEAD:]) != crc:
        raise ValueError("a damaged body")
    valid = np.unpackbits(np.frombuffer(raw, np.uint8, null_bytes, _HEAD), count=rows, bitorder="little").astype(bool) if flags else np.ones(rows, bool)
    if int(valid.sum()) != dense or (flags and dense == rows):
        raise ValueError("nulls that do not fit the head")
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, offset=_HEAD + null_bytes), count=dense * width, bitorder="little").reshape(dense, width).astype(np.uint64)
    codes = (bits << np.arange(width, dtype=np.uint64)).sum(1, dtype=np.uint64)
    values = np.zeros(rows, dtype=np.int64)
    values[valid] = (codes + np.int64(base).view(np.uint64)).view(np.int64)
    return values, valid


def to_pages(df: DataFrame, page_rows: int = 16_384) -> DataFrame:
    """(page, raw) of a column (row_id, value) with all its rows."""

    def build(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("row_id")
        first = int(g["page"].iloc[0]) * page_rows
        if not np.array_equal(g["row_id"].to_numpy(), np.arange(first, first + len(g))):
            raise ValueError("a page lacks rows")
        return pd.DataFrame({"page": [g["page"].iloc[0]], "raw": [pack(g["value"].to_numpy(), g["valid"].to_numpy(dtype=bool))]})

    rows = df.select(block(page_rows).alias("page"), "row_id", F.coalesce("value", F.lit(0).cast("long")).alias("value"), F.col("value").isNotNull().alias("valid"))
    return rows.groupBy("page").applyInPandas(build, "page long, raw binary")


def from_pages(pages: DataFrame, page_rows: int = 16_384) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for page, raw in zip(b["page"], b["raw"]):
                values, valid = unpack(bytes(raw))
                yield pd.DataFrame({"row_id": page * page_rows + np.arange(len(values)), "value": values, "valid": valid})

    got = pages.mapInPandas(read, "row_id long, value long, valid boolean")
    return got.select("row_id", F.when(F.col("valid"), F.col("value")).alias("value"))


def bundle(pages: DataFrame) -> DataFrame:
    """(page, offset, bytes) of pages laid end to end, each at a multiple of 64."""
    size = pages.select(F.col("page").alias("_b"), F.length("raw").cast("long").alias("bytes"))
    room = size.withColumn("_room", F.ceil(F.col("bytes") / ALIGN) * ALIGN)
    return folded(room, "_room", F.sum, "offset").select(F.col("_b").alias("page"), F.col("offset").cast("long").alias("offset"), "bytes")
