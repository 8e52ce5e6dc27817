"""Vectorised word access for Arrow string columns, and the shared folder.

A *word* is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``.  All
functions work on the UTF-8 bytes of a whole batch with numpy, so no Python
object is made for a document or a word.
"""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step holds at a time.
STEP_BYTES = 2 << 20
#: Bytes of words that are hashed at a time.
HASHED = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULT, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
_own: dict[str, str] = {}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply, twice)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@dataclass
class Words:
    """Words of a batch: byte spans, and ``first[d]:first[d + 1]`` for document d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes (A-Z folded to a-z if ``lower``).

        By slices of some ``HASHED`` bytes, so a very long text takes no more
        working memory than a short one, whether it is many words or one.
        """
        out = np.empty(len(self.start), dtype=np.uint64)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + HASHED, "right")))
            if self.end[i] - self.start[i] > HASHED:
                out[i], j = self._long(int(self.start[i]), int(self.end[i]), lower), i + 1
            else:
                at = self.start[i]
                data = self.data[at : self.end[j - 1]]
                run = np.zeros(len(data) + 1, dtype=np.uint64)
                np.cumsum(_BYTE[LOWER[data] if lower else data] * _power("p", _MULT, len(data)), out=run[1:])
                out[i:j] = (run[self.end[i:j] - at] - run[self.start[i:j] - at]) * _power("i", _INVERSE, len(data))[self.start[i:j] - at]
            i = j
        return mix(out + (self.end - self.start).astype(np.uint64))

    def _long(self, start: int, end: int, lower: bool) -> np.uint64:
        total = 0
        for a in range(start, end, HASHED):
            data = self.data[a : min(a + HASHED, end)]
            part = int(np.sum(_BYTE[LOWER[data] if lower else data] * _power("p", _MULT, len(data)), dtype=np.uint64))
            total = (total + part * pow(_MULT, a - start, 1 << 64)) % (1 << 64)
        return np.uint64(total)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(column: pa.Array) -> Words:
    data, offsets = buffers(column)
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64), offsets)
    gap = SPACE[data]
    before, after = np.empty_like(gap), np.empty_like(gap)
    before[0], after[-1] = True, True
    before[1:], after[:-1] = gap[:-1], gap[1:]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[full] = True
    after[full[1:] - 1] = True
    np.logical_not(gap, out=gap)
    start, end = np.flatnonzero(gap & before), np.flatnonzero(gap & after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets), offsets)


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; one document at least."""
    at = batch.schema.get_field_index(column)
    if not batch.num_rows:
        return
    text = batch.column(at)
    if text.null_count:
        text = text.fill_null("")
    _, offsets = buffers(text)
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def uint_le(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each unsigned 64-bit value."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def from_uint_le(raw: bytes, width: int) -> np.ndarray:
    got = np.frombuffer(raw, dtype=np.uint8).reshape(-1, width)
    out = np.zeros((len(got), 8), dtype=np.uint8)
    out[:, :width] = got
    return out.view("<u8").reshape(-1)


# --------------------------------------------------------------- the session

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark) -> None:
    """Let Python workers of this session import the package (local sessions start
    elsewhere), and give large arrays back to the system once they are freed."""
    env = spark.sparkContext.environment
    env.setdefault("MALLOC_MMAP_THRESHOLD_", str(4 << 20))
    env.setdefault("MALLOC_TRIM_THRESHOLD_", str(32 << 20))
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def shared_uri(spark) -> str:
    """``spark.checkpoint.dir``; a temporary folder of our own only where it is unset and
    driver and executors are one process (tests); on a cluster it must be set."""
    if uri := spark.conf.get("spark.checkpoint.dir", None):
        return uri.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "own" not in _own:
        _own["own"] = tempfile.mkdtemp(prefix="licet-")
        atexit.register(shutil.rmtree, _own["own"], True)
    return f"file://{_own['own']}"


def _delete(uri: str) -> None:
    from pyspark.sql import SparkSession

    if "://" not in uri or uri.startswith("file:"):
        shutil.rmtree(unquote(urlparse(uri).path), ignore_errors=True)
    elif (spark := SparkSession.getActiveSession()) is not None:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark, kind: str) -> str:
    """URI of a new folder of our own in the shared one; deleted when the driver exits."""
    uri = f"{shared_uri(spark)}/{kind}-{uuid.uuid4().hex}"
    atexit.register(_delete, uri)
    return uri


def mounted(uri: str) -> str:
    """The local path of a shared ``file:`` URI; memory mapping needs a mounted folder."""
    parsed = urlparse(uri)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped models need a mounted (file:) spark.checkpoint.dir, not {parsed.scheme}:")
    return unquote(parsed.path)


def written(df, kind: str):
    """The rows as a table in the shared folder: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    uri = shared_folder(spark, kind)
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def documents(spark, sf_dir: str):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def warn(text: str) -> None:
    print(text, file=sys.stderr)


def unused(df, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns of ``df``."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def plus(schema, **columns: str):
    """A schema with further columns, given by their types' names."""
    from pyspark.sql import types as T

    out = T.StructType(list(schema.fields))
    for name, kind in columns.items():
        out = out.add(name, T.StructType.fromDDL(f"_ {kind}").fields[0].dataType)
    return out


def extended(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    """A batch with further columns."""
    made = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in columns.values()]
    return pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *columns])
