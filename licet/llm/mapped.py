"""Files of arrays in the shared folder, which workers map into memory."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Files that a worker keeps mapped.
MAPPED = 8192


def _aligned(n: int) -> int:
    return -(-n // 8) * 8


def save(path: str, **arrays: np.ndarray) -> None:
    """Arrays in one file with an offset table, which appears at once, so a task may be run again."""
    table, at = {}, 0
    for name, a in arrays.items():
        table[name] = [a.dtype.str, list(a.shape), at]
        at += _aligned(a.nbytes)
    head = json.dumps(table).encode()
    head += b" " * (_aligned(len(head)) - len(head))
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{os.path.dirname(path)}/.{os.path.basename(path)}-{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes())
            f.write(b"\0" * (_aligned(a.nbytes) - a.nbytes))
    os.replace(part, path)


def load(path: str) -> dict[str, np.ndarray]:
    if not os.path.exists(path):
        return {}
    raw = np.memmap(path, dtype=np.uint8, mode="r")
    n = int.from_bytes(raw[:8].tobytes(), "little")
    out = {}
    for name, (kind, shape, at) in json.loads(raw[8 : 8 + n].tobytes()).items():
        size = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = np.frombuffer(raw[8 + n + at : 8 + n + at + size], dtype=kind).reshape(shape)
    return out


class Shards:
    """The mapped files of a folder, the last ``MAPPED`` used ones."""

    def __init__(self, folder: str):
        self.folder, self.open = folder, {}

    def __call__(self, name: str) -> dict[str, np.ndarray]:
        got = self.open.pop(name, None)
        if got is None:
            got = load(f"{self.folder}/{name}")
            if len(self.open) >= MAPPED:
                self.open.pop(next(iter(self.open)))
        self.open[name] = got
        return got


def by_shard(batches: Iterator[pa.RecordBatch], done) -> Iterator[pa.RecordBatch]:
    """Calls ``done(shard, table)`` for the rows of each shard, which follow each other (first column)."""
    now, held = None, []
    for batch in batches:
        shard = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if shard[a] != now and held:
                yield done(int(now), pa.Table.from_batches(held))
                held = []
            now = shard[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield done(int(now), pa.Table.from_batches(held))
