"""Interpolated modified Kneser-Ney model of any order, counted in Spark.

Vocabulary: every task counts the hashes of its words; hash ranges of them are
summed, sorted and written.  The most frequent words have the first numbers, the
others follow by their place in that order.

Counting: every task turns its texts into numbers, sums the n-grams of a few
million tokens at a time and sends them, packed in the order of their first
words, to shards.  A shard task adds them up, writes sorted hash arrays, and
sends each distinct n-gram's last n - 1 words on: their count at the order
below is the number of distinct words before them (modified Kneser-Ney), and
so on down to single words.  A shard holds whole contexts, so the numbers of a
context's followers are counted in it; contexts whose words are all frequent
(more than ``SHARD`` times in the corpus) are dealt by whole n-grams instead,
and the numbers of their followers are added up in one more step, so that no
context gathers more than ``SHARD`` tokens in a task.  With many shards tasks
deal to ranges of shards first, which are dealt out again (:data:`FAN`).

Arrays: a shard is one file with an offset table, mapped into memory when it is
first needed.  A key is stored as 32 bits inside buckets of its upper bits; an
n-gram or context that was met once takes about 4.5 bytes, others 1 or 4
more.  About 50 bits of a key are compared within a shard, so an n-gram that
the corpus lacks is taken for one that it has once in 10^8 times.  Words have
64-bit hashes: two of n words share one with probability n * n / 2 ** 65.

Model: with counts c of an order (of the tokens at the highest one, of distinct
words before at the others) and discounts D for counts of 1, 2 and more,
``P(w|h) = (c(hw) - D) / c(h) + gamma(h) P(w|h')`` where h' lacks the first
word of h, down to ``1 / (V + 1)``, which is also what an unknown word gets; a
context that was never met is left out.  Texts begin with ``order - 1`` begin
marks, which are contexts only, and end with an end token.

Cases: null and empty texts have the end token only; without training documents
every token has probability ``1 / (V + 1) = 1``.  Extra columns pass through;
columns named as the results are replaced.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled, text
from .mapped import Shards, save

ORDER = 3
#: The hash of the end token; numbers of the begin mark and of words that the corpus lacks.
END = np.uint64(2)
BEGIN, UNKNOWN = 0, 2**63
#: Tokens that a task sums at a time; tokens of the input for each shard, and of a context in one.
TOKENS = 1_500_000
SHARD = 1_500_000
#: Shards that one task deals to at most.
FAN = 1024
#: Numbers below this one take two bytes where n-grams are packed.
SHORT = 2**16 - 1
_BUCKET = 16
_GRAMS, _CONTEXTS, _NUMBERS = 0, 1, 2
#: The usual numbers: an n-gram's count; a context's sum, followers counted once, twice, oftener.
ONCE, LONE = (1,), (1, 1, 0, 0)


@dataclass(frozen=True)
class Model:
    folder: str
    order: int
    shards: int
    types: int  # V: distinct words
    tokens: int  # N: training tokens
    discounts: tuple[tuple[float, float, float], ...]  # by order, from 1
    total: int  # sum of the single words' counts
    gamma: float  # of the empty context


@dataclass(frozen=True)
class Deal:
    """How n-grams are written and dealt."""

    folder: str
    shards: int
    width: int  # bytes of a word's number from SHORT on
    step: int  # shards of a range


# ------------------------------------------------------------------- hash keys


def sequence(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's words and its end token, and each document's first token."""
    w = text.words(column)
    n = len(w.first) - 1
    first = w.first + np.arange(n + 1)
    h = w.hashes(lower=True)
    h[h <= END] += np.uint64(8)
    word = np.full(first[-1], END, dtype=np.uint64)
    word[np.arange(len(h)) + np.repeat(np.arange(n), w.counts())] = h
    return word, first


def grams(ids: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """Columns of the n-gram that ends at each token; before a text stands the begin mark."""
    out = [ids]
    place = np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))
    for back in range(1, order):
        c = np.full(len(ids), BEGIN, dtype=np.uint64)
        c[back:] = ids[:-back]
        c[place < back] = BEGIN
        out.insert(0, c)
    return out


def key(columns: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(columns[0]), 0x51ED270B, dtype=np.uint64)
    for c in columns:
        h = longer(h, c)
    return h


def longer(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The keys of n-grams with one more word."""
    return text.mix(h * np.uint64(0x9E3779B97F4A7C15) + c)


def range_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of 64-bit hashes."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _grouped(shard: np.ndarray) -> np.ndarray:
    """A stable order by shard; 16 bits sort in linear time."""
    return np.argsort(shard.astype(np.uint16) if shard.max(initial=0) < 1 << 16 else shard, kind="stable")


def distinct(k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each, and each one's number: ``np.unique`` sorts stably for this, which is slower."""
    order = np.argsort(k)
    k = k[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    back = np.empty(len(k), dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    return k[new], order[new], back


def summed(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams and their counts."""
    k = key(columns)
    n = len(k)
    order = np.argsort(k)
    k = k[order]
    firsts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if n else np.zeros(0, np.int64)
    del k
    total = np.diff(np.append(firsts, n)).astype(np.uint64) if counts is None else np.add.reduceat(counts[order], firsts) if n else counts
    at = order[firsts]
    del order, firsts
    return [c[at] for c in columns], total


# ----------------------------------------------------------------------- blobs


def _pack_counts(c: np.ndarray) -> bytes:
    small = np.minimum(c, 255).astype(np.uint8)
    return small.tobytes() + c[small == 255].astype("<u8").tobytes()


def _unpack_counts(raw: memoryview, n: int) -> tuple[np.ndarray, int]:
    c = np.frombuffer(raw, np.uint8, n).astype(np.uint64)
    big = np.flatnonzero(c == 255)
    c[big] = np.frombuffer(raw, "<u8", len(big), n)
    return c, n + 8 * len(big)


def _planes(short: np.ndarray) -> list[bytes]:
    """Low and high bytes of 16-bit values."""
    return [(short & 255).astype(np.uint8).tobytes(), (short >> 8).astype(np.uint8).tobytes()]


def pack(columns: list[np.ndarray], counts: list[np.ndarray], width: int) -> bytes:
    """n-grams in the order of their first two words, of which the first is written once for its run.  Numbers from
    ``SHORT`` on follow in full.  Each kind of bytes is a block, which zstandard gives a code of its own."""
    short = [np.minimum(c, SHORT).astype(np.uint16) for c in columns]
    order = np.argsort(short[1], kind="stable") if len(short) > 1 else np.arange(len(short[0]))
    order = order[np.argsort(short[0][order], kind="stable")]
    short = [c[order] for c in short]
    firsts = np.flatnonzero(np.concatenate([[True], short[0][1:] != short[0][:-1]]))
    runs = np.diff(np.append(firsts, len(order))).astype(np.uint64)
    parts = [np.array([len(order), len(firsts)], dtype="<u8").tobytes() + _pack_counts(runs), *_planes(np.diff(short[0][firsts], prepend=np.uint16(0)))]
    for c in short[1:]:
        parts += _planes(c)
    parts.append(b"".join(text.uint_le(c[order[x == SHORT]], width) for c, x in zip(columns, short)))
    parts += [_pack_counts(c[order]) for c in counts]
    z = zstandard.ZstdCompressor(1).compressobj(sum(map(len, parts)))
    return b"".join([x for p in parts for x in (z.compress(p), z.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK))] + [z.flush()])


def unpack(raw: bytes, columns: int, counts: int, width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    view = memoryview(zstandard.decompress(raw))
    n, m = (int(x) for x in np.frombuffer(view, "<u8", 2))
    runs, used = _unpack_counts(view[16:], m)
    at = 16 + used
    ids = []
    for size in (m, *[n] * (columns - 1)):
        low, high = np.frombuffer(view, np.uint8, 2 * size, at).reshape(2, size).astype(np.uint64)
        ids.append(low | high << np.uint64(8))
        at += 2 * size
    ids[0] = np.repeat(np.cumsum(ids[0]), runs.astype(np.int64))
    for c in ids:
        long = np.flatnonzero(c == SHORT)
        c[long] = text.from_uint_le(view[at : at + len(long) * width], width)
        at += len(long) * width
    out = []
    for _ in range(counts):
        c, used = _unpack_counts(view[at:], n)
        out.append(c)
        at += used
    return ids, out


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["shard", "kind", "packed"])


_SCHEMA = "shard int, kind int, packed binary"


def _dealt(kind: int, shard: np.ndarray, columns: list[np.ndarray], counts: list[np.ndarray], width: int, step: int = 1) -> Iterator[pa.RecordBatch]:
    """n-grams as a blob for each range of ``step`` shards, named by its first one."""
    part = shard // step
    order = _grouped(part)
    part = part[order]
    firsts = np.flatnonzero(np.diff(part, prepend=-1))
    rows = []
    for a, b in zip(firsts, np.append(firsts[1:], len(part))):
        at = order[a:b]
        rows.append((int(part[a]) * step, kind, pack([c[at] for c in columns], [c[at] for c in counts], width)))
        if len(rows) == 64:
            yield _rows(rows)
            rows = []
    if rows:
        yield _rows(rows)


# ---------------------------------------------------------------------- tables


def hashed(k: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of sorted keys, and the keys as 32 bits in buckets of their upper bits."""
    bits = max(0, int(len(k) // _BUCKET).bit_length())
    upper = np.uint64(64 - bits)
    order = np.argsort(k)
    k = k[order]
    bucket = (k >> upper).astype(np.int64) if bits else np.zeros(len(k), np.int64)
    begins = np.searchsorted(bucket, np.arange((1 << bits) + 1)).astype("<u4")
    return order, {"begins": begins, "low": (k >> np.uint64(32 - bits) & np.uint64(0xFFFFFFFF)).astype("<u4")}


def find(arrays: dict[str, np.ndarray], k: np.ndarray) -> np.ndarray:
    """The place of each key, or -1: all keys' searches step together."""
    if not arrays or not len(arrays["low"]):
        return np.full(len(k), -1, dtype=np.int64)
    begins, low = arrays["begins"], arrays["low"]
    bits = (len(begins) - 1).bit_length() - 1
    bucket = (k >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(k), np.int64)
    want = (k >> np.uint64(32 - bits) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    lo, end = begins[bucket].astype(np.int64), begins[bucket + 1].astype(np.int64)
    last = len(low) - 1
    for i in reversed(range(int((end - lo).max(initial=0)).bit_length())):  # how many of the bucket are less, by bits
        at = lo + (1 << i)
        lo += ((at <= end) & (low[np.minimum(at, last + 1) - 1] < want)).astype(np.int64) << i
    hit = (lo < end) & (low[np.minimum(lo, last)] == want)
    return np.where(hit, lo, -1)


def _narrow(c: np.ndarray) -> np.ndarray:
    """Counts in the least width that holds them all."""
    most = int(c.max(initial=0))
    return c.astype("<u1" if most < 2**8 else "<u2" if most < 2**16 else "<u4" if most < 2**32 else "<u8")


def save_table(path: str, columns: list[np.ndarray], rows: np.ndarray, usual: tuple[int, ...]) -> None:
    """Rows of numbers by key: a bit tells which keys have other ones than the
    ``usual``; these are stored in bytes, and those with large numbers once more."""
    order, arrays = hashed(key(columns))
    rows = rows[order]
    other = np.zeros(-(-len(rows) // 64) * 64, dtype=np.uint8)
    other[: len(rows)] = (rows != np.array(usual, dtype=np.uint64)).any(1)
    rank = np.concatenate([[0], np.cumsum(other.reshape(-1, 64).sum(1, dtype=np.int64))])[:-1]
    rows = rows[other[: len(rows)] > 0]
    large = np.flatnonzero((rows >= 255).any(1))
    save(path, **arrays, other=np.packbits(other, bitorder="little").view("<u8"), rank=rank, rows=np.minimum(rows, 255).astype(np.uint8), at=large, large=rows[large])


def look_up(arrays: dict[str, np.ndarray], k: np.ndarray, usual: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are there, and the rows of these; neighbours of sorted keys share cache lines."""
    place = find(arrays, k)
    hit = np.flatnonzero(place >= 0)
    place = place[hit]
    out = np.empty((len(hit), len(usual)))
    out[:] = usual
    if len(hit):
        bits, bit = arrays["other"][place >> 6], (place & 63).astype(np.uint64)
        other = np.flatnonzero(bits >> bit & np.uint64(1))
        less = bits & ((np.uint64(1) << bit) - np.uint64(1))
        row = arrays["rank"][place[other] >> 6] + np.bitwise_count(less[other])
        got = arrays["rows"][row].astype(np.float64)
        large = np.flatnonzero((got == 255).any(1))
        got[large] = arrays["large"][np.searchsorted(arrays["at"], row[large])]
        out[other] = got
    return hit, out


class Words:
    """Numbers of words by their hashes: 1, 2, ... by falling counts for some 65,000 words, then all by their place."""

    def __init__(self, folder: str):
        self.files = Shards(folder)
        layout = self.files("layout")
        self.before, self.heavy = layout["before"], layout["heavy"][0]  # words before each hash range; the last frequent number
        self.ranked, self.sorted, self.rank = layout["ranked"], layout["sorted"], layout["rank"]  # places of the first numbers; sorted; their numbers

    def number(self, place: np.ndarray) -> np.ndarray:
        out = place + len(self.ranked) + 1
        if len(self.ranked):
            at = np.minimum(np.searchsorted(self.sorted, place), len(self.sorted) - 1)
            out = np.where(self.sorted[at] == place, self.rank[at], out)
        return out.astype(np.uint64)

    def place(self, number: np.ndarray) -> np.ndarray:
        out = number.astype(np.int64) - len(self.ranked) - 1
        first = np.flatnonzero(out < 0)
        out[first] = self.ranked[number[first].astype(np.int64) - 1]
        return out

    def look_up(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (from 1; ``UNKNOWN``: not in the corpus) and count of each word."""
        number, count = np.full(len(distinct), UNKNOWN, dtype=np.uint64), np.zeros(len(distinct), dtype=np.uint64)
        shards = len(self.before) - 1
        k = text.mix(distinct)
        order = np.argsort(k)
        k = k[order]
        bounds = np.searchsorted(range_of(k, shards), np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(bounds)):
            a, b = bounds[s], bounds[s + 1]
            have = self.files(f"words/{s}")
            if have:
                at = np.minimum(np.searchsorted(have["keys"], k[a:b]), len(have["keys"]) - 1)
                hit = np.flatnonzero(have["keys"][at] == k[a:b])
                number[order[a + hit]] = self.number(self.before[s] + at[hit])
                count[order[a + hit]] = have["counts"][at[hit]]
        return number, count

    def shard(self, number: np.ndarray) -> np.ndarray:
        """The hash ranges of words."""
        return np.searchsorted(self.before, self.place(number), "right") - 1

    def frequent(self, columns: list[np.ndarray]) -> np.ndarray:
        """Contexts of frequent words (or begin marks) only; other contexts occur less often."""
        return np.all([c <= self.heavy for c in columns], axis=0)


# -------------------------------------------------------------------- counting


def _count_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            k, c = np.unique(text.mix(np.concatenate(held)), return_counts=True)
            held.clear()
            bounds = np.searchsorted(range_of(k, shards), np.arange(shards + 1))
            for i in range(0, shards, 64):
                some = [s for s in range(i, min(i + 64, shards)) if bounds[s] < bounds[s + 1]]
                yield _rows([(s, _GRAMS, _pack_words(k[bounds[s] : bounds[s + 1]], c[bounds[s] : bounds[s + 1]])) for s in some])

        for batch in batches:
            for part in text.steps(batch):
                word, _ = sequence(part.column(0))
                held.append(word)
                size += len(word)
                if size >= 2 * TOKENS:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return run


def _pack_words(k: np.ndarray, c: np.ndarray) -> bytes:
    return len(k).to_bytes(8, "little") + k.astype("<u8").tobytes() + _pack_counts(c.astype(np.uint64))


def _unpack_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(raw, "<u8", n, 8), _unpack_counts(memoryview(raw)[8 + 8 * n :], n)[0]


def _add_words(folder: str, heavy: int, ranked: int):
    """``ranked``: the most frequent words of a shard that are told to the driver, and all with more than ``heavy`` tokens."""

    def done(shard: int, kind: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        k, c = (np.concatenate(x) for x in zip(*map(_unpack_words, held)))
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        firsts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        k, c = k[firsts], np.add.reduceat(c, firsts)
        save(f"{folder}/words/{shard}", keys=k, counts=_narrow(c))
        often = np.argsort(c, kind="stable")[max(0, len(c) - max(ranked, int((c > heavy).sum()))) :]
        often = np.stack([often.astype("<i8"), c[often].astype("<i8")]).tobytes()
        columns = [pa.array([shard], pa.int32()), pa.array([len(k)], pa.int64()), pa.array([int(c.sum())], pa.int64()), pa.array([often], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["shard", "types", "tokens", "often"])

    return _runs(done)


def _runs(done):
    """Calls ``done(shard, kind, blobs)`` for each run of rows of a shard and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for shard, kind, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (shard, kind) != now and held:
                    yield from done(*now, held)
                    held = []
                now = shard, kind
                held.append(packed.as_py())
        if held:
            yield from done(*now, held)

    return run


def _place(columns: list[np.ndarray], words: Words, shards: int) -> np.ndarray:
    """The shards of n-grams: by context, or by the whole of it where the context may be
    too frequent; single words go where the vocabulary has them."""
    if len(columns) == 1:
        return words.shard(columns[0])
    k = key(columns[:-1])
    often = np.flatnonzero(words.frequent(columns[:-1]))
    k[often] = longer(k[often], columns[-1][often])
    return range_of(k, shards)


def _count_grams(order: int, deal: Deal):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(deal.folder)
        held: list[list[np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            columns, counts = summed([np.concatenate(c) for c in zip(*held)])
            held.clear()
            yield from _dealt(_GRAMS, _place(columns, words, deal.shards), columns, [counts], deal.width, deal.step)

        for batch in batches:
            for part in text.steps(batch):
                word, first = sequence(part.column(0))
                distinct, back = np.unique(word, return_inverse=True)
                held.append(grams(words.look_up(distinct)[0][back], first, order))
                size += len(word)
                if size >= TOKENS:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return run


def _deal_again(order: int, deal: Deal):
    """From ranges of shards to shards: n-grams of a few million tokens are summed again before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(deal.folder)
        held: dict[int, list] = {_GRAMS: [], _CONTEXTS: []}
        size = {_GRAMS: 0, _CONTEXTS: 0}

        def flush(kind: int) -> Iterator[pa.RecordBatch]:
            columns, counts = ([np.concatenate(c) for c in zip(*x)] for x in zip(*held[kind]))
            held[kind].clear()
            size[kind] = 0
            if kind == _GRAMS:
                columns, total = summed(columns, counts[0])
                yield from _dealt(kind, _place(columns, words, deal.shards), columns, [total], deal.width)
            else:
                yield from _dealt(kind, range_of(key(columns), deal.shards), columns, counts, deal.width)

        for batch in batches:
            for shard, kind, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if kind == _NUMBERS:
                    yield _rows([(shard, kind, packed.as_py())])
                    continue
                held[kind].append(unpack(packed.as_py(), order, 1 if kind == _GRAMS else 4, deal.width))
                size[kind] += len(held[kind][-1][0][0])
                if size[kind] >= TOKENS:
                    yield from flush(kind)
        for kind in held:
            if held[kind]:
                yield from flush(kind)

    return run


def _numbers(order: int, counts: np.ndarray) -> tuple[int, int, bytes]:
    """Of an order: n-grams counted once .. four times, the sum of the counts."""
    return 0, _NUMBERS, np.array([order, *((counts == i).sum() for i in range(1, 5)), counts.sum()], dtype="<u8").tobytes()


def _add_grams(order: int, deal: Deal):
    """A shard's task for one order: sums, arrays, and what the order below gets."""

    def done(shard: int, kind: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        if kind == _NUMBERS:
            yield _rows([(0, kind, x) for x in held])
            return
        if kind == _CONTEXTS:  # of frequent words, of the order above
            columns, stats = ([np.concatenate(c) for c in zip(*x)] for x in zip(*(unpack(x, order, 4, deal.width) for x in held)))
            held.clear()
            k = key(columns)
            o = np.argsort(k)
            firsts = np.flatnonzero(np.concatenate([[True], k[o][1:] != k[o][:-1]]))
            table = np.add.reduceat(np.column_stack(stats)[o], firsts, axis=0)
            save_table(f"{deal.folder}/frequent{order + 1}/{shard}", [c[o[firsts]] for c in columns], table, LONE)
            return
        words = Words(deal.folder)
        parts = [unpack(x, order, 1, deal.width) for x in held]
        held.clear()
        columns, counts = [np.concatenate(c) for c in zip(*(p[0] for p in parts))], np.concatenate([p[1][0] for p in parts])
        del parts
        columns, counts = summed(columns, counts)
        yield _rows([_numbers(order, counts)])
        if order == 1:  # a shard of words: their counts by number
            begin, end = words.before[shard : shard + 2]
            out = np.zeros(end - begin, dtype=np.uint64)
            out[words.place(columns[0]) - begin] = counts
            save(f"{deal.folder}/single/{shard}", counts=_narrow(out))
            return
        save_table(f"{deal.folder}/grams{order}/{shard}", columns, counts[:, None], ONCE)
        # contexts: the sum of the counts, followers counted once, twice, oftener
        k = key(columns[:-1])
        o = np.argsort(k, kind="stable")
        firsts = np.flatnonzero(np.concatenate([[True], k[o][1:] != k[o][:-1]]))
        c = counts[o]
        stats = np.column_stack([np.add.reduceat(x, firsts) for x in (c, (c == 1).astype(np.uint64), (c == 2).astype(np.uint64), (c > 2).astype(np.uint64))])
        heads = [x[o[firsts]] for x in columns[:-1]]
        del o, k, c
        often = words.frequent(heads)
        save_table(f"{deal.folder}/contexts{order}/{shard}", [x[~often] for x in heads], stats[~often], LONE)
        if often.any():
            heads = [x[often] for x in heads]
            yield from _dealt(_CONTEXTS, range_of(key(heads), deal.shards), heads, list(stats[often].T), deal.width, deal.step)
        columns, counts = summed(columns[1:])
        yield from _dealt(_GRAMS, _place(columns, words, deal.shards), columns, [counts], deal.width, deal.step)

    return _runs(done)


def _by_shard(df: DataFrame, shards: int) -> DataFrame:
    """A partition for each shard: no two large ones meet by chance."""
    return df.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind")


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's; numbers of entries counted once .. four times."""
    n1, n2, n3, n4 = (max(x, 1) for x in n)
    y = n1 / (n1 + 2 * n2)
    return tuple(min(i - 0.05, max(0.05, i - (i + 1) * y * b / a)) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def train(docs: DataFrame, tokens: int, order: int = ORDER, shard: int = SHARD, fan: int = FAN) -> Model:
    """Count the column ``text``; ``tokens`` is about the number of its tokens, which sets the number of shards."""
    if order < 1:
        raise ValueError("an order is at least 1")
    spark = docs.sparkSession
    text.ready(spark)
    shards = max(1, -(-tokens // shard))
    folder = text.mounted(text.shared_folder(spark, "kneser-ney"))
    os.makedirs(folder, exist_ok=True)
    docs = docs.select("text")
    rows = _by_shard(docs.mapInArrow(_count_words(shards), _SCHEMA), shards).mapInArrow(_add_words(folder, shard, -(-SHORT // shards)), "shard int, types long, tokens long, often binary").collect()
    # one row a shard; words: as many as shards and SHORT, or as are frequent
    types, n = {r.shard: r.types for r in rows}, sum(r.tokens for r in rows)
    before = np.cumsum([0, *(types.get(s, 0) for s in range(shards))])
    often = [np.frombuffer(r.often, "<i8").reshape(2, -1) + [[before[r.shard]], [0]] for r in rows]
    place, count = np.concatenate([np.zeros((2, 0), np.int64), *often], axis=1)
    ranked = place[np.lexsort((place, -count))]
    o = np.argsort(ranked)
    save(f"{folder}/layout", before=before, heavy=np.array([(count > shard).sum()], dtype=np.uint64), ranked=ranked, sorted=ranked[o], rank=o + 1)
    v = int(before[-1])
    deal = Deal(folder, shards, max(1, -(-(v + len(ranked)).bit_length() // 8)), -(-shards // fan))
    out = docs.mapInArrow(_count_grams(order, deal), _SCHEMA)
    for k in range(order, 0, -1):
        if deal.step > 1:
            out = out.repartitionById(shards, F.col("shard")).mapInArrow(_deal_again(k, deal), _SCHEMA)
        out = _by_shard(out, shards).mapInArrow(_add_grams(k, deal), _SCHEMA)
    names = [f"n{i}" for i in range(6)]
    each = out.mapInArrow(_read_numbers, ", ".join(f"{n} long" for n in names)).groupBy("n0").agg(*(F.sum(n).alias(n) for n in names[1:]))
    of = {r.n0: [r[n] for n in names[1:]] for r in each.collect()}  # one row an order
    levels = tuple(discounts(of.get(k, [0] * 5)[:4]) for k in range(1, order + 1))
    once, twice, _, _, total = of.get(1, [0] * 5)
    d = levels[0]
    gamma = (d[0] * once + d[1] * twice + d[2] * (v - once - twice)) / total if total else 1.0
    return Model(folder, order, shards, v, n, levels, total, gamma)


def _read_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.frombuffer(x.as_py(), "<u8") for k, x in zip(batch.column(1).to_pylist(), batch.column(2)) if k == _NUMBERS]
        yield pa.RecordBatch.from_arrays([pa.array([int(r[i]) for r in rows], pa.int64()) for i in range(6)], names=[f"n{i}" for i in range(6)])


def _each(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = _grouped(shard)
    firsts = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for a, b in zip(firsts, np.append(firsts[1:], len(shard))):
        yield int(shard[order[a]]), order[a:b]


class Scorer:
    """Looks n-grams and words up in the mapped arrays."""

    def __init__(self, model: Model):
        self.m = model
        self.words = Words(model.folder)
        self.files = self.words.files

    def single(self, number: np.ndarray) -> np.ndarray:
        """Distinct words before each word."""
        out = np.zeros(len(number))
        known = np.flatnonzero(number != UNKNOWN)
        for s, at in _each(self.words.shard(number[known])):
            have, at = self.files(f"single/{s}"), known[at]
            if have:
                out[at] = have["counts"][self.words.place(number[at]) - self.words.before[s]]
        return out

    def level(self, gram: list[np.ndarray], some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The contexts' numbers (0: never met) and the n-grams' counts (0 where ``some``, which depends on the n-gram
        only, is false: not looked up).  Each distinct context and n-gram is looked up once, in the order of its key."""
        k, shards = len(gram), self.m.shards
        head = key(gram[:-1])
        whole, at, back = distinct(longer(head, gram[-1]))
        some = some[at]
        head, one, of = distinct(head[at])
        words = [c[at[one]] for c in gram[:-1]]
        known, often = np.all([c != UNKNOWN for c in words], axis=0), self.words.frequent(words)
        shard = range_of(head, shards)  # grows with the key
        stats, counts = np.zeros((len(head), 4)), np.zeros(len(whole))
        for kind, these in (("contexts", known & ~often), ("frequent", known & often)):
            these = np.flatnonzero(these)
            for s, x in _each(shard[these]):
                x = these[x]
                hit, got = look_up(self.files(f"{kind}{k}/{s}"), head[x], LONE)
                stats[x[hit]] = got
        shard = np.where(often[of], range_of(whole, shards), shard[of])
        these = np.flatnonzero(some & (stats[of, 0] > 0))
        for s, x in _each(shard[these]):
            x = these[x]
            hit, got = look_up(self.files(f"grams{k}/{s}"), whole[x], ONCE)
            counts[x[hit]] = got[:, 0]
        return stats[of[back]], counts[back]

    def score(self, column: pa.Array) -> dict[str, np.ndarray]:
        m = self.m
        word, first = sequence(column)
        distinct, back = np.unique(word, return_inverse=True)
        number, count = self.words.look_up(distinct)
        base = np.log10((count.astype(np.float64) + 1) / (m.tokens + m.types + 1))[back]
        seen = self.single(number)
        d = np.array([0.0, *m.discounts[0]])
        p = ((np.maximum(seen - d[np.minimum(seen, 3).astype(int)], 0) / max(m.total, 1)) + m.gamma / (m.types + 1))[back]
        columns, lower = grams(number[back], first, m.order), (seen > 0)[back]
        for k in range(2, m.order + 1):
            # an n-gram is met only if its last words are
            stats, c = self.level(columns[m.order - k :], lower)
            d = np.array([0.0, *m.discounts[k - 1]])
            total = stats[:, 0]
            gamma = np.divide(stats[:, 1:] @ d[1:], total, out=np.ones_like(total), where=total > 0)
            p = np.divide(np.maximum(c - d[np.minimum(c, 3).astype(int)], 0), total, out=np.zeros_like(c), where=total > 0) + gamma * p
            lower = c > 0
        each = lambda x: np.add.reduceat(x, first[:-1]) if len(first) > 1 else x[:0]
        return {"n_tokens": np.diff(first), "n_known": each((count > 0).astype(np.int64)[back]), "base_score": each(base), "score": each(np.log10(p))}


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without text, with n_tokens, n_known, train_tokens, base_score and score."""
    text.ready(docs.sparkSession)
    columns = {"n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double"}
    docs = docs.drop(*columns)
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in text.steps(batch):
                got = scorer.score(part.column(part.schema.get_field_index("text")))
                got["train_tokens"] = np.full(part.num_rows, model.tokens)
                yield text.extended(part.select(kept), **{c: pa.array(got[c], pa.int64() if k == "long" else pa.float64()) for c, k in columns.items()})

    return docs.mapInArrow(run, text.plus(docs.select(*kept).schema, **columns))


def about_tokens(docs: DataFrame) -> int:
    """An estimate from all texts' bytes, to choose the number of shards."""
    r = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return (r.b or 0) // 6 + r.n


def op4(spark, sf_dir: str) -> DataFrame:
    docs = text.documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.coalesce(labelled.remainder("doc_id", 7) == 2, F.lit(False))
    seen = docs.where(~held_out)
    model = train(seen, about_tokens(seen))
    return score_texts(docs.withColumn("held_out", held_out), model)
