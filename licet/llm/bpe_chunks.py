"""Byte-level BPE with reuse of content-defined chunks.

Chunks: a rolling hash over ``WINDOW`` bytes cuts a text wherever it falls in a
fixed class, so equal passages of different texts have equal chunks whatever
stands before them.  One pass counts the chunks' 128-bit keys over the whole
table; the texts of chunks that occur twice or more go, each once, to shards of
the keys, which encode every one of them once and write sorted keys and ids to
the shared folder.  The pass that encodes the documents maps these files and
takes the ids of shared chunks from them; a chunk that occurs once is encoded
where it stands.  So every distinct chunk of the table is encoded once, and no
text moves but the shared chunks'.

Joins: a chunk's ids near its ends may differ from those of the whole text.
Around each join the last ids before it and the first ones after it are decoded
and encoded anew, until the new ids agree on both sides with ids that are kept;
an agreement counts where a white-space byte follows a visible ASCII byte, for
there pre-tokenization parts whatever surrounds the place, so the ids beyond
are those of the whole text.  Without agreement the window doubles, up to both
chunks whole.  A cut without such a place since the one before is no cut, so
texts without them are encoded as they are.

Cases: null counts as the empty text, with no ids.  Strings of special tokens
inside a text become the special token, as the library does by default.
Extra columns pass through; columns named as the results are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .mapped import Shards, by_shard, save

WINDOW = 16
#: One byte in so many begins a chunk, on average; a chunk has LONGEST bytes at most, where it can be cut.
CHUNK, LONGEST = 1024, 1 << 16
#: Bytes of the input for each shard of shared chunks; keys that a task counts at a time.
SHARD_BYTES, KEYS = 64 << 20, 200_000
#: Ids on either side of a join that are encoded anew first.
AROUND = 6
#: Bytes that the rolling hash takes at a time.
SLICE = 1 << 20

#: The split of byte-level BPE, and the characters that the faster library gets.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LATIN = re.compile("[\t\n -~\u00a1-\u00ac\u00ae-\u024f]*")

_MASK = np.uint64(CHUNK - 1)
_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[33:127] = True


def _windows(data: np.ndarray) -> np.ndarray:
    """The hash of the ``WINDOW`` bytes that end before each byte, from byte WINDOW on."""
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(text._BYTE[data] * text._power("p", text._MULT, len(data)), dtype=np.uint64)])
    return text.mix((run[WINDOW:] - run[:-WINDOW]) * text._power("i", text._INVERSE, len(data))[: len(run) - WINDOW])


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ascending places where chunks begin: documents' begins and the cuts inside them; the last is the end."""
    found = []
    for a in range(0, len(data), SLICE):
        begin = max(0, a - WINDOW)
        part = data[begin : a + SLICE]
        if len(part) > WINDOW:
            at = np.flatnonzero((_windows(part)[:-1] & _MASK) == 0) + begin + WINDOW
            found.append(at[at >= a])
    place = np.concatenate(found) if found else np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, place, "right") - 1
    place = place[place - offsets[doc] >= WINDOW]
    # long stretches without a cut
    edges = np.union1d(place, offsets)
    wide = np.flatnonzero(np.diff(edges) > LONGEST)
    if len(wide):
        place = np.union1d(place, np.concatenate([np.arange(edges[i] + LONGEST, edges[i + 1], LONGEST) for i in wide]))
    place = place[(data[place] & 0xC0) != 0x80] if len(place) else place
    # only where a place that surely parts tokens lies between a cut and the one before
    safe = np.flatnonzero(text.SPACE[data[1:]] & _VISIBLE[data[:-1]]) + 1 if len(data) else np.zeros(0, np.int64)
    if len(place):
        doc = np.searchsorted(offsets, place, "right") - 1
        before = np.where(np.diff(doc, prepend=-1) > 0, offsets[doc], np.concatenate([[0], place[:-1]]))
        # a safe place at a document's begin would lie in the one before
        place = place[np.searchsorted(safe, place, "right") > np.searchsorted(safe, before, "right")]
    return np.union1d(place, offsets)


def chunks(column: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The chunks of all documents in order, and each document's first one."""
    data, offsets = text.buffers(column)
    places = cuts(data, offsets)
    raw = data.tobytes()
    at = places.tolist()
    return [raw[a:b] for a, b in zip(at, at[1:])], np.searchsorted(places, offsets)


class Encoder:
    """Encodes texts and chunks, and repairs joins."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.decimal = [b"%d" % i for i in range(n)]
        self.bytes = self._token_bytes(n)
        self.fast = self._fast()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # ids whose bytes begin with white space, end with a visible ASCII character, begin inside a character
        self.space = [bool(b) and text.SPACE[b[0]] for b in self.bytes]
        self.visible = [bool(b) and _VISIBLE[b[-1]] for b in self.bytes]
        self.inside = [bool(b) and b[0] & 0xC0 == 0x80 for b in self.bytes]
        self.encoded = self.repaired = 0

    def _token_bytes(self, n: int) -> list[bytes]:
        """Each id's bytes: the tokenizer writes bytes as printable characters."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in plain}
        back |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        return [added[i].encode() if i in added else bytes(back[c] for c in self.tokenizer.id_to_token(i) or "") for i in range(n)]

    def _fast(self):
        """The same merges in a faster library, where ids are in the order of merges
        and text is split as in byte-level BPE; else None."""
        model = json.loads(self.tokenizer.to_str())
        vocabulary, merges = model["model"]["vocab"], model["model"]["merges"]
        before = model["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and model["normalizer"] is None
        ids = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if not plain or any(a >= b for a, b in zip(ids, ids[1:])) or len(vocabulary) < len(ids) + 256:
            return None
        import tiktoken

        added = set(self.tokenizer.get_added_tokens_decoder())
        ranks = {self.bytes[i]: i for i in vocabulary.values() if i not in added}
        return tiktoken.Encoding("chunks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, found: list[bytes]) -> list[array]:
        """Ids of texts.  Only Latin text goes to the faster library: there both
        libraries' classes of characters are the same in every Unicode version."""
        self.encoded += len(found)
        said = [x.decode() for x in found]
        quick = [self.fast is not None and LATIN.fullmatch(t) is not None and not any(s in t for s in self.specials) for t in said]
        slow = iter(self.tokenizer.encode_batch_fast([t for t, q in zip(said, quick) if not q], add_special_tokens=False))
        return [array("i", self.fast.encode_ordinary(t) if q else next(slow).ids) for t, q in zip(said, quick)]

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def joined(self, parts: list[array]) -> array:
        """The ids of the text whose chunks have the ids ``parts``."""
        out = array("i", parts[0]) if parts else array("i")
        for part in parts[1:]:
            self._join(out, part)
        return out

    def _join(self, out: array, part: array) -> None:
        around = AROUND
        while True:
            i = max(0, len(out) - around)
            while i and self.inside[out[i]]:
                i -= 1
            j = min(len(part), around)
            while j < len(part) and self.inside[part[j]]:
                j += 1
            old, first = out[i:], part[:j]
            new = self.encode([self.decode_bytes(old) + self.decode_bytes(first)])[0]
            self.repaired += 1
            left, right = self._agree_left(new, old) if i else 0, self._agree_right(new, first) if j < len(part) else 0
            # what is new ends in ids that both have; a whole part needs none, the next join looks at its end
            if left is not None and right is not None and left <= len(new) - right:
                del out[i + left :]
                out.extend(new[left : len(new) - right])
                out.extend(part[j - right :])
                return
            around *= 2

    def _agree_left(self, new: array, old: array) -> int | None:
        """How many first ids are equal up to a place that parts tokens."""
        for t in range(1, min(len(new), len(old))):
            if new[t - 1] != old[t - 1]:
                return None
            if new[t] == old[t] and self.space[new[t]] and self.visible[new[t - 1]]:
                return t
        return None

    def _agree_right(self, new: array, old: array) -> int | None:
        """How many last ids are equal from a place that parts tokens."""
        for t in range(1, min(len(new), len(old))):
            if new[-t] != old[-t]:
                return None
            if new[-t - 1] == old[-t - 1] and self.space[new[-t]] and self.visible[new[-t - 1]]:
                return t
        return None

    def batch(self, column: pa.Array, shared: Shared | None = None) -> Iterator[array]:
        """The ids of each document: shared chunks' ids as they were stored, others encoded here."""
        parts, firsts = chunks(column)
        ids = shared.find(parts) if shared else [None] * len(parts)
        rest = [k for k, x in enumerate(ids) if x is None]
        # by parts, for many ids at once take much more memory than what is kept of them
        for at in range(0, len(rest), 200):
            some = rest[at : at + 200]
            for k, got in zip(some, self.encode([parts[k] for k in some]), strict=True):
                ids[k] = got
        bounds = firsts.tolist()
        for a, b in zip(bounds, bounds[1:]):
            yield self.joined(ids[a:b])


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """A worker's encoder: its tables serve all tasks that it runs."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# -------------------------------------------------------------- shared chunks


def keys_of(parts: list[bytes]) -> np.ndarray:
    """Two 64-bit words of each chunk's key."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), ">u8").astype(np.uint64).reshape(-1, 2)


def _shard(high: np.ndarray, shards: int) -> np.ndarray:
    return ((high >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


class Shared:
    """The chunks that occur more than once, by key: ``kind`` "keys" tells which, "chunks" has their ids."""

    def __init__(self, folder: str, shards: int, kind: str = "chunks"):
        self.files, self.shards, self.kind = Shards(folder), shards, kind

    def places(self, keys: np.ndarray) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
        """Per shard its arrays, which keys it has, and where."""
        shard = _shard(keys[:, 0], self.shards)
        for s in np.unique(shard):
            have, at = self.files(f"{self.kind}/{s}"), np.flatnonzero(shard == s)
            if not have or not len(have["high"]):
                continue
            place = np.searchsorted(have["high"], keys[at, 0])
            found = np.full(len(at), -1, dtype=np.int64)
            # keys with equal high words follow each other; more than a few do not meet in 2 ** 64
            for _ in range(4):
                here = np.minimum(place, len(have["high"]) - 1)
                hit = (have["high"][here] == keys[at, 0]) & (have["low"][here] == keys[at, 1]) & (place < len(have["high"]))
                found = np.where(hit, here, found)
                place = place + 1
            yield have, at[found >= 0], found[found >= 0]

    def which(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        keys = keys_of(parts)
        out = np.zeros(len(parts), dtype=bool)
        for _, at, _ in self.places(keys):
            out[at] = True
        return keys, out

    def find(self, parts: list[bytes]) -> list[array | None]:
        out: list[array | None] = [None] * len(parts)
        if parts:
            for have, at, place in self.places(keys_of(parts)):
                for k, p in zip(at.tolist(), place.tolist()):
                    a, b = have["begins"][p : p + 2]
                    out[k] = array("i", have["ids"][a:b].astype(np.int32).tobytes())
        return out


def _count(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            k, n = np.unique(np.concatenate(held), axis=0, return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(_shard(k[:, 0], shards)), pa.array(k[:, 0].view(np.int64)), pa.array(k[:, 1].view(np.int64)), pa.array(n)], names=["shard", "high", "low", "n"])

        for batch in batches:
            for part in text.steps(batch):
                held.append(keys_of(chunks(part.column(0))[0]))
                size += len(held[-1])
                if size >= KEYS:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return run


def _write_keys(folder: str):
    def done(shard: int, t: pa.Table) -> pa.RecordBatch:
        k = np.column_stack([t.column(i).to_numpy().view(np.uint64) for i in (1, 2)])
        order = np.lexsort((k[:, 1], k[:, 0]))
        k, n = k[order], t.column(3).to_numpy()[order]
        firsts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(1)]))
        k = k[firsts][np.add.reduceat(n, firsts) > 1]
        save(f"{folder}/keys/{shard}", high=k[:, 0], low=k[:, 1])
        return pa.RecordBatch.from_arrays([pa.array([len(k)], pa.int64())], names=["n"])

    return lambda batches: by_shard(batches, done)


def _texts(folder: str, shards: int):
    """The shared chunks' texts, each once a task's step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = Shared(folder, shards, "keys")
        said: set[bytes] = set()
        for batch in batches:
            for part in text.steps(batch):
                parts = [x for x in dict.fromkeys(chunks(part.column(0))[0]) if x]
                if not parts:
                    continue
                k, hit = shared.which(parts)
                at = [i for i in np.flatnonzero(hit).tolist() if (key := k[i].tobytes()) not in said and not said.add(key)]
                if len(said) > KEYS:
                    said.clear()
                yield pa.RecordBatch.from_arrays([pa.array(_shard(k[at, 0], shards)), pa.array(k[at, 0].view(np.int64)), pa.array(k[at, 1].view(np.int64)), pa.array([parts[i] for i in at], pa.binary())], names=["shard", "high", "low", "chunk"])

    return run


def _write_chunks(folder: str, path: str):
    """A shard's task: every chunk once, encoded and written."""

    def done(shard: int, t: pa.Table) -> pa.RecordBatch:
        encoder = encoder_of(path)
        high, low = (t.column(i).to_numpy().view(np.uint64) for i in (1, 2))
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        firsts = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
        at = order[firsts]
        ids, begins = array("i"), [0]
        for i in range(0, len(at), 200):
            for got in encoder.encode(t.column(3).take(pa.array(at[i : i + 200])).to_pylist()):
                ids.extend(got)
                begins.append(len(ids))
        narrow = np.uint16 if len(encoder.bytes) <= 1 << 16 else np.uint32
        save(f"{folder}/chunks/{shard}", high=high[firsts], low=low[firsts], begins=np.array(begins), ids=np.frombuffer(ids, np.int32).astype(narrow))
        return pa.RecordBatch.from_arrays([pa.array([len(at)], pa.int64())], names=["n"])

    return lambda batches: by_shard(batches, done)


def shared_chunks(docs: DataFrame, path: str, shard_bytes: int = SHARD_BYTES) -> tuple[str, int, int]:
    """Encodes every chunk of the column ``text`` that occurs more than once, once; the folder, its shards and how many."""
    spark = docs.sparkSession
    text.ready(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    folder = text.mounted(text.shared_folder(spark, "chunks"))
    texts = docs.select("text")
    rows = texts.mapInArrow(_count(shards), "shard int, high long, low long, n long")
    rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(_write_keys(folder), "n long").agg(F.sum("n")).collect()
    rows = texts.mapInArrow(_texts(folder, shards), "shard int, high long, low long, chunk binary")
    n = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(_write_chunks(folder, path), "n long").agg(F.sum("n")).first()[0]
    return folder, shards, n or 0


# ------------------------------------------------------------------- documents


def _encoded(docs: DataFrame, make, drop: tuple[str, ...] = (), path: str | None = None, **columns: str) -> DataFrame:
    path = path or default_path()
    docs = docs.drop(*(c for c in columns if c != "text"))
    folder, shards, _ = shared_chunks(docs, path)
    kept = [c for c in docs.columns if c not in drop]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shared = encoder_of(path), Shared(folder, shards)
        for batch in batches:
            for part in text.steps(batch):
                got = [make(encoder, x) for x in encoder.batch(part.column(part.schema.get_field_index("text")), shared)]
                yield text.extended(part.select(kept), **{c: pa.array([g[i] for g in got]) if kind != "array<int>" else pa.array([g[i] for g in got], pa.list_(pa.int32())) for i, (c, kind) in enumerate(columns.items())})

    return docs.mapInArrow(run, text.plus(docs.select(*kept).schema, **columns))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array of int) of the column ``text``."""
    return _encoded(docs, lambda _, ids: (np.frombuffer(ids, np.int32) if len(ids) else np.zeros(0, np.int32),), (), path, ids="array<int>")


def decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``decoded`` (string) of the column ``ids``; null ids: empty."""
    path = path or default_path()
    text.ready(docs.sparkSession)
    docs = docs.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            yield text.extended(batch, decoded=pa.array([encoder.decode(x or []) for x in ids], pa.string()))

    return docs.mapInArrow(run, text.plus(docs.schema, decoded="string"))


def _digests(encoder: Encoder, ids: array) -> tuple[int, str, str]:
    decimals = b",".join(map(encoder.decimal.__getitem__, ids))
    decoded = encoder.decode(ids).encode()
    return len(ids), hashlib.sha256(decimals).hexdigest(), hashlib.sha256(decoded).hexdigest()


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` without text, with the number of ids and the digests of ids and decoded text."""
    return _encoded(docs, _digests, ("text",), path, n_tokens="long", ids_sha256="string", decoded_sha256="string")


def op3(spark, sf_dir: str) -> DataFrame:
    return digests(text.documents(spark, sf_dir).select("doc_id", "text"))


def encoded_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the kept documents' ids and the digests of a round trip."""
    return digests(docs.select("doc_id", "source", "text"))
