"""Media columns: documents as ordered sequences of text and media.

:func:`sequences` parses HTML into an ordered array of structs, texts and media
references (digest, caption) with their positions.  :func:`stored` keeps
payloads losslessly as 8-bit RGB images of width 64, in PNG form, in the shared
folder.  :func:`features` reads the stored bytes back, checks and measures
them.  :func:`resolved` joins references to media by digest only, so payloads
never move with the sequences, and positions and captions stay beside them.

Cases: null html is an empty sequence; a reference to no digest keeps its
position, url and caption; one that no media has
gets null media columns; media stored twice under one digest are
equal and resolve once; null payloads count as empty (a payload is never
shorter than one row of 192 bytes of white space).  Extra columns pass through, but for those named as the results.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import markup, text

WIDTH = 64
ROW = 3 * WIDTH
PNG = b"\x89PNG\r\n\x1a\n"
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,url:string,caption:string>>"
MEDIA = frozenset("img audio video source embed".split())
UNREAD = frozenset("script style template".split())
FEATURES = {
    "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long",
    "media_bytes": "long", "media_sha256": "string", "feature": "string",
}
_REFERENCE = re.compile(r"sha256:([0-9a-f]{64})$")


# ------------------------------------------------------------- the stored form


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(raw: bytes) -> bytes:
    """A payload, filled up with spaces to whole rows, as an RGB image; its length is kept as text."""
    rows = max(1, -(-len(raw) // ROW))
    pixels = np.full(rows * ROW, 32, dtype=np.uint8)
    pixels[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    lines = np.zeros((rows, ROW + 1), dtype=np.uint8)
    lines[:, 1:] = pixels.reshape(rows, ROW)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 2, 0, 0, 0)
    return b"".join([PNG, _chunk(b"IHDR", head), _chunk(b"tEXt", b"n_bytes\0%d" % len(raw)), _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)), _chunk(b"IEND", b"")])


def from_png(media: bytes) -> tuple[bytes, int]:
    """The samples and the unpadded length; ValueError if the stored bytes are not whole."""
    if media[:8] != PNG:
        raise ValueError("not a PNG")
    at, data, length, size = 8, [], None, None
    while at < len(media):
        n = struct.unpack_from(">I", media, at)[0]
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            length = int(body[8:])
        at += 12 + n
    if size is None or size[2:] != (8, 2, 0, 0, 0) or length is None:
        raise ValueError("not an image of this kind")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(size[1], 3 * size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes(), length


def image_feature(samples: bytes) -> str:
    """Size, mean colour and a 64-bit difference hash of 8 x 9 cells."""
    pixels = np.frombuffer(samples, dtype=np.uint8).reshape(-1, WIDTH, 3)
    mean = pixels.reshape(-1, 3).mean(0)
    grey = pixels.mean(2)
    rows = np.array_split(np.arange(len(grey)), 8) if len(grey) >= 8 else [np.array([i * len(grey) // 8]) for i in range(8)]
    cols = np.linspace(0, WIDTH, 10).astype(int)
    cells = np.array([np.add.reduceat(grey[r].mean(0), cols[:-1]) / np.diff(cols) for r in rows])
    bits = np.packbits(cells[:, 1:] > cells[:, :-1])
    return f"{WIDTH}x{len(grey)} rgb({','.join(f'{m:.3f}' for m in mean)}) dhash({bits.tobytes().hex()})"


def measure(media: bytes) -> tuple:
    samples, length = from_png(media)
    return length, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(media), hashlib.sha256(media).hexdigest(), image_feature(samples)


# ------------------------------------------------------------------- sequences


def parse(html: str | None) -> list[dict]:
    """Texts and media references in page order.  A media reference is an element with a source;
    its digest is that of a ``sha256:`` source, null for any other."""
    out: list[dict] = []
    words: list[str] = []
    media: dict | None = None
    caption: list[str] | None = None

    def said(parts: list[str]) -> str:
        return " ".join(markup.unescape("".join(parts)).split())

    def add(kind: str, body: str | None, digest=None, url=None, caption=None) -> dict:
        out.append({"position": len(out), "kind": kind, "text": body, "digest": digest, "url": url, "caption": caption})
        return out[-1]

    def flush() -> None:
        if body := said(words):
            add("text", body)
        words.clear()

    def close_caption() -> None:
        nonlocal caption
        body, caption = said(caption or []), None
        if media is not None:
            media["caption"] = body
        elif body:
            add("text", body)

    for kind, what, raw in markup.tokens(html or "", UNREAD):
        if kind == "text":
            (words if caption is None else caption).append(what)
        elif kind == "start" and what in MEDIA:
            got = dict(reversed(list(markup.attributes(raw))))  # of two attributes of one name the first counts
            if url := got.get("src", "").strip():
                flush()
                found = _REFERENCE.search(url)
                media = add("media", None, found[1] if found else None, url, got.get("alt"))
        elif what == "figcaption":
            if caption is not None:
                close_caption()
            if kind == "start":
                flush()
                caption = []
        elif what == "figure":
            flush()
            if kind == "end":
                media = None
        elif what not in markup.INLINE and what not in UNREAD:
            flush()
    if caption is not None:
        close_caption()
    flush()
    return out


def sequences(pages: DataFrame) -> DataFrame:
    """``pages`` with ``sequence`` in place of ``html``."""
    text.ready(pages.sparkSession)
    pages = pages.drop("sequence")
    kept = [c for c in pages.columns if c != "html"]
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("url", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column(batch.schema.get_field_index("html")).to_pylist()
            yield text.extended(batch.select(kept), sequence=pa.array([parse(h) for h in html], kind))

    return pages.mapInArrow(run, text.plus(pages.select(*kept).schema, sequence=SEQUENCE))


def stored(payloads: DataFrame) -> DataFrame:
    """From the string column ``text``: a table ``digest`` (of the payload's bytes), ``media``, in the shared folder."""
    text.ready(payloads.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.steps(batch, limit=4 << 20):
                data, off = text.buffers(part.column(0))
                raw = data.tobytes()
                each = [raw[a:b] for a, b in zip(off, off[1:])]
                once = {x: to_png(x) for x in dict.fromkeys(each)}
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(x).hexdigest() for x in once]), pa.array(list(once.values()), pa.binary())], names=["digest", "media"])

    return text.written(payloads.select("text").mapInArrow(run, "digest string, media binary"), "media")


def features(media: DataFrame) -> DataFrame:
    """One row per digest of what the stored bytes hold, read back."""
    text.ready(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [measure(m.as_py()) for m in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[i] for g in got]) for i in range(len(FEATURES)))], names=["digest", *FEATURES])

    schema = "digest string, " + ", ".join(f"{k} {v}" for k, v in FEATURES.items())
    return media.select("digest", "media").mapInArrow(run, schema).dropDuplicates(["digest"])


def resolved(sequences_: DataFrame, found: DataFrame) -> DataFrame:
    """One row per media reference, with its position, url, caption and digest and the columns of ``found``.

    Columns of ``sequences_`` with one of these names are replaced.  References
    without a digest take no part in the join, so they cannot gather in one task.
    """
    at, digest = text.unused(sequences_, "_at", "_digest")
    own = ["position", "url", "caption", "digest", *(c for c in found.columns if c != "digest")]
    refs = sequences_.withColumn(at, F.explode("sequence")).where(F.col(at)["kind"] == "media").drop("sequence", *own)
    refs = refs.select("*", *(F.col(at)[c].alias(c) for c in ("position", "url", "caption", "digest"))).drop(at)
    found = found.withColumnRenamed("digest", digest)
    met = refs.where("digest IS NOT NULL").join(found, F.col("digest") == F.col(digest), "left").drop(digest)
    lone = refs.where("digest IS NULL").select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema if f.name != digest))
    return met.unionByName(lone)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = text.documents(spark, sf_dir)
    body = F.coalesce("text", F.lit(""))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    html = F.concat(F.lit("<article><p>Document "), name, F.lit("</p><figure><img src='sha256:"), F.sha2(body.cast("binary"), 256), F.lit("' alt='text as an image'><figcaption>Text of document "), name, F.lit("</figcaption></figure></article>"))
    found = text.written(features(stored(docs.select("text"))), "features")
    # every reference here has a digest; what it resolves to is the whole result
    out = resolved(sequences(docs.select("doc_id", html.alias("html"))), found)
    return out.select("doc_id", *FEATURES)
