"""Quality classifier: compressed sizes under two zstandard dictionaries.

One dictionary is trained on good and one on bad labelled text.  A text is cut
into blocks of ``BLOCK`` bytes and every block is compressed with either
dictionary, so that long texts keep the dictionaries' effect.  The normalised
difference ``(good - bad) / (good + bad)`` of the two sizes is mapped to the
probability of quality by a logistic calibration that is fitted on labelled
texts which the dictionaries have not seen.  The calibration also sees how far
a text compresses at all, in powers, for text that repeats itself compresses
to nearly nothing under both dictionaries.

Cases: null and empty texts have sizes 0 and get the calibrated score of the
zero features; without labels of both classes the score is the known share of
label 1, or 0.5.  Extra columns of the input are passed through by
:func:`score_quality`, whose own columns replace columns of the same names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled, text

BLOCK = 1024
LEVEL = 3
#: Texts of each class that the model is fitted on at most.
PER_CLASS = 1500


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    constant: float | None = None


def blocks(raw: bytes) -> list[bytes]:
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


class Sizes:
    """Compressed sizes of a text, with the good and with the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.by = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
            d.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def __call__(self, raw: bytes) -> tuple[int, int]:
        parts = blocks(raw)
        return tuple(sum(map(len, map(c.compress, parts))) for c in self.by)


def features(good: int, bad: int, n: int) -> list[float]:
    both = good + bad
    d = (good - bad) / both if both else 0.0
    r = both / (2 * n) if n else 0.0
    return [d, d * d, r, r * r, d * r, 1.0 / (1.0 + n / 64.0)]


def _dictionary(texts: list[bytes], size: int) -> bytes:
    parts = [b for t in texts for b in blocks(t)]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: raw content
        return b"\n".join(parts)[-size:] or b" "


def fit(sample: list[tuple[str, int]], size: int = 112_640) -> Model:
    """Even rows of each class make the dictionaries, odd ones the calibration."""
    raw = {v: [t.encode() for t, y in sample if y == v] for v in (0, 1)}
    if min(len(x) for x in raw.values()) < 4:
        n = len(sample)
        return Model(b"", b"", (), (), (), len(raw[1]) / n if n else 0.5)
    # equal sizes of text, so that neither dictionary knows more
    size = int(min(size, *(sum(map(len, x[::2])) // 4 for x in raw.values())))
    size = max(size, 1024)
    good, bad = (_dictionary(raw[v][::2], size) for v in (1, 0))
    sizes = Sizes(good, bad)
    held = [(t, v) for v in (0, 1) for t in raw[v][1::2]]
    x = np.array([features(*sizes(t), len(t)) for t, _ in held])
    y = np.array([v for _, v in held], dtype=float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    w = logistic((x - mean) / scale, y)
    return Model(good, bad, tuple(mean), tuple(scale), tuple(w))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Newton's method; classes weigh the same; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    each = np.where(y > 0.5, len(y) / (2 * max(1, (y > 0.5).sum())), len(y) / (2 * max(1, (y < 0.5).sum())))
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (each * (y - p)) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def scores(column: pa.Array, model: Model, sizes: Sizes | None) -> np.ndarray:
    n = len(column)
    if model.constant is not None or not n:
        return np.full(n, model.constant if n else 0.0)
    data, offsets = text.buffers(column)
    raw = data.tobytes()
    x = np.empty((n, len(model.mean)))
    for i in range(n):
        t = raw[offsets[i] : offsets[i + 1]]
        x[i] = features(*sizes(t), len(t))
    z = ((x - model.mean) / model.scale) @ np.array(model.weights[:-1]) + model.weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, seen=None, per_class: int = PER_CLASS) -> Model:
    """Fit on at most ``per_class`` texts of each class; the classes' odds among
    all labels that may be seen calibrate the constant."""
    seen = F.lit(True) if seen is None else seen
    model = fit(labelled.sample(docs, labels, "quality", per_class, seen))
    if model.constant is not None:
        return model
    known = labels.where(seen)
    odds = known.agg(F.count_if(F.col("quality") == 1).alias("a"), F.count_if(F.col("quality") == 0).alias("b")).first()
    return replace(model, weights=(*model.weights[:-1], model.weights[-1] + math.log((odds.a + 1) / (odds.b + 1))))


def score_quality(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """``docs`` with a double ``score`` (0 to 1) from the column ``text``."""
    spark = docs.sparkSession
    text.ready(spark)
    held = spark.sparkContext.broadcast(model)
    docs = docs.drop(score)
    schema = text.plus(docs.schema, **{score: "double"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        sizes = None if m.constant is not None else Sizes(m.good, m.bad)
        for batch in batches:
            for part in text.steps(batch, limit=16 << 20):
                got = scores(part.column(part.schema.get_field_index("text")), m, sizes)
                yield text.extended(part, **{score: got})

    return docs.mapInArrow(run, schema)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = text.documents(spark, sf_dir)
    model = train(docs, text.table(spark, sf_dir, "labels"), labelled.remainder("doc_id", 3) != 1)
    out = score_quality(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (labelled.remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score at least 0.5."""
    model = train(docs, text.table(spark, sf_dir, "labels"))
    cols = docs.columns
    return score_quality(docs, model, "_quality").where("_quality >= 0.5").select(*cols)
