"""Toxicity by a subsequence string kernel and a support vector machine.

The kernel of two tokens counts the subsequences of 3 and 4 letters that they
share, also where other characters stand between the letters; a gap of n
characters weighs ``DECAY ** n``, up to ``SPAN`` characters in all, and a token
of n letters is scaled by ``1 / sqrt(n)``.  Digits that stand for letters are
read as these, letters beyond a to z have codes by a hash of theirs, and
letters that are set apart by spaces are one token, so
gapped insults and ones with inserted characters still resemble the plain ones.

Nyström: the kernel is taken with some landmark tokens only, and a linear SVM
(squared hinge) is fitted in the space that they span.  Labels are of
documents; white-space tokens stand in place of sentences, and the ones that
make a toxic document toxic are found by turns: fit, choose the highest ones of
every toxic document again, fit.  So an insult of several ordinary words, or
one parted by spaces into pieces longer than a letter, is not seen.  Being linear in the subsequences, the fitted
sum over landmarks is one table of weights, so scoring costs a few table
look-ups per letter of each *distinct* token of a batch.

A document's two highest tokens, calibrated on labelled documents that the
SVM has not seen, give its probability.

Cases: null and empty texts score as documents without tokens, below 0.5;
without labels of both classes the score is the known share of label 1, or 0.
Extra columns pass through; columns named as the results are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled, text
from .compression_quality import logistic

DECAY = 0.6
SPAN = 6
#: Letters of a piece; longer tokens are several pieces that overlap by SPAN - 1.
PIECE = 24
LANDMARKS = 256
#: Documents of each class that the model is fitted on at most.
PER_CLASS = 900
#: The most common clean tokens, which are negative from the start, and the tokens of a toxic document that are positive at a time.
COMMON, MEANT = 6000, 3
#: Tokens whose scores a worker keeps.
KEPT = 1_000_000
#: A document without tokens.
NOTHING = -3.0

#: Digits that stand for letters.
_DIGITS = dict(zip("013457@", "oieasta"))
#: The begin of a token is a letter too.
_BEGIN = 31
_TRIPLES = 32**3
_N = _TRIPLES + 32**4
_GRAMS = 1 << 20
#: A token may be meant if a run of its letters is so many deviations more common in toxic documents.
LEAST_Z = 3.5
_GAPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_GAPS4 = [(a, b, c) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of subsequences, 32 ** 3 + 32 ** 4
    bias: float
    calibration: tuple[float, float, float]
    constant: float | None = None


@lru_cache(1)
def _codes() -> np.ndarray:
    """The letter code (1 to 30; 0: no letter) of each character below U+10000: a to z, and a hash for other
    letters (also those with accents, which make other words in many languages)."""
    out = np.zeros(1 << 16, dtype=np.uint8)
    for i in range(1 << 16):
        c = _DIGITS.get(chr(i)) or chr(i).lower()
        if c.isalpha():
            out[i] = ord(c) - 96 if "a" <= c <= "z" else 1 + ord(c[0]) * 2654435761 % (1 << 32) % 30
    return out


@dataclass
class Letters:
    """The letter codes of all characters of a batch, and its words in them."""

    codes: np.ndarray
    start: np.ndarray
    end: np.ndarray


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letter codes of UTF-8 characters, and how many characters begin before each byte."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    point = data[at].astype(np.int32)
    more = np.flatnonzero(point >= 0xC0)  # characters of two bytes and more; those beyond U+FFFF are no letters
    if len(more):
        b = [data[np.minimum(at[more] + k, len(data) - 1)].astype(np.int32) & 0x3F for k in (1, 2)]
        first = point[more]
        point[more] = np.where(first < 0xE0, (first & 0x1F) << 6 | b[0], np.where(first < 0xF0, (first & 0x0F) << 12 | b[0] << 6 | b[1], 0))
    return _codes()[point], np.concatenate([[0], np.cumsum(lead)])


def letters(w: text.Words) -> Letters:
    codes, before = characters(w.data)
    return Letters(codes, before[w.start], before[w.end])


def piece_matrix(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of words, one row per piece (0: no letter), and each row's word."""
    step = PIECE - SPAN
    n = np.maximum(1, -(-(end - start - SPAN + 1) // step))
    token = np.repeat(np.arange(len(start)), n)
    part = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
    at = start[token] + part * step
    where = at[:, None] + np.arange(PIECE)
    rows = codes[np.minimum(where, len(codes) - 1)].astype(np.int32)
    rows[where >= end[token][:, None]] = 0
    begins = (codes[start] > 0)[token] & (part == 0)
    return np.concatenate([np.where(part == 0, np.where(begins, _BEGIN, 0), codes[np.maximum(at - 1, 0)])[:, None], rows[:, :-1]], axis=1), token


def _small_pieces(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`piece_matrix` in bytes, made by parts."""
    made = [piece_matrix(codes, start[i : i + 10_000], end[i : i + 10_000]) for i in range(0, len(start), 10_000)]
    return np.concatenate([c.astype(np.uint8) for c, _ in made]), np.concatenate([o + i * 10_000 for i, (_, o) in enumerate(made)])


def _indexes(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Per pattern of gaps the subsequences' indexes (0: none) and the weight."""
    codes = codes.astype(np.int32)
    for a, b in _GAPS:
        x, y, z = codes[:, : PIECE - b], codes[:, a : PIECE - b + a], codes[:, b:]
        yield np.where((x > 0) & (y > 0) & (z > 0), x << 10 | y << 5 | z, 0), DECAY ** (b - 2)
    for a, b, c in _GAPS4:
        x, y, z, u = codes[:, : PIECE - c], codes[:, a : PIECE - c + a], codes[:, b : PIECE - c + b], codes[:, c:]
        yield np.where((x > 0) & (y > 0) & (z > 0) & (u > 0), _TRIPLES + (x << 15 | y << 10 | z << 5 | u), 0), DECAY ** (c - 3)


def _scale(codes: np.ndarray) -> np.ndarray:
    return 1 / np.sqrt(np.maximum(1, (codes > 0).sum(1)))


def piece_scores(codes: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """The decision values.  ``weights[0]`` is 0, as is that of every index with a 0 in it."""
    out = np.zeros(len(codes), dtype=np.float32)
    for i in range(0, len(codes), 5_000):
        c = codes[i : i + 5_000].astype(np.int32)
        total = np.zeros(len(c), dtype=np.float32)
        for a, b in _GAPS:
            total += np.float32(DECAY ** (b - 2)) * weights[c[:, : PIECE - b] << 10 | c[:, a : PIECE - b + a] << 5 | c[:, b:]].sum(1)
        quads = weights[_TRIPLES:]
        for a, b, d in _GAPS4:
            total += np.float32(DECAY ** (d - 3)) * quads[c[:, : PIECE - d] << 15 | c[:, a : PIECE - d + a] << 10 | c[:, b : PIECE - d + b] << 5 | c[:, d:]].sum(1)
        out[i : i + 5_000] = total * _scale(c)
    return out + np.float32(bias)


def token_scores(codes: np.ndarray, start: np.ndarray, end: np.ndarray, model: Model) -> np.ndarray:
    if not len(start):
        return np.zeros(0, dtype=np.float32)
    codes, token = piece_matrix(codes, start, end)
    got = piece_scores(codes, model.weights, model.bias)
    # letters that other characters part inside a token: also without these
    parted = np.flatnonzero(((codes[:, :-1] == 0) & (codes[:, 1:] > 0)).any(1))
    if len(parted):
        c = codes[parted]
        c = np.take_along_axis(c, np.argsort(c == 0, axis=1, kind="stable"), axis=1)
        got[parted] = np.maximum(got[parted], piece_scores(c, model.weights, model.bias))
    if len(got) == len(start):
        return got
    return np.maximum.reduceat(got, np.flatnonzero(np.diff(token, prepend=-1)))


def spaced(x: Letters, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of three or more one-letter words of a document as one token each: codes, begins, ends, documents."""
    n = len(x.start)
    one = (x.end - x.start == 1) & (x.codes[np.minimum(x.start, max(0, len(x.codes) - 1))] > 0) if n else np.zeros(0, bool)
    at = np.flatnonzero(one)
    if not len(at):
        return np.zeros(0, np.uint8), at, at, at
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(doc[at]) > 0)]))
    size = np.diff(np.append(begin, len(at)))
    long = size >= 3
    return x.codes[x.start[at]], begin[long], (begin + size)[long], doc[at[begin[long]]]


class Scorer:
    """The two highest token scores of each document of a batch."""

    def __init__(self, model: Model):
        self.model = model
        self.key = np.zeros(0, dtype=np.uint64)
        self.value = np.zeros(0, dtype=np.float32)

    def words(self, w: text.Words, x: Letters) -> np.ndarray:
        h = w.hashes()
        key, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        known = self.key[at] == key if len(self.key) else np.zeros(len(key), bool)
        out = np.empty(len(key), dtype=np.float32)
        out[known] = self.value[at[known]]
        new = first[~known]
        out[~known] = token_scores(x.codes, x.start[new], x.end[new], self.model)
        if len(new):
            if len(self.key) + len(new) > KEPT:
                self.key, self.value = key, out
            else:
                keys = np.concatenate([self.key, key[~known]])
                order = np.argsort(keys, kind="stable")
                self.key, self.value = keys[order], np.concatenate([self.value, out[~known]])[order]
        return out[back]

    def top(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        w = text.words(column)
        n = len(w.first) - 1
        one, two = np.full(n, NOTHING, dtype=np.float32), np.full(n, NOTHING, dtype=np.float32)
        if not len(w.start):
            return one, two
        x = letters(w)
        score, doc = self.words(w, x), np.repeat(np.arange(n), w.counts())
        codes, start, end, owner = spaced(x, doc)
        if len(start):
            score, doc = np.concatenate([score, token_scores(codes, start, end, self.model)]), np.concatenate([doc, owner])
        # the two highest of each document
        order = np.lexsort((-score, doc))
        score, doc = score[order], doc[order]
        firsts = np.flatnonzero(np.diff(doc, prepend=-1))
        one[doc[firsts]] = np.maximum(score[firsts], NOTHING)
        second = firsts[np.diff(np.append(firsts, len(doc))) > 1] + 1
        two[doc[second]] = np.maximum(score[second], NOTHING)
        return one, two


# ------------------------------------------------------------------------ fit


def _sparse(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, weight) of all subsequences."""
    rows, cols, vals = [], [], []
    for idx, weight in _indexes(codes):
        r, c = np.nonzero(idx)
        rows.append(r)
        cols.append(idx[r, c])
        vals.append(np.full(len(r), weight, dtype=np.float32))
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)


def kernel(codes: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """The kernel of every row with every landmark."""
    r, c, v = _sparse(landmarks)
    used, col = np.unique(c, return_inverse=True)
    table = np.zeros((len(used), len(landmarks)), dtype=np.float32)
    np.add.at(table, (col, r), v)
    table *= _scale(landmarks).astype(np.float32)
    place = np.full(_N, -1, dtype=np.int32)
    place[used] = np.arange(len(used))
    out = np.zeros((len(codes), len(landmarks)), dtype=np.float32)
    step = max(16, 50_000 // max(1, len(landmarks)))
    for i in range(0, len(codes), step):
        part = codes[i : i + step]
        r, c, v = _sparse(part)
        c = place[c]
        hit = c >= 0
        r, c, v = r[hit], c[hit], v[hit]
        order = np.argsort(r, kind="stable")
        r, c, v = r[order], c[order], v[order]
        if len(r):
            firsts = np.flatnonzero(np.diff(r, prepend=-1))
            out[i + r[firsts]] = np.add.reduceat(table[c] * v[:, None], firsts, axis=0)
        out[i : i + step] *= _scale(part)[:, None]
    return out


def _svm(z: np.ndarray, y: np.ndarray, each: np.ndarray, ridge: float = 0.03) -> np.ndarray:
    """Squared hinge by Newton's method on the rows inside the margin; last weight: bias.  In double precision, by blocks."""
    size = z.shape[1] + 1
    penalty = np.full(size, ridge)
    penalty[-1] = 1e-3
    w = np.zeros(size)
    before = None
    for _ in range(30):
        a, b, inside = np.diag(penalty), np.zeros(size), np.empty(len(z), dtype=bool)
        for i in range(0, len(z), 2000):
            x = np.column_stack([z[i : i + 2000], np.ones(len(z[i : i + 2000]))]).astype(np.float64)
            t, e = y[i : i + 2000], each[i : i + 2000]
            hit = inside[i : i + 2000] = t * (x @ w) < 1
            weighted = x[hit] * e[hit, None]
            a += x[hit].T @ weighted
            b += weighted.T @ t[hit]
        if before is not None and (inside == before).all():
            break
        before = inside
        w = np.linalg.solve(a, b)
    return w


def _grams(codes: np.ndarray) -> np.ndarray:
    """Hashes of the runs of 5, 6 and 8 letters of each row (0: none)."""
    out = []
    for n in (5, 6, 8):
        h = np.zeros((len(codes), PIECE - n + 1), dtype=np.uint32)
        whole = np.ones(h.shape, dtype=bool)
        for j in range(n):
            c = codes[:, j : PIECE - n + 1 + j]
            h = h * np.uint32(0x9E3779B1) + c.astype(np.uint32)
            whole &= c > 0
        h ^= h >> np.uint32(15)
        out.append(np.where(whole, h % np.uint32(_GRAMS - 1) + 1, 0).astype(np.int32))
    return np.concatenate(out, axis=1)


def _highest(scores: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per token the highest score of its pieces, and the first piece that has it."""
    most = np.maximum.reduceat(scores, firsts)
    owner = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(scores))))
    hit = np.flatnonzero(scores == most[owner])
    return most, hit[np.unique(owner[hit], return_index=True)[1]]


def fit(sample: list[tuple[str, int]]) -> Model:
    """Two of three documents of each class fit the SVM, the others calibrate."""
    n = len(sample)
    ones = sum(y for _, y in sample)
    empty = Model(np.zeros(1, np.float32), 0.0, (0.0, 0.0, 0.0), ones / n if n else 0.0)
    if min(ones, n - ones) < 6:
        return empty
    seen = {0: 0, 1: 0}
    use = []
    for _, y in sample:
        seen[y] += 1
        use.append(seen[y] % 3 != 0)
    train = [(t, y) for (t, y), u in zip(sample, use) if u]
    held = [(t, y) for (t, y), u in zip(sample, use) if not u]
    # distinct tokens, and the documents' tokens
    ids: dict[bytes, int] = {}
    docs = [np.unique(np.array([ids.setdefault(x, len(ids)) for x in t.encode().split()], dtype=np.int64)) for t, _ in train]
    y = np.array([v for _, v in train])
    if not ids:
        return empty
    tokens = list(ids)
    ends = np.cumsum([len(t) for t in tokens])
    codes, before = characters(np.frombuffer(b"".join(tokens), np.uint8))
    codes, owner = _small_pieces(codes, before[ends - [len(t) for t in tokens]], before[ends])
    firsts = np.flatnonzero(np.diff(owner, prepend=-1))
    # 1. how much more often toxic documents have each run of letters: tokens that may be meant
    df = np.zeros((2, _GRAMS), dtype=np.float32)
    bounds = np.append(firsts, len(codes))
    for have, v in zip(docs, y):
        rows = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in have]) if len(have) else firsts[:0]
        met: list[np.ndarray] = [np.unique(_grams(codes[rows[i : i + 5000]])) for i in range(0, len(rows), 5000)]
        df[v][np.unique(np.concatenate(met)) if met else rows] += 1
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    p = (df.sum(0) + 1) / (n1 + n0 + 2)
    z = (df[1] / n1 - df[0] / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    z[0] = 0
    z = z.astype(np.float32)
    # the highest piece stands for a token in training
    stands, piece = _highest(np.concatenate([z[_grams(codes[i : i + 5000])].max(1) for i in range(0, len(codes), 5000)]), firsts)
    value = stands
    toxic = [d for d, v in zip(docs, y) if v and len(d)]
    clean = np.unique(np.concatenate([d for d, v in zip(docs, y) if not v] or [np.zeros(0, np.int64)]))
    if not toxic or not len(clean):
        return empty
    freq = np.bincount(np.concatenate([d for d, v in zip(docs, y) if not v]), minlength=len(tokens))
    common = clean[np.argsort(-freq[clean], kind="stable")][:COMMON]
    # 2. landmarks: high tokens that differ, and common ones
    high = np.argsort(-value, kind="stable")
    high = high[value[high] > LEAST_Z]
    _, differ = np.unique(codes[piece[high]], axis=0, return_index=True)
    high = high[np.sort(differ)]
    chosen: list[int] = []
    for at in range(0, len(high), LANDMARKS):  # by blocks: only those chosen and one block are compared at a time
        block = np.concatenate([chosen, np.arange(at, min(at + LANDMARKS, len(high)))]).astype(int)
        near = kernel(codes[piece[high[block]]], codes[piece[high[block]]])
        own = np.sqrt(np.maximum(np.diag(near), 1e-9))
        near = near / own[:, None] / own[None, :]
        take = list(range(len(chosen)))
        for i in range(len(chosen), len(block)):
            if len(take) < LANDMARKS * 2 // 3 and (not take or near[i, take].max() < 0.7):
                take.append(i)
        chosen = block[take].tolist()
        if len(chosen) >= LANDMARKS * 2 // 3:
            break
    marks = np.unique(np.concatenate([high[chosen], common[: LANDMARKS - len(chosen)]])).astype(np.int64)
    m = codes[piece[marks]]
    k = kernel(m, m).astype(np.float64)
    lam, vec = np.linalg.eigh(k)
    good = lam > 1e-4 * lam.max()
    root = vec[:, good] / np.sqrt(lam[good])
    # 3. by turns: fit, and choose the toxic documents' tokens again
    weights, bias = None, 0.0
    sel_neg = common
    for _ in range(3):
        meant = [d[stands[d] > LEAST_Z] for d in toxic]
        positive = np.unique(np.concatenate([d[np.argsort(-value[d], kind="stable")[:MEANT]] for d in meant]))
        positive = np.setdiff1d(positive, clean)
        hard = clean[value[clean] > (2 if weights is None else -1)]  # with evidence of their own, later inside the margin
        sel_neg = np.unique(np.concatenate([sel_neg, hard]))
        chosen_ = np.concatenate([positive, sel_neg])
        if not len(positive):
            return empty
        target = np.concatenate([np.ones(len(positive)), -np.ones(len(sel_neg))])
        each = np.where(target > 0, 3.0, 3.0 * len(positive) / len(sel_neg) + 0.5)
        z = kernel(codes[piece[chosen_]], m) @ root.astype(np.float32)
        w = _svm(z, target, each)
        beta = (root @ w[:-1]) * _scale(m)
        r, c, v = _sparse(m)
        weights = np.bincount(c, weights=beta[r] * v, minlength=_N).astype(np.float32)
        bias = float(w[-1])
        value, piece = _highest(piece_scores(codes, weights, bias), firsts)
    # 4. calibration on the other documents
    model = Model(weights, bias, (0.0, 0.0, 0.0))
    scorer = Scorer(model)
    tops = [scorer.top(b.column(0)) for b in text.steps(pa.RecordBatch.from_arrays([pa.array([t for t, _ in held])], names=["text"]), limit=1 << 18)]
    one, two = (np.concatenate(x) for x in zip(*tops))
    x, yh = np.column_stack([one, two]).astype(float), np.array([v for _, v in held], dtype=float)
    c = logistic(x, yh, ridge=0.05)
    return replace(model, calibration=(float(c[0]), float(c[1]), float(c[2])))


def train(docs: DataFrame, labels: DataFrame, seen=None, per_class: int = PER_CLASS) -> Model:
    """Fit on at most ``per_class`` texts of each class; the classes' odds among
    all labels that may be seen calibrate the constant."""
    seen = F.lit(True) if seen is None else seen
    model = fit(labelled.sample(docs, labels, "toxic", per_class, seen))
    if model.constant is not None:
        return model
    known = labels.where(seen).agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b")).first()
    a, b, c = model.calibration
    return replace(model, calibration=(a, b, c + math.log((known.a + 1) / (known.b + 1))))


def score_toxicity(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """``docs`` with a double ``score`` (0 to 1) from the column ``text``."""
    spark = docs.sparkSession
    text.ready(spark)
    held = spark.sparkContext.broadcast(model)  # 4 MB, whatever the input
    docs = docs.drop(score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        scorer = Scorer(m)
        a, b, c = m.calibration
        for batch in batches:
            for part in text.steps(batch):
                if m.constant is not None:
                    got = np.full(part.num_rows, m.constant)
                else:
                    one, two = scorer.top(part.column(part.schema.get_field_index("text")))
                    got = 1 / (1 + np.exp(-np.clip(a * one.astype(float) + b * two + c, -40, 40)))
                yield text.extended(part, **{score: got})

    return docs.mapInArrow(run, text.plus(docs.schema, **{score: "double"}))


def op10(spark, sf_dir: str) -> DataFrame:
    docs = text.documents(spark, sf_dir)
    model = train(docs, text.table(spark, sf_dir, "labels"), labelled.remainder("doc_id", 5) != 0)
    out = score_toxicity(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (labelled.remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_civil(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score below 0.5."""
    model = train(docs, text.table(spark, sf_dir, "labels"))
    cols = docs.columns
    return score_toxicity(docs, model, "_toxic").where("_toxic < 0.5").select(*cols)
