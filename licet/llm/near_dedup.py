"""Near-duplicates by improved consistent weighted sampling.

A text's elements are its shingles of five words.  A shingle weighs
``1 + ln(times)`` times its inverse document frequency, ``1 + ln((1 + N) / (1 +
df)) / ln(2 + N)``, between 1 and 2.  The frequencies are those of all documents'
shingles, counted in ``2 ** 20`` hashed classes, a table of fixed size: shingles
of so small a share of the documents that chance fills their classes as much
(some 0.03 %) are not told apart, whatever the number of documents.
Consistent weighted samples agree with the probability of the
weighted Jaccard similarity; ``BANDS`` bands of ``ROWS`` samples give the
candidates, which are verified on whole texts by that similarity alone.  Pairs
at 0.8 miss all bands with probability 0.0002.

Why 0.8: it is the similarity that near copies are asked to have.  Of a text of
n words an edit of one word changes five shingles of n - 4 in both texts, so
one edit in 45 words is as much as a pair may have.

Equal word sequences are one node from the start, by two digests of 64 bits.  In a bucket of a band first
one leader, the node with most company in all its buckets, is compared with the
others.  Where the others then lie in several classes, every node outside the
largest one is compared with all nodes of other classes: as rows in buckets of
up to ``SMALL`` nodes, and in larger ones by blocks of ``BLOCK`` times
``BLOCK`` nodes, each a task's matrix product that leaves the pairs near or over
the threshold, which are then verified as all others are, if they join classes.  So any two nodes of a bucket end in one class, or have been
compared with each other: no link between candidates is lost, and a group of n
copies costs n comparisons.  Classes are the connected components of the links.

Cases: null and empty texts have no words; they are one node, and link to
nothing else.  Texts of one to four words have one shingle of all of them.
Rows with equal id and text are one document twice; a null id is the last
choice for a class's representative.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text

SHINGLE = 5
SIMILAR = 0.8
SMALL, BLOCK = 32, 256
#: A key of more than one in so many rows is hot.
HOT = 4096
BANDS, ROWS = 16, 4
CLASSES = 20
_SLICES = 64
_E = np.uint64(44)
_E_MASK = np.uint64((1 << 44) - 1)
_POOL = 16

_rng = np.random.Generator(np.random.PCG64(271828))
#: Draws that elements pick from by hash: Gamma(2, 1), log of Gamma(2, 1), uniform.
_R = _rng.gamma(2.0, 1.0, 1 << _POOL).astype(np.float32)
_Q = (np.log(_rng.gamma(2.0, 1.0, 1 << _POOL)) - _R).astype(np.float32)
_B = _rng.random(1 << _POOL).astype(np.float32)
_ODD = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(w: text.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document and 64-bit key of every shingle (texts of fewer words: one of them all), and each
    document's two digests of its words in order."""
    counts = w.counts()
    docs = len(counts)
    h = w.hashes()
    doc = np.repeat(np.arange(docs), counts)
    place = (np.arange(len(h)) - w.first[doc]).astype(np.uint64) if len(h) else h
    digests = []
    full = np.flatnonzero(counts)
    for odd in (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)):
        digest = np.zeros(docs, dtype=np.uint64)
        if len(full):
            digest[full] = np.add.reduceat(text.mix(h + place * odd), w.first[full])
            digest = text.mix(digest + counts.astype(np.uint64))
        digests.append(digest)
    n = max(0, len(h) - SHINGLE + 1)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(SHINGLE):
        key = text.mix(key + h[j : j + n] * np.uint64(0x9E3779B97F4A7C15))
    whole = np.flatnonzero(doc[:n] == doc[SHINGLE - 1 :]) if n else np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    return np.concatenate([doc[whole] if n else doc[:0], short]), np.concatenate([key[whole], digests[0][short]]), *digests


def shingle_class(key: np.ndarray) -> np.ndarray:
    """The bits of a key that its element lacks."""
    return (key & np.uint64((1 << CLASSES) - 1)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """The inverse document frequency of each class of shingles; the driver gets 64 rows, 8 MB."""
    text.ready(docs.sparkSession)
    width = (1 << CLASSES) // _SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << CLASSES, dtype=np.uint32), 0
        for batch in batches:
            for part in text.steps(batch):
                doc, key, _, _ = shingles(text.words(part.column(0)))
                has = np.unique(doc << CLASSES | shingle_class(key))
                df += np.bincount(has & ((1 << CLASSES) - 1), minlength=1 << CLASSES).astype(np.uint32)
                n += part.num_rows
        if n:
            rows = [zstandard.compress(x.astype("<i8").tobytes(), 1) for x in (*df.reshape(_SLICES, width), np.array([n]))]
            yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES + 1), pa.int32()), pa.array(rows, pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                c = np.frombuffer(zstandard.decompress(raw.as_py()), "<i8")
                total[k] = total[k] + c if k in total else c
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "counts"])

    schema = "slice int, counts binary"
    rows = docs.select("text").mapInArrow(count, schema).repartition(_SLICES, "slice").mapInArrow(add, schema).collect()
    got = {r.slice: np.frombuffer(bytes(r.counts), "<i8") for r in rows}
    n = int(got[_SLICES][0]) if got else 0
    df = np.concatenate([got[i] for i in range(_SLICES)]) if got else np.zeros(1 << CLASSES)
    return (1 + np.log((1 + n) / (1 + df)) / np.log(2 + n)).astype(np.float32)


def weighted(w: text.Words, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents, elements (44 bits), weights and times, sorted by the first two; and each document's digests."""
    doc, key, digest, check = shingles(w)
    order = np.argsort(doc.astype(np.uint64) << _E | key >> np.uint64(20))
    doc, key = doc[order], key[order]
    element = key >> np.uint64(20)
    firsts = np.flatnonzero(np.concatenate([[True], (element[1:] != element[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(firsts, len(key)))
    return doc[firsts], element[firsts], idf[shingle_class(key[firsts])] * (1 + np.log(times.astype(np.float32))), times, digest, check


def bands(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
    """Band keys of each document (rows of zeros: no elements)."""
    out = np.zeros((docs, BANDS), dtype=np.int64)
    if not len(doc):
        return out
    firsts = np.flatnonzero(np.diff(doc, prepend=-1))
    e = text.mix(element)
    low = e & np.uint64(0xFFFFFFFF)
    log = np.log(weight)
    key = np.zeros(len(firsts), dtype=np.uint64)
    for k in range(BANDS * ROWS):
        at = (e * _ODD[k] >> np.uint64(64 - _POOL)).astype(np.int64)
        r, b = _R[at], _B[at]
        t = np.floor(log / r + b)
        a = _Q[at] - r * (t - b)
        # order as numbers: a float's bits, with those of negative ones turned
        bits = a.view(np.int32)
        bits = np.where(bits < 0, ~bits, bits | np.int32(-(2**31))).view(np.uint32).astype(np.uint64)
        what = low ^ (t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF))
        least = np.minimum.reduceat(bits << np.uint64(32) | what, firsts)
        key = text.mix(key * np.uint64(31) + (least & np.uint64(0xFFFFFFFF)) + np.uint64(k))
        if k % ROWS == ROWS - 1:
            out[doc[firsts], k // ROWS] = key.view(np.int64)
            key = np.full(len(firsts), k + 1, dtype=np.uint64)
    return out


def similarities(a: pa.Array, b: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of the texts of each row."""
    n = len(a)
    parts = [weighted(text.words(x), idf)[:3] for x in (a, b)]
    key = np.concatenate([d.astype(np.uint64) << _E | e for d, e, _ in parts])
    weight = np.concatenate([x[2] for x in parts]).astype(np.float64)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    row = (key >> _E).astype(np.int64)
    both = np.flatnonzero(key[1:] == key[:-1])
    total = np.bincount(row, weight, minlength=n)
    common = np.bincount(row[both], np.minimum(weight[both], weight[both + 1]), minlength=n)
    return np.divide(common, total - common, out=np.zeros(n), where=total > common)


def signatures(docs: DataFrame, idf) -> DataFrame:
    """Per document doc_id, _h (hash of the text), node and check (digests of its words), bands (null: no words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.steps(batch):
                doc, e, weight, _, digest, check = weighted(text.words(part.column(part.schema.get_field_index("text"))), idf.value)
                keys = bands(doc, e, weight, part.num_rows)
                some = np.zeros(part.num_rows, dtype=bool)
                some[doc] = True
                packed = [keys[i].tobytes() if some[i] else None for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digest.view(np.int64)), pa.array(check.view(np.int64)), pa.array(packed, pa.binary())], names=["doc_id", "_h", "node", "check", "bands"])

    return docs.select("doc_id", F.xxhash64("text").alias("_h"), "text").mapInArrow(run, "doc_id long, _h long, node long, check long, bands binary")


def spread(rows: DataFrame, each: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined with ``each``, which has one row a key and in ``size`` how many rows there are of it.

    Keys of more than one in ``HOT`` of the ``total`` rows number less than ``HOT``: the driver
    learns them and their rows of ``each`` are broadcast, so none of them gathers in a task; the others go by key.
    """
    hot = [r[0] for r in each.where(F.col(size) * HOT > total).select(key).collect()]
    if not hot:
        return rows.join(each, key)
    some = F.col(key).isin(hot)
    return rows.where(some).join(F.broadcast(each.where(some)), key).unionByName(rows.where(~some).join(each.where(~some), key))


def _buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node, count) of all buckets with two nodes or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(x.as_py() for x in batch.column(1)), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["bucket", "node"])

    some = nodes.where("bands IS NOT NULL").select("node", "bands")
    rows = some.mapInArrow(run, "bucket long, node long")
    sizes = text.written(rows.groupBy("bucket").count().where("count > 1"), "sizes")
    return spread(rows, sizes, "bucket", "count", some.count() * BANDS)


def _verified(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """Pairs (a, b) of nodes with the similarity of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.steps(batch, "_one", 1 << 20):
                got = similarities(part.column(2), part.column(3), idf.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got)], names=["a", "b", "similarity"])

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("_one"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("_two"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "_one", "_two").mapInArrow(run, "a long, b long, similarity double")


def _between(column: pa.Array, asks: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarities of the texts that ask with all of the others, as a matrix, to some 0.00001; and which rows ask."""
    doc, e, weight, times, _, _ = weighted(text.words(column), idf)
    n = len(column)
    q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
    place = np.empty(n, dtype=np.int64)
    place[q], place[m] = np.arange(len(q)), np.arange(len(m))
    total = np.bincount(doc, weight, minlength=n)
    # a shingle's times as levels, whose weights add up: the common weight is a product of matrices
    level = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    doc, e, one = np.repeat(doc, times), np.repeat(e, times), np.repeat(weight / (1 + np.log(times)), times)
    step = one * (np.log(level + 1.0) - np.log(np.maximum(level, 1.0)) + (level == 0))
    _, col = np.unique(text.mix(e + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True)
    cols = int(col.max(initial=-1)) + 1
    both = (np.bincount(col[asks[doc]], minlength=cols) > 0) & (np.bincount(col[~asks[doc]], minlength=cols) > 0)
    new = np.cumsum(both) - 1
    keep = both[col]
    doc, col, step = doc[keep], new[col[keep]], np.sqrt(step[keep])
    common = np.zeros((len(q), len(m)), np.float32)
    order = np.argsort(col, kind="stable")
    bounds = np.searchsorted(col[order], np.arange(0, int(both.sum()) + 4096, 4096))
    for i, j in zip(bounds, bounds[1:]):
        at = order[i:j]
        if len(at):
            c, d, a = col[at] % 4096, doc[at], asks[doc[at]]
            x, y = np.zeros((len(q), 4096), np.float32), np.zeros((len(m), 4096), np.float32)
            x[place[d[a]], c[a]] = step[at][a]
            y[place[d[~a]], c[~a]] = step[at][~a]
            common += x @ y.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(common / (total[q][:, None] + total[m][None, :] - common)), q


def _joining(rest: DataFrame, texts: DataFrame, idf, similar: float) -> DataFrame:
    """Links of large buckets' smaller classes: ``rest`` has bucket, node, label, outside and the bucket's numbers."""

    def done(rows: list[tuple], column: list[str]) -> list[tuple]:
        asks = np.array([r[2] for r in rows])
        if asks.all() or not asks.any():
            return []
        s, q = _between(pa.array(column), asks, idf.value)
        m = np.flatnonzero(~asks)
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(s >= similar - 1e-3)):
            (a, la, _), (b, lb, _) = rows[q[i]], rows[m[j]]
            if a != b and top(la) != top(lb):
                exact = float(similarities(pa.array([column[q[i]]]), pa.array([column[m[j]]]), idf.value)[0])
                if exact >= similar:
                    root[top(la)] = top(lb)
                    out.append((min(a, b), max(a, b), exact))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, said, out = None, [], [], []
        for batch in batches:
            for bucket, x, y, node, label, asks, t in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, x, y) != now:
                    if rows:
                        out += done(rows, said)
                    now, rows, said = (bucket, x, y), [], []
                rows.append((node, label, asks))
                said.append(t)
            yield _links(out)
            out = []
        if rows:
            yield _links(done(rows, said))

    def _links(out) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "similarity"])

    blocks = F.ceil(F.col("_all") / BLOCK).cast("int")
    asking = F.ceil(F.col("_outside") / BLOCK).cast("int")
    hashed = F.xxhash64("node")
    one = rest.where("outside").select("bucket", F.pmod(hashed, asking).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("y"), "node", "label", F.lit(True).alias("asks"))
    two = rest.select("bucket", F.explode(F.sequence(F.lit(0), asking - 1)).alias("x"), F.pmod(hashed, blocks).cast("int").alias("y"), "node", "label", F.lit(False).alias("asks"))
    rows = one.unionByName(two).join(texts, "node").select("bucket", "x", "y", "node", "label", "asks", "text")
    return rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y").mapInArrow(run, "a long, b long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of the nodes in ``links`` (a, b): the least node that they reach.

    Least labels of neighbours, then labels of labels, until nothing changes.
    """
    both = text.written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = text.written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m")).select("node", F.least("node", "_m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        new = labels.join(near, "node").select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("_new"))
        jump = labels.select(F.col("node").alias("_new"), F.col("label").alias("_jump"))
        new = text.written(new.join(jump, "_new", "left").select("node", "_old", F.least("_new", F.coalesce("_jump", "_new")).alias("label")), "labels")
        changed = not new.where("label <> _old").isEmpty()
        labels = new.select("node", "label")
        if not changed:
            return labels


def _signed(docs: DataFrame, idf) -> tuple[DataFrame, DataFrame]:
    """The signatures; and per node how many rows it has, and the id and hash of the one that stands for it."""
    stands = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_h"))
    each = (F.min(stands).alias("_rep"), F.count(F.lit(1)).alias("_rows"), F.first("bands").alias("bands"), F.min("check").alias("_c"), F.max("check").alias("_d"))
    signed = text.written(signatures(docs, idf), "signatures")
    nodes = text.written(signed.groupBy("node").agg(*each), "nodes")
    clash = nodes.where("_c <> _d").select("node", F.lit(True).alias("_clash"))
    if not clash.isEmpty():  # different texts with one digest: about n * n / 2 ** 65 of them
        other = signed.join(F.broadcast(clash), "node", "left").withColumn("node", F.when(F.col("_clash"), F.xxhash64("node", "check")).otherwise(F.col("node")))
        signed = text.written(other.drop("_clash"), "signatures")
        nodes = text.written(signed.groupBy("node").agg(*each), "nodes")
    return signed, nodes.drop("_c", "_d")


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Per row of ``docs`` doc_id, _h, class_id (the least id of its class), class_size and first (it stands for its class)."""
    spark = docs.sparkSession
    text.ready(spark)
    idf = spark.sparkContext.broadcast(document_frequencies(docs))
    signed, nodes = _signed(docs, idf)
    buckets = text.written(_buckets(nodes), "buckets")
    n_buckets = buckets.count()
    # the texts of the nodes that share a bucket
    wanted = nodes.join(buckets.select("node").distinct(), "node").select("node", F.col("_rep.doc_id").alias("_id"), F.col("_rep._h").alias("_hash"))
    here = docs.select("doc_id", F.xxhash64("text").alias("_h"), "text")
    texts = here.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash"))).select("node", "text")
    texts = text.written(texts.dropDuplicates(["node"]) if _repeats(signed) else texts, "texts")

    company = buckets.groupBy("node").agg(F.sum("count").alias("_company"))
    leaders = text.written(buckets.join(company, "node").groupBy("bucket").agg(F.max(F.struct("_company", "node"))["node"].alias("lead"), F.first("count").alias("_n")), "leaders")
    canonical = (F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b"))
    pairs = spread(buckets.select("bucket", "node"), leaders, "bucket", "_n", n_buckets).where("node <> lead").select(*canonical).distinct()
    found = text.written(_verified(pairs, texts, idf), "compared")
    labels = components(found.where(F.col("similarity") >= similar))
    # what has not led, in the buckets where it lies in several classes
    rest = buckets.select("bucket", "node").join(leaders.select("bucket", F.col("lead").alias("node")), ["bucket", "node"], "left_anti")
    rest = text.written(rest.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "rest")
    sizes = rest.groupBy("bucket", "label").count()
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("count", "label")).alias("_most"), F.count(F.lit(1)).alias("_n"), F.sum("count").alias("_all"))
    largest = text.written(largest.where("_n > 1"), "largest")
    rest = spread(rest, largest, "bucket", "_all", n_buckets).select("bucket", "node", "label", (F.col("label") != F.col("_most.label")).alias("outside"), "_all", (F.col("_all") - F.col("_most.count")).alias("_outside"))
    rest = text.written(rest, "rest")
    few = rest.where(F.col("_all") <= SMALL)
    pairs = few.select("bucket", "node", "label").join(few.where("outside").select("bucket", F.col("node").alias("lead"), F.col("label").alias("_label")), "bucket").where("label <> _label").select(*canonical).distinct()
    more = _verified(pairs.join(found, ["a", "b"], "left_anti"), texts, idf).where(F.col("similarity") >= similar)
    large = _joining(rest.where(F.col("_all") > SMALL), texts, idf, similar)
    new = text.written(more.unionByName(large), "compared")
    of = nodes.join(labels, "node", "left").select("node", "_rep", "_rows", F.coalesce("label", "node").alias("_class"))
    if not new.isEmpty():
        # classes that the further links join: components of classes, not of nodes again
        name = labels.select("node", F.col("label").alias("_to"))
        for end in ("a", "b"):
            new = new.join(name.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        joins = components(new).select(F.col("node").alias("_class"), F.col("label").alias("_to"))
        of = of.join(joins, "_class", "left").withColumn("_class", F.coalesce("_to", "_class")).drop("_to")
    of = text.written(of, "of")
    each = of.groupBy("_class").agg(F.min("_rep").alias("_rep"), F.count(F.lit(1)).alias("_nodes"), F.sum("_rows").alias("class_size"))
    each = text.written(each, "classes").select("_class", F.col("_rep.doc_id").alias("class_id"), F.col("_rep._h").alias("_first"), "class_size", "_nodes")
    named = text.written(spread(of.select("_class", "node", "_rows"), each, "_class", "_nodes", of.count()).drop("_class", "_nodes"), "named")
    out = spread(signed.select("doc_id", "_h", "node"), named, "node", "_rows", signed.count())
    return out.select("doc_id", "_h", "class_id", "class_size", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("_h") == F.col("_first"))).alias("first"))


def _repeats(signed: DataFrame) -> bool:
    return not signed.groupBy("doc_id", "_h").count().where("count > 1").isEmpty()


def first_of_classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` that stand for their classes, one each, with all their columns."""
    cols = docs.columns
    h, id_, hash_ = text.unused(docs, "_h", "_id", "_hash")
    found = text.written(classes(docs.select("doc_id", "text"), similar).where("first").select(F.col("doc_id").alias(id_), F.col("_h").alias(hash_)), "first")
    out = docs.withColumn(h, F.xxhash64("text")).join(found.distinct(), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(h) == F.col(hash_)), "left_semi")
    if not found.groupBy(id_, hash_).count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", h])
    return out.select(*cols)


def op7(spark, sf_dir: str) -> DataFrame:
    return classes(text.documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "class_id", "class_size", "first")


def keep_first(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class."""
    return first_of_classes(docs)
