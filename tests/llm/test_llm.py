"""The ten operators and the pipeline: brute force, round trips, held-out accuracy and odd tables."""

import collections
import hashlib
import math
import os
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from licet.llm import bpe_chunks, chat_schema, compression_quality, interleaved, kneser_ney, labelled, mixing, near_dedup, rules_quality, tag_paths, text, toxicity
from licet.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix strange potions under pale moonlight near old stone bridges".split()


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n)) + f" end{seed}."


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, an empty text, white space only, one very long text, repeated rows, ties."""
    long_ = prose(1, 60_000)
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, long_, "en", "a", len(long_)),
        (5, prose(2, 120), "en", "b", 1), (6, prose(2, 120), "de", None, 1), (6, prose(2, 120), "de", None, 1), (None, "no id here", "en", "b", 1),
        (8, "naïve ☃ 日本語 <|endoftext|> x", "en", "c", 1), (9, "a\x1cb c d", "en", "c", 1), (10, prose(3, 40), "en", "a", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def split(t):
    return (t or "").encode().split()


# ------------------------------------------------------------------ shared


def test_words_match_bytes_split():
    texts = ["a b", "", None, " x\ty ", "é z\x1c w", "\n\n", "q" * 5000]
    w = text.words(pa.array(texts))
    got = [[w.data[w.start[i] : w.end[i]].tobytes() for i in range(w.first[d], w.first[d + 1])] for d in range(len(texts))]
    assert got == [split(t) for t in texts]
    h = w.hashes()
    seen = {}
    for i, x in enumerate(x for g in got for x in g):
        assert seen.setdefault(x, h[i]) == h[i]
    assert len(set(seen.values())) == len(seen)


# ------------------------------------------------- classifiers, held-out rows


@pytest.mark.parametrize("name, label, least", [("op1_compression_quality", "quality", 0.93), ("op10_string_kernel", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    d = "/root/testdata/sf0.01"
    out = QUERIES[name](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    r = out.where("held_out").agg(F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("right"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r.right >= least and 0 <= r.lo <= r.hi <= 1


def test_held_out_toxicity_recall_and_precision(spark):
    d = "/root/testdata/sf0.1"
    out = QUERIES["op10_string_kernel"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    r = out.selectExpr("count_if(predicted = 1 AND toxic = 1) AS hit", "count_if(predicted = 1) AS said", "count_if(toxic = 1) AS real").first()
    assert r.real > 90 and r.hit >= 0.85 * r.real and r.hit >= 0.93 * r.said


def test_held_out_quality_by_class(spark):
    d = "/root/testdata/sf0.1"
    out = QUERIES["op1_compression_quality"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    r = out.groupBy("quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("right"), F.count(F.lit(1)).alias("n")).collect()
    assert len(r) == 2 and all(x.right >= 0.95 and x.n > 100 for x in r)


def test_letters_of_other_scripts_are_told_apart():
    clean = [(prose(i, 60) + " городской погода", 0) for i in range(60)]
    bad = [(prose(100 + i, 50) + " негодяй ты и негодяй", 1) for i in range(60)]
    model = toxicity.fit([x for pair in zip(clean, bad) for x in pair])
    one, _ = toxicity.Scorer(model).top(pa.array(["ты негодяй", "ты нег.одяй", "городской", "погода", "молоко дорога"]))
    assert min(one[:2]) > max(one[2:])


def test_inserted_letters_still_resemble():
    clean = [(prose(i, 60), 0) for i in range(60)]
    bad = [(prose(100 + i, 50) + f" you {w} and {w}", 1) for i in range(60) for w in [("idiot", "moron", "scumbag")[i % 3]]]
    model = toxicity.fit([x for pair in zip(clean, bad) for x in pair])
    one, _ = toxicity.Scorer(model).top(pa.array(["you idiot there", "you id-iot there", "you idxiot there", "i d i o t", "the lazy dog", "", None]))
    assert min(one[:4]) > one[4] and one[5] == one[6] == np.float32(toxicity.NOTHING)


def test_classifiers_on_odd_tables(odd, none, labels):
    for model, score in ((compression_quality.train(odd, labels), compression_quality.score_quality), (toxicity.train(odd, labels), toxicity.score_toxicity)):
        clash = odd.withColumn("score", F.lit("mine"))
        rows = score(clash, model).collect()
        assert len(rows) == 11 and {r.score for r in rows} <= {0.0, 0.5}
        assert score(none, model).count() == 0
    sample = [(prose(i, 80), 1) for i in range(40)] + [("%%% $$$ *** " * 30 + str(i), 0) for i in range(40)]
    model = compression_quality.fit(sample)
    got = [r.score for r in compression_quality.score_quality(odd.where("doc_id IN (1, 2, 4, 5)").orderBy("doc_id"), model).collect()]
    assert all(0 <= x <= 1 for x in got) and got[0] == got[1] and got[3] > 0.5


def test_sample_is_bounded_and_one_label_each(spark, odd):
    lab = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (6, 0, 1), (10, 1, 0), (10, 0, 0), (99, 1, 1), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    got = labelled.sample(odd, lab, "quality", 2, F.lit(True))
    assert len(got) <= 4 and {y for _, y in got} == {0, 1}


# -------------------------------------------------------------- quality rules


def brute_measures(t):
    t = t or ""
    ws = split(t)
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if x.encode().split():
            dup += x in seen
            seen.add(x)
    grams = collections.Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    hit = set()
    for i in range(len(ws) - 7):
        if grams[tuple(ws[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    return len(ws), sum(len(w.decode()) for w in ws), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_rules_base_measures(spark, odd, none):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(*odd.columns).unionByName(odd.where("doc_id <> 4 OR doc_id IS NULL"))
    out = rules_quality.judged(docs.withColumn("kept", F.lit(7)).withColumn("n_words", F.lit("x")).withColumn("_t", F.col("text")).select("doc_id", "text", "kept", "n_words", F.col("_t").alias("body")))
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_measures(r.body)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert rules_quality.judged(none).count() == 0


def test_em_finds_the_faults():
    rng = np.random.default_rng(0)
    names = list(rules_quality.RULES)
    rows = []
    for i in range(4000):
        v = np.where(rng.random(len(names)) < 0.02, 0, 1)
        if i % 5 == 0:
            v[names.index(("symbols", "repeats")[i // 5 % 2])] = -1
        rows.append(v)
    pats, counts = np.unique(np.array(rows), axis=0, return_counts=True)
    share, table = rules_quality.estimate(pats, counts.astype(float))
    assert abs(share[0] - 0.8) < 0.05 and table[1, names.index("repeats"), 0] > 0.8


# ------------------------------------------------------------------------ BPE


def test_bpe_equals_the_library(spark, odd, none):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(bpe_chunks.default_path())
    docs = spark.read.parquet(f"{DATA}/documents.parquet").unionByName(odd)
    want = collections.Counter()
    for r in docs.collect():
        ids = tk.encode(r.text or "", add_special_tokens=False).ids
        back = tk.decode(ids, skip_special_tokens=False)
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_chunks.digests(docs.select("doc_id", "text")).collect())
    assert got == want
    both = bpe_chunks.decode(bpe_chunks.encode(odd.withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(2)).drop("decoded")))
    assert all((r.text or "") == r.decoded for r in both.collect())
    assert bpe_chunks.digests(none.select("doc_id", "text")).count() == 0


def test_chunks_are_shared_and_encoded_once(spark):
    shared = prose(7, 4000)
    texts = [prose(8 + i, 50 + 20 * i) + " " + shared for i in range(4)] + [shared, prose(99, 3000)]
    parts = collections.Counter(x for t in texts for x in bpe_chunks.chunks(pa.array([t]))[0])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    folder, shards, n = bpe_chunks.shared_chunks(docs, bpe_chunks.default_path(), 5000)
    assert shards > 10 and n == sum(c > 1 for c in parts.values()) > 10
    e, stored = bpe_chunks.Encoder(bpe_chunks.default_path()), bpe_chunks.Shared(folder, shards)
    got = list(e.batch(pa.array(texts), stored))
    # encoded here: chunks that occur once, and windows around joins
    assert e.encoded - e.repaired == sum(c == 1 for c in parts.values())
    assert [list(x) for x in got] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_joins_are_repaired_until_they_agree():
    """Any cuts at all, also inside words, white space and special tokens, give the whole text's ids."""
    e = bpe_chunks.Encoder(bpe_chunks.default_path())
    rng = np.random.default_rng(11)
    texts = [prose(3, 60), "a  b\n\n   c " * 20, "don't we'll  it's 123,456 x<|endoftext|>y <|endoftext|> z " * 6, "naïve ☃ 日本語です。 текст и слова\u00a0x " * 8, "x" * 300, " " * 200 + "end", "日本語" * 60 + " a b c"]
    for t in texts:
        for _ in range(30):
            at = np.unique(rng.integers(0, len(t) + 1, rng.integers(1, 12)))
            parts = [x for x in np.split(np.array(list(t)), at) if len(x)]
            got = e.joined(e.encode(["".join(x).encode() for x in parts]))
            assert list(got) == e.tokenizer.encode(t, add_special_tokens=False).ids


# ----------------------------------------------------------------- Kneser-Ney


@pytest.mark.parametrize("order, shard, fan", [(1, 2000, 1024), (2, 2000, 1024), (3, 40, 1024), (3, 400, 4), (5, 2000, 1024)])
def test_kneser_ney_brute_force(spark, odd, order, shard, fan):
    """Every order against plain counting, also with frequent contexts (small ``SHARD``) and dealing in two steps (small ``FAN``)."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("doc_id < 60").unionByName(odd.select("doc_id", "text"))
    rows = docs.collect()
    seen = lambda r: zlib.crc32(str(r.doc_id).encode()) % 7 != 2 if r.doc_id is not None else True
    tok = lambda t: [w.translate(bytes(text.LOWER)) for w in split(t)] + ["</s>"]
    train = [tok(r.text) for r in rows if seen(r)]
    count = collections.Counter(x for t in train for x in t)
    n, v = sum(count.values()), len(count)

    def spans(t):
        t = ["<s>"] * (order - 1) + t
        return [tuple(t[i : i + order]) for i in range(len(t) - order + 1)]

    levels = {order: collections.Counter(g for t in train for g in spans(t))}
    for k in range(order - 1, 0, -1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])

    def disc(counts):
        a = [max(1, sum(x == i for x in counts)) for i in (1, 2, 3, 4)]
        y = a[0] / (a[0] + 2 * a[1])
        return [0, *(min(i - 0.05, max(0.05, i - (i + 1) * y * a[i] / a[i - 1])) for i in (1, 2, 3))]

    d = {k: disc(c.values()) for k, c in levels.items()}
    total, mass = collections.Counter(), collections.Counter()
    for k, c in levels.items():
        for g, x in c.items():
            total[k, g[:-1]] += x
            mass[k, g[:-1]] += d[k][min(x, 3)]

    def p(g):
        if not g:
            return 1 / (v + 1)
        k, low = len(g), p(g[1:])
        t, x = total[k, g[:-1]], levels[k][g]
        return (max(x - d[k][min(x, 3)], 0) + mass[k, g[:-1]] * low) / t if t else low

    start = ("<s>",) * (order - 1)
    assert abs(sum(p((*start, w)) for w in [*count, "<unk>"]) - 1) < 1e-9
    held = F.coalesce(labelled.remainder("doc_id", 7) == 2, F.lit(False))
    model = kneser_ney.train(docs.where(~held), 16 * shard, order, shard, fan)
    got = {(r.doc_id, r.n_tokens): r for r in kneser_ney.score_texts(docs, model).collect()}
    for r in rows:
        t = tok(r.text)
        g = got[r.doc_id, len(t)]
        assert g.n_known == sum(count[w] > 0 for w in t) and g.train_tokens == n
        assert math.isclose(g.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert math.isclose(g.score, sum(math.log10(p(x)) for x in spans(t)), rel_tol=1e-9)


def test_ngrams_are_packed_with_short_numbers(spark):
    """What counting sends to the shards, on real texts: 3.6 bytes a trigram (6.0 with numbers in the order of hashes)."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("text")
    model = kneser_ney.train(docs, 10**6)
    deal = kneser_ney.Deal(model.folder, 4, 3, 1)
    sent = [x for b in kneser_ney._count_grams(3, deal)(docs.toArrow().to_batches()) for x in b.column(2).to_pylist()]
    got = [kneser_ney.unpack(x, 3, 1, 3) for x in sent]
    assert sum(int(counts.sum()) for _, (counts,) in got) == model.tokens
    assert sum(map(len, sent)) < 4.5 * sum(len(counts) for _, (counts,) in got)


def test_packed_ngrams_come_back():
    """Numbers around ``SHORT``, begin marks, large counts, long runs and lone rows, at every order."""
    rng = np.random.default_rng(4)
    odd = np.array([0, 1, 255, 256, kneser_ney.SHORT - 1, kneser_ney.SHORT, kneser_ney.SHORT + 1, 2**24 - 1], dtype=np.uint64)
    for order, n in ((1, 1), (1, 8), (2, 3000), (3, 1), (3, 3000), (5, 3000)):
        columns = [rng.choice(odd, n) for _ in range(order)]
        counts = [rng.choice(np.array([0, 1, 254, 255, 256, 10**12], dtype=np.uint64), n) for _ in range(4)]
        ids, numbers = kneser_ney.unpack(kneser_ney.pack(columns, counts, 3), order, 4, 3)
        assert sorted(zip(*ids, *numbers)) == sorted(zip(*columns, *counts))


def test_frequent_words_have_the_first_numbers(spark):
    """By falling counts; numbers and places belong together, also past the ranked words."""
    texts = [" ".join(f"w{i}" for i in range(j, 300)) for j in range(0, 300, 3)]
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in texts], "text string"), 1_500, shard=50)
    words = kneser_ney.Words(model.folder)
    hashes = np.unique(kneser_ney.sequence(pa.array(texts))[0])
    number, count = words.look_up(hashes)
    assert sorted(number) == list(range(1, 302)) and list(count[np.argsort(number)]) == sorted(count, reverse=True)
    assert words.heavy == (count > 50).sum() > 0 and np.array_equal(words.number(words.place(number)), number)
    words.ranked, words.sorted, words.rank = words.ranked[:7], np.sort(words.ranked[:7]), np.argsort(words.ranked[:7]) + 1
    places = np.arange(model.types)
    number = words.number(places)
    assert len(set(number)) == model.types and number.max() == 7 + model.types and np.array_equal(words.place(number), places)


def test_kneser_ney_without_training(odd, none):
    model = kneser_ney.train(none, 0)
    rows = kneser_ney.score_texts(odd.select("doc_id", "text"), model).collect()
    assert len(rows) == 11 and all(r.score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in rows)


# --------------------------------------------------------------------- mixing


def test_mix_targets_and_limits(spark, odd, none):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").unionByName(odd)
    a = mixing.mixed(docs.withColumn("size", F.lit("x")).withColumn("target", F.lit(1)))
    rows = a.collect()
    assert len(rows) == docs.count()
    by, size, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
    want = [mixing.Source(s, size[s], w) for s, w in zip(sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size), [5, 2, 1] * 20)]
    mixing.targets(want, sum(size.values()))
    assert all(math.isclose(target[s.name], s.target) and s.target <= 3 * s.size for s in want)
    assert math.isclose(sum(s.target for s in want), sum(size.values()))
    for s in size:
        assert abs(by[s] - target[s]) <= 0.02 * target[s] + 20
    again = collections.Counter((r.doc_id, r.taken) for r in mixing.mixed(docs).collect())
    assert again == collections.Counter((r.doc_id, r.taken) for r in rows)
    assert mixing.mixed(none).count() == 0


def test_mix_as_documents(odd):
    docs = odd.where("doc_id IN (5, 10)")
    taken = {r.doc_id: r.taken for r in mixing.mixed(docs).collect()}
    got = collections.Counter()
    for r in mixing.repeated(docs).collect():
        got[r.doc_id] += len(split(r.text))
    assert got == collections.Counter({k: v for k, v in taken.items() if v})


# ---------------------------------------------------------------------- media


def test_media_round_trip(spark, odd, none):
    for raw in (b"", b"x", bytes(range(256)) * 3, b" " * 192):
        png = interleaved.to_png(raw)
        samples, n = interleaved.from_png(png)
        assert n == len(raw) and samples == raw + b" " * (len(samples) - n) and len(samples) % 192 == 0 and samples
        with pytest.raises(ValueError):
            interleaved.from_png(png[:40] + bytes([png[40] ^ 1]) + png[41:])
    assert interleaved.features(interleaved.stored(odd.select("text"))).count() == 8  # distinct texts; null is the empty one
    assert interleaved.features(interleaved.stored(none.select("text"))).count() == 0


def test_sequences_keep_order_and_captions(spark):
    digest = "ab" * 32
    html = f"<p>one <b>two</b></p><figure><img src='sha256:{digest}' alt='alt'><figcaption>The  caption</figcaption></figure>after<script>no</script><img src='sha256:{'cd' * 32}' alt='own'>"
    pages = spark.createDataFrame([(1, html, 5), (2, None, 6), (3, "", 7)], "doc_id long, html string, sequence int")
    rows = {r.doc_id: r.sequence for r in interleaved.sequences(pages).collect()}
    assert [(x.position, x.kind, x.text or x.digest[:4], x.caption) for x in rows[1]] == [(0, "text", "one two", None), (1, "media", "abab", "The caption"), (2, "text", "after", None), (3, "media", "cdcd", "own")]
    assert rows[2] == rows[3] == []
    found = spark.createDataFrame([(digest, 1)], "digest string, n_bytes long")
    got = {r.position: (r.n_bytes, r.caption) for r in interleaved.resolved(interleaved.sequences(pages), found).collect()}
    assert got == {1: (1, "The caption"), 3: (None, "own")}


# ----------------------------------------------------------------- near-dedup


def test_near_copies_one_class(spark, odd, none):
    base = prose(20, 200).split()
    rows = [(100 + i, " ".join(base[:i] + ["changed"] + base[i + 1 :]), "en", "z", 1) for i in range(40)] + [(200 + i, prose(300 + i, 150), "en", "z", 1) for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA).unionByName(odd).withColumn("node", F.lit("x")).withColumn("label", F.lit(1))
    got = collections.defaultdict(list)
    for r in near_dedup.classes(docs).collect():
        got[r.doc_id].append(r)
    assert {r.class_id for i in range(100, 140) for r in got[i]} == {100}
    assert all(got[200 + i][0].class_id == 200 + i for i in range(20))
    assert {r.class_id for i in (1, 2, 3) for r in got[i]} == {1} and {r.class_id for i in (5, 6) for r in got[i]} == {5}
    kept = sorted((r.doc_id for r in near_dedup.first_of_classes(docs).collect()), key=str)
    assert kept == sorted([100, *range(200, 220), 1, 4, 5, None, 8, 9, 10], key=str)
    assert near_dedup.classes(none).count() == 0 and near_dedup.first_of_classes(none).count() == 0


def test_no_link_is_lost(spark, monkeypatch):
    """Blocks for every bucket: the classes are the components of all verified pairs that share a bucket."""
    monkeypatch.setattr(near_dedup, "SMALL", 1)
    rng = np.random.default_rng(5)
    base = prose(50, 120).split()
    texts = [" ".join(w if rng.random() > q else f"n{rng.integers(10**6)}" for w in base) for q in (0.01, 0.02, 0.03, 0.04) for _ in range(15)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = near_dedup.document_frequencies(docs)
    w = text.words(pa.array(texts))
    doc, e, weight = near_dedup.weighted(w, idf)[:3]
    keys = near_dedup.bands(doc, e, weight, len(texts))
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (keys[i] == keys[j]).any() and near_dedup.similarities(pa.array([texts[i]]), pa.array([texts[j]]), idf)[0] >= 0.8:
                root[top(i)] = top(j)
    got = collections.defaultdict(set)
    for r in near_dedup.classes(docs).collect():
        got[r.class_id].add(r.doc_id)
    want = collections.defaultdict(set)
    for i in range(len(texts)):
        want[top(i)].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and len(want) > 1


def test_recall_of_all_pairs(spark):
    """Against plain counting: weights, similarities, and the share of all pairs at 0.8 or more that end in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    grams = {}
    for i, t in rows:
        w = t.encode().split()
        grams[i] = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])
    df = collections.Counter(g for c in grams.values() for g in c)
    n = len(rows)
    weight = {i: {g: (1 + math.log(x)) * (1 + math.log((1 + n) / (1 + df[g])) / math.log(2 + n)) for g, x in c.items()} for i, c in grams.items()}
    total = {i: sum(c.values()) for i, c in weight.items()}
    where = collections.defaultdict(list)
    for i, c in weight.items():
        for g in c:
            where[g].append(i)
    common = collections.Counter()
    for g, ids in where.items():
        for a in range(len(ids)):
            for b in range(a):
                common[ids[a], ids[b]] += min(weight[ids[a]][g], weight[ids[b]][g])
    pairs = [(a, b) for (a, b), c in common.items() if c / (total[a] + total[b] - c) >= 0.8]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert len(pairs) > 50 and sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)
    # and no class holds documents that no chain of such pairs joins (0.78: classes of shingles are a little coarse)
    root = {i: i for i, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in common.items():
        if c / (total[a] + total[b] - c) >= 0.78:
            root[top(a)] = top(b)
    assert all(top(i) == top(k) for i, k in got.items() if grams[i])


def test_hot_keys_join_whole(spark):
    rows = spark.range(1000).selectExpr("CASE WHEN id < 700 THEN 0 ELSE id END AS k", "id AS v")
    each = rows.groupBy("k").count().withColumn("w", F.col("k") * 2)
    assert sorted(near_dedup.spread(rows, each, "k", "count", 4096 * 10).collect()) == sorted(rows.join(each, "k").collect())


def test_equal_digests_of_unequal_texts_are_parted(spark, monkeypatch):
    real = near_dedup.signatures
    monkeypatch.setattr(near_dedup, "signatures", lambda d, idf: real(d, idf).withColumn("node", F.lit(7).cast("long")))
    docs = spark.createDataFrame([(1, prose(1, 90)), (2, prose(2, 90)), (3, prose(1, 90))], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_dedup.classes(docs).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2)}


def test_block_similarities_equal_pairs():
    texts = [prose(i % 3, 60) + f" x{i} the the the the the the" for i in range(12)] + ["", "one two"]
    idf = np.linspace(1, 3, 1 << near_dedup.CLASSES).astype(np.float32)
    asks = np.arange(len(texts)) % 2 == 0
    s, q = near_dedup._between(pa.array(texts), asks, idf)
    m = np.flatnonzero(~asks)
    for i, a in enumerate(q):
        want = near_dedup.similarities(pa.array([texts[a]] * len(m)), pa.array([texts[b] for b in m]), idf)
        assert np.allclose(s[i], want, atol=1e-5)


# ----------------------------------------------------------------- extraction


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, you know.</p></div>
<div id="content"><h2>Title &amp; more</h2><p>First   paragraph, with <b>bold</b> text&nbsp;and <a href="#">a link</a>.<p>Second one; unclosed.<br>Line.</div>
<aside><p>Side text, quite long. It has marks, too.</p></aside><section class="comments"><p>Nice post! I agree, really.</p></section><form><label>Mail</label></form>
<div class="ad">Buy now, cheap.</div><footer>&copy; us</footer></body></html>"""


def test_extraction(spark):
    assert tag_paths.extract(PAGE) == "Title & more First paragraph, with bold text and a link. Second one; unclosed. Line."
    pages = spark.createDataFrame([(1, "u", PAGE, "mine"), (2, None, None, "mine"), (3, "u", "", "mine"), (4, "u", "<nav>only menu</nav>", "mine"), (5, "u", "plain &lt;text", "mine"), (6, "u", "<p>" + "word, " * 50_000, "mine")], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in tag_paths.extracted(pages).collect()}
    assert got[2] == got[3] == got[4] == ("", 0) and got[5] == ("plain <text", 11) and got[6][1] == 50_000 * 6 - 1
    assert tag_paths.extracted(pages.limit(0)).count() == 0


@pytest.mark.parametrize("box", ["div", "blockquote", "section", "ul", "table"])
def test_extraction_keeps_what_lies_around_a_large_part(box):
    lead, end, most = "A lead, with enough words.", "The end, with enough words.", "Most of the text, here. " * 10
    inner = {"ul": f"<li>{most}</li>", "table": f"<tr><td>{most}</td></tr>"}.get(box, f"<p>{most}</p>")
    page = f"<body><nav>menu</nav><article><h1>The title</h1><p>{lead}</p><{box}>{inner}</{box}><p>{end}</p></article><footer>us</footer></body>"
    assert len(most) > 0.75 * len(most + lead + end)
    assert tag_paths.extract(page) == f"The title {lead} {most}{end}"


ARTICLE = "<h1>The title</h1>" + "".join(f"<p>This is paragraph {i}, with several words and marks, and it goes on for a while.</p>" for i in range(12))


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "related-work", "social-science", "search-results", "menu-page", "site-content"])
def test_a_name_is_outweighed_by_the_text(name):
    page = f'<body><nav><a href=/>Home</a></nav><div class="{name}">{ARTICLE}</div><div class="sidebar"><p>Short thing here.</p></div><footer>us</footer></body>'
    want = tag_paths.extract(f"<article>{ARTICLE}</article>")
    assert tag_paths.extract(page) == want and len(want) > 900
    # beside an article a part of that name goes, however long
    assert tag_paths.extract(f'<body><article>{ARTICLE}</article><div class="{name}">{ARTICLE * 3}</div></body>').startswith(want)


def test_long_comments_go():
    said = "".join(f"<div class=comment><p>I say {i} that this comment is very long, longer than it should be, on and on.</p></div>" for i in range(40))
    assert "comment" not in tag_paths.extract(f"<body><div>{ARTICLE}</div><div id=comments>{said}</div></body>")


def test_the_threshold_decides(monkeypatch):
    page = f"<body><div><a href=1>One</a> <a href=2>Two</a></div><div>Buy now</div>{ARTICLE}<div><a>x</a><a>y</a></div><div>Imprint</div></body>"
    got = tag_paths.extract(page)
    assert got.startswith("The title This") and got.endswith("for a while.")
    monkeypatch.setattr(tag_paths, "THRESHOLD", 0)
    assert "Imprint" in tag_paths.extract(page)


@pytest.mark.parametrize("html", ["<p>a &#" + "9" * 5000 + "; b", "<a " * 350_000, '<a ">" ' * 150_000, "<div>" * 200_000 + "text" + "</div>" * 200_000, "<div>" * 400 + "</span></b>" * 100_000 + "x", "<script>x" + "</script " * 100_000, "<b><i>" * 50_000 + "</b>" * 50_000])
def test_hard_pages_take_linear_time(html):
    began = time.perf_counter()
    tag_paths.extract(html)
    interleaved.parse(html)
    assert time.perf_counter() - began < 10


def test_references_decode_as_in_browsers():
    assert tag_paths.extract("<p>a &#" + "9" * 5000 + "; b &#" + "0" * 5000 + "65; &eacute;&amp c &#x110000; &#x41;") == "a � b A é& c � A"


def test_every_reference_keeps_its_place(spark):
    html = '<p>One</p><img src="https://x/y.png" alt="a &amp; b"><figure><video src=\'sha256:' + "a" * 64 + "'></video><figcaption>Cap</figcaption></figure><p>Two"
    got = interleaved.parse(html)
    assert [(x["position"], x["kind"], x["text"], x["url"] and x["url"][:8], x["caption"]) for x in got] == [(0, "text", "One", None, None), (1, "media", None, "https://", "a & b"), (2, "media", None, "sha256:a", "Cap"), (3, "text", "Two", None, None)]
    pages = spark.createDataFrame([(1, html, "mine", "mine", "mine")], "page_id long, html string, digest string, position string, _at string")
    found = interleaved.features(interleaved.stored(spark.createDataFrame([("x",)], "text string"))).withColumn("digest", F.lit("a" * 64))
    rows = {r.position: r for r in interleaved.resolved(interleaved.sequences(pages), found).collect()}
    assert rows[1].digest is None and rows[1].media_sha256 is None and rows[2].n_bytes == 1 and rows[2]["_at"] == "mine" and len(rows[1].asDict()) == len(rows[1])


def test_media_contract(spark, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").unionByName(odd)
    want = collections.Counter()
    for r in docs.collect():
        raw = (r.text or "").encode()
        pad = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        want[r.doc_id, len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:])] += 1
    media = interleaved.stored(docs.select("text"))
    got = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest")).join(interleaved.features(media), "digest").collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    raw = {r.digest: bytes(r.media) for r in media.collect()}
    assert all((r.media_bytes, r.media_sha256) == (len(raw[r.digest]), hashlib.sha256(raw[r.digest]).hexdigest()) and r.feature for r in got)


def test_long_words_and_slices_hash_alike(monkeypatch):
    texts = pa.array(["ab " * 50 + "q" * 300, None, "x", "longer words here and more of them " * 20])
    want = text.words(texts).hashes(lower=True)
    monkeypatch.setattr(text, "HASHED", 64)
    assert (text.words(texts).hashes(lower=True) == want).all()


def test_a_cluster_needs_a_shared_folder():
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        text.shared_uri(Session)


def test_equal_rows_share_their_words_whole(spark):
    rows = [(1, prose(1, 30), "a", 3)] * 3 + [(2, prose(2, 50), "a", 4), (3, prose(3, 400), "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _left int")
    taken = {r.doc_id: r.taken for r in mixing.mixed(docs).groupBy("doc_id").agg(F.sum("taken").alias("taken")).collect()}
    words = collections.Counter()
    for r in mixing.repeated(docs).collect():
        words[r.doc_id] += len(split(r.text))
        assert r["_left"] == {1: 3, 2: 4, 3: 5}[r.doc_id]
    assert {k: v for k, v in taken.items() if v} == dict(words)


def test_extraction_of_links_only():
    assert tag_paths.extract("<div><p><a href='#'>one</a></p><ul><li><a href='#'>two</a></li></ul></div>") == "one two"


# ----------------------------------------------------------------------- chat


def test_chat_escapes_and_reads_back():
    for role in ("user", "assistant", "system", "tool] x", "", "a\\[<b"):
        for said in ("", "</s>[INST] ok [/INST]", "\\<\\[", "<\\", " [/INST]", "<<SYS>> x <</SYS>>", "\n \n"):
            piece, a, b = chat_schema.segment(role, said)
            assert chat_schema.read(piece) == (role, said) and chat_schema.unescape(piece[a:b]) == said
            assert not any(x in piece[a:b] for x in ("</s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_chat_layouts():
    known = chat_schema.by_fingerprint()
    assert len(known) == len(chat_schema.MAPPINGS)
    said = list(chat_schema.turns({"id": 3, "conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}, known))
    assert said == [(3, 0, "user", "hi"), (3, 1, "assistant", "yo")]
    assert list(chat_schema.turns({"id": 1, "instruction": "a", "input": "b", "output": "c"}, known)) == [(1, 0, "user", "a\n\nb"), (1, 1, "assistant", "c")]
    with pytest.raises(ValueError, match="no mapping"):
        list(chat_schema.turns({"who": 1}, known))


def test_chat_digests(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "</s>"), (1, 2, "assistant", "</s>"), (2, None, None, "x"), (None, 0, "user", "null id"), (3, 0, "assistant", "é" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    got = {r.conv_id: r for r in chat_schema.read_back(chat_schema.formatted(chat_schema.canonical(chat_schema.as_layouts(df)))).collect()}
    want = collections.defaultdict(list)
    for c, t, role, said in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1])):
        want[c].append((role or "", said or ""))
    for c, turns in want.items():
        loss = "".join(s for r, s in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{s}\n" for r, s in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert len(got) == len(want)


# ------------------------------------------------------------------- toxicity


def test_toxicity_learns_from_the_later_pieces_of_long_tokens():
    r = np.random.default_rng(5)
    letters = list("bcdfghjklmnpqrstvwxz")
    lead = lambda: "".join(r.choice(letters, 24))
    other = lambda: "".join(r.choice(letters, 11))
    sample = [(" ".join([lead() + other() for _ in range(20)] + [lead() + "grumblewort"] * y), y) for y in [0, 1] * 60]
    model = toxicity.fit(sample)
    bad, good = (pa.array([lead() + end() for _ in range(20)]) for end in (lambda: "grumblewort", other))
    scorer = toxicity.Scorer(model)
    assert scorer.top(bad)[0].min() > 0 > scorer.top(good)[0].max()


# ------------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    assert [f.__module__.rsplit(".", 1)[1] for _, f in corpus_pipeline.STAGES] == ["toxicity", "compression_quality", "near_dedup", "mixing", "bpe_chunks"]
    docs = text.documents(spark, DATA)
    labels_ = {r.doc_id: r for r in text.table(spark, DATA, "labels").collect()}
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = text.written(stage(spark, docs, DATA), "test")
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "toxicity":
            assert sum(labels_[i].toxic for i in ids if i in labels_) <= 0.4 * sum(x.toxic for x in labels_.values())
        if name == "MinHash near-dedup":
            assert out.count() == len(ids) == out.select("text").distinct().count()
        sizes.append(out.count())
        docs = out
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] > 0 and set(docs.columns) >= {"n_tokens", "ids_sha256", "decoded_sha256"}


def test_pipeline_on_an_empty_table(spark, tmp_path):
    d = str(tmp_path)
    for t in os.listdir(DATA):
        spark.read.parquet(f"{DATA}/{t}").limit(0).write.parquet(f"{d}/{t}")
    assert corpus_pipeline.run(spark, d).count() == 0
    for name, q in QUERIES.items():
        assert q(spark, d).count() == (1 if name in ("op9_chat_schema", "chat_turns") else 0)  # conversation -1


# ------------------------------------------------------------------------ SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_parts_that_sql_can_say(spark, name):
    import glob

    import duckdb

    db = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    plain = lambda row: tuple(round(x, 6) if isinstance(x, float) else x for x in row)
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rel = db.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    want = sorted((plain(r) for r in rel.select(*(duckdb.ColumnExpression(c) for c in cols)).fetchall()), key=repr)
    assert sorted((plain(r) for r in df.select(*cols).collect()), key=repr) == want and want


def test_ngrams_are_looked_up_once(spark, monkeypatch):
    """A phrase that is repeated asks the arrays of each order for its contexts and n-grams once, and scores as before."""
    texts = ["a b c " * 40, "c b a", "a b c"]
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in texts], "text string"), 200)
    asked, plain = [], kneser_ney.look_up
    monkeypatch.setattr(kneser_ney, "look_up", lambda arrays, k, usual: asked.append(k) or plain(arrays, k, usual))
    got = kneser_ney.Scorer(model).score(pa.array(texts))
    assert all(len(np.unique(k)) == len(k) for k in asked)
    alone = [kneser_ney.Scorer(model).score(pa.array([t]))["score"][0] for t in texts]
    assert np.allclose(got["score"], alone, rtol=1e-12)
