"""Quality rules under weak supervision.

Every rule looks at one measure of a text and votes good (1), bad (-1) or
abstains (0).  Expectation-maximisation over the counts of *all* documents'
vote patterns estimates how each rule votes on good texts and on each kind of
bad ones, and the share of good ones, without labels; a text's posterior probability of quality
then replaces a filter that wants all rules to pass.  The counts of patterns
are an ordinary aggregate with at most ``3 ** len(RULES)`` rows, which bounds
what the driver receives.

Cases: null and empty texts have zero measures (and fail the base rule, having
under 20 words); an empty table gives an empty result.  Extra columns pass
through :func:`measured` and :func:`judged`; columns of the same names as
theirs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

MEASURES = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "n_lines": "long", "n_upper": "long", "n_letters": "long", "n_bare": "long", "n_ends": "long",
}
#: name: (share, good if in this range, bad if outside that range); nothing to divide by: abstain.
RULES: dict[str, tuple[str, tuple[float, float], tuple[float, float]]] = {
    "length": ("n_words / 1.0", (40, 1e18), (20, 1e18)),
    "repeats": ("n_repeat_words / n_words", (-1, 0.05), (-1, 0.2)),
    "symbols": ("n_symbols / n_words", (-1, 0.03), (-1, 0.2)),
    "lines": ("n_dup_lines / n_lines", (-1, 0.05), (-1, 0.3)),
    "capitals": ("n_upper / n_letters", (0.002, 0.12), (-1, 0.4)),
    "word length": ("word_chars / n_words", (3, 9), (2.2, 14)),
    "bare symbols": ("n_bare / n_words", (-1, 0.02), (-1, 0.1)),
    "sentences": ("n_ends / n_words", (0.01, 0.4), (0.001, 0.6)),
}
#: The kinds of faults, and the rules that tell them.
FAULTS = {"repetition": ("repeats", "lines"), "symbols": ("symbols", "bare symbols"), "shouting": ("capitals", "sentences"), "odd words": ("word length",)}
#: A vote's probability is kept off 0 and 1 by so many imagined documents for each vote.
SMOOTH = 1.0
WINDOW = 8

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_MORE = np.arange(256) & 0xC0 == 0x80
_PLAIN = _LETTER.copy()
_PLAIN[48:58] = True
_PLAIN[128:] = True
_END = np.zeros(256, dtype=bool)
_END[list(b".!?")] = True


def _per_doc(hit: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
    return np.diff(run[offsets])


def repeated_words(h: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per document, words in windows of ``window`` words that it has twice or more."""
    n, docs = len(h), len(first) - 1
    if n < window:
        return np.zeros(docs, dtype=np.int64)
    doc = np.repeat(np.arange(docs, dtype=np.uint64), np.diff(first))
    last = n - window + 1
    key = np.zeros(last, dtype=np.uint64)
    for j in range(window):
        key = text.mix(key + h[j : j + last] * np.uint64(0x9E3779B97F4A7C15))
    key = text.mix(key ^ (doc[:last] * np.uint64(0xD6E8FEB86659FD93)))
    whole = np.flatnonzero(doc[:last] == doc[window - 1 :])
    if not len(whole):
        return np.zeros(docs, dtype=np.int64)
    order = np.argsort(key[whole])
    k = key[whole][order]
    same = k[1:] == k[:-1]
    twice = np.zeros(len(whole), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = whole[twice]
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return _per_doc(np.cumsum(edge[:-1]) > 0, first)


def measures(column: pa.Array) -> dict[str, np.ndarray]:
    w = text.words(column)
    data, off = w.data, w.offsets
    inside = ~text.SPACE[data]
    plain = np.concatenate([[0], np.cumsum(_PLAIN[data], dtype=np.int64)])
    raw = data.tobytes()
    repeated, lines = np.zeros(len(off) - 1, np.int64), np.zeros(len(off) - 1, np.int64)
    for i in range(len(off) - 1):
        seen: set[bytes] = set()
        for line in raw[off[i] : off[i + 1]].split(b"\n"):
            if line in seen:
                repeated[i] += 1
                lines[i] += 1
            elif line.split(None, 1):
                seen.add(line)
                lines[i] += 1
    return {
        "n_words": w.counts(),
        "word_chars": _per_doc(inside & ~_MORE[data], off),
        "n_symbols": _per_doc(_SYMBOL[data], off),
        "n_dup_lines": repeated,
        "n_repeat_words": repeated_words(w.hashes(), w.first),
        "n_lines": lines,
        "n_upper": _per_doc(_UPPER[data], off),
        "n_letters": _per_doc(_LETTER[data], off),
        "n_bare": _per_doc(plain[w.end] == plain[w.start], w.first),
        "n_ends": _per_doc(_END[data[w.end - 1]], w.first),
    }


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the measures of the column ``text``."""
    text.ready(docs.sparkSession)
    docs = docs.drop(*MEASURES)
    # the text goes to Python beside the columns that are kept, and stays there
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.steps(batch):
                got = measures(part.column(part.schema.get_field_index("text")))
                yield text.extended(part.select(kept), **{c: got[c].astype(np.int64) for c in MEASURES})

    return docs.mapInArrow(run, text.plus(docs.select(*kept).schema, **MEASURES))


def votes(rules=RULES) -> dict[str, Column]:
    """Each rule's vote, from the measures."""

    def vote(share: str, good: tuple[float, float], bad: tuple[float, float]) -> Column:
        over, under = share.split(" / ")
        x = F.col(over) / (F.lit(float(under)) if under == "1.0" else F.nullif(F.col(under), F.lit(0)))
        return F.when((x >= good[0]) & (x <= good[1]), 1).when((x < bad[0]) | (x > bad[1]), -1).otherwise(0)

    return {name: vote(*rule) for name, rule in rules.items()}


def estimate(patterns: np.ndarray, counts: np.ndarray, rules=RULES, faults=FAULTS, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """EM for a good class and one bad class per kind of fault, in which the
    rules vote independently (faulty texts mostly have one kind of fault, so a
    single bad class would not have independent votes).

    Returns each class's share and, per class (good first), rule and vote
    (-1, 0, 1), the probability of the vote when the rule votes (abstaining: 1).  It starts from the rules' bad
    votes: those of a kind make its class, texts without any the good one.
    """
    names = list(rules)
    kinds = [[names.index(r) for r in rs if r in names] for rs in faults.values()]
    k = 1 + len(kinds)
    if not len(patterns):
        return np.full(k, 1 / k), np.ones((k, len(names), 3))
    hot = (patterns[:, :, None] == np.array([-1, 0, 1])).astype(float)
    q = np.full((len(patterns), k), 1e-3)
    for g, rs in enumerate(kinds, 1):
        q[:, g] += (patterns[:, rs] == -1).sum(1)
    q[:, 0] += np.where(q[:, 1:].sum(1) < 0.5, 1.0, 0.2)
    q /= q.sum(1, keepdims=True)
    for _ in range(rounds):
        each = counts[:, None] * q
        share = (each.sum(0) + SMOOTH) / (counts.sum() + k * SMOOTH)
        table = np.einsum("pc,pjv->cjv", each, hot) + SMOOTH / 3
        table[:, :, 1] = 0
        table /= table.sum(2, keepdims=True)
        table[:, :, 1] = 1  # abstaining says nothing
        z = np.einsum("pjv,cjv->pc", hot, np.log(table)) + np.log(share)
        new = np.exp(z - z.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        moved, q = float(np.abs(new - q).max()), new
        if moved < 1e-9:
            break
    return share, table


def judged(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs``' measures with ``base_failed``, ``posterior`` and ``kept``."""
    got = text.written(measured(docs), "measures").select("*", *(v.alias(f"_vote {k}") for k, v in votes(rules).items()))
    names = [f"_vote {k}" for k in rules]
    rows = got.groupBy(*names).count().collect()  # 3 ** rules rows at most
    share, table = estimate(np.array([[r[n] for n in names] for r in rows]).reshape(len(rows), len(names)), np.array([r["count"] for r in rows], dtype=float), rules)
    log = np.log(table)
    # log odds of each bad class against the good one
    odds = []
    for c in range(1, len(share)):
        z = F.lit(float(np.log(share[c] / share[0])))
        for j, n in enumerate(names):
            step = log[c, j] - log[0, j]
            z += F.when(F.col(n) == -1, float(step[0])).when(F.col(n) == 1, float(step[2])).otherwise(float(step[1]))
        odds.append(F.exp(F.least(z, F.lit(700.0))))
    posterior = 1 / (1 + sum(odds, F.lit(0.0)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = got.withColumn("base_failed", failed).withColumn("posterior", posterior)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)).drop(*names)


def op2(spark, sf_dir: str) -> DataFrame:
    out = judged(text.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "posterior", "kept")
