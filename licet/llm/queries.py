"""The queries of this subpackage, by name, and SQL for what SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe_chunks, chat_schema, compression_quality, interleaved, kneser_ney, mixing, near_dedup, rules_quality, tag_paths, toxicity

QUERIES = {
    "op1_compression_quality": compression_quality.op1,
    "op2_weak_rules": rules_quality.op2,
    "op3_bpe_chunks": bpe_chunks.op3,
    "op4_kneser_ney": kneser_ney.op4,
    "op5_low_discrepancy_mix": mixing.op5,
    "op6_interleaved_media": interleaved.op6,
    "op7_weighted_minhash": near_dedup.op7,
    "op8_tag_path_ratios": tag_paths.op8,
    "op9_chat_schema": chat_schema.op9,
    "op10_string_kernel": toxicity.op10,
}

#: The ten results are scores of fitted models, digests of library output or parts
#: of parsed text, which SQL cannot say: tests hold them against brute force.  The
#: queries below are those of their columns that it can.
ORACLE_SQL: dict[str, str] = {}

_WORD = r"[^\x20\x09-\x0D]+"
_WORDS = f"(SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents)"


def _part(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


@_part("rules_base_measures", f"""WITH d AS (SELECT row_number() OVER () AS k, * FROM {_WORDS}),
l AS (SELECT k, count(*) - count(DISTINCT line) AS n FROM (SELECT k, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}') GROUP BY k),
x AS (SELECT k, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
r AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY k, s) AS c FROM x) WHERE c > 1) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
len(w) < 20 OR 100 * coalesce(r.n, 0) > 30 * len(w) AS base_failed FROM d LEFT JOIN l USING (k) LEFT JOIN r USING (k)""")
def rules_base_measures(spark, d):
    return rules_quality.op2(spark, d).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


@_part("mix_sizes", f"SELECT doc_id, CAST(len(w) AS BIGINT) AS size, CAST(sum(len(w)) OVER (PARTITION BY source) AS BIGINT) AS source_size FROM (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents)")
def mix_sizes(spark, d):
    return mixing.op5(spark, d).select("doc_id", "size", "source_size")


_CRC = "(4294967295 - list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))))"


@_part("ngram_base_scores", f"""WITH t AS (SELECT row_number() OVER () AS k, doc_id, {_CRC} % 7 = 2 AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}'), chr(10)) AS w FROM documents),
o AS (SELECT k, held_out, unnest(w) AS x FROM t), c AS (SELECT x, count(*) AS c FROM o WHERE NOT held_out GROUP BY x), n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c),
s AS (SELECT k, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 1) / CAST(n + v + 1 AS DOUBLE))) AS base FROM o LEFT JOIN c USING (x), n GROUP BY k)
SELECT doc_id, held_out, n_tokens, n_known, (SELECT n FROM n) AS train_tokens, round(base, 3) AS base_score FROM t JOIN s USING (k)""")
def ngram_base_scores(spark, d):
    return kneser_ney.op4(spark, d).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


@_part("chat_turns", """SELECT conv_id, count(*) AS n_turns, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars FROM conversations GROUP BY conv_id
UNION ALL SELECT -1, 2, length('</s>[INST] ok [/INST]')""")
def chat_turns(spark, d):
    return chat_schema.op9(spark, d).select("conv_id", "n_turns", "loss_chars")
