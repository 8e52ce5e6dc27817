"""A training-data pipeline: five stages from ``documents`` to token ids.

Every stage is a function of (spark, docs, sf_dir); its result is written as
Parquet in the shared folder and read again as the next stage's documents.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from licet.llm import bpe_chunks, compression_quality, mixing, near_dedup, text, toxicity

STAGES = [
    ("toxicity", toxicity.keep_civil),
    ("quality classifier", compression_quality.keep_good),
    ("MinHash near-dedup", near_dedup.keep_first),
    ("mixing sources to target weights", mixing.mixed_stage),
    ("BPE encoding and decoding", bpe_chunks.encoded_stage),
]

#: Fitted scores, near-duplicate classes and token ids cannot be said in SQL.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    docs = text.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = text.written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
