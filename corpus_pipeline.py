"""The corpus pipeline: filter, deduplicate, decontaminate and encode ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept
and returns a DataFrame; ``run`` writes every stage as Parquet into the shared
folder and hands the table, read again, to the next.  All stages but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from geoquarry.llm import bpe, decontam, exact_dedup, minhash, toxicity
from geoquarry.llm.words import id_bucket
from geoquarry.plans.staging import Staging
from geoquarry.sources.tables import table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.7 or more go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), id_bucket(3) != 1)
    return toxicity.keep_clean(docs, model, 0.7)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays, then the smallest doc_id."""
    return exact_dedup.keep_one(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (5-word shingles, 0.8) the smallest doc_id stays."""
    return minhash.keep_one(docs, k=5, threshold=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item, or a whole shorter item, go."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian u32), ids_sha256, decoded_sha256 of what is left."""
    return bpe.encode_documents(spark, docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: Training, MinHash and BPE have no SQL form; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    staging = Staging(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staging.cut(stage(spark, docs, sf_dir), name)
    return docs
