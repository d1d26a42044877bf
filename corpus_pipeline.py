"""A training-data pipeline: each stage calls an operator on all that the stage before it kept.

quality classifier -> near-duplicate removal -> secret redaction -> source mixing -> piece ids.
Stages take (spark, docs, sf_dir) and return the columns of documents; the last returns the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import mixing, pieces, quality, secrets, simhash
from factloom.llm.scratch import materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps; rejected ones go."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, whole or in blocks of words, as the sources' targets ask."""
    return mixing.apply_plan(docs, mixing.plan(docs))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_pieces, ids of every document of the mix."""
    import public_tokenizers

    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "source"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("piece_ids", piece_ids),
]

#: Seeded sampling, bit-sliced links and piece merges have no SQL form: tests/llm/test_pipeline.py has a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
