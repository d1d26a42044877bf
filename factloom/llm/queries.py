"""The registered query of each operator: production parameters, whole tables, full results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, licenses, media, mixing, neighbours, oracles, periods, pieces, quality, scoring, scratch, secrets, simhash, suffixdedup, tokenfile


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    """Where a public tokenizer's file is; only the two queries that use one need the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.deduplicate(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(_table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", mixing.taken_words().alias("taken"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.filter("kept").select("doc_id", "log_ratio", "n_grams", "log_weight", "key")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    words, labels = F.col("base.word"), F.col("base.label")
    joined = lambda names: F.array_join(F.array_sort(F.array_distinct(names)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        joined(labels).alias("base_labels"),
        joined(F.concat(labels, F.col("spans.label"))).alias("labels"),
        "score",
    )


def op5_pieces(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids, and whether decoding the ids restores the text."""
    return pieces.encode(_table(spark, sf_dir, "documents"), model or _vocabulary("piece_bpe_32k.model"), check=True)


def op6_token_file(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = f"{scratch.shared_folder(spark)}/factloom-tokens-{uuid.uuid4().hex}"
    scratch.keep_until_release(spark, path)
    tokenfile.write(_table(spark, sf_dir, "documents"), path, tokenizer or _vocabulary("byte_bpe_50k.json"))
    return tokenfile.read_checksums(spark, path)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_lm_scores(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return scoring.score(_table(spark, sf_dir, "documents"), model or _vocabulary("piece_bpe_32k.model"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.periodic_runs(_table(spark, sf_dir, "documents"), plant=True)


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_mixing": op2_mixing,
    "op3_quality": op3_quality,
    "op4_licenses": op4_licenses,
    "op5_pieces": op5_pieces,
    "op6_token_file": op6_token_file,
    "op7_media": op7_media,
    "op8_secrets": op8_secrets,
    "op9_neighbours": op9_neighbours,
    "op10_simhash": op10_simhash,
    "op11_collocations": op11_collocations,
    "op12_lm_scores": op12_lm_scores,
    "op13_periodic_runs": op13_periodic_runs,
}

#: Where SQL can express the query; the others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {"op2_mixing": oracles.OP2_MIXING, "op11_collocations": oracles.OP11_COLLOCATIONS}
