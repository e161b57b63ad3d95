"""A corpus pipeline: five stages over `documents`, each written as Parquet and read back as the next one's documents."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import byte_bpe, minhash, mixing, rule_ensemble, toxicity
from larkspur.llm.common import free_name, save, shared_dir, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is rejected go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "toxic")
    return toxicity.scored(docs, model, into=score).filter(F.col(score) < toxicity.REJECT).select(*docs.columns)


def quality_in(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is accepted stay."""
    model = rule_ensemble.fit(rule_ensemble.training_rows(docs, table(spark, sf_dir, "labels")))
    score = free_name(docs, "quality")
    return rule_ensemble.scored(docs, model, into=score).filter(F.col(score) >= rule_ensemble.ACCEPT).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more."""
    return minhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources have their target weights; copies are rows of their own."""
    return mixing.mix(docs, mixing.source_rates(docs)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the ids of each whole text, and the SHA-256 of the bytes that they decode to."""
    path = public_tokenizers.path(RANKS)
    encoded = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN).drop("text")
    decoded = byte_bpe.decode(encoded.withColumn("again", F.col("ids")), path, "again")
    return decoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxic_out),
    ("quality_classifier", quality_in),
    ("near_dedup", near_dedup),
    ("mix_sources", mixed),
    ("byte_bpe", tokens),
]
#: SQL can't express the fitted stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir.

    Null and empty texts, repeated rows and null keys are documents like any other; which of them a stage keeps is what its
    operator's docstring says. An empty table goes through all stages. Columns beside those of documents come along up to
    the last stage, whatever their names.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        save(stage(spark, docs, sf_dir), f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
