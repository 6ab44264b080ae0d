"""From ``documents`` to training tokens: five stages, each by an operator of ``deltaloom.llm``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm import bpe, decontaminate, language, secrets, simhash
from deltaloom.llm.frames import dealt, tabled

#: Posterior that a language must reach.
LEAST_SCORE = 0.5
#: Near duplicates: words of a shingle; least similarity of two texts' sets of shingles.
SHINGLE, ALIKE = 5, 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language: null, without a letter, or with no language over LEAST_SCORE."""
    found = language.identify(docs, language.train(docs), keep=docs.columns)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates keep one document, that of the smallest id; ids that repeat or are missing are told apart by their texts."""
    return simhash.drop_similar(docs, shingle=SHINGLE, least=ALIKE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that a benchmark item leaks into."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_leaks(docs, items).filter(F.size("leaks") == 0).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark; ``n_chars`` follows the text."""
    clean = secrets.redact_secrets(docs)
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number, and digests of ids and decoded texts, with each document's id, language and source."""
    return bpe.digest(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id", "lang", "source"], with_ids=True)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("bpe", encode)]

#: Learned language trees, links of similar texts and BPE have no SQL; tests/llm/test_pipeline.py holds the whole run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents``."""
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else tabled(docs), sf_dir)
    return docs
