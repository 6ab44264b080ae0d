"""Queries of the training-data operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm import bpe, decontaminate, language, licenses, media, secrets, sharding, simhash, substrings, tokens
from deltaloom.llm.frames import dealt


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: Bytes of text that a shard of op1 may hold.
SHARD_BYTES = 1 << 20


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, shard, local_depth, shard_bytes, shard_rows of every document."""
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), ["doc_id"], SHARD_BYTES, keep=["doc_id"])


OP1_SQL = f"""
WITH d AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h, coalesce(strlen(text), 0) AS b FROM documents),
     sums AS (SELECT k AS depth, h >> (32 - k) AS at, sum(b) AS bytes, count(*) AS n FROM d, range(0, 33) r(k) GROUP BY ALL),
     leaf AS (SELECT d.doc_id, d.h, min(s.depth) AS depth FROM d JOIN sums s ON s.at = d.h >> (32 - s.depth) AND (s.bytes <= {SHARD_BYTES} OR s.depth = 32) GROUP BY ALL)
SELECT doc_id, CASE WHEN leaf.depth = 0 THEN '' ELSE lpad(bin(h >> (32 - leaf.depth)), CAST(leaf.depth AS INTEGER), '0') END AS shard,
       CAST(leaf.depth AS BIGINT) AS local_depth, CAST(s.bytes AS BIGINT) AS shard_bytes, CAST(s.n AS BIGINT) AS shard_rows
FROM leaf JOIN sums s ON s.depth = leaf.depth AND s.at = h >> (32 - leaf.depth)
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, edits, first_word of every benchmark item that leaks into a document."""
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontaminate.leak_rows(decontaminate.find_leaks(docs.select("doc_id", "text"), items, keep=["doc_id"]), ["doc_id"])


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document, without repeats of 20 words."""
    return substrings.dedup_substrings(_table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     w AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d)),
     later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
     gone AS (SELECT doc_id, list_sort(list_distinct(flatten(list(range(i, i + 20))))) AS g FROM later GROUP BY doc_id),
     kept AS (SELECT d.doc_id, len(ws) AS n, coalesce(len(g), 0) AS r, CASE WHEN g IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(g, i)) END AS k FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as baseline JPEG and read back: sizes, digests and the thumbnail's hash."""
    return media.media_columns(_table(spark, sf_dir, "documents"), keep=["doc_id"], with_media=False)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from those that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text", language.held_out().alias("held_out")), language.train(docs), keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, base phrases, labels and score of every document."""
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("spans")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document under byte_bpe_50k.json."""
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document under word_bpe_49k.json."""
    return bpe.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in every document."""
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of this subpackage, by name."""
    return {f.__name__: f for f in (op1_sharding, op2_decontamination, op3_substring_dedup, op4_simhash_near_dedup, op5_media_columns, op6_language_id, op7_license_scan, op8_token_counts, op9_bpe_codec, op10_secret_scan)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those queries that SQL can express."""
    return {"op1_sharding": OP1_SQL, "op3_substring_dedup": OP3_SQL}
