"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlens.llm import bpe, exact, langid, licenses, mixing, near, quality, secrets, substring, vectors

#: Folder of the public tokenizer files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = secrets.Words.load(f"{TOKENIZERS}/word_bpe_49k.json")
    # a few thousand rows in one partition: the forest is then the same on a cluster of any size
    model = secrets.train(secrets.labelled_findings(spark).coalesce(1), words)
    return secrets.scan(table(spark, sf_dir, "documents"), model, words)  # documents have no paths


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(table(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out().alias("held_out"))
    model = langid.train(docs.where("not held_out").select("text", "lang", F.col("doc_id").alias("key")), f"{TOKENIZERS}/piece_bpe_32k.model")
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "language.lang_pred", "language.score")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.dedup(table(spark, sf_dir, "documents"), percent=85)


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.dedup(table(spark, sf_dir, "embeddings"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": """
            WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS h FROM documents)
            SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
                   doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
            FROM d""",
        "op9_licenses": licenses.oracle_sql(licenses.rules()),
    }
