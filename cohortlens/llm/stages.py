"""Stages of the corpus pipeline: each takes and, but for the last, returns documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, jaccard, language, packing, secrets


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model does not reject; a missing language is filled in."""
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))).select("lang", "text"))
    known = language.identify(docs, model).where("NOT rejected")
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).drop("lang_pred", "score", "rejected")


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least id."""
    return jaccard.keep_first(docs)


def keep_clear_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_items(docs, benchmark).where(F.size("matches") == 0).drop("matches")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mask."""
    masked = secrets.redact(secrets.scan_secrets(docs)).drop("secret_spans")
    return masked.withColumn("n_chars", F.length("text").cast("bigint"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in training sequences."""
    return packing.pack(docs.select("doc_id", "text", "lang", "source"))
