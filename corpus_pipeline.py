"""From raw documents to packed training sequences, in stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import stages
from cohortlens.session import written

STAGES = [
    ("language_id", stages.keep_known_languages),
    ("jaccard_join", stages.keep_one_of_similar),
    ("decontamination", stages.keep_clear_of_benchmark),
    ("secret_scan", stages.redact_secrets),
    ("packing", stages.pack_sequences),
]
#: The stages fit a model, join by similarity and search with edits: no SQL says that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole of documents; each stage is
    written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
