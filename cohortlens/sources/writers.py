"""Result sinks: Parquet snapshots and CSV reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import col


def save_snapshot(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Parquet snapshot, partitioned by instrument or period where given."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def save_tables(tables: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """One snapshot per table under a folder."""
    return {name: save_snapshot(df, f"{folder}/{name}") for name, df in tables.items()}


def save_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> str:
    """CSV with a header per part file, range-sorted over the parts if asked."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)
    return path


def save_instrument(df: DataFrame, path: str, descriptions: Sequence[str]) -> str:
    """Tab-separated table with names and, once, a description line below them.

    The first part file starts with the description line; ``part-00000*`` is
    the header path to read it back with.
    """
    spark: SparkSession = df.sparkSession
    text = df.select(*[col(c).cast("string").alias(c) for c in df.columns])
    line = spark.createDataFrame([tuple(descriptions)], text.schema).coalesce(1)
    line.unionAll(text).write.mode("overwrite").options(
        header=True, sep="\t", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


def by_cluster(df: DataFrame, cluster: str, subject: str = "subjectkey") -> DataFrame:
    """Rows sorted by cluster, then subject."""
    return df.orderBy(F.col(cluster), F.col(subject))
