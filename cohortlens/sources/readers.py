"""Tab-separated assessment tables whose second line describes the columns."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import col
from ..operators.ordering import first_rows

QUOTE = '"'
#: Written dates besides ISO, and texts that stand for a missing value.
DATE_FORMATS = ("M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss")
NA_TEXTS = ("", "na", "n/a", "nan", "null", "none")


def table_name(path: str) -> str:
    """Table name of a file: its base name without the ``.txt`` ending."""
    return path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".txt")


def header_lines(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Column names and descriptions: the first two lines of a file."""
    lines = [r["value"] for r in spark.read.text(path).head(2)]
    split = lambda line: [part.strip().strip(QUOTE) for part in line.rstrip("\r\n").split("\t")]
    names = split(lines[0]) if lines else []
    return names, split(lines[1]) if len(lines) > 1 else []


def read_instrument(spark: SparkSession, path: str, types: Mapping[str, str] | None = None,
                    date: str = "interview_date", header_path: str | None = None,
                    date_formats: Sequence[str] = DATE_FORMATS, na: Sequence[str] = NA_TEXTS) -> DataFrame:
    """One tab-separated table without its description line.

    Columns are read as text and texts in ``na`` (in any case) become NULL, then
    ``types`` are tried (unreadable, and not a number, is NULL) and the date is
    parsed: as ISO, or by the first of ``date_formats`` that fits.  Only the two header lines reach the driver; a folder
    of part files takes them from ``header_path``.
    """
    names, descriptions = header_lines(spark, header_path or path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.csv(path, sep="\t", header=True, schema=schema, quote=QUOTE, enforceSchema=True)
    is_description = reduce(operator.and_, [
        F.coalesce(col(n), F.lit("")) == F.lit(d) for n, d in zip(names, descriptions)], F.lit(bool(descriptions)))
    types = dict(types or {})
    absent = [t.lower() for t in na]

    def typed(n):
        value = F.when(~F.lower(F.trim(col(n))).isin(absent), col(n))
        if n in types:
            cast = value.try_cast(types[n])
            return F.when(~F.isnan(cast), cast) if types[n] in ("double", "float") else cast
        if n == date:
            return F.coalesce(F.try_to_timestamp(value), *[F.try_to_timestamp(value, F.lit(f)) for f in date_formats])
        return value

    return rows.filter(~is_description).select(*[typed(n).alias(n) for n in names])


def unreadable(raw: DataFrame, read: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column, values that are there in ``raw`` text and NULL in ``read``:
    ``(column, given, read, lost)``."""
    given = raw.agg(*[F.count(F.when(F.trim(col(c)) != "", 1)).alias(c) for c in columns]).unpivot([], list(columns), "column", "given")
    kept = read.agg(*[F.count(col(c)).alias(c) for c in columns]).unpivot([], list(columns), "column", "read")
    return given.join(kept, "column").withColumn("lost", F.col("given") - F.col("read"))


def with_file_order(df: DataFrame, name: str = "_ord") -> DataFrame:
    """An ingest ordinal that follows file and line order.

    Add it right at the read: it is stable under recomputation because a file
    split always holds the same lines.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def data_dictionary(spark: SparkSession, headers: Mapping[str, str]) -> DataFrame:
    """Description of each column, from the first table that has it:
    ``(column, description, table)``.  ``headers`` maps table to header path."""
    rows = []
    for position, (name, path) in enumerate(headers.items()):
        names, descriptions = header_lines(spark, path)
        rows += [(position, name, n, d) for n, d in zip(names, descriptions)]
    lines = spark.createDataFrame(rows, "position int, `table` string, `column` string, description string")
    return first_rows(lines, ["column"], [F.col("position")]).select("column", "description", "table")


def read_stacked(spark: SparkSession, paths: Mapping[str, str], types: Mapping[str, str] | None = None,
                 headers: Mapping[str, str] | None = None, date: str = "interview_date") -> dict[str, DataFrame]:
    """Tables read and stacked when their headers agree from the third column
    on, under the first one's name."""
    headers = headers or paths
    groups: dict[tuple, list[str]] = {}
    for name in paths:
        names, _ = header_lines(spark, headers[name])
        groups.setdefault(tuple(names[2:]), []).append(name)
    out = {}
    for members in groups.values():
        tables = [read_instrument(spark, paths[n], types, date, headers[n]) for n in members]
        # The first two columns may be named differently and do not take part.
        first = tables[0].columns
        out[members[0]] = reduce(DataFrame.unionByName, [t.toDF(*first) for t in tables])
    return out


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A written CSV result with a known schema."""
    return spark.read.csv(path, header=True, schema=schema)


def read_codebook(spark: SparkSession, path: str, item_column: str = "item") -> DataFrame:
    """Codebook CSV with one row per item, in file order."""
    names = spark.read.csv(path, header=True).columns
    schema = ", ".join(f"`{n}` {'double' if n == 'max_score' else 'string'}" for n in names)
    rows = spark.read.csv(path, header=True, schema=schema).withColumnRenamed(item_column, "item")
    return with_file_order(rows, "position")

