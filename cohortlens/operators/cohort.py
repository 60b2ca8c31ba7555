"""Choosing subjects by recorded phenotype, and restricting tables to them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col, found, join_on_keys
from .ordering import first_rows

SUBJECT = "subjectkey"
MAX_LISTED_SUBJECTS = 100_000


def select_phenotype(phenotypes: DataFrame, pattern: str | None = None, exception_pattern: str | None = None,
                     description_pattern: str | None = None, order: Sequence[str] = ("_ord",),
                     subject: str = SUBJECT, mode: str = "consistent") -> DataFrame:
    """One row per selected subject, its first one under ``order``.

    ``consistent``: rows without phenotype are ignored; every phenotype of the
    subject must match ``pattern``; if one also matches ``exception_pattern``,
    some description of the subject must match too (``description_pattern``,
    by default the same pattern; full text is searched).
    ``first_row``: a missing phenotype is tested as the text ``nan``, and only
    the first row's phenotype and description count for the exception.
    Both patterns are needed for a selection; without them every subject is kept.

    One shuffle by subject: consistency is an aggregate, and the first row is
    carried along as a minimum, so both reduce on the map side.
    """
    if pattern is None or exception_pattern is None:
        return first_rows(phenotypes, [subject], [col(c) for c in order])
    description_pattern = description_pattern or pattern
    rows = phenotypes
    phenotype = F.col("phenotype").cast("string")
    if mode == "consistent":
        rows = rows.filter(F.col("phenotype").isNotNull())
    else:
        phenotype = F.coalesce(phenotype, F.lit("nan"))
    description = F.coalesce(found("phenotype_description", description_pattern), F.lit(False))
    matches, excepted = found(phenotype, pattern), found(phenotype, exception_pattern)
    whole_row = F.struct(*[col(c) for c in phenotypes.columns])
    position = F.struct(*[col(c) for c in order])
    per_subject = rows.groupBy(subject).agg(
        F.bool_and(matches).alias("_all_match"),
        F.bool_or(excepted).alias("_excepted"),
        F.bool_or(description).alias("_described"),
        F.min_by(F.struct(whole_row.alias("row"), excepted.alias("excepted"), description.alias("described")),
                 position).alias("_first"),
    )
    if mode == "consistent":
        keep = F.col("_all_match") & (~F.col("_excepted") | F.col("_described"))
    else:
        keep = F.col("_all_match") & (~F.col("_first.excepted") | F.col("_first.described"))
    return per_subject.filter(keep).select("_first.row.*")


def demographics(selected: DataFrame, subject: str = SUBJECT) -> DataFrame:
    """The five demographic columns, phenotype in lower case."""
    return selected.select(
        col(subject).alias("gui"), "sex", F.lower(F.col("phenotype").cast("string")).alias("phenotype"),
        "ethnic_group", "dataset_id")


def restrict(table: DataFrame, cohort: DataFrame, subject: str = SUBJECT) -> DataFrame:
    """Rows of cohort subjects."""
    return table.join(cohort.select(subject), subject, "left_semi")


def exclude(table: DataFrame, subjects: DataFrame, subject: str = SUBJECT) -> DataFrame:
    """Rows of subjects that are not listed."""
    return table.join(subjects.select(subject), subject, "left_anti")


def exclude_listed(table: DataFrame, subjects: Iterable, subject: str = SUBJECT) -> DataFrame:
    """Rows of subjects outside an explicit list; unknown ids are ignored."""
    subjects = list(subjects)
    if len(subjects) > MAX_LISTED_SUBJECTS:
        raise ValueError("pass long exclusion lists as a DataFrame to exclude()")
    if not subjects:
        return table
    listed = table.sparkSession.createDataFrame([(s,) for s in subjects], [subject])
    return exclude(table, listed.select(col(subject).cast(table.schema[subject].dataType)), subject)


def attach_phenotype(table: DataFrame, selected: DataFrame, subject: str = SUBJECT) -> DataFrame:
    """Phenotype of each cohort row, and its site if the table has none."""
    wanted = ["phenotype"] + ([] if "site" in table.columns else ["site"])
    cohort = selected.select(subject, *wanted)
    return table.drop("phenotype").join(cohort, subject, "inner")


def placeholder_phenotype(table: DataFrame) -> DataFrame:
    """Phenotype ``NA`` when no selection was asked for."""
    return table.withColumn("phenotype", F.lit("NA"))


def attach_descriptions(table: DataFrame, phenotypes: DataFrame, order: Sequence[str] = ("_ord",),
                        subject: str = SUBJECT) -> DataFrame:
    """Phenotype and description of each subject's first phenotype row."""
    first = first_rows(phenotypes, [subject], [col(c) for c in order]).select(
        subject, "phenotype", "phenotype_description")
    return table.drop("phenotype", "phenotype_description").join(first, subject, "left")


def join_demographics(table: DataFrame, people: DataFrame, columns: Sequence[str] = ("sex", "site", "phenotype"),
                      subject: str = SUBJECT) -> DataFrame:
    """Demographic columns on clustered rows; subjects without any keep NULL."""
    return join_on_keys(table, people.select(subject, *columns), [subject], "left")
