"""Longitudinal, cross-sectional and wide views, and subject counts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import columns as X
from ..functions.columns import col
from .clean import ORDER
from .cohort import SUBJECT
from .ordering import first_rows, with_group_count

# Item tables of single schedule modules start like this and are
# left out of the cross-section; these name parts leave the outer wide table.
MODULE_TABLE = r"ados[0-9|t]"
NOT_A_FEATURE = "interview|sex|respond|relation"
OBSERVATION_RECORD = ("instrument", "interview_age", "interview_date")
SHARED = ("dataset_id", "interview_age", "interview_date", "sex")

#: Bits of a mask, and how many of them are settled before equal masks are added.
MAX_INSTRUMENTS = 62
INSTRUMENTS_A_STEP = 4


def stack(tables: Mapping[str, DataFrame], columns: Sequence[str], subject: str = SUBJECT) -> DataFrame:
    """Shared columns of all instruments, with the instrument's name."""
    return reduce(DataFrame.unionByName, [
        df.select(subject, F.lit(name).alias("instrument"), *columns) for name, df in tables.items()])


def cross_section(df: DataFrame, keys: Sequence[str] = (SUBJECT,), order: Sequence[str] = ORDER) -> DataFrame:
    """Earliest observation per key (per subject, or subject and instrument)."""
    return first_rows(df, list(keys), [F.col("interview_age").asc_nulls_last(), *[col(c) for c in order]])


def cross_sections(tables: Mapping[str, DataFrame], order: Sequence[str] = ORDER) -> dict[str, DataFrame]:
    """Cross-section of every instrument except single-module item tables."""
    return {n: cross_section(df, order=order) for n, df in tables.items() if not re.match(MODULE_TABLE, n)}


def longitudinal(observations: DataFrame, subject: str = SUBJECT) -> DataFrame:
    """Distinct (instrument, age, date) records of subjects seen more than once
    in that instrument.

    A long table: a list per subject would gather a much-observed subject in
    one row.
    """
    counted = with_group_count(observations.select(subject, *OBSERVATION_RECORD), [subject, "instrument"], "_n")
    return counted.filter(F.col("_n") > 1).drop("_n").distinct()


def observation_records(observations: DataFrame, extra: Sequence[str] = ("sex", "diagnosis"),
                        subject: str = SUBJECT) -> DataFrame:
    """Distinct observation records of all subjects and instruments."""
    return observations.select(subject, *OBSERVATION_RECORD, *extra).distinct()


def with_period_count(df: DataFrame, subject: str = SUBJECT, name: str = "intersection_count") -> DataFrame:
    """Number of rows (periods) available for the row's subject."""
    return with_group_count(df, [subject], name)


def repeated_assessments(df: DataFrame, keys: Sequence[str] = (), subject: str = SUBJECT) -> DataFrame:
    """Rows of subjects that occur more than once, and how many such subjects."""
    per_subject = df.groupBy(*keys, subject).agg(F.count("*").alias("_n"))
    many = F.col("_n") > 1
    return per_subject.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(many, F.col("_n"))), F.lit(0)).alias("observations"),
        F.count(F.when(many, 1)).alias("subjects"))


def subject_counts(df: DataFrame, keys: Sequence[str] = ("instrument",), subject: str = SUBJECT) -> DataFrame:
    """Observations and unique subjects per key; subjects collapse first."""
    per_subject = df.groupBy(*keys, subject).agg(F.count("*").alias("_n"))
    return per_subject.groupBy(*keys).agg(F.sum("_n").alias("observations"), F.count(subject).alias("subjects"))


def wide_inner(tables: Mapping[str, DataFrame], subject: str = SUBJECT) -> DataFrame:
    """Subjects present in every cross-section, columns side by side.  Ages and
    dates, and any name found twice, carry the instrument's name."""
    seen: dict[str, int] = {}
    for df in tables.values():
        for c in df.columns:
            seen[c] = seen.get(c, 0) + 1
    parts = []
    for name, df in tables.items():
        suffixed = {c: f"{c}_{name}" for c in df.columns
                    if c != subject and (seen[c] > 1 or c in ("interview_age", "interview_date"))}
        parts.append(df.withColumnsRenamed(suffixed))
    return reduce(lambda a, b: a.join(b, subject, "inner"), parts)


def wide_outer(tables: Mapping[str, DataFrame], subject: str = SUBJECT, suffixed: Sequence[str] = ("ados",),
               without: str = NOT_A_FEATURE) -> DataFrame:
    """Features of all cross-sections side by side, for every subject that is in
    any; those of ``suffixed`` instruments carry its name."""
    parts = []
    for name, df in tables.items():
        features = [c for c in X.pick_columns(df.columns, without, drop=True) if c != subject]
        parts.append(df.select(subject, *[
            col(c).alias(f"{c}_{name}" if name in suffixed else c) for c in features]))
    return reduce(lambda a, b: a.join(b, subject, "full_outer"), parts)


def shared_subjects(tables: Mapping[str, DataFrame], subject: str = SUBJECT) -> DataFrame:
    """Subjects that occur in every table."""
    return reduce(DataFrame.intersect, [df.select(subject) for df in tables.values()])


def combination_counts(memberships: DataFrame, instruments: Sequence[str], max_size: int | None = None,
                       subject: str = SUBJECT) -> DataFrame:
    """For each combination of instruments, the subjects that have at least
    those, zero included: ``(combination, size, subjects)``.

    Memberships (subject, instrument) collapse to one bit mask per subject and
    then to one count per mask, to which the mask of all instruments is added
    with a count of 0, so that every combination occurs.  The counts are then
    summed over supersets: instrument by instrument a mask that holds it counts
    with it and without it, and equal masks are added up before the next few
    instruments.  Work grows with the masks of each step, at most the number of
    combinations, however many subjects there are.  With ``max_size`` a mask is
    left out as soon as more instruments than that are settled in it.

    A mask is a 64-bit number: more than 62 instruments raise ``ValueError``.
    """
    instruments = list(instruments)
    if not 1 <= len(instruments) <= MAX_INSTRUMENTS:
        raise ValueError(f"1 to {MAX_INSTRUMENTS} instruments")
    max_size = max_size or len(instruments)
    bits = [F.lit(1 << i).cast("bigint") for i in range(len(instruments))]
    bit = reduce(lambda acc, i: acc.when(F.col("instrument") == instruments[i], bits[i]),
                 range(1, len(instruments)), F.when(F.col("instrument") == instruments[0], bits[0]))
    masks = memberships.select(subject, bit.alias("_bit")).groupBy(subject).agg(F.bit_or("_bit").alias("_mask"))
    everything = memberships.sparkSession.range(1).select(
        F.lit((1 << len(instruments)) - 1).cast("bigint").alias("_mask"), F.lit(0).cast("bigint").alias("_n"))
    counts = masks.filter(F.col("_mask").isNotNull()).groupBy("_mask").agg(
        F.count("*").alias("_n")).unionByName(everything)
    for start in range(0, len(instruments), INSTRUMENTS_A_STEP):
        for i in range(start, min(start + INSTRUMENTS_A_STEP, len(instruments))):
            mask, settled = F.col("_mask"), F.lit((2 << i) - 1).cast("bigint")
            held = mask.bitwiseAND(bits[i]) != 0
            both = F.when(held, F.array(mask, mask.bitwiseXOR(bits[i]))).otherwise(F.array(mask))
            counts = counts.select(F.explode(both).alias("_mask"), "_n")
            if max_size < len(instruments):
                counts = counts.filter(F.bit_count(mask.bitwiseAND(settled)) <= max_size)
        counts = counts.groupBy("_mask").agg(F.sum("_n").alias("_n"))
    named = F.array(*[F.when(F.col("_mask").bitwiseAND(b) != 0, F.lit(n)) for b, n in zip(bits, instruments)])
    return counts.filter("_mask <> 0").select(
        F.array_join(named, "&").alias("combination"), F.bit_count("_mask").cast("int").alias("size"),
        F.col("_n").alias("subjects"))
