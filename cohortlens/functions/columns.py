"""Column expressions shared by the operators.  All run JVM-side."""

from __future__ import annotations

import operator
import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import written

# Upper bounds in months of the age periods; anything not inside
# (0, 204), including 204 itself and NULL, is the last period.
AGE_PERIODS = (("P1", 30), ("P2", 72), ("P3", 156))
OPEN_PERIOD = ("P4", 204)
LAST_PERIOD = "P5"

# Text codes found in questionnaire score columns.
CEILING_TOKENS = {">90": 91.0, "?90": 90.0}
MISSING_TOKENS = ("999", "999.0", "888", "-9", '"', ".")

# A per-group summary of at most this many rows is broadcast.
SUMMARY_ROWS = 50_000

# Beyond this many inputs a row expression goes through an array, so that the
# generated method stays below the JVM's 64 KB limit.
WIDE_ROW = 80


def col(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN becomes NULL, so that aggregates skip it."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c), c)


def number(c) -> Column:
    """Numeric value of a possibly textual column; unreadable text is NULL."""
    return col(c).try_cast("double")


# ---- row-wise reductions that skip NULL -------------------------------------

def row_sum(cols: Sequence) -> Column:
    """Sum of the non-NULL values; 0 when there are none."""
    cols = [col(c).cast("double") for c in cols]
    if not cols:
        return F.lit(0.0)
    if len(cols) > WIDE_ROW:
        return F.aggregate(F.array(*cols), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    return reduce(operator.add, [F.coalesce(c, F.lit(0.0)) for c in cols])


def row_count(cols: Sequence) -> Column:
    """Number of non-NULL values."""
    cols = [col(c) for c in cols]
    if not cols:
        return F.lit(0)
    if len(cols) > WIDE_ROW:
        return F.size(F.array_compact(F.array(*cols)))
    return reduce(operator.add, [c.isNotNull().cast("int") for c in cols])


def row_missing(cols: Sequence) -> Column:
    """Number of NULL values."""
    return F.lit(len(cols)) - row_count(cols)


def row_mean(cols: Sequence) -> Column:
    """Mean of the non-NULL values; NULL when there are none."""
    n = row_count(cols)
    return F.when(n > 0, row_sum(cols) / n)


# ---- recodes ----------------------------------------------------------------

def null_when(c, *conditions: Column) -> Column:
    """``c`` with NULL wherever one of the conditions holds."""
    bad = reduce(operator.or_, [F.coalesce(x, F.lit(False)) for x in conditions])
    return F.when(~bad, col(c))


def recode_item(c, above: int | None = 3) -> Column:
    """Item score: 999 and more, and negatives, are missing; codes above the
    scale count as 0.  ``above=None`` leaves the column alone."""
    if above is None:
        return col(c)
    x = number(c)
    return F.when((x < 0) | (x >= 999), None).when(x > above, F.lit(0.0)).otherwise(x)


def recode_scale_score(c, missing_from: int = 777) -> Column:
    """Standard score: ``missing_from`` and more, and negatives, are missing."""
    x = number(c)
    return null_when(x, x >= missing_from, x < 0)


def recode_adaptive(name: str, informant: str = "relationship", mode: str = "current") -> Column:
    """Adaptive-behaviour column: range limits depend on the column's role."""
    x = number(name)
    if mode == "older":
        bad = [x >= 999, x < 0]
    else:
        bad = [x > 140, x < 0]
        if re.search("_vscore", name):
            bad.append(x > 24)
    if name == informant:
        bad.append(x == 27)
    return null_when(x, *bad)


def recode_token_score(c, mode: str = "current") -> Column:
    """Questionnaire score stored as text: ceiling marks become numbers,
    missing marks and unreadable text become NULL."""
    text = F.trim(col(c).cast("string"))
    missing = MISSING_TOKENS if mode == "current" else ("999", '"', ".")
    out = F.when(text.isin(list(missing)), F.lit(None).cast("double"))
    for token, value in CEILING_TOKENS.items():
        out = out.when(text == token, F.lit(value))
    out = out.otherwise(text.try_cast("double"))
    return null_when(out, out > 200) if mode == "current" else out


def age_period(age) -> Column:
    """Age in months to period label."""
    x = number(age)
    inside = x > 0
    out = F.when(inside & (x <= AGE_PERIODS[0][1]), AGE_PERIODS[0][0])
    for label, upper in AGE_PERIODS[1:]:
        out = out.when(inside & (x <= upper), label)
    return out.when(inside & (x < OPEN_PERIOD[1]), OPEN_PERIOD[0]).otherwise(LAST_PERIOD)


def missing_indicator(c) -> Column:
    return col(c).isNull().cast("int")


# ---- scores -----------------------------------------------------------------

def subscale_score(items: Sequence[str], max_scores: dict[str, float] | None = None) -> Column:
    """Sum of the answered items, over the maximum those items could reach."""
    total = row_sum(items)
    if max_scores is not None:
        reachable = row_sum([F.when(col(i).isNotNull(), F.lit(float(max_scores[i]))) for i in items])
        total = total / F.nullif(reachable, F.lit(0.0))
    return F.when(row_count(items) > 0, total)


def scale_score(subscales: Sequence[str], averaged: bool = True) -> Column:
    """Mean (or sum) of the available subscales."""
    if averaged:
        return row_mean(subscales)
    return F.when(row_count(subscales) > 0, row_sum(subscales))


# ---- text matches -----------------------------------------------------------

def found(c, pattern: str) -> Column:
    """Pattern occurs anywhere in the lower-cased text."""
    return F.lower(col(c).cast("string")).rlike(pattern)


def starts(c, pattern: str) -> Column:
    """Pattern matches at the start of the text."""
    return col(c).rlike(f"^(?:{pattern})")


def pick_columns(columns: Iterable[str], pattern: str, anchored: bool = False, drop: bool = False) -> list[str]:
    """Column names that match (or do not match) a pattern, in their order."""
    test = re.match if anchored else re.search
    return [c for c in columns if bool(test(pattern, c)) != drop]


# ---- scaling and intervals --------------------------------------------------

def proportion_half_width(p, n) -> Column:
    """Half width of the 95% normal interval of a proportion."""
    p, n = col(p), col(n)
    return 1.96 * F.sqrt(p * (1 - p) / F.nullif(n.cast("double"), F.lit(0.0)))


def with_min_max(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Features scaled to [0, 1] by their own minimum and maximum, per ``by``
    group if given; a constant feature becomes 0.

    One map-side-combined aggregate gives the limits.  Ungrouped limits come
    back as a scalar subquery; grouped ones join on the group.
    """
    limits = [F.struct(F.min(col(c)).alias("lo"), F.max(col(c)).alias("hi")).alias(c) for c in features]
    if by:
        source = join_summary(df, df.groupBy(*by).agg(F.struct(*limits).alias("_limits")), by)
    else:
        source = df.withColumn("_limits", df.agg(F.struct(*limits).alias("_limits")).scalar())
    lim = F.col("_limits")
    scaled = {}
    for c in features:
        lo, hi = lim.getField(c).getField("lo"), lim.getField(c).getField("hi")
        scaled[c] = F.when(hi > lo, (col(c) - lo) / (hi - lo)).otherwise(F.when(col(c).isNotNull(), F.lit(0.0)))
    return source.withColumns(scaled).select(*df.columns)


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which NULL keys match each other; right keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = reduce(operator.and_, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


def join_summary(left: DataFrame, summary: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a per-group summary to the rows it came from.

    The summary is written (one small job) and counted: up to SUMMARY_ROWS rows
    it is broadcast, so the rows stay where they are; beyond that the join
    shuffles, and adaptive execution splits skewed groups.
    """
    table = written(summary, "summary")
    small = table.count() <= SUMMARY_ROWS
    return join_on_keys(left, F.broadcast(table) if small else table, keys, how)


def to_long(df: DataFrame, ids: Sequence[str], features: Sequence[str],
            name: str = "feature", value: str = "value") -> DataFrame:
    """One row per (row, feature)."""
    return df.select(*ids, *[col(c).cast("double").alias(c) for c in features]).unpivot(
        list(ids), list(features), name, value)
