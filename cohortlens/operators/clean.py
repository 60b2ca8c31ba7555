"""Row cleaning: recodes over many columns, uninformative rows, repeats."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import columns as X
from ..functions.columns import col
from ..session import allow_wide
from .cohort import SUBJECT
from .ordering import first_rows, last_rows, with_group_count

ORDER = ("_ord",)
# The five subscale scores a social-responsiveness row must not
# miss altogether.
RESPONSIVENESS_SCORES = ("aware_t_score", "cog_t_score", "comm_t_score", "motiv_t_score", "manner_t_score")
# Features left out of imputation, by instrument.
EXCLUDED_FEATURES = {
    "ados": ("B2", "B3"),
    "mullen": ("scoresumm_gm_t_score",),
    "vineland": ("written_vscore",),
}


def recode(df: DataFrame, features: Sequence[str], rule: Callable[[str], Column]) -> DataFrame:
    """Apply a recode expression to several columns in one projection."""
    allow_wide(df, features)
    wanted = set(features)
    return df.select(*[rule(c).alias(c) if c in wanted else col(c) for c in df.columns])


def recode_items(df: DataFrame, items: Sequence[str], above: int | None = 3) -> DataFrame:
    return recode(df, items, lambda c: X.recode_item(c, above))


def recode_tokens(df: DataFrame, features: Sequence[str], respondent: str = "respond",
                  mode: str = "current") -> DataFrame:
    """Textual scores to numbers; the respondent code 999 is missing."""
    def rule(c):
        if c == respondent:
            x = X.number(c)
            return X.null_when(x, x == 999)
        return X.recode_token_score(c, mode)
    return recode(df, features, rule)


def drop_floor_scores(df: DataFrame, scores: Sequence[str], floor: float = 20) -> DataFrame:
    """Drop a row if any present score is at the floor or below."""
    # ``least`` skips NULL, so one expression covers every score.
    lowest = F.least(*[col(c) for c in scores]) if len(scores) > 1 else col(scores[0])
    return df.filter(F.coalesce(lowest > floor, F.lit(True)))


def is_uninformative(features: Sequence[str]) -> Column:
    """No feature present, or the present ones add up to zero."""
    return X.row_sum(features) == 0


def drop_uninformative(df: DataFrame, features: Sequence[str], mode: str = "row",
                       subject: str = SUBJECT) -> DataFrame:
    """Drop uninformative rows, or with ``mode='subject'`` every row of a
    subject that has one."""
    allow_wide(df, features)
    if mode == "row":
        return df.filter(~is_uninformative(features))
    bad = df.filter(is_uninformative(features)).select(subject).distinct()
    return df.join(bad, subject, "left_anti")


def drop_repeats(df: DataFrame, features: Sequence[str], informant: str | None = None,
                 order: Sequence[str] = ORDER, subject: str = SUBJECT) -> DataFrame:
    """Of rows equal in subject, age, informant and features keep the last.

    The key starts with the subject but is as fine as the features, so a
    subject with very many rows still spreads over tasks.
    """
    keys = list(dict.fromkeys([subject, "interview_age", *([informant] if informant else []), *features]))
    return last_rows(df, keys, order)


def one_per_respondent(df: DataFrame, respondent: str = "respond", order: Sequence[str] = ORDER,
                       subject: str = SUBJECT) -> DataFrame:
    """Earliest row per (subject, respondent); subjects left with several rows
    lose those without a respondent."""
    first = first_rows(df, [subject, respondent], [F.col("interview_age"), *[col(c) for c in order]])
    counted = with_group_count(first, [subject], "_rows")
    return counted.filter((F.col("_rows") == 1) | col(respondent).isNotNull()).drop("_rows")


def first_observation(df: DataFrame, informant: str | None = None, order: Sequence[str] = ORDER,
                      subject: str = SUBJECT) -> DataFrame:
    """Earliest row per subject, then by informant with unknown ones last."""
    then = [col(informant).asc_nulls_last()] if informant else []
    return first_rows(df, [subject], [F.col("interview_age").asc_nulls_last(), *then, *[col(c) for c in order]])


def most_complete(df: DataFrame, features: Sequence[str] | None = None, pattern: str = "score|total",
                  order: Sequence[str] = ORDER, subject: str = SUBJECT) -> DataFrame:
    """Per subject and period the row with the fewest missing scores."""
    features = list(features) if features else X.pick_columns(df.columns, pattern)
    return first_rows(df, [subject, "interview_period"], [X.row_missing(features), *[col(c) for c in order]])


def merge_twins(df: DataFrame, twins: Mapping[str, str]) -> DataFrame:
    """Fill a column from its twin, or rename the twin if it is alone."""
    out = []
    gone = {b for a, b in twins.items() if a in df.columns and b in df.columns}
    new_name = {b: a for a, b in twins.items() if b in df.columns and a not in df.columns}
    for c in df.columns:
        if c in twins and twins[c] in df.columns:
            out.append(F.coalesce(col(c), col(twins[c])).alias(c))
        elif c not in gone:
            out.append(col(c).alias(new_name.get(c, c)))
    return df.select(*out)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def keep_listed(df: DataFrame, wanted: Sequence[str], always: Sequence[str] = ()) -> DataFrame:
    """Columns of an ordered list that exist, after those always kept."""
    return df.select(*always, *[c for c in wanted if c in df.columns and c not in always])


def in_period(df: DataFrame, period: str) -> DataFrame:
    """Rows of one period, or of several given as ``P1|P2``."""
    if "|" in period:
        return df.filter(F.col("interview_period").rlike(period))
    return df.filter(F.col("interview_period") == period)


def drop_scoreless_subjects(df: DataFrame, scores: Sequence[str] = RESPONSIVENESS_SCORES,
                            subject: str = SUBJECT) -> DataFrame:
    """Drop every row of a subject that has a row missing all the scores."""
    bad = df.filter(X.row_count(scores) == 0).select(subject).distinct()
    return df.join(bad, subject, "left_anti")


def drop_excluded_features(df: DataFrame, instrument: str,
                           excluded: Mapping[str, Sequence[str]] = EXCLUDED_FEATURES) -> DataFrame:
    return df.drop(*excluded.get(instrument, ()))


def missing_indicators(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """0/1 per feature: 1 where it is missing."""
    return df.select(*keep, *[X.missing_indicator(c).alias(c) for c in features])
