"""Missing data: measure it, prepare tables for imputation, inject it."""

from __future__ import annotations

import operator
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import columns as X
from ..functions.columns import col, join_on_keys
from ..session import allow_wide, written
from . import clean
from .cohort import SUBJECT
from .ordering import HASH_SPAN, hash32, with_rank
from .views import wide_outer

# Columns that carry no score, and the share of missing scores
# from which a subject is labelled as having some.
NOT_MEASURED = "interview|sex|resp|relat"
NOT_COUNTED = "interview|relationship|respon|intersection"
SOME_MISSING = 0.15

#: Blocks whose bits share one number.
WORD = 62
#: Flags of all patterns up to which their table is broadcast.
BROADCAST_FLAGS = 1_000_000


def feature_columns(df: DataFrame, without: str = NOT_MEASURED, subject: str = SUBJECT) -> list[str]:
    """Score columns: neither the subject, nor ``_`` helpers, nor excluded names."""
    return [c for c in X.pick_columns(df.columns, without, drop=True) if c != subject and not c.startswith("_")]


def _unpivot_one_row(wide: DataFrame, keys: Sequence[str], features: Sequence[str], value: str) -> DataFrame:
    return wide.unpivot(list(keys), list(features), "feature", value)


def missing_percent(df: DataFrame, features: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Percentage of missing values: ``(*by, feature, missing_perc)``.

    All features in one aggregate; only its few result rows are turned long.
    """
    features = list(features) if features else feature_columns(df)
    share = [(F.avg(X.missing_indicator(c)) * 100).alias(c) for c in features]
    return _unpivot_one_row(df.groupBy(*by).agg(*share), by, features, "missing_perc")


def missing_summary(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Largest and mean missing percentage over the features."""
    return missing_percent(df, features).agg(
        F.max("missing_perc").alias("max_perc"), F.avg("missing_perc").alias("mean_perc"))


def missing_frequency(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Two rows per feature: percentage missing (``0``) and available (``1``)."""
    both = F.explode(F.array(
        F.struct(F.lit("0").alias("status"), F.col("missing_perc").alias("perc")),
        F.struct(F.lit("1").alias("status"), (100 - F.col("missing_perc")).alias("perc"))))
    return missing_percent(df, features).select("feature", both.alias("_b")).select("feature", "_b.*")


def missing_by_cluster(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """Missing percentage per cluster and feature."""
    return missing_percent(df, features, [cluster])


def missing_grid(df: DataFrame, features: Sequence[str], subject: str = SUBJECT) -> DataFrame:
    """Long 0/1 grid ``(subject, feature, missing)``."""
    return clean.missing_indicators(df, features, [subject]).unpivot([subject], list(features), "feature", "missing")


def prepare_imputation(tables: Mapping[str, DataFrame], period: str = "P2", threshold: float = 0.35,
                       excluded: Mapping[str, Sequence[str]] = clean.EXCLUDED_FEATURES,
                       subject: str = SUBJECT) -> dict[str, DataFrame]:
    """Tables of one period with the label ``countna``.

    If no feature of any table reaches ``threshold`` missing, nothing is
    dropped and ``countna`` is 0 everywhere.  Otherwise a subject with a row
    missing more than ``threshold`` of its features goes, and the rest are
    labelled 0 below 15 % and 1 from there on.  The decision is a scalar
    subquery, so nothing runs before the result is used.
    """
    chosen = {}
    for name, df in tables.items():
        df = clean.in_period(df, period)
        if name == "srs":
            df = clean.drop_scoreless_subjects(df, subject=subject)
        chosen[name] = clean.drop_excluded_features(df, name, excluded)
    worst = reduce(DataFrame.unionAll, [
        missing_summary(df).select("max_perc") for df in chosen.values()]).agg(F.max("max_perc")).scalar()
    out = {}
    for name, df in chosen.items():
        features = feature_columns(df, NOT_COUNTED, subject)
        allow_wide(df, features)
        gated = F.coalesce(worst >= threshold * 100, F.lit(False))
        share = X.row_missing(features) / len(features)
        rows = df.withColumn("_gated", gated).withColumn("_share", share)
        rows = rows.withColumn("countna", F.when(F.col("_gated") & (F.col("_share") >= SOME_MISSING), 1).otherwise(0))
        bad = rows.filter(F.col("_gated") & (F.col("_share") > threshold)).select(subject).distinct()
        out[name] = rows.drop("_gated", "_share").join(bad, subject, "left_anti")
    return out


def prepare_wide(tables: Mapping[str, DataFrame], subject: str = SUBJECT) -> tuple[DataFrame, DataFrame]:
    """Outer-wide table of all instruments' features, and its missing summary."""
    wide = wide_outer(tables, subject)
    return wide, missing_summary(wide, [c for c in wide.columns if c != subject])


# ---- injection --------------------------------------------------------------

def hashed_draw(*ids, salt: int) -> Column:
    """Draw on [0, 2**32) from a row's identity; the default source of chance."""
    return hash32(*ids, seed=salt)


def arithmetic_draw(row_id: Column, salt: int) -> Column:
    """The same from an integer id with plain arithmetic, so that another
    engine can repeat it."""
    step = (col(row_id) % F.lit(1 << 31)) * F.lit(2654435761) + F.lit(salt * 40503 + 12345)
    mixed = step % F.lit(HASH_SPAN)
    return (F.floor(mixed / 65536) + (mixed % F.lit(65536)) * F.lit(48271)) % F.lit(HASH_SPAN)


def _high_bit(draw: Column) -> Column:
    return (F.floor(draw / (HASH_SPAN // 64)) % 2).cast("int")


def inject_mcar(df: DataFrame, blocks: Mapping[str, Sequence[str]], alpha: float = 0.20, row_id: str = SUBJECT,
                by: Sequence[str] = (), seed: int = 0, draw: Callable[..., Column] | None = None) -> DataFrame:
    """Values missing completely at random, by blocks of features.

    Each row draws one bit per block; among rows of a pattern the
    ``ceil(alpha * n)`` with the smallest draw lose the blocks whose bit is 1.
    The pattern that would lose everything is left alone.  ``by`` columns (an
    iteration number) draw independently.
    """
    allow_wide(df, df.columns)
    if draw is None:
        draw = lambda ident, salt: hashed_draw(ident, *by, salt=salt)
    names = list(blocks)
    bits = [_high_bit(draw(row_id, seed * 1000 + i + 1)).cast("bigint") for i in range(len(names))]
    # A pattern is one number for every 62 blocks.
    words = [bits[i:i + WORD] for i in range(0, len(bits), WORD)]
    patterns = [f"_pattern{w}" for w in range(len(words))]
    marked = df.withColumns({
        name: reduce(operator.add, [b * F.lit(1 << i).cast("bigint") for i, b in enumerate(word)])
        for name, word in zip(patterns, words)}).withColumn("_draw", draw(row_id, seed * 1000))
    ranked = with_rank(marked, [*by, *patterns], "_draw", [row_id], "_rank", "_size")
    spared = reduce(operator.and_, [F.col(name) == (1 << len(word)) - 1 for name, word in zip(patterns, words)])
    ranked = ranked.withColumn("_hit", (F.col("_rank") <= F.ceil(F.lit(alpha) * F.col("_size"))) & ~spared)
    block_of = {c: i for i, n in enumerate(names) for c in blocks[n]}

    def lost(c):
        word, i = divmod(block_of[c], WORD)
        return F.col("_hit") & (F.col(patterns[word]).bitwiseAND(F.lit(1 << i).cast("bigint")) != 0)

    return ranked.select(*[F.when(~lost(c), col(c)).alias(c) if c in block_of else col(c) for c in df.columns])


def mar_patterns(spark, features: int, patterns: int, alpha: float, seed: int, draw: Callable[..., Column]) -> DataFrame:
    """Random patterns: ``(_pattern, _keep, _weigh, _chance)``.

    Per feature whether the pattern keeps it and whether it weighs it, a bit
    each; per quarter how likely a row is hit.  Every value is a draw from the
    number of its pattern and place, so there is no limit on patterns.
    """
    at = lambda width, i: F.col("_pattern") * F.lit(width) + i
    places = F.sequence(F.lit(0).cast("bigint"), F.lit(features - 1).cast("bigint"))
    flags = lambda salt: F.transform(places, lambda i: _high_bit(draw(at(features, i), salt)) == 1)
    odds = F.array(F.lit(1.0), *[F.floor(draw(at(3, F.lit(q)), seed * 1000 + 4) / (HASH_SPAN / 5)).cast("double")
                                 for q in range(3)])
    table = spark.range(patterns).select(F.col("id").alias("_pattern")).select(
        "_pattern", flags(seed * 1000 + 2).alias("_keep"), flags(seed * 1000 + 3).alias("_weigh"), odds.alias("_odds"))
    mean = F.aggregate("_odds", F.lit(0.0), lambda a, x: a + x) / 4
    return table.select("_pattern", "_keep", "_weigh",
                        F.transform("_odds", lambda x: F.lit(alpha) * x / mean).alias("_chance"))


def inject_mar(df: DataFrame, features: Sequence[str], alpha: float = 0.20, row_id: str = SUBJECT,
               by: Sequence[str] = (), patterns: int = 16, seed: int = 0,
               draw: Callable[..., Column] | None = None) -> DataFrame:
    """Values missing at random: how likely depends on observed values.

    Each row draws one of ``patterns`` random patterns (bit 0: the feature is
    lost; the pattern losing nothing is skipped).  Within a pattern rows are
    cut at the quartiles of a weighted sum of the features the pattern leaves,
    equal sums together.  The lowest quarter has odds 1, the others draw odds
    0 to 4, and a row is hit with probability alpha * odds / mean odds.  A
    pattern's only row is always hit.  ``by`` columns (an iteration number) draw
    independently, from the same patterns.  With ``draw`` as the source of
    chance of the rows, the patterns come from ``arithmetic_draw``.
    """
    if patterns < 1:
        raise ValueError("at least one pattern")
    allow_wide(df, features)
    features = list(features)
    of_row = draw or (lambda ident, salt: hashed_draw(ident, *by, salt=salt))
    of_pattern = arithmetic_draw if draw else (lambda ident, salt: hashed_draw(ident, salt=salt))
    table = written(mar_patterns(df.sparkSession, len(features), patterns, alpha, seed, of_pattern), "patterns")
    if patterns * len(features) <= BROADCAST_FLAGS:
        table = F.broadcast(table)
    chosen = df.withColumn("_pattern", F.pmod(of_row(row_id, seed * 1000 + 1), F.lit(patterns)).cast("bigint")).join(
        table, "_pattern")
    kept = {c: F.col("_keep")[i] for i, c in enumerate(features)}
    weighted = X.row_sum([F.when(kept[c] & F.col("_weigh")[i], col(c)) for i, c in enumerate(features)])
    marked = chosen.withColumn("_sum", weighted).drop("_weigh")
    # Equal sums collapse before they are ranked, however many rows share one.
    slot = [*by, "_pattern", "_sum"]
    sums = with_rank(marked.groupBy(*slot).agg(F.count("*").alias("_c")), slot[:-1], "_sum", [], "_upto", "_size",
                     span=None, weight="_c")
    ranked = join_on_keys(marked, sums, slot)
    quarter = F.least(F.floor(4 * (F.col("_upto") - F.col("_c")) / F.col("_size")), F.lit(3)).cast("int")
    chance = F.get(F.col("_chance"), quarter)
    share = of_row(row_id, seed * 1000 + 5) / F.lit(float(HASH_SPAN))
    hit = F.exists("_keep", lambda k: ~k) & ((F.col("_size") == 1) | (share < chance))
    ranked = ranked.withColumn("_hit", hit)
    return ranked.select(*[
        F.when(~F.col("_hit") | kept[c], col(c)).alias(c) if c in kept else col(c) for c in df.columns])
