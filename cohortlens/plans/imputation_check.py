"""How well does nearest-neighbour imputation restore injected gaps?"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import probability as P
from ..functions.columns import col, join_summary, to_long
from ..operators.missing import inject_mar, inject_mcar
from ..operators.neighbors import impute_rows
from ..operators.ordering import exact_quantiles, rank_brackets, with_rank
from ..session import written

QUANTILES = (0.25, 0.5, 0.75)
# Fixed value: two-sided 95% point of the standard normal distribution.
Z95 = 1.959963984540054


def mean_intervals(values: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean per key with its 95% t interval, from the population deviation."""
    stats = values.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                                      F.stddev_pop(value).alias("sd"))
    half = F.col("_t") * F.col("sd") / F.sqrt(F.col("n"))
    return stats.withColumn("_t", P.t_quantile((F.col("n") - 1).cast("double"))).select(
        *keys, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def rank_spread(n: Column, prob: float | Column) -> Column:
    """Ranks on either side of ``n * prob`` beyond which no value has a weight."""
    prob = F.lit(prob) if isinstance(prob, float) else prob
    return 12 * F.sqrt(n * prob * (1 - prob)) + 40


def interval_brackets(values: DataFrame, keys: Sequence[str], value: str = "value", probs: Sequence[float] = QUANTILES) -> DataFrame:
    """Brackets of the values that ``quantile_intervals`` weights, and of the quantiles."""
    return rank_brackets(values, keys, value, probs, lambda n, p: rank_spread(n, p) + 2)


def quantile_intervals(values: DataFrame, keys: Sequence[str], value: str = "value",
                       probs: Sequence[float] = QUANTILES, brackets: DataFrame | None = None) -> DataFrame:
    """95% intervals of quantiles with the Maritz-Jarrett standard error:
    ``(*keys, prob, low, high)``, around the (n + 1) p order-statistic estimate.

    The standard error weights each ordered value by a difference of beta
    distribution functions at its rank, so values need only their ranks: equal
    values collapse, and running counts come from value buckets.  Beyond 12
    standard deviations of the rank (and 40 ranks) those weights are below 1e-20
    of the whole; only values within are weighted, about sqrt(n) of them.  So only
    values in ``brackets`` around the ranks are sorted, beside the count of those below.
    """
    keys = list(keys)
    if brackets is None:
        brackets = interval_brackets(values, keys, value, probs)
    near = join_summary(values.select(*keys, col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull()), brackets, keys)
    near = near.select(*keys, "_n", "_v", F.explode("_b").alias("_b"))
    lo, hi = F.col("_b.lo"), F.col("_b.hi")
    near = near.filter((lo.isNull() | (F.col("_v") >= lo)) & (hi.isNull() | (F.col("_v") <= hi))).select(
        *keys, "_n", "_v", "_b.prob", "_b.below")
    counted = near.groupBy(*keys, "_n", "prob", "below", "_v").agg(F.count("*").alias("_c"))
    ranked = with_rank(counted, [*keys, "prob"], "_v", [], "_inside", None, span=None, weight="_c")
    ranked = ranked.withColumn("_upto", F.col("below") + F.col("_inside"))
    n, upto, before = F.col("_n").cast("double"), F.col("_upto"), F.col("_upto") - F.col("_c")
    center, spread = n * F.col("prob"), rank_spread(n, F.col("prob"))
    each = ranked.filter((upto > center - spread) & (before < center + spread))
    m = F.floor(F.col("prob") * n + 0.5)
    share = lambda x: P._vectorized(P.beta_cdf, (m - 1).cast("double"), (n - m).cast("double"), x)
    weight = F.when((m > 1) & (m < n), share(upto / n) - share(before / n))
    place = F.greatest(F.lit(1), F.least(F.floor((n + 1) * F.col("prob")), F.col("_n") - 1))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (n + 1) * F.col("prob") - place))
    at = lambda r: F.max(F.when((F.col("_before") < r) & (r <= F.col("_upto")), F.col("_v")))
    weighted = each.withColumns({"_w": weight, "_before": before, "_place": place, "_part": part})
    out = weighted.groupBy(*keys, "prob", "_part").agg(
        F.sum(F.col("_w") * F.col("_v")).alias("_m1"), F.sum(F.col("_w") * F.col("_v") * F.col("_v")).alias("_m2"),
        at(F.col("_place")).alias("_a"), at(F.col("_place") + 1).alias("_b"))
    center = (1 - F.col("_part")) * F.col("_a") + F.col("_part") * F.col("_b")
    variance = F.col("_m2") - F.col("_m1") * F.col("_m1")
    half = Z95 * F.when(variance >= 0, F.sqrt(variance))
    return out.select(*keys, "prob", (center - half).alias("low"), (center + half).alias("high"))


def evaluate_imputation(df: DataFrame, features: Sequence[str], alpha: float = 0.20, n_iter: int = 10,
                        k: int = 5, pattern: str = "MCAR", blocks: Mapping[str, Sequence[str]] | None = None,
                        row_id: str = "subjectkey", seed: int = 0, draw=None) -> DataFrame:
    """Raw bias, percent bias, coverage and mean interval width of the mean and
    of the quartiles over ``n_iter`` injections into a complete table:
    ``(statistic, raw_bias, percent_bias, coverage, width)``.

    The iteration is a column, so all injections and imputations are one job;
    the imputed rows are written once, as every statistic reads them.
    """
    features = list(features)
    base = df.select(row_id, *features)
    copies = base.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1))))
    if pattern == "MCAR":
        if not blocks:
            raise ValueError("MCAR needs blocks: instrument name -> its features")
        holes = inject_mcar(copies, blocks, alpha, row_id, ["iteration"], seed, draw)
    else:
        holes = inject_mar(copies, features, alpha, row_id, ["iteration"], seed=seed)
    holes = written(holes, "injected")
    complete = written(impute_rows(holes, holes, features, k, row_id, ["iteration"]), "imputed")
    return imputation_scores(base, complete, features)


def imputation_scores(base: DataFrame, complete: DataFrame, features: Sequence[str]) -> DataFrame:
    """Scores from the true table and its imputed copies (column ``iteration``)."""
    true, found = to_long(base, [], features), to_long(complete, ["iteration"], features)
    keys = ["iteration", "feature"]

    true_mean = true.groupBy("feature").agg(F.avg("value").alias("true"))
    means = mean_intervals(found, keys).select(*keys, F.lit("mean").alias("statistic"), F.col("mean").alias("estimate"),
                                               "low", "high").join(true_mean, "feature")
    name = F.concat(F.lit("q"), F.col("prob").cast("string")).alias("statistic")
    true_q = exact_quantiles(true, ["feature"], "value", QUANTILES).withColumnRenamed("quantile", "true")
    brackets = interval_brackets(found, keys)
    found_q = exact_quantiles(found, keys, "value", QUANTILES, brackets).withColumnRenamed("quantile", "estimate")
    quantiles = quantile_intervals(found, keys, brackets=brackets).join(found_q, [*keys, "prob"]).join(true_q, ["feature", "prob"]).select(
        "feature", "iteration", name, "estimate", "low", "high", "true")
    each = means.select("feature", "iteration", "statistic", "estimate", "low", "high", "true").unionByName(quantiles)

    inside = F.coalesce(((F.col("low") <= F.col("true")) & (F.col("true") <= F.col("high"))).cast("double"), F.lit(0.0))
    per_feature = each.groupBy("statistic", "feature").agg(
        F.avg("estimate").alias("estimate"), F.max("true").alias("true"), F.avg(inside).alias("coverage"),
        # A feature with an undefined width in any iteration has no mean width.
        F.when(F.count(F.col("high") - F.col("low")) == F.count("*"), F.avg(F.col("high") - F.col("low"))).alias("width"))
    scores = per_feature.groupBy("statistic").agg(
        F.avg("estimate").alias("_e"), F.avg("true").alias("_t"),
        F.avg("coverage").alias("coverage"), F.avg("width").alias("width"))
    bias = F.col("_e") - F.col("_t")
    return scores.select("statistic", bias.alias("raw_bias"),
                         (100 * F.abs(bias / F.nullif(F.col("_t"), F.lit(0.0)))).alias("percent_bias"), "coverage", "width")
