"""Statistical comparison of clusters.

Every test starts from one aggregate over the subjects (moments per cluster, or
a contingency table); what follows works on its few result rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import probability as P
from ..functions.columns import col, join_on_keys, missing_indicator, to_long
from .cohort import SUBJECT
from .ordering import exact_quantiles, five_numbers


def moments(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """Size, mean and sample variance: ``(feature, cluster, n, mean, var)``.

    All features in one aggregate; its result rows are turned long.
    """
    stats = df.groupBy(col(cluster).alias("cluster")).agg(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.count(col(c)).alias("n"), F.avg(col(c)).alias("mean"),
                 F.var_samp(col(c)).alias("var")) for c in features]).alias("_s"))
    return stats.filter(F.col("cluster").isNotNull()).select("cluster", F.explode("_s").alias("_s")).select(
        F.col("_s.feature").alias("feature"), "cluster", "_s.n", "_s.mean", "_s.var")


def _pairs(stats: DataFrame, keys: Sequence[str], group: str, others: Sequence[str]) -> DataFrame:
    """Each two groups of one key side by side, ``group_a`` < ``group_b``."""
    side = lambda s: stats.select(*keys, *[col(c).alias(f"{n}_{s}") for c, n in [(group, "group"), *zip(others, others)]])
    return side("a").join(side("b"), list(keys)).filter(F.col("group_a") < F.col("group_b"))


def welch(stats: DataFrame, alternative: str = "two-sided") -> DataFrame:
    """Welch t test between the two clusters of each feature, from ``moments``;
    features with another number of clusters are left out.  ``less``: the first
    cluster's mean is smaller."""
    only_two = stats.groupBy("feature").agg(F.count("*").alias("_k")).filter(F.col("_k") == 2).drop("_k")
    two = _pairs(stats.join(only_two, "feature"), ["feature"], "cluster", ["n", "mean", "var"])
    a, b = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    out = two.select(
        "feature",
        ((F.col("mean_a") - F.col("mean_b")) / F.nullif(F.sqrt(a + b), F.lit(0.0))).alias("t"),
        ((a + b) * (a + b) / F.nullif(a * a / (F.col("n_a") - 1) + b * b / (F.col("n_b") - 1), F.lit(0.0))).alias("df"),
        "mean_a", "mean_b")
    return out.withColumn("p", P.t_p_value("t", "df", alternative))


def anova(stats: DataFrame) -> DataFrame:
    """One-way analysis of variance per feature, from ``moments``."""
    n, mean, var = F.col("n"), F.col("mean"), F.col("var")
    total = stats.filter(n > 0).groupBy("feature").agg(
        F.count("*").alias("_k"), F.sum("n").alias("_n"), (F.sum(n * mean) / F.sum(n)).alias("_grand"),
        F.sum(F.when(n > 1, (n - 1) * var).otherwise(0.0)).alias("ss_within"))
    between = stats.filter(n > 0).join(total.select("feature", "_grand"), "feature").groupBy("feature").agg(
        F.sum(n * (mean - F.col("_grand")) * (mean - F.col("_grand"))).alias("ss_between"))
    out = total.join(between, "feature").select(
        "feature", (F.col("_k") - 1).cast("double").alias("df_between"),
        (F.col("_n") - F.col("_k")).cast("double").alias("df_within"), "ss_between", "ss_within")
    f = (F.col("ss_between") / F.nullif(F.col("df_between"), F.lit(0.0))) / F.nullif(
        F.col("ss_within") / F.nullif(F.col("df_within"), F.lit(0.0)), F.lit(0.0))
    return out.withColumn("f", f).withColumn("p", P.f_p_value("f", "df_between", "df_within"))


def holm(tests: DataFrame, keys: Sequence[str], p: str = "p", name: str = "p_holm",
         order: Sequence[str] = ("group_a", "group_b")) -> DataFrame:
    """Holm-adjusted p values within each key (one row per test there)."""
    within = Window.partitionBy(*keys)
    ranked = within.orderBy(col(p).asc_nulls_last(), *order)
    scaled = (F.count(col(p)).over(within) - F.row_number().over(ranked) + 1) * col(p)
    running = F.max("_scaled").over(ranked.rowsBetween(Window.unboundedPreceding, 0))
    return tests.withColumn("_scaled", scaled).withColumn(
        name, F.when(col(p).isNotNull(), F.least(running, F.lit(1.0)))).drop("_scaled")


def pairwise_t(stats: DataFrame, keys: Sequence[str] = ("feature",), group: str = "cluster") -> DataFrame:
    """t tests between every two groups of each key with the standard deviation
    pooled over all its groups, Holm adjusted."""
    keys = list(keys)
    stats = stats.filter(F.col("n") > 0)
    pooled = stats.groupBy(*keys).agg(
        (F.sum("n") - F.count("*")).cast("double").alias("df"),
        F.sum(F.when(F.col("n") > 1, (F.col("n") - 1) * F.col("var")).otherwise(0.0)).alias("_ss"))
    two = _pairs(stats, keys, group, ["n", "mean"]).join(pooled, keys)
    spread = F.sqrt(F.col("_ss") / F.nullif(F.col("df"), F.lit(0.0)) * (1 / F.col("n_a") + 1 / F.col("n_b")))
    out = two.select(*keys, "group_a", "group_b",
                     ((F.col("mean_a") - F.col("mean_b")) / F.nullif(spread, F.lit(0.0))).alias("t"), "df")
    return holm(out.withColumn("p", P.t_p_value("t", "df")), keys)


def feature_comparison(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """Pairwise t tests between the features of each cluster."""
    return pairwise_t(moments(df, cluster, features), ["cluster"], "feature")


# ---- counts -----------------------------------------------------------------

def contingency(df: DataFrame, category: str, cluster: str) -> DataFrame:
    """Counts of category x cluster in long form; NULLs are left out."""
    return df.filter(col(category).isNotNull() & col(cluster).isNotNull()).groupBy(
        col(category).cast("string").alias("category"), col(cluster).alias("cluster")).agg(F.count("*").alias("n"))


def contingency_wide(df: DataFrame, category: str, cluster: str, clusters: Sequence) -> DataFrame:
    """The same with one column per cluster."""
    table = contingency(df, category, cluster)
    return table.groupBy("category").agg(*[
        F.coalesce(F.sum(F.when(F.col("cluster") == c, F.col("n"))), F.lit(0)).alias(f"cluster_{c}") for c in clusters])


def chi_squared(table: DataFrame) -> DataFrame:
    """Independence test of a long contingency table ``(category, cluster, n)``:
    ``(chi2, df, p)``; continuity correction for 2 x 2 tables only.

    Cells nobody is in count: their squared deviation is their expectation, and
    the expectations of all cells add up to the total.
    """
    rows = table.groupBy("category").agg(F.sum("n").alias("_row"))
    cols = table.groupBy("cluster").agg(F.sum("n").alias("_col"))
    shape = rows.agg(F.struct(F.count("*").alias("r"), F.sum("_row").alias("total"))).scalar()
    width = cols.agg(F.count("*")).scalar()
    cells = table.join(rows, "category").join(cols, "cluster").withColumn("_shape", shape).withColumn("_c", width)
    total = F.col("_shape.total")
    expected = F.col("_row") * F.col("_col") / total
    gap = F.abs(F.col("n") - expected)
    sums = cells.withColumn("_e", expected).withColumn("_gap", gap).groupBy("_shape", "_c").agg(
        F.sum(F.col("_gap") * F.col("_gap") / F.col("_e")).alias("_plain"), F.sum("_e").alias("_seen"),
        F.max("_gap").alias("_max_gap"))
    plain = F.col("_plain") + (total - F.col("_seen"))
    # In a 2 x 2 table all four cells deviate by the same amount.
    two = (F.col("_shape.r") == 2) & (F.col("_c") == 2)
    less = F.greatest(F.col("_max_gap") - F.least(F.lit(0.5), F.col("_max_gap")), F.lit(0.0))
    corrected = plain / F.nullif(F.col("_max_gap") * F.col("_max_gap"), F.lit(0.0)) * less * less
    out = sums.select(
        F.when(two, F.coalesce(corrected, F.lit(0.0))).otherwise(plain).alias("chi2"),
        ((F.col("_shape.r") - 1) * (F.col("_c") - 1)).cast("double").alias("df"))
    return out.withColumn("p", P.chi2_p_value("chi2", "df"))


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    return df.groupBy(cluster).agg(F.count("*").alias("n"))


def membership_flow(df: DataFrame, first: str, second: str, category: str) -> DataFrame:
    """Subjects by cluster in two clusterings and a category."""
    return df.groupBy(first, second, category).agg(F.count("*").alias("n"))


# ---- distributions ----------------------------------------------------------

def boxplots(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """Five-number summary per feature and cluster."""
    return five_numbers(to_long(df, [cluster], features), ["feature", cluster], "value")


def distribution(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Present values, range, mean and median per feature."""
    values = to_long(df, [], features).filter(F.col("value").isNotNull())
    ends = values.groupBy("feature").agg(F.count("*").alias("n"), F.min("value").alias("minimum"),
                                         F.max("value").alias("maximum"), F.avg("value").alias("mean"))
    return ends.join(exact_quantiles(values, ["feature"], "value", [0.5]).select(
        "feature", F.col("quantile").alias("median")), "feature")


def histogram(df: DataFrame, features: Sequence[str], bins: int = 50) -> DataFrame:
    """Equal-width bins between a feature's minimum and maximum: ``(feature,
    bin, n)``, bins 0 to ``bins - 1`` with at least one value; a constant
    feature falls in the middle bin of a range of width 1."""
    values = to_long(df, [], features).filter(F.col("value").isNotNull())
    ends = values.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    position = F.when(span > 0, (F.col("value") - F.col("_lo")) / span).otherwise(0.5)
    number = F.least(F.floor(position * bins), F.lit(bins - 1)).cast("int")
    # One row per feature of the call.
    return values.join(F.broadcast(ends), "feature").groupBy("feature", number.alias("bin")).agg(F.count("*").alias("n"))


# ---- reports ----------------------------------------------------------------

def _report(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _line(df: DataFrame, test: str, statistic: str, degrees, p: str = "p", subject: str = "feature") -> DataFrame:
    return df.select(F.lit(test).alias("test"), col(subject).alias("variable"),
                     F.col(statistic).cast("double").alias("statistic"), degrees.alias("df"), F.col(p).alias("p"))


def _mean_tests(df: DataFrame, cluster: str, features: Sequence[str], alternative: str) -> list[DataFrame]:
    """Two clusters: Welch test.  More: analysis of variance and pairwise tests."""
    stats = moments(df, cluster, features)
    counted = stats.filter(F.col("n") > 0).withColumn(
        "_k", F.count("*").over(Window.partitionBy("feature")))
    many = counted.filter(F.col("_k") > 2).drop("_k")
    pairs = pairwise_t(many).withColumn("pair", F.concat_ws(":", "feature", "group_a", "group_b"))
    return [
        _line(welch(counted.filter(F.col("_k") == 2).drop("_k"), alternative), "welch", "t", F.col("df")),
        _line(anova(many), "anova", "f", F.col("df_within")),
        _line(pairs, "pairwise", "t", F.col("df"), "p_holm", "pair"),
    ]


def confounders(df: DataFrame, cluster: str, categories: Sequence[str] = ("sex", "site", "phenotype"),
                age: str = "interview_age") -> DataFrame:
    """Do categories and age differ between clusters?  Long report ``(test,
    variable, statistic, df, p)``."""
    tables = [_line(chi_squared(contingency(df, c, cluster)).withColumn("feature", F.lit(c)), "chi2", "chi2", F.col("df"))
              for c in categories]
    return _report([*tables, *_mean_tests(df, cluster, [age], "two-sided")])


def compare_missingness(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """Does missingness differ between clusters?  Same report per feature."""
    flags = df.select(cluster, *[missing_indicator(c).alias(c) for c in features])
    return _report(_mean_tests(flags, cluster, features, "two-sided"))


def compare_features(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """Do feature means differ between clusters (first smaller, if two)?"""
    return _report(_mean_tests(df, cluster, features, "less"))
