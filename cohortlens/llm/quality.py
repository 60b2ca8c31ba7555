"""Quality rules with robust multivariate outliers.

Simple counts fail a text outright.  The texts that pass are described by a
vector of transformed statistics; per language and source a minimum covariance
determinant estimate gives centre and scatter, and texts whose Mahalanobis
distance is too large are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.session import written

from .exprs import SPACES, clear_of, let, set_apart, words

#: Statistics of the vector, and the least standard deviation each is taken to
#: have: below it differences are not evidence of anything.
VECTOR = ("v_length", "v_word", "v_symbol", "v_line", "v_repeat")
FLOORS = (0.5, 0.04, 0.02, 0.05, 0.05)
#: Words that one repeated window of three covers.
REPEAT_UNIT = 6
#: Share of normal texts whose distance the default cutoff admits.
ADMITTED = 0.9999
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
GROUP = ("_lang", "_source")


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of each whole text; zero for a null text."""
    docs, at, restored = set_apart(clear_of(docs, COUNTS))
    t = F.coalesce(F.col(at(text)), F.lit(""))
    symbols = "#*$%&|<>"
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return docs.select(
        "*",
        F.length(F.translate(t, SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, symbols, ""))).cast("bigint").alias("n_symbols"),
        let(words(t), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), _repeated(w).alias("r"))).alias("_w"),
        let(lines, lambda a: F.struct(F.size(a).cast("bigint").alias("n"),
                                      (F.size(a) - F.size(F.array_distinct(a))).cast("bigint").alias("d"))).alias("_l"),
    ).select(*restored.values(), F.col("_w.n").alias("n_words"), "word_chars", "n_symbols",
             F.col("_l.d").alias("n_dup_lines"), F.col("_w.r").alias("n_repeat_words"), F.col("_l.n").alias("n_lines"))


def _repeated(w: Column) -> Column:
    """Words in windows of three that occur twice or more in the array ``w``."""
    zero = F.lit(0).cast("bigint")
    windows = F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, w[i + 1], w[i + 2]))

    def covered(t):
        placed = F.array_sort(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(placed, lambda p: F.size(F.array_distinct(F.flatten(F.transform(
            F.filter(p, lambda x, j: (x["h"] == F.get(p, j - 1)["h"]) | (x["h"] == F.get(p, j + 1)["h"])),
            lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))).cast("bigint"))

    return F.when(F.size(w) < 4, zero).otherwise(let(windows, lambda t: F.when(
        F.size(F.array_distinct(t)) == F.size(t), zero).otherwise(covered(t))))


def failed(n_words: str = "n_words", n_repeat: str = "n_repeat_words") -> Column:
    return (F.col(n_words) < 50) | (100 * F.col(n_repeat) > 50 * F.col(n_words))


def _vector() -> list[Column]:
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    values = (F.log(n), F.log(chars / n), F.sqrt(F.col("n_symbols") / chars),
              F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))), F.sqrt(F.col("n_repeat_words") / n))
    return [v.cast("double").alias(name) for v, name in zip(values, VECTOR)]


def _noise() -> list[Column]:
    """Variance that each statistic of a text has from its own size.  The root of
    a count's share varies by half the root of the share that one count makes up:
    one repeated line of a short text says little, half of many lines a lot."""
    n, chars, lines = (F.greatest(c, F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    values = (F.lit(0.0), F.lit(0.0), 0.25 / chars, 0.25 / lines, 0.25 * REPEAT_UNIT / n)
    return [v.cast("double").alias(f"e_{i}") for i, v in enumerate(values)]


def _shrunk(factor: dict, scale: Column) -> list[Column]:
    """What is left of each deviation when a text's noise joins the scatter's variance."""
    spread = [scale * sum((factor[i, j] * factor[i, j] for j in range(i + 1)), F.lit(0.0)) for i in range(len(VECTOR))]
    return [F.sqrt(v / (v + F.col(f"e_{i}"))) for i, v in enumerate(spread)]


def _distance(center: Sequence[Column], factor: dict, left: Sequence[Column] | None = None) -> Column:
    """Squared Mahalanobis distance by forward substitution; ``factor`` holds
    the lower Cholesky factor of the scatter, ``left`` the part of each deviation that counts."""
    total = F.lit(0.0)
    solved: list[Column] = []
    for i, name in enumerate(VECTOR):
        rest = F.col(name) - center[i]
        if left:
            rest = rest * left[i]
        for j in range(i):
            rest = rest - factor[i, j] * solved[j]
        solved.append(rest / factor[i, i])
    for z in solved:
        total = total + z * z
    return total


def _cholesky(moments: DataFrame) -> DataFrame:
    """Adds the factor ``f_i_j`` of ``c_i_j`` with its floors, column by column."""
    p = len(VECTOR)
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"c_{i}_{j}") + F.lit(FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"f_{i}_{k}") * F.col(f"f_{j}_{k}")
            # Floors keep the scatter positive definite; the bound only meets rounding.
            value = F.sqrt(F.greatest(rest, F.lit((FLOORS[i] * 1e-3) ** 2))) if i == j else rest / F.col(f"f_{j}_{j}")
            moments = moments.withColumn(f"f_{i}_{j}", value)
    return moments


def _moments(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    p = len(VECTOR)
    parts = [F.avg(v).alias(f"m_{i}") for i, v in enumerate(VECTOR)]
    parts += [F.covar_pop(VECTOR[i], VECTOR[j]).alias(f"c_{i}_{j}") for i in range(p) for j in range(i + 1)]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *parts)


def _factor_columns() -> tuple[list[Column], dict]:
    p = len(VECTOR)
    return [F.col(f"m_{i}") for i in range(p)], {(i, j): F.col(f"f_{i}_{j}") for i in range(p) for j in range(i + 1)}


def estimates(rows: DataFrame, keys: Sequence[str], share: float = 0.75, steps: int = 4,
              accuracy: int = 2000) -> DataFrame:
    """A robust centre and scatter per group: columns ``m_i``, ``f_i_j``.

    Concentration steps start from two robust diagonal scatters around the
    median (median deviation, and half the spread between the 10% and 90%
    points).  Each step keeps the ``share`` of a group that is nearest and takes
    its mean and covariance, which never enlarges the determinant; the start
    that ends with the smaller determinant is used.  The cut is a mergeable
    quantile sketch, so no group meets in one task.  The scatter is scaled to
    the distances that a normal vector would have at that share.

    One job per step, over ``rows`` and a table with two rows per group.
    """
    p = len(VECTOR)
    starts = rows.groupBy(*keys).agg(*[F.percentile_approx(v, F.array(*map(F.lit, (.1, .5, .9))), accuracy).alias(f"q_{i}")
                                       for i, v in enumerate(VECTOR)])
    spread = rows.join(starts, list(keys)).groupBy(*keys).agg(
        *[F.percentile_approx(F.abs(F.col(v) - F.col(f"q_{i}")[1]), 0.5, accuracy).alias(f"d_{i}") for i, v in enumerate(VECTOR)])
    first = starts.join(spread, list(keys)).withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    center = [F.col(f"q_{i}")[1].alias(f"m_{i}") for i in range(p)]
    scale = [F.when(F.col("start") == 0, 1.4826 * F.col(f"d_{i}")).otherwise((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 2.5631)
             for i in range(p)]
    diagonal = [(scale[i] ** 2 if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i in range(p) for j in range(i + 1)]
    model = written(_cholesky(first.select(*keys, "start", *center, *diagonal)), "mcd-start")
    center, factor = _factor_columns()
    for step in range(steps + 1):
        placed = rows.join(model, list(keys)).select(*keys, "start", *VECTOR, _distance(center, factor).alias("_d"))
        cut = placed.groupBy(*keys, "start").agg(F.percentile_approx("_d", share, accuracy).alias("_cut"))
        if step == steps:
            model = model.join(cut, [*keys, "start"])
            break
        near = placed.join(cut, [*keys, "start"]).where("_d <= _cut")
        model = written(_cholesky(_moments(near, [*keys, "start"])), f"mcd-{step}")
    determinant = sum((F.log(F.col(f"f_{i}_{i}")) for i in range(p)), F.lit(0.0))
    best = F.min_by(F.struct("_cut", *[f"m_{i}" for i in range(p)], *[f"f_{i}_{j}" for i in range(p) for j in range(i + 1)]),
                    F.struct(determinant, F.col("start")))
    expected = chi2_quantile(share, p)
    return written(model.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*").withColumn(
        "_scale", F.greatest(F.col("_cut") / expected, F.lit(1.0))).drop("_cut"), "mcd")


def chi2_quantile(share: float, p: int) -> float:
    """Quantile of a chi-squared distribution (Wilson and Hilferty)."""
    from statistics import NormalDist
    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(share) * math.sqrt(2 / (9 * p))) ** 3


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                  cutoff: float | None = None, least: int = 50) -> DataFrame:
    """Every column of ``docs``, the counts, ``base_failed``, ``distance`` and ``kept``.

    A text fails outright with fewer than 50 words, or if more than half of its
    words lie in repeated windows of three.  Among the others, those whose
    squared robust distance is above ``cutoff`` are rejected; by default that is
    the quantile ``ADMITTED`` of a normal vector's distances.  A text's own noise
    (its counts are whole numbers) is part of the variance it is held against.  A group of
    language and source with fewer than ``least`` such texts has no scatter of
    its own and uses that of its language, and a language with too few that of
    all texts.  Null languages and sources form groups of their own; a null or
    empty text fails outright with ``distance`` null.  Repeated rows are all
    kept and all count.  Columns of ``docs`` with the added names are replaced.

    Writes the statistics once and runs a few jobs over them while it is built.
    """
    docs, at, restored = set_apart(clear_of(docs, [*COUNTS, "base_failed", "distance", "kept"]))
    counted = text_counts(docs, at(text))
    slim = counted.select(F.coalesce(F.concat(F.lit("="), at(lang)), F.lit("")).alias("_lang"),
                          F.coalesce(F.concat(F.lit("="), at(source)), F.lit("")).alias("_source"),
                          *[c for c in counted.columns if c != at(text)]).withColumn("base_failed", failed())
    table = written(slim, "quality")
    good = table.where(~F.col("base_failed")).select(*GROUP, *_vector())
    sizes = written(good.groupBy(*GROUP).count(), "quality-sizes")
    per_lang = sizes.groupBy("_lang").agg(F.sum("count").alias("_lang_count"))
    # Each text takes part in the estimates of its group, its language and all texts.
    level = F.when(F.col("count") >= least, 0).when(F.col("_lang_count") >= least, 1).otherwise(2)
    choice = sizes.join(per_lang, "_lang").select(*GROUP, level.alias("_level"))
    marks = [F.struct(F.lit(0).alias("level"), F.col("_lang").alias("a"), F.col("_source").alias("b")),
             F.struct(F.lit(1).alias("level"), F.col("_lang").alias("a"), F.lit("").alias("b")),
             F.struct(F.lit(2).alias("level"), F.lit("").alias("a"), F.lit("").alias("b"))]
    needed = choice.select(F.when(F.col("_level") == 0, marks[0]).when(F.col("_level") == 1, marks[1]).otherwise(
        marks[2]).alias("k")).distinct()
    rows = good.withColumn("k", F.explode(F.array(*marks))).join(needed, "k", "left_semi").select(
        F.col("k.level").alias("_level"), F.col("k.a").alias("_a"), F.col("k.b").alias("_b"), *VECTOR)
    model = estimates(written(rows, "quality-rows"), ["_level", "_a", "_b"])
    placed = table.select("*", *_vector(), *_noise()).join(choice, list(GROUP), "left").withColumns({
        "_a": F.when(F.col("_level") < 2, F.col("_lang")).otherwise(""),
        "_b": F.when(F.col("_level") == 0, F.col("_source")).otherwise("")}).join(model, ["_level", "_a", "_b"], "left")
    center, factor = _factor_columns()
    distance = F.when(~F.col("base_failed"), _distance(center, factor, _shrunk(factor, F.col("_scale"))) / F.col("_scale"))
    cutoff = chi2_quantile(ADMITTED, len(VECTOR)) if cutoff is None else cutoff
    kept = ~F.col("base_failed") & (F.coalesce(F.col("_distance"), F.lit(0.0)) <= cutoff)
    return placed.withColumn("_distance", distance).select(
        *[c for name, c in restored.items() if name.lower() != text.lower()], *COUNTS, "base_failed",
        F.col("_distance").alias("distance"), kept.alias("kept"))
