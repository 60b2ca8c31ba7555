"""Stratify a cohort: split, impute, embed, choose k, cluster, compare."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import pick_columns, with_min_max
from ..operators import clean, cohort, missing, neighbors, stability, views
from ..operators.clean import ORDER
from ..operators.cohort import SUBJECT
from ..session import written
from ..sources.writers import save_csv

# Name patterns of the two feature levels of the
# adaptive-behaviour instrument.
LEVEL_PATTERNS = {"subdomain": "vscore", "domain": "communication|livingskills|socialization"}
PERIODS = ("P1", "P2", "P3")


@dataclass(frozen=True)
class StratifyConfig:
    """Parameters of a run; the defaults are those of the original study."""

    periods: Sequence[str] = PERIODS
    levels: Mapping[str, str] = field(default_factory=lambda: dict(LEVEL_PATTERNS))
    missing_threshold: float = 0.60
    test_size: float = 0.45
    seed: int = 42
    impute_neighbors: int = 5
    vote_neighbors: int = 10
    ks: Sequence[int] = tuple(range(2, 11))
    folds: int = 10
    rand_iter: int | None = 100
    embed_dims: int = 2
    cluster: stability.ClusterFn = stability.ward


@dataclass
class LevelResult:
    """Outcome of one period and feature level."""

    choice: stability.Choice
    k: int
    errors: DataFrame
    labels: DataFrame
    points: DataFrame
    missing_by_cluster: DataFrame
    indicators: DataFrame


def select_rows(df: DataFrame, periods: Sequence[str], features: Sequence[str] | None = None,
                order: Sequence[str] = ORDER) -> DataFrame:
    """Rows of the periods, one per subject and period (the most complete),
    with the number of periods the subject has."""
    rows = clean.in_period(df, "|".join(periods)) if len(periods) > 1 else clean.in_period(df, periods[0])
    return views.with_period_count(clean.most_complete(rows, features, order=order))


def run_validation(train: DataFrame, test: DataFrame, raw_test: DataFrame, features: Sequence[str],
                   config: StratifyConfig = StratifyConfig(), row_id: str = SUBJECT) -> LevelResult:
    """Embed, choose k by stability on train, evaluate on test, and describe the
    missingness of the test rows as they were before imputation.

    Choosing k runs the search; everything else stays lazy.  Reported cluster
    numbers start at 1.
    """
    features = list(features)
    # Fitting reads its rows several times, and may be given rows that are still to be imputed.
    slim = lambda df: written(df.select(row_id, *features), "features")
    e_train, e_test = (written(x, "embedded") for x in stability.embed(
        slim(train), [slim(test)], features, config.embed_dims))
    axes = [c for c in e_train.columns if c != row_id]
    keyed = e_train.withColumn("_position", F.xxhash64(row_id).cast("double"))
    choice = stability.choose_k(keyed, axes, config.ks, config.folds, config.rand_iter, config.vote_neighbors,
                                row_id, "_position", cluster=config.cluster)
    best = choice.best.first()["k"]
    errors, labels = stability.evaluate(e_train, e_test, axes, best, config.vote_neighbors, row_id, config.cluster)
    labels = written(labels.withColumns({c: F.col(c) + 1 for c in ("clustering", "classification")}), "labels")
    points = e_train.withColumn("split", F.lit("train")).unionByName(e_test.withColumn("split", F.lit("test"))).join(
        labels.select("split", row_id, F.col("clustering").alias("cluster")), ["split", row_id])
    marked = raw_test.select(row_id, *features).join(
        labels.filter(F.col("split") == "test").select(row_id, F.col("clustering").alias("cluster")), row_id)
    return LevelResult(
        choice=choice, k=best, errors=errors, labels=labels, points=points,
        missing_by_cluster=missing.missing_by_cluster(marked, "cluster", features),
        indicators=clean.missing_indicators(marked, features, [row_id, "cluster"]))


@dataclass
class PeriodResult:
    """Test rows with clusters and demographics, and each level's outcome."""

    data: DataFrame
    levels: dict[str, LevelResult]
    scaled: dict[str, DataFrame]

    def distances(self, level: str, features: Sequence[str]) -> DataFrame:
        """Distances within and between clusters of scaled train and test rows."""
        return neighbors.distance_summary(self.scaled[level], "cluster", features, ["split"])

    def save(self, folder: str, period: str) -> None:
        save_csv(self.data, f"{folder}/data_{period}", [SUBJECT])
        for name, result in self.levels.items():
            save_csv(result.indicators, f"{folder}/missing_{name}_{period}")
            features = [c for c in self.scaled[name].columns if c not in (SUBJECT, "split", "cluster")]
            save_csv(self.distances(name, features), f"{folder}/distances_{name}_{period}", ["split", "cluster_a", "cluster_b"])


def stratify(df: DataFrame, demographics: DataFrame, instrument: str = "vineland",
             config: StratifyConfig = StratifyConfig(), order: Sequence[str] = ORDER) -> dict[str, PeriodResult]:
    """The whole run for one instrument's level table, per period."""
    features_all = pick_columns(df.columns, "score|total")
    rows = written(select_rows(df, config.periods, features_all, order), "selected")
    out = {}
    for period in config.periods:
        prepared = missing.prepare_imputation({instrument: rows.select(
            SUBJECT, "interview_age", "interview_period", "intersection_count", *features_all)},
            period, config.missing_threshold)[instrument]
        features = [c for c in features_all if c in prepared.columns]
        split = written(stability.train_test(prepared, ["countna", "intersection_count"], config.test_size,
                                             SUBJECT, config.seed), "split")
        train, test = (split.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
        i_train, i_test = (written(x, "imputed") for x in neighbors.impute(train, test, features, config.impute_neighbors))
        data, levels, scaled = i_test.select(SUBJECT, "interview_age", *features), {}, {}
        for name, pattern in config.levels.items():
            chosen = pick_columns(features, pattern)
            result = run_validation(i_train, i_test, test, chosen, config)
            levels[name] = result
            test_labels = result.labels.filter(F.col("split") == "test")
            data = data.join(test_labels.select(SUBJECT, F.col("clustering").alias(f"cluster_{name}")), SUBJECT)
            both = i_train.select(SUBJECT, *chosen).withColumn("split", F.lit("train")).unionByName(
                i_test.select(SUBJECT, *chosen).withColumn("split", F.lit("test")))
            scaled[name] = with_min_max(both.join(
                result.labels.select("split", SUBJECT, F.col("clustering").alias("cluster")), ["split", SUBJECT]),
                chosen, ["split"])
        out[period] = PeriodResult(cohort.join_demographics(data, demographics), levels, scaled)
    return out
