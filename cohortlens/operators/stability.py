"""Splits, clustering, and the choice of the number of clusters by stability."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, join_on_keys, proportion_half_width
from ..session import written
from . import neighbors as N, packed
from .cohort import SUBJECT
from .ordering import hash32, with_rank

MAX_MICRO = 1000
FITS_AT_ONCE = 4


# ---- splits -----------------------------------------------------------------

def train_test(df: DataFrame, strata: Sequence[str] = (), test_size: float = 0.45, row_id: str = SUBJECT,
               seed: int = 42, draw: Column | None = None) -> DataFrame:
    """Column ``split`` (train/test): in each stratum the rows with the
    smallest draws train, rounded down to ``(1 - test_size) * n`` (the share is
    exact to nine decimals)."""
    drawn = df.withColumn("_draw", hash32(row_id, seed=seed) if draw is None else draw)
    ranked = with_rank(drawn, list(strata), "_draw", [row_id], "_rank", "_size")
    share = F.lit(10 ** 9 - round(10 ** 9 * test_size)).cast("decimal(10,0)")
    train = F.col("_rank") <= F.floor(F.col("_size").cast("decimal(18,0)") * share / F.lit(10 ** 9).cast("decimal(10,0)"))
    return ranked.withColumn("split", F.when(train, "train").otherwise("test")).drop("_draw", "_rank", "_size")


def with_folds(df: DataFrame, folds: int, order: str = SUBJECT, strata: Sequence[str] = ()) -> DataFrame:
    """Column ``fold`` 0 .. folds-1: contiguous runs of an order of any type with
    sizes that differ by at most one, the longer first; or, with strata,
    dealt out in turn within each stratum."""
    ranked = with_rank(df, list(strata), order, [order], "_rank", "_size", span=None)
    at, n = F.col("_rank") - 1, F.col("_size")
    if strata:
        fold = at % folds
    else:
        short, longer = F.floor(n / folds), n % folds
        cut = longer * (short + 1)
        fold = F.when(at < cut, F.floor(at / (short + 1))).otherwise(
            longer + F.floor((at - cut) / F.greatest(short, F.lit(1))))
    return ranked.withColumn("fold", fold.cast("int")).drop("_rank", "_size")


# ---- embedding and clustering -----------------------------------------------

def embed(train: DataFrame, others: Sequence[DataFrame], features: Sequence[str], dims: int = 2,
          prefix: str = "e") -> list[DataFrame]:
    """Standardized principal components ``e0, e1, ...`` fitted on train and
    applied to train and the other tables; the features are replaced."""
    steps = Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="_x"),
        StandardScaler(inputCol="_x", outputCol="_z", withMean=True),
        PCA(k=dims, inputCol="_z", outputCol="_p")]).fit(train)
    out = []
    for df in (train, *others):
        parts = vector_to_array("_p")
        out.append(steps.transform(df).select(
            *[c for c in df.columns if c not in features],
            *[parts[i].alias(f"{prefix}{i}") for i in range(dims)]))
    return out


@dataclass
class WardTree:
    """Micro-clusters of a table and the tree that merges them.

    ``leaves`` are the model's centres that hold rows, in order.
    """

    model: object
    features: Sequence[str]
    sizes: np.ndarray
    merges: list[tuple[int, int, float, int]]
    leaves: np.ndarray

    def cut(self, k: int) -> list[int]:
        """Label 0 .. k-1 of each micro-cluster, numbered by first appearance."""
        m = len(self.sizes)
        member = {i: [i] for i in range(m)}
        for step, (a, b, _, _) in enumerate(self.merges[:max(m - k, 0)]):
            member[m + step] = member.pop(a) + member.pop(b)
        labels = [0] * m
        for label, group in enumerate(sorted(member.values(), key=min)):
            for i in group:
                labels[i] = label
        return labels

    def label(self, df: DataFrame, ks: Sequence[int]) -> DataFrame:
        """Adds ``cluster_<k>`` for each k: the micro-cluster's label, looked up."""
        assembler = VectorAssembler(inputCols=list(self.features), outputCol="_x")
        scored = self.model.transform(assembler.transform(df))
        points = np.asarray(self.model.clusterCenters(), float)
        # A centre that held no rows of the fit takes the label of the nearest leaf.
        near = [int(np.argmin(((points[self.leaves] - p) ** 2).sum(axis=1))) for p in points]
        cuts = {f"cluster_{k}": F.element_at(F.array(*[F.lit(self.cut(k)[i]) for i in near]), F.col("_micro") + 1) for k in ks}
        return scored.select(*df.columns, *[c.alias(n) for n, c in cuts.items()])

    def linkage(self, spark) -> DataFrame:
        """Merge table: node ``m + step`` joins ``left`` and ``right``."""
        return spark.createDataFrame([(i, a, b, h, n) for i, (a, b, h, n) in enumerate(self.merges)],
                                     "step int, `left` int, `right` int, height double, n bigint")


def _merge_centers(centers: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Ward merges of at most MAX_MICRO weighted centres."""
    centers, weight = centers.astype(float).copy(), sizes.astype(float).copy()
    m = len(weight)
    node, alive, merges = np.arange(m), np.ones(m, bool), []
    square = ((centers[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)
    cost = square * 2 * np.outer(weight, weight) / (weight[:, None] + weight[None, :])
    np.fill_diagonal(cost, np.inf)
    for step in range(m - 1):
        i, j = np.unravel_index(np.argmin(cost), cost.shape)
        i, j = min(i, j), max(i, j)
        height, n = math.sqrt(max(cost[i, j], 0.0)), weight[i] + weight[j]
        merges.append((int(min(node[i], node[j])), int(max(node[i], node[j])), height, int(round(n))))
        centers[i] = (weight[i] * centers[i] + weight[j] * centers[j]) / n
        weight[i], node[i], alive[j] = n, m + step, False
        cost[j, :] = cost[:, j] = np.inf
        others = np.flatnonzero(alive & (np.arange(m) != i))
        d = ((centers[others] - centers[i]) ** 2).sum(axis=1)
        cost[i, others] = cost[others, i] = d * 2 * weight[others] * n / (weight[others] + n)
    return merges


def ward(df: DataFrame, features: Sequence[str], micro: int = 100, seed: int = 42, iterations: int = 10) -> WardTree:
    """Ward clustering in two stages: k-means micro-clusters on Spark, then
    Ward merging of their (at most 1,000) weighted centres on the driver.  One
    tree serves every number of clusters.

    A table with fewer distinct rows than ``micro`` has as many leaves as the
    fit finds centres; leaves are weighted by the rows they hold, and empty ones
    are left out."""
    if micro > MAX_MICRO:
        raise ValueError(f"at most {MAX_MICRO} micro-clusters")
    vectors = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df).select("_x").persist()
    try:
        model = KMeans(k=micro, featuresCol="_x", predictionCol="_micro", seed=seed, maxIter=iterations).fit(vectors)
        held = dict(model.transform(vectors).groupBy("_micro").count().collect())
    finally:
        vectors.unpersist()
    leaves = np.array(sorted(held))
    sizes = np.array([held[i] for i in leaves])
    return WardTree(model, list(features), sizes, _merge_centers(np.asarray(model.clusterCenters())[leaves], sizes), leaves)


# ---- agreement of labellings ------------------------------------------------

def zero_one_loss(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose labels differ."""
    return df.groupBy(*by).agg(F.avg((col(a) != col(b)).cast("double")).alias("loss"))


def _assign(overlap: np.ndarray) -> np.ndarray:
    """Column for each row of a square table so that the total is largest, by
    repeated shortest augmenting paths; k is the number of clusters, so small."""
    cost = overlap.max() - overlap
    k = len(cost)
    row_price, col_price, owner = np.zeros(k), np.zeros(k), np.full(k, -1)
    for start in range(k):
        best, via, done = np.full(k, np.inf), np.full(k, -1), np.zeros(k, bool)
        row, column, base = start, -1, 0.0
        reached = []
        while True:
            slack = base + cost[row] - row_price[row] - col_price
            better = ~done & (slack < best)
            best[better], via[better] = slack[better], column
            column = int(np.argmin(np.where(done, np.inf, best)))
            base, done[column] = best[column], True
            reached.append(column)
            if owner[column] < 0:
                break
            row = owner[column]
        row_price[start] += base
        for c in reached[:-1]:
            row_price[owner[c]] += base - best[c]
            col_price[c] -= base - best[c]
        while column >= 0:
            previous = via[column]
            owner[column] = start if previous < 0 else owner[previous]
            column = previous
    out = np.empty(k, int)
    out[owner] = np.arange(k)
    return out


def align_labels(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Best one-to-one renaming of predicted labels per run.

    ``counts``: ``(*by, truth, predicted, n)``, at most k x k rows per run.
    Result: ``(*by, predicted, aligned, matched)``.  Labels that occur on one
    side only are matched with a spare label of the other side, or renamed
    to -1 if there is none.
    """
    by = list(by) or ["_all"]
    if by == ["_all"]:
        counts = counts.withColumn("_all", F.lit(0))
    schema = ", ".join([*(f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in by),
                        "predicted int, aligned int, matched bigint"])

    def best(pdf):
        truth, predicted = sorted(pdf["truth"].unique()), sorted(pdf["predicted"].unique())
        k = max(len(truth), len(predicted))
        table = np.zeros((k, k))
        for t, p, n in zip(pdf["truth"], pdf["predicted"], pdf["n"]):
            table[predicted.index(p), truth.index(t)] = n
        to = _assign(table)
        out = pd.DataFrame({"predicted": predicted,
                            "aligned": [truth[to[i]] if to[i] < len(truth) else -1 for i in range(len(predicted))],
                            "matched": [int(table[i, to[i]]) for i in range(len(predicted))]})
        for c in by:
            out.insert(0, c, pdf[c].iloc[0])
        return out[[*by, "predicted", "aligned", "matched"]]

    found = counts.select(*by, col("truth").cast("int").alias("truth"), col("predicted").cast("int").alias("predicted"), "n")
    return found.groupBy(*by).applyInPandas(best, schema).drop("_all")


def aligned_loss(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Zero-one loss after the best renaming, from label pair counts."""
    by = list(by)
    total = counts.groupBy(*by).agg(F.sum("n").alias("_n"))
    matched = align_labels(counts, by).groupBy(*by).agg(F.sum("matched").alias("_m"))
    if not by:
        total, matched, keys = total.withColumn("_k", F.lit(0)), matched.withColumn("_k", F.lit(0)), ["_k"]
    else:
        keys = by
    return join_on_keys(total, matched, keys).select(*by, (1 - F.col("_m") / F.col("_n")).alias("loss"))


def plain_loss(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    same = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0))
    return counts.groupBy(*by).agg((1 - same / F.sum("n")).alias("loss"))


# ---- train / test steps ------------------------------------------------------

def permuted_labels(labels: DataFrame, iterations: int, by: Sequence[str], label: str = "label",
                    row_id: str = SUBJECT, seed: int = 0) -> DataFrame:
    """Labels shuffled over the rows of each key, once per iteration.

    Two random orders of the same rows are matched rank by rank; ranks come
    from hash buckets, so a run's rows never gather in one task.
    """
    by = list(by)
    ids = labels.select(*by, row_id).withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    places = with_rank(ids.withColumn("_h", hash32(row_id, "iter", *by, seed=seed * 2 + 1)), [*by, "iter"], "_h",
                       [row_id], "_r").drop("_h")
    cards = with_rank(labels.select(*by, row_id, label).withColumn("_h", hash32(row_id, *by, seed=seed * 2 + 2)), by,
                      "_h", [row_id], "_r").select(*by, "_r", label)
    return join_on_keys(places, cards, [*by, "_r"]).drop("_r")


def _pair_counts(predictions: DataFrame, truth: DataFrame, by: Sequence[str], row_id: str) -> DataFrame:
    """Counts of (truth, predicted) per run; ``truth`` may lack the run's
    iteration, which then applies to each."""
    shared = [c for c in by if c in truth.columns]
    joined = predictions.withColumnRenamed("query_id", row_id).join(
        truth.select(*shared, row_id, col("label").alias("truth")), [*shared, row_id])
    return joined.groupBy(*by, "truth", "predicted").agg(F.count("*").alias("n"))


@dataclass
class Runs:
    """Clustered train and test rows of several runs, and their neighbours.

    ``labels``: ``(run, k, split, row_id, label)``; ``near``: ``(run, split,
    query_id, neighbor_id)`` with neighbours from the run's train rows.
    """

    labels: DataFrame
    near: DataFrame
    row_id: str = SUBJECT

    def _of(self, split):
        return self.labels.filter(F.col("split") == split).drop("split")

    def _near(self, split):
        return self.near.filter(F.col("split") == split).drop("split", "dist")

    def errors(self) -> DataFrame:
        """Per run and k: disagreement of the classifier with the clustering,
        on train as it is and on test after alignment: ``(run, k, split, error)``."""
        by, train = ["run", "k"], self._of("train")
        losses = []
        for split, loss in (("train", plain_loss), ("test", aligned_loss)):
            predicted = N.vote(self._near(split), train, by, self.row_id)
            losses.append(loss(_pair_counts(predicted, self._of(split), by, self.row_id), by).select(
                *by, F.lit(split).alias("split"), F.col("loss").alias("error")))
        return losses[0].unionByName(losses[1])

    def all_errors(self, iterations: int, seed: int = 0) -> DataFrame:
        """``errors`` beside their mean over shuffles of the train labels:
        ``(run, k, split, error, random_error)``, all in one pass."""
        return packed.labelling_errors(self.labels, self.near, iterations, self.row_id, _agreeing, seed)

    def random_errors(self, iterations: int, seed: int = 0) -> DataFrame:
        """The errors with the train labels shuffled, averaged over iterations:
        ``(run, k, split, random_error)``.  Test clusterings stay unshuffled."""
        return self.all_errors(iterations, seed).drop("error")


def _agreeing(table: np.ndarray) -> int:
    """Rows that agree after the best renaming, from counts of (truth, vote)."""
    votes = table.T.astype(float)
    return int(votes[np.arange(len(votes)), _assign(votes)].sum())


ClusterFn = Callable[[DataFrame, Sequence[str]], WardTree]


def cluster_runs(runs: Sequence[tuple[int, DataFrame, DataFrame]], features: Sequence[str], ks: Sequence[int],
                 k_neighbors: int = 10, row_id: str = SUBJECT, cluster: ClusterFn = ward) -> Runs:
    """Cluster train and test of each run independently and find neighbours.

    Fitting is the only step done run by run, a few at a time; rows of all runs
    then go through one neighbour search.  Both results are written, as every k
    and iteration reads them.
    """
    ks, features = list(ks), list(features)

    def labelled(job):
        run, split, part = job
        part = part.select(row_id, *features)
        return cluster(part, features).label(part, ks).select(
            F.lit(run).alias("run"), F.lit(split).alias("split"), "*")

    jobs = [(run, split, part) for run, train, test in runs for split, part in (("train", train), ("test", test))]
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        parts = list(pool.map(inheritable_thread_target(jobs[0][2].sparkSession)(labelled), jobs))
    rows = written(reduce(DataFrame.unionByName, parts), "runs")
    each_k = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), col(f"cluster_{k}").alias("label")) for k in ks]))
    labels = rows.select("run", "split", row_id, each_k.alias("_l")).select("run", "split", row_id, "_l.*")
    train = rows.filter(F.col("split") == "train")
    # One search over the rows of both splits: a row is in one split of a run.
    near = N.nearest_neighbors(train, rows, features, k_neighbors, row_id, ["run"])
    near = near.join(rows.select("run", "split", col(row_id).alias("query_id")), ["run", "query_id"])
    return Runs(labels, written(near, "neighbors"), row_id)


def fold_runs(df: DataFrame, folds: int, order: str = SUBJECT, strata: Sequence[str] = ()):
    """(run, train, validation) per fold; the folded table is written once."""
    folded = written(with_folds(df, folds, order, strata), "folds")
    return [(f, folded.filter(F.col("fold") != f), folded.filter(F.col("fold") == f)) for f in range(folds)]


@dataclass
class Choice:
    """Scores of the search and the chosen number of clusters, all lazy."""

    fold_scores: DataFrame
    scores: DataFrame

    @property
    def best(self) -> DataFrame:
        return best_k(self.scores.filter(F.col("split") == "test"))


def score_folds(errors: DataFrame, random: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Per-fold errors over the mean random train error of their k, and per k
    the mean error over the mean random error of its split; no baseline or a
    zero one leaves no normalized fold score and the plain mean."""
    if random is None:
        random = errors.select("run", "k", "split", F.lit(None).cast("double").alias("random_error"))
    base = random.groupBy("k", "split").agg(F.avg("random_error").alias("random_error"))
    train_base = base.filter(F.col("split") == "train").select("k", F.col("random_error").alias("_base"))
    per_fold = errors.join(train_base, "k", "left").select(
        col("run").alias("fold"), "k", "split", "error",
        (F.col("error") / F.nullif(F.col("_base"), F.lit(0.0))).alias("normalized"))
    mean = errors.groupBy("k", "split").agg(F.avg("error").alias("error"))
    scores = mean.join(base, ["k", "split"], "left").withColumn(
        "score", F.coalesce(F.col("error") / F.nullif(F.col("random_error"), F.lit(0.0)), F.col("error")))
    return per_fold, scores


def best_k(scores: DataFrame) -> DataFrame:
    """The k with the smallest score, the largest such k on ties."""
    return scores.orderBy(F.col("score").asc(), F.col("k").desc()).limit(1).select("k", "score")


def choose_k(df: DataFrame, features: Sequence[str], ks: Sequence[int] = range(2, 11), folds: int = 10,
             rand_iter: int | None = 100, k_neighbors: int = 10, row_id: str = SUBJECT, order: str | None = None,
             strata: Sequence[str] = (), cluster: ClusterFn = ward) -> Choice:
    """Cross-validated stability of each k, normalized by shuffled labels."""
    runs = cluster_runs(fold_runs(df, folds, order or row_id, strata), features, ks, k_neighbors, row_id, cluster)
    if rand_iter:
        both = written(runs.all_errors(rand_iter), "errors")
        per_fold, scores = score_folds(both.drop("random_error"), both.drop("error"))
    else:
        per_fold, scores = score_folds(runs.errors(), None)
    return Choice(per_fold, scores)


def evaluate(train: DataFrame, test: DataFrame, features: Sequence[str], k: int, k_neighbors: int = 10,
             row_id: str = SUBJECT, cluster: ClusterFn = ward) -> tuple[DataFrame, DataFrame]:
    """Errors on train and held-out test for a chosen k, and every row's labels:
    ``(split, error)`` and ``(split, row_id, clustering, classification)``."""
    runs = cluster_runs([(0, train, test)], features, [k], k_neighbors, row_id, cluster)
    predicted = N.vote(runs.near.drop("split", "dist"), runs._of("train"), ["run", "k"], row_id)
    labels = runs.labels.withColumnRenamed("label", "clustering").join(
        predicted.select("run", "k", col("query_id").alias(row_id), F.col("predicted").alias("classification")),
        ["run", "k", row_id]).select("split", row_id, "clustering", "classification")
    return runs.errors().select("split", "error"), labels


def stability_curve(scores: DataFrame) -> DataFrame:
    """Mean normalized score per k and split with the 95% half width of a
    proportion; a mean above 1 is no proportion and has none."""
    means = scores.groupBy("k", "split").agg(F.avg("normalized").alias("mean"), F.count("normalized").alias("_n"))
    width = F.when(F.col("mean") <= 1, proportion_half_width(F.col("mean"), F.col("_n")))
    return means.select("k", "split", "mean", width.alias("half_width"))
