"""k-means over a vector-approximation file.

Vectors of whole numbers are compressed to a few bits per dimension: the number
of the cell that holds the component.  The squared distance of a vector and a
centroid is the vector's own square, which is the same for all centroids, and
per dimension ``c * c - 2 * x * c``.  For each centroid a table holds the least
and the greatest such value of every cell of every dimension, so that adding up
table entries by a vector's cells gives an interval of its distance to each
centroid, up to its own square.  Where one centroid's interval ends before the
others begin, the approximation alone decides; only where intervals overlap the
full vector is fetched, by a join on the row.  Centroids are kept as exact sums:
a round fetches and adds what changed its cluster.  All numbers are integers, so
ties and results are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import col
from ..session import written
from .exprs import clear_of

#: Components beyond this are held at it: squared distances must fit 64 bits.
LARGEST = 1 << 27
#: Rows from which the borders of the cells are taken; every row gets its cells.
BORDER_ROWS = 4096
BLOCK = 1024
RESULT = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def whole_vectors(vector: Column, dims: int, scale: int) -> Column:
    """``floor(scale * x)`` of each component; null unless there are exactly
    ``dims``, all finite."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))
    ints = F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * F.lit(float(scale))), F.lit(LARGEST)),
                                                    F.lit(-LARGEST)).cast("int"))
    return F.when((F.size(vector) == dims) & finite, ints)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def limits(vectors: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest component of every dimension over all rows."""
    def of_task(batches):
        lo, hi = None, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), dims)
                lo = x.min(axis=0) if lo is None else np.minimum(lo, x.min(axis=0))
                hi = x.max(axis=0) if hi is None else np.maximum(hi, x.max(axis=0))
        if lo is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(lo), pa.array(hi)], names=["d", "lo", "hi"])

    found = vectors.select("v").mapInArrow(of_task, "d bigint, lo bigint, hi bigint").groupBy("d").agg(
        F.min("lo"), F.max("hi")).orderBy("d").collect()
    return np.array([r[1] for r in found]), np.array([r[2] for r in found])


class Cells:
    """Borders of the cells: cell ``b`` of a dimension holds the whole numbers
    from ``low[d, b]`` to ``high[d, b]``."""

    def __init__(self, sample: np.ndarray, lo: np.ndarray, hi: np.ndarray, bits: int):
        n = 1 << bits
        self.borders = np.quantile(sample, np.arange(1, n) / n, axis=0, method="lower").T.astype(np.int64)
        self.low = np.concatenate((np.minimum(lo, self.borders[:, 0] - 1)[:, None], self.borders), axis=1)
        self.high = np.concatenate((self.borders - 1, np.maximum(hi, self.borders[:, -1])[:, None]), axis=1)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """The cell of every component, one byte each."""
        return np.column_stack([np.searchsorted(b, x[:, d], "right") for d, b in enumerate(self.borders)]).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest share of the distance: (dimension, cell, centroid)."""
        c = centroids.T[:, None, :]
        one, other = -2 * self.low[:, :, None] * c, -2 * self.high[:, :, None] * c
        return c * c + np.minimum(one, other), c * c + np.maximum(one, other)


def decide(codes: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which centroids may be the nearest of each approximation (rows x centroids)."""
    out = np.empty((len(codes), near.shape[2]), bool)
    for s in range(0, len(codes), BLOCK):
        part = codes[s:s + BLOCK]
        least, most = near[0][part[:, 0]], far[0][part[:, 0]]
        for d in range(1, part.shape[1]):
            least += near[d][part[:, d]]
            most += far[d][part[:, d]]
        out[s:s + BLOCK] = least <= most.min(axis=1)[:, None]
    return out


MARKED = "row bigint, code binary, old int, cluster int, among array<int>"
SETTLED = "row bigint, code binary, old int, cluster int, distance bigint, v array<int>"


def _mark(state: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """The cluster of each row where its approximation decides, else -1 and the
    centroids whose intervals overlap the nearest one's."""
    width = cells.low.shape[0]

    def scan(batches):
        near, far = cells.tables(centroids)
        for batch in batches:
            row, code, old = batch.columns
            if not batch.num_rows:
                continue
            bytes_ = np.frombuffer(b"".join(code.to_pylist()), np.uint8).reshape(-1, width)
            may = decide(bytes_, near, far)
            n = may.sum(axis=1)
            cluster = np.where(n == 1, may.argmax(axis=1), -1)
            may[n == 1] = False
            among = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(may.sum(axis=1)))), pa.int32()),
                                             pa.array(np.nonzero(may)[1], pa.int32()))
            yield pa.RecordBatch.from_arrays([row, code, old, pa.array(cluster, pa.int32()), among],
                                             names=["row", "code", "old", "cluster", "among"])

    return state.select("row", "code", F.col("cluster").alias("old")).mapInArrow(scan, MARKED)


def _settle(fetched: DataFrame, centroids: np.ndarray, dims: int) -> DataFrame:
    """Nearest of the open centroids by the full vector, the smaller number on a
    tie, and the distance."""
    def measure(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(batch.schema.get_field_index("v")), dims)
            cluster = batch.column(3).to_numpy(zero_copy_only=False).copy()
            lists = batch.column(4)
            rows = np.repeat(np.arange(len(x)), np.diff(lists.offsets.to_numpy()))
            those = lists.flatten().to_numpy(zero_copy_only=False)
            distance = np.full((len(x), len(centroids)), np.iinfo(np.int64).max)
            for s in range(0, len(rows), 8 * BLOCK):
                r, c = rows[s:s + 8 * BLOCK], those[s:s + 8 * BLOCK]
                distance[r, c] = ((x[r] - centroids[c]) ** 2).sum(axis=1)
            unsure = cluster < 0
            cluster[unsure] = distance[unsure].argmin(axis=1)
            own = ((x - centroids[cluster]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(cluster, pa.int32()), pa.array(own), batch.column(5)],
                names=["row", "code", "old", "cluster", "distance", "v"])

    return fetched.select("row", "code", "old", "cluster", "among", "v").mapInArrow(measure, SETTLED)


def _moves(settled: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """What the rows that changed their cluster add to the clusters' counts and sums."""
    def of_task(batches):
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            x = _matrix(batch.column(2), dims)
            for j, sign in ((0, -1), (1, 1)):
                c = batch.column(j).to_numpy(zero_copy_only=False)
                ok = c >= 0
                np.add.at(n, c[ok], sign)
                np.add.at(total, c[ok], sign * x[ok])
        some = np.flatnonzero((n != 0) | total.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(some, dims + 1)), pa.array(np.tile(np.arange(dims + 1), len(some))),
             pa.array(np.column_stack((total[some], n[some])).ravel())], names=["c", "d", "s"])

    changed = settled.where("cluster <> old").select("old", "cluster", "v")
    rows = changed.mapInArrow(of_task, "c bigint, d bigint, s bigint").groupBy("c", "d").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out = np.zeros((k, dims + 1), object)
    for r in rows:
        out[r["c"], r["d"]] = int(r["s"])
    return out[:, dims], out[:, :dims]


def centroid_clusters(df: DataFrame, row_id: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5,
                      dims: int = 64, scale: int = 256, seed: str = "2", bits: int = 6) -> DataFrame:
    """The nearest of ``k`` centroids for each vector after ``rounds`` rounds.

    Kept are rows whose vector has exactly ``dims`` components, none null or not
    finite; components become ``floor(scale * x)``, held within +-2**27.  Starting
    centroids are the kept vectors with the smallest SHA-256 of ``seed:id`` (a
    null id is empty text; equal ids go by the vector), fewer than ``k`` if there
    are fewer rows.  Ties go to the smaller number; an empty cluster's centroid
    stays.  Rows that repeat are clustered each.  Adds ``cluster``, ``distance``
    (squared), ``cluster_inertia``, ``inertia`` and ``centroid_sha256``; columns of
    those names are replaced, others stay.

    Runs two or three jobs a round.  The driver holds centroids and their sums.
    Borders of the cells come from at most 4,096 rows, which decides how
    many vectors are fetched and never a result.
    """
    spark = df.sparkSession
    df = clear_of(df, RESULT)
    packed = df.select(F.struct(*[col(c) for c in df.columns]).alias("data"), col(row_id).cast("string").alias("id"),
                       whole_vectors(col(vector), dims, scale).alias("v")).where("v is not null")
    vectors = written(packed.withColumn("row", F.monotonically_increasing_id()), "vectors")
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("id", F.lit(""))), 256)
    first = vectors.orderBy(told, "v", "row").select("v").limit(k).collect()
    schema = T.StructType([*df.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()),
                           T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()),
                           T.StructField("centroid_sha256", T.StringType())])
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array([r["v"] for r in first], np.int64)
    k = len(centroids)
    lo, hi = limits(vectors, dims)
    sample = vectors.orderBy(F.xxhash64("id", "row")).select("v").limit(BORDER_ROWS).collect()
    cells = Cells(np.array([r["v"] for r in sample], np.int64), lo, hi, bits)

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [c.tobytes() for c in cells.encode(_matrix(batch.column(1), dims))] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary())], names=["row", "code"])

    state = written(vectors.select("row", "v").mapInArrow(approximate, "row bigint, code binary").withColumn(
        "cluster", F.lit(-1)), "cells")
    counts, sums = np.zeros(k, object), np.zeros((k, dims), object)
    for step in range(rounds + 1):
        marked = written(_mark(state, cells, centroids), "marked")
        # The last round reports distances, which take every vector.
        wanted = marked if step == rounds else marked.where("cluster < 0 or cluster <> old")
        settled = written(_settle(wanted.join(vectors.select("row", "v"), "row"), centroids, dims), "settled")
        if step < rounds:
            n, moved = _moves(settled, k, dims)
            counts, sums = counts + n, sums + moved
            centroids = np.array([[int(s) // int(counts[c]) for s in sums[c]] if counts[c] else list(centroids[c])
                                  for c in range(k)], np.int64)
            state = marked.where("cluster >= 0 and cluster = old").select("row", "code", "cluster").unionByName(
                settled.select("row", "code", "cluster"))
    inertia = dict(settled.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    by_cluster = F.array(*[F.lit(int(inertia.get(c, 0))).cast("bigint") for c in range(k)])
    digest = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids.tolist()])
    place = F.col("cluster") + 1
    return vectors.select("row", "data").join(settled.select("row", "cluster", "distance"), "row").select(
        "data.*", "cluster", "distance", F.element_at(by_cluster, place).alias("cluster_inertia"),
        F.lit(int(sum(inertia.values()))).cast("bigint").alias("inertia"), F.element_at(digest, place).alias("centroid_sha256"))
