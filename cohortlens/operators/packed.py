"""Errors of very many labellings of the same rows at once.

The choice of k compares every number of clusters with many shuffles of its
labels.  Neighbours do not depend on labels, so a query gathers what its neighbours'
labels follow from, votes for all labellings, arrays of small codes over (k, shuffle),
in a few array passes, and adds to counts of (truth, vote) that leave a task once.
No row is ever copied per shuffle.

A shuffle does not move labels either.  It is a keyed permutation of the ranks of
a run's rows; with the labels sorted, the label at a permuted rank follows from
how many rows have each label.  So a neighbour travels as its rank and its labels
by k, and the task that votes computes its codes.  One look-up gives the codes of all
k, as the labels of every k are runs of the same ranks; a task has few runs, and
permutes the ranks of one once.  Votes are counted in the bits of one number a query and k.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col
from ..session import written
from .ordering import hash32, with_rank

ROUNDS = 8
CHUNK = 256
#: Queries that vote at once by counts in bits, bytes of a run's permuted ranks that a
#: task keeps, and parts of a run beyond which it permutes only what it meets.
MORE, TABLE_BYTES, TABLE_PARTS = 2048, 64 << 20, 8


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    # Keys that follow each other are spread over all 64 bits before they meet x.
    x = x + np.uint64(key * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(rank: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a keyed permutation of ``0 .. n-1`` sends each rank: a Feistel network
    over the next power of four, walked on while it leads beyond n."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out, open_ = rank.astype(np.uint64), np.arange(len(rank))
    while len(open_):
        left, right = out[open_] >> shift, out[open_] & mask
        for k in range(ROUNDS):
            left, right = right, left ^ (_mixed(right, key * ROUNDS + k + 1) & mask)
        out[open_] = left << shift | right
        open_ = open_[out[open_] >= n]
    return out.astype(np.int64)


@dataclass
class Codes:
    """The labels of each k in order, and how many train rows of a run have each."""

    ks: list[int]
    values: list[np.ndarray]
    held: dict[int, list[np.ndarray]]

    @property
    def most(self) -> int:
        return max(len(v) for v in self.values)

    def of(self, labels: np.ndarray) -> np.ndarray:
        """Codes of rows x ks labels."""
        return np.column_stack([np.searchsorted(v, labels[:, j]) for j, v in enumerate(self.values)]).astype(np.uint16)

    def shuffled(self, run: int, rank: np.ndarray, codes: np.ndarray, iterations: int, seed: int) -> np.ndarray:
        """Codes as they are and for each shuffle: rows x ks x (1 + iterations)."""
        out = np.empty((*codes.shape, iterations + 1), np.uint16)
        out[:, :, 0] = codes
        ends = [np.cumsum(h) for h in self.held[run]]
        for i in range(iterations):
            at = permuted(rank, int(ends[0][-1]), (seed * 1_000_003 + run) * 1_000_003 + i)
            for j, e in enumerate(ends):
                out[:, j, i + 1] = np.searchsorted(e, at, "right")
        return out


class _Shuffles:
    """The codes that the ranks of one run have in each shuffle, as places in a list of
    the code combinations that occur."""

    def __init__(self, codes: Codes, run: int, iterations: int, seed: int, keep: bool):
        ends = [np.cumsum(h) for h in codes.held[run]]
        self.n, self.cuts = int(ends[0][-1]), np.unique(np.concatenate(ends))
        first = np.concatenate([[0], self.cuts])
        self.combined = np.column_stack([np.searchsorted(e, first, "right") for e in ends]).astype(np.uint8)
        self.key = lambda i: (seed * 1_000_003 + run) * 1_000_003 + i
        self.kind = np.uint8 if len(first) <= 256 else np.uint16
        self.table = None
        if keep and self.n * iterations * self.kind().itemsize <= TABLE_BYTES:
            self.table = [self._places(np.arange(self.n), i) for i in range(iterations)]

    def _places(self, rank, i):
        return np.searchsorted(self.cuts, permuted(rank, self.n, self.key(i)), "right").astype(self.kind)

    def places(self, rank: np.ndarray, i: int) -> np.ndarray:
        return self.table[i][rank] if self.table is not None else self._places(rank, i)


def most_voted(tally: np.ndarray, most: int, width: int) -> np.ndarray:
    """The code with the largest count, the smallest on ties, from counts of ``width`` bits."""
    mask, best = np.uint64((1 << width) - 1), None
    for v in range(most):
        n = (tally >> np.uint64(v * width) & mask) << np.uint64(8) | np.uint64(255 - v)
        best = n if best is None else np.maximum(best, n, out=best)
    return (np.uint64(255) - (best & np.uint64(255))).astype(np.int64)


def tables_of(codes: Codes, shuffles: _Shuffles, near_rank, near, rank, own, train: bool, iterations: int) -> np.ndarray:
    """Counts of (truth, vote) for the labels as they are and for each shuffle, the
    tables of all k one after the other, from the ranks and codes of some queries and
    of the ``m`` neighbours each."""
    m, size = near_rank.shape[1], np.array([len(v) for v in codes.values])
    width, start = m.bit_length(), np.concatenate([[0], np.cumsum(size * size)])
    bits = lambda c: np.left_shift(np.uint64(1), c.astype(np.uint64) * np.uint64(width))
    ballots, out = bits(shuffles.combined), np.zeros((iterations + 1, start[-1]), np.int64)
    own = own.astype(np.int64)
    for i in range(iterations + 1):
        if i == 0:
            tally, truth = bits(near).sum(axis=1), own
        else:
            tally = ballots[shuffles.places(near_rank[:, 0], i - 1)]
            for j in range(1, m):
                tally += ballots[shuffles.places(near_rank[:, j], i - 1)]
            # Test rows keep theirs in every shuffle.
            truth = shuffles.combined[shuffles.places(rank, i - 1)].astype(np.int64) if train else own
        vote = np.minimum(most_voted(tally, codes.most, width), size - 1)
        out[i] = np.bincount((truth * size + vote + start[:-1]).ravel(), minlength=start[-1])
    return out


def known_codes(labels: DataFrame) -> Codes:
    """Counted by one small aggregate: runs x ks x labels rows, whatever the data."""
    rows = labels.groupBy("run", "k", "label").agg(F.count_if(F.col("split") == "train").alias("n")).collect()
    ks = sorted({r["k"] for r in rows})
    values = [np.array(sorted({r["label"] for r in rows if r["k"] == k})) for k in ks]
    held = {run: [np.zeros(len(v), np.int64) for v in values] for run in {r["run"] for r in rows}}
    for r in rows:
        j = ks.index(r["k"])
        held[r["run"]][j][np.searchsorted(values[j], r["label"])] = r["n"]
    return Codes(ks, values, held)


def _ranked(labels: DataFrame, row_id: str, seed: int) -> DataFrame:
    """``(run, split, row_id, _r, _l)``: a row's place in a random order of its run's
    rows, and its labels by k.  All its shuffled labels follow from these two."""
    wide = labels.groupBy("run", "split", row_id).agg(F.array_sort(F.collect_list(F.struct("k", "label"))).alias("_l")).select(
        "run", "split", row_id, F.transform("_l", lambda x: x["label"]).alias("_l"), hash32(row_id, "run", seed=seed * 2 + 1).alias("_h"))
    return with_rank(wide, ["run", "split"], "_h", [row_id], "_r").drop("_h")


def voted(codes: np.ndarray, most: int) -> np.ndarray:
    """Most frequent code among the neighbours (axis 1), the smallest on ties."""
    best, out = (codes == 0).sum(axis=1, dtype=np.int16), np.zeros((len(codes), *codes.shape[2:]), np.int64)
    for v in range(1, most):
        n = (codes == v).sum(axis=1, dtype=np.int16)
        more = n > best
        out[more], best[more] = v, n[more]
    return out


def labelling_errors(labels: DataFrame, near: DataFrame, iterations: int, row_id: str, aligned: Callable[[np.ndarray], int],
                     seed: int = 0) -> DataFrame:
    """``(run, k, split, error, random_error)`` from ``(run, k, split, row_id,
    label)`` and the neighbours ``(run, split, query_id, neighbor_id)`` of every row
    among its run's train rows: the share of rows whose vote is not their label,
    on train as it is and on test after the best renaming (``aligned`` gives the
    rows that agree then), for the labels as they are and as the mean over
    ``iterations`` shuffles of the train labels.  Runs one small job for the codes.
    """
    codes = known_codes(labels)
    ranked = written(_ranked(labels, row_id, seed), "ranked")
    donors = ranked.where("split = 'train'").select("run", col(row_id).alias("neighbor_id"), F.struct("_r", "_l").alias("_d"))
    # A run is dealt to few tasks, each of which permutes its ranks once; few bytes, much
    # work, so that the partitions are not joined.
    cores = labels.sparkSession.sparkContext.defaultParallelism
    parts, query = max(1, -(-2 * cores // max(1, len(codes.held)))), ["run", "_part", "split", "query_id"]
    own = ranked.withColumnRenamed(row_id, "query_id").select("run", "split", "query_id", F.struct("_r", "_l").alias("_d"), F.lit(True).alias("_own"))
    dealt = near.join(donors, ["run", "neighbor_id"]).select("run", "split", "query_id", "_d", F.lit(False).alias("_own")).unionByName(
        own).withColumn("_part", F.pmod(hash32("query_id", seed=31), F.lit(parts)).cast("int"))
    gathered = dealt.repartition(4 * parts * max(1, len(codes.held)), "run", "_part").groupBy(*query).agg(
        F.collect_list(F.when(~F.col("_own"), F.col("_d"))).alias("_near"), F.max(F.when(F.col("_own"), F.col("_d"))).alias("_d"))
    met = gathered.where((F.size("_near") > 0) & F.col("_d").isNotNull()).sortWithinPartitions("run", "split").select(
        "run", "split", F.transform("_near", lambda x: x["_r"]).alias("_near_r"),
        F.flatten(F.transform("_near", lambda x: x["_l"])).alias("_near_l"), "_d._r", "_d._l")
    shape = (len(codes.ks), iterations + 1)
    size = [len(v) for v in codes.values]

    def all_labellings(run, ranks, own):
        own = codes.of(np.concatenate(own.to_list()).reshape(-1, shape[0]))
        return codes.shuffled(run, np.asarray(ranks, np.int64) - 1, own, iterations, seed)

    def count(batches):
        totals, last, shuffles = {}, None, None
        for pdf in batches:
            lengths = pdf["_near_r"].map(len)
            for (run, split, m), part in pdf.groupby(["run", "split", lengths], sort=False):
                if codes.most * int(m).bit_length() <= 64 and codes.most < 256:
                    if run != last:
                        last, shuffles = run, _Shuffles(codes, int(run), iterations, seed, parts <= TABLE_PARTS)
                    for s in range(0, len(part), MORE):
                        some = part.iloc[s:s + MORE]
                        ranks = np.concatenate(some["_near_r"].to_list()).astype(np.int64).reshape(-1, m) - 1
                        own = codes.of(np.array(some["_l"].to_list()).reshape(-1, shape[0]))
                        there = codes.of(np.concatenate(some["_near_l"].to_list()).reshape(-1, shape[0])).reshape(-1, m, shape[0])
                        found = tables_of(codes, shuffles, ranks, there, some["_r"].to_numpy(np.int64) - 1, own, split == "train", iterations)
                        for k, cells in zip(codes.ks, np.split(found, np.cumsum([n * n for n in size])[:-1], axis=1)):
                            totals[int(run), split, k] = totals.get((int(run), split, k), 0) + cells.ravel()
                    continue
                for s in range(0, len(part), CHUNK):
                    some = part.iloc[s:s + CHUNK]
                    there = all_labellings(int(run), np.concatenate(some["_near_r"].to_list()), some["_near_l"])
                    votes = voted(there.reshape(-1, m, *shape), codes.most)
                    if split == "train":
                        truth = all_labellings(int(run), some["_r"], some["_l"])
                    else:  # test rows keep theirs in every shuffle
                        truth = np.repeat(codes.of(np.array(some["_l"].to_list()))[:, :, None], shape[1], axis=2)
                    truth = truth.astype(np.int64)
                    for j, n in enumerate(size):
                        cell = (np.arange(shape[1]) * n + truth[:, j]) * n + np.minimum(votes[:, j], n - 1)
                        found = np.bincount(cell.ravel(), minlength=shape[1] * n * n)
                        key = (int(run), split, codes.ks[j])
                        totals[key] = totals.get(key, 0) + found
        if totals:
            yield pd.DataFrame([(*key, v.astype(np.int64).tobytes()) for key, v in totals.items()],
                               columns=["run", "split", "k", "_c"])

    counts = met.mapInPandas(count, "run int, split string, k int, _c binary")

    def score(pdf):
        run, split, k = pdf[["run", "split", "k"]].iloc[0]
        n = size[codes.ks.index(k)]
        tables = sum(np.frombuffer(b, np.int64) for b in pdf["_c"]).reshape(-1, n, n)
        agree = [int(np.trace(t)) if split == "train" else aligned(t) for t in tables]
        loss = 1 - np.array(agree) / tables.sum(axis=(1, 2))
        return pd.DataFrame([(run, k, split, loss[0], loss[1:].mean() if len(loss) > 1 else None)],
                            columns=["run", "k", "split", "error", "random_error"])

    return counts.groupBy("run", "split", "k").applyInPandas(score, "run int, k int, split string, error double, random_error double")
