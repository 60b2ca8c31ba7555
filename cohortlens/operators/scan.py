"""Exact nearest neighbours over many features, by comparing all pairs.

With many features the bounds of cells rule out next to nothing, and packs of
queries sent to every cell are most of what such a search moves and keeps on disk.
Here the pairs of a group are cut into cells of a grid: a task holds some of the
queries and what they have found, and the donors of a part go past in blocks.  A
row is copied once for each cell of its row or column of the grid, a few times
and not once a block.

Rows that lack the same features meet in one matrix product of single precision
over the features both have.  It gives a lower bound of each distance, smaller by
at least what such a product may lose, so that no neighbour is missed; the pairs
within what a query knows already are then measured in full.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import col
from ..session import bound_batches, written
from . import celltree
from .ordering import hash32

#: Pairs whose distances are computed at once.
PAIRS_AT_ONCE = 20_000
#: Rows of a tile of queries and of a block of donors, and rows that make one of their own pattern.
TILE, BLOCK, LEAST = 512, 2048, 64
#: Donors from which a query that knows nothing takes its first bound.
LOOK = 512
#: Found pairs a tile gathers for each of its queries before it keeps the best.
HELD = 32
#: Bytes of the queries of a cell, and the pairs that make a cell worth its copies.
CELL_BYTES, CELL_PAIRS = 24 << 20, 10 ** 10
#: Distances are rounded to nine places; beyond this they cannot be equal.
NEAR = 2e-9
#: Beyond these sizes, in units of the queries' spread, single precision would overflow.
LARGE = 1e12


def distances(q, donors, r, c):
    """Distances of pairs from plain differences, so that equal rows have equal ones."""
    dist = np.empty(len(r))
    for s in range(0, len(r), PAIRS_AT_ONCE):
        diff = q[r[s:s + PAIRS_AT_ONCE]] - donors[c[s:s + PAIRS_AT_ONCE]]
        dist[s:s + PAIRS_AT_ONCE] = np.sqrt(np.nansum(diff * diff, axis=1) * q.shape[1] / np.isfinite(diff).sum(axis=1))
    return np.round(dist, 9)


def first_k(r, k):
    """Of ordered pairs the first k of each query."""
    return np.arange(len(r)) - np.searchsorted(r, r) < k


def first_fills(able, r, k):
    """Of ordered pairs and the gaps that each may fill, those that are among the
    first k of their query and feature."""
    count, start = np.cumsum(able, axis=0, dtype=np.int32), np.searchsorted(r, r)
    return able & (count - np.where(start[:, None] > 0, count[start - 1], 0) <= k)


class _Rows:
    """Rows around a common middle, in units of a common spread; missing values are 0."""

    def __init__(self, x: np.ndarray, middle: np.ndarray, unit: float):
        self.x, self.there = x, np.isfinite(x)
        self.pure = bool((self.there == self.there[0]).all())
        self.at = np.where(self.there, (x - middle) / unit, 0.0)
        self.large = bool(np.abs(self.at).max(initial=0.0) > LARGE)
        self._side = None

    def side(self, features: np.ndarray, kind, make):
        """What one side of a product over these features needs; kept until others are asked for."""
        key = features.tobytes(), kind
        if self._side is None or self._side[0] != key:
            self._side = key, make(np.compress(features, self.at, axis=1))
        return self._side[1]


class Block(_Rows):
    """Donors, in the order of their ids."""

    def __init__(self, x, ids, middle, unit):
        order = np.argsort(ids, kind="stable")
        super().__init__(x[order], middle, unit)
        self.ids, self.bits, self._sides = ids[order], np.packbits(self.there, axis=1), {}
        # Features that the same donors have fill the same gaps.
        self.key = [bool(v) for v in self.there[0]] if self.pure else [self.there[:, j].tobytes() for j in range(x.shape[1])]

    def side(self, features, kind, make):
        # Tiles of several patterns take turns.
        key = features.tobytes(), kind
        if key not in self._sides:
            self._sides[key] = make(np.compress(features, self.at, axis=1))
        return self._sides[key]


class Tile(_Rows):
    """Queries and the best distances they know: for each set of gaps that
    the donors so far could only fill together, or for all rows without ``fill``."""

    def __init__(self, x, ids, middle, unit, k, fill):
        super().__init__(x, middle, unit)
        self.ids, self.unit, self.k, self.fill, self.pool, self.pooled = ids, unit, k, fill, [], 0
        self._last = None
        nothing = lambda rows: np.where(rows[:, None], np.full(k, np.inf), -np.inf)
        every = np.ones(len(x), bool)
        if not fill:
            self.known = [(None, nothing(every))]
        elif self.pure:
            gaps = np.flatnonzero(~self.there[0])
            self.known = [(gaps, nothing(every))] if len(gaps) else []
        else:
            self.known = [(np.array([j]), nothing(~self.there[:, j])) for j in np.flatnonzero(~self.there.all(axis=0))]

    def meet(self, block: Block) -> None:
        known = self._fillable(block)
        if known:
            r, c = (self._same_features if self.pure and block.pure else self._own_features)(block, known)
            if len(r):
                self._take(block, r, c, known)

    def _fillable(self, block):
        """The known distances that this block may better, with the donors that can
        (all: None); sets of gaps that some donors fill only in part are parted."""
        if not self.fill:
            return [(0, None)]
        if self._last is not None and block.pure and self._last[0] == block.key:
            return self._last[1]
        parted, out = [], []
        for gaps, best in self.known:
            kinds = {}
            for j in gaps:
                kinds.setdefault(block.key[j], []).append(j)
            for n, some in enumerate(kinds.values()):
                parted.append((np.array(some), best if n == 0 else best.copy()))
        self.known = parted
        for i, (gaps, _) in enumerate(self.known):
            able = block.there[:, gaps[0]]
            if able.all():
                out.append((i, None))
            elif able.any():
                out.append((i, able))
        self._last = (block.key, out) if block.pure else None
        return out

    def _within(self, dist):
        """Squares, in the unit, of distances that may be rounded to ``dist`` or less."""
        return ((np.maximum(dist, 0.0) + NEAR) / self.unit) ** 2 * (1 + 1e-9) + 1e-30

    def _same_features(self, block, known):
        features = self.there[0] & block.there[0]
        m, d = int(features.sum()), len(features)
        if not m:
            return np.zeros(0, int), np.zeros(0, int)
        kind = float if self.large or block.large else np.float32
        eps = 4 * (m + 1) * (2.0 ** -52 if kind is float else 2.0 ** -23)

        def ours(at):
            return np.column_stack([-2.0 * at, np.ones(len(at))]).astype(kind), (at * at).sum(axis=1)

        def theirs(at):
            square = (at * at).sum(axis=1)
            return np.ascontiguousarray(np.column_stack([at, square * (1 - eps)]).astype(kind).T), square.max()

        a, own = self.side(features, kind, ours)
        b, most = block.side(features, kind, theirs)
        low = a @ b  # less what the query's own square adds
        far = np.max([self.known[i][1][:, -1] for i, _ in known], axis=0)
        edge = np.where(np.isfinite(far), self._within(np.where(np.isfinite(far), far, 0.0)) * m / d, far)
        blank = np.flatnonzero(edge == np.inf)
        if len(blank) and len(block.x) >= self.k:
            first = np.partition(low[blank, :LOOK], self.k - 1, axis=1)[:, self.k - 1] if len(block.x) > LOOK else np.partition(
                low[blank], self.k - 1, axis=1)[:, self.k - 1]
            sure = np.maximum(first + own[blank] + 3 * eps * (own[blank] + most), 0.0)
            edge[blank] = self._within(np.sqrt(sure * d / m) * self.unit) * m / d
        limit = np.nextafter((edge - own * (1 - eps)).astype(kind), kind(np.inf))
        return np.divmod(np.flatnonzero(low <= limit[:, None]), low.shape[1])

    def _own_features(self, block, known):
        """Rows that lack what they like: the products also say what a pair shares."""
        d = self.x.shape[1]
        kind = float if self.large or block.large else np.float32
        eps = 4 * (3 * d + 1) * (2.0 ** -52 if kind is float else 2.0 ** -23)
        here, there = self.there.astype(kind), block.there.astype(kind)
        a = np.concatenate([-2.0 * self.at, self.at ** 2 * (1 - eps), here], axis=1).astype(kind)
        b = np.concatenate([block.at, there, block.at ** 2 * (1 - eps)], axis=1).astype(kind)
        shared = here @ there.T
        with np.errstate(divide="ignore", invalid="ignore"):
            low = (a @ b.T) * kind(d) / shared
        low[shared <= 0] = np.inf
        limits = []
        for i, able in known:
            far = self.known[i][1][:, -1]
            edge = np.where(np.isfinite(far), self._within(np.where(np.isfinite(far), far, 0.0)), far)
            blank = np.flatnonzero(edge == np.inf)
            part = low[blank] if able is None else low[np.ix_(blank, able)]
            if len(blank) and part.shape[1] >= self.k:
                first = np.partition(part[:, :LOOK] if part.shape[1] > LOOK else part, self.k - 1, axis=1)[:, self.k - 1]
                lost = 3 * eps * d * ((self.at[blank] ** 2).sum(axis=1) + (block.at ** 2).sum(axis=1).max())
                edge[blank] = self._within(np.sqrt(np.maximum(first + lost, 0.0)) * self.unit)
            limits.append(np.nextafter(edge.astype(kind), kind(np.inf)))
        near = (low <= np.max(limits, axis=0)[:, None]) & np.isfinite(low)
        if len(known) > 1 and near.sum() > self.k * HELD * len(near):
            # A gap that few can fill keeps no bound: only those few are looked at for it.
            whole, near = near, np.zeros_like(near)
            for (_, able), limit in zip(known, limits):
                if able is None:
                    near |= low <= limit[:, None]
                else:
                    near[:, able] |= low[:, able] <= limit[:, None]
            near &= whole
        return np.nonzero(near)

    def _take(self, block, r, c, known):
        dist = distances(self.x, block.x, r, c)
        far = np.column_stack([self.known[i][1][:, -1] for i, _ in known])
        some = dist <= far.max(axis=1)[r]
        r, c, dist = r[some], c[some], dist[some]
        order = np.lexsort((c, dist, r))
        r, c, dist = r[order], c[order], dist[order]
        if all(able is None for _, able in known) and (self.pure or not self.fill):
            keep = first_k(r, self.k)
            r, c, dist = r[keep], c[keep], dist[keep]
            for i, _ in known:
                self._better(i, r, dist)
        else:
            may = np.column_stack([np.ones(len(c), bool) if able is None else able[c] for _, able in known])
            may = first_fills(may & (dist[:, None] <= far[r]), r, self.k)
            for n, (i, _) in enumerate(known):
                self._better(i, r[may[:, n]], dist[may[:, n]])
            keep = may.any(axis=1)
            r, c, dist = r[keep], c[keep], dist[keep]
        if len(r):
            self.pool.append((r, block.ids[c], dist, block.bits[c]))
            self.pooled += len(r)
            if self.pooled > HELD * len(self.x):
                self.pool = [self.best()[:4]]
                # What stays may be more than that; the next look is after as many again.
                self.pooled = max(0, len(self.pool[0][0]) - HELD * len(self.x) // 2)

    def _better(self, i, r, dist):
        """Ordered pairs, at most k of a query, among its best."""
        rows, start = np.unique(r, return_index=True)
        new = np.full((len(rows), self.k), np.inf)
        at = np.searchsorted(rows, r)
        new[at, np.arange(len(r)) - start[at]] = dist
        best = self.known[i][1]
        best[rows] = np.sort(np.concatenate([best[rows], new], axis=1), axis=1)[:, :self.k]

    def best(self):
        """Pairs that are among the k of their query, or of a gap of it: places of the
        queries, donors, distances, what the donors have, and the gaps (or None)."""
        if not self.pool:
            return np.zeros(0, int), np.zeros(0, object), np.zeros(0), np.zeros((0, 1), np.uint8), None
        r, ids, dist, bits = (np.concatenate(part) for part in zip(*self.pool))
        far = np.max([best[:, -1] for _, best in self.known], axis=0)
        some = dist <= far[r]
        r, ids, dist, bits = r[some], ids[some], dist[some], bits[some]
        order = np.lexsort((np.unique(ids, return_inverse=True)[1].ravel(), dist, r))
        r, ids, dist, bits = r[order], ids[order], dist[order], bits[order]
        if not self.fill:
            keep, gaps = first_k(r, self.k), None
        else:
            d, parts = self.x.shape[1], [part for part, _ in self.known]
            one, gaps = [part[0] for part in parts], np.zeros((len(r), d), bool)
            step = max(1, PAIRS_AT_ONCE * 64 // d)
            cut = [0]
            while cut[-1] < len(r):  # whole queries at a time
                cut.append(int(np.searchsorted(r, r[min(cut[-1] + step, len(r)) - 1], "right")))
            for s, e in zip(cut, cut[1:]):
                has = np.unpackbits(bits[s:e], axis=1, count=d).astype(bool)
                may = first_fills(has[:, one] & ~self.there[r[s:e]][:, one], r[s:e], self.k)
                for part, fills in zip(parts, may.T):
                    gaps[s:e, part] = fills[:, None]
            keep = gaps.any(axis=1)
            gaps = gaps[keep]
        return r[keep], ids[keep], dist[keep], bits[keep], gaps


def _runs(pattern: np.ndarray):
    """Start and end of each run of one pattern."""
    edges = [0, *(np.flatnonzero(pattern[1:] != pattern[:-1]) + 1), len(pattern)]
    return zip(edges, edges[1:])


def tiles(x, ids, pattern, k, fill) -> tuple[list[Tile], np.ndarray, float]:
    """Tiles of queries that come in the order of their patterns, with the middle and the unit."""
    there = np.isfinite(x)
    number = np.maximum(there.sum(axis=0), 1)
    middle = np.where(there, x, 0.0).sum(axis=0) / number
    unit = float(np.sqrt((np.where(there, x - middle, 0.0) ** 2).sum() / max(1, there.sum()))) or 1.0
    unit = unit if np.isfinite(unit) else 1.0
    places, rest = [], []
    for s, e in _runs(pattern):
        if e - s >= LEAST:
            places += [np.arange(i, min(i + TILE, e)) for i in range(s, e, TILE)]
        else:
            rest.append(np.arange(s, e))
    if rest:
        rest = np.concatenate(rest)
        places += [rest[i:i + TILE] for i in range(0, len(rest), TILE)]
    return [Tile(x[p], ids[p], middle, unit, k, fill) for p in places], middle, unit


class _Blocks:
    """Donors in blocks of one pattern, and those of rare patterns together."""

    def __init__(self, middle, unit):
        self.made = lambda x, i: Block(x, i, middle, unit)
        self.pattern, self.one, self.rare, self.few = None, [], [], 0

    def add(self, x, ids, pattern):
        for s, e in _runs(pattern):
            if pattern[s] != self.pattern:
                yield from self._close()
                self.pattern = pattern[s]
            self.one.append((x[s:e], ids[s:e]))
            yield from self._cut(self.one, BLOCK)

    def _cut(self, rows, least):
        if rows and sum(len(i) for _, i in rows) >= least:
            x, ids = np.concatenate([p[0] for p in rows]), np.concatenate([p[1] for p in rows])
            rows.clear()
            whole = len(ids) if least < BLOCK else len(ids) // BLOCK * BLOCK
            for s in range(0, whole, BLOCK):
                yield self.made(x[s:s + BLOCK], ids[s:s + BLOCK])
            if whole < len(ids):
                rows.append((x[whole:], ids[whole:]))

    def _close(self):
        yield from self._cut(self.one, LEAST)
        self.rare += self.one
        self.few += sum(len(i) for _, i in self.one)
        self.one = []
        if self.few >= BLOCK:
            yield from self._cut(self.rare, BLOCK)
            self.few = sum(len(i) for _, i in self.rare)

    def last(self):
        yield from self._close()
        yield from self._cut(self.rare, 1)


def all_pairs(train: DataFrame, query: DataFrame, features: Sequence[str], k: int, row_id: str, by: Sequence[str],
              fill: bool, found: T.StructType) -> DataFrame:
    """The pairs that are among the closest k of a query, or of a gap of it, in some
    cell of the grid: rows of ``found``.  Counts the rows of each group first."""
    spark, d = train.sparkSession, len(features)
    bound_batches(spark)
    by, values, id_type = list(by), [col(c) for c in features], train.schema[row_id].dataType
    group = (F.to_json(F.struct(*by)) if by else F.lit("")).alias("_group")
    donors = celltree.as_points(train.select(group, row_id, *values), ["_group", row_id], features)
    queries = written(celltree.as_points(query.select(*by, group, col(row_id).cast(id_type).alias(row_id), *values),
                                         [*by, "_group", row_id], features, fill), "queries")
    # A grid that copies few rows: as many cells as the cores need, or the pairs are worth.
    number = train.groupBy(group).agg(F.count("*").alias("_t")).join(
        queries.groupBy("_group").agg(F.count("*").alias("_q")), "_group")
    number = written(number, "numbers")
    pairs = number.agg(F.sum(F.col("_t").cast("double") * F.col("_q"))).first()[0] or 1.0
    worth = F.col("_t").cast("double") * F.col("_q")
    cells = F.ceil(F.greatest(worth / F.lit(float(CELL_PAIRS)), worth / F.lit(pairs) * F.lit(4 * spark.sparkContext.defaultParallelism)))
    rows = max(TILE, CELL_BYTES // (8 * d))
    across = F.greatest(F.ceil(F.col("_q") / F.lit(rows)), F.round(F.sqrt(cells * F.col("_q") / F.col("_t"))), F.lit(1))
    grid = number.select("_group", across.cast("int").alias("_a"),
                         F.greatest(F.ceil(cells / across), F.lit(1)).cast("int").alias("_b"))
    grid = written(grid, "grid")
    total = grid.agg(F.sum(F.col("_a").cast("bigint") * F.col("_b"))).first()[0] or 1
    tasks = int(max(1, min(2 * total, max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(total / 4)))))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n, seed: F.pmod(hash32(row_id, seed=seed), F.col(n)).cast("int")
    # Whole numbers have no null in pandas; what stands there for a donor is not read.
    nothing = lambda f: F.lit(0 if isinstance(f.dataType, (T.IntegralType, T.BooleanType)) else None).cast(f.dataType)
    kept = [query.schema[c] for c in by]
    first = celltree._with(queries, grid, "_group").withColumn("_i", dealt("_a", 21)).withColumn("_j", every("_b"))
    then = celltree._with(donors, grid, "_group").withColumn("_j", dealt("_b", 22)).withColumn("_i", every("_a"))
    then = then.withColumns({f.name: nothing(f) for f in kept}) if kept else then
    names = [*by, "_group", row_id, "_x", "_pattern", "_i", "_j"]
    both = first.select(*names, F.lit(False).alias("_second")).unionByName(then.select(*names, F.lit(True).alias("_second")))
    cell = ["_group", "_i", "_j"]
    both = both.repartition(tasks, *cell).sortWithinPartitions(*cell, "_second", F.col("_pattern").desc(), row_id)

    def parts(batches):
        for pdf in batches:
            for key, part in pdf.groupby([*cell, "_second"], sort=False):
                yield key, part

    def rows_of(part):
        return celltree._decoded(part["_x"], d), part[row_id].to_numpy(), part["_pattern"].to_numpy(object)

    def meet(batches):
        for _, own in groupby(parts(batches), lambda p: p[0][:3]):
            held, blocks, fixed = [], None, None
            for key, part in own:
                if not key[3]:
                    held.append(rows_of(part))
                    fixed = fixed or {c: part[c].iloc[0] for c in found.names if c in by or c == "_group"}
                    continue
                if not held and blocks is None:
                    continue  # no queries
                if blocks is None:
                    queue, middle, unit = tiles(*(np.concatenate(x) for x in zip(*held)), k, fill)
                    held, blocks = [], _Blocks(middle, unit)
                for block in blocks.add(*rows_of(part)):
                    for tile in queue:
                        tile.meet(block)
            if blocks is None:
                continue
            for block in blocks.last():
                for tile in queue:
                    tile.meet(block)
            while queue:
                tile = queue.pop()
                r, ids, dist, _, gaps = tile.best()
                more = {"_fills": [g.tobytes() for g in np.packbits(gaps, axis=1)]} if fill and len(r) else {}
                if len(r):
                    out = pd.DataFrame({"query_id": tile.ids[r], "neighbor_id": ids, "dist": dist, **more})
                    yield out.assign(**{c: [v] * len(out) for c, v in fixed.items()})[found.names]

    return both.mapInPandas(meet, found)
