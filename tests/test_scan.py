"""All pairs of many-featured rows, against brute force, and how often rows are read or moved."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import neighbors, ordering, packed, scan
from cohortlens.plans import imputation_check, stratify

D = 20


def rows_of(kind, n, rng):
    x = rng.normal(size=(n, D))
    if kind == "blocks":
        for b in range(4):
            x[rng.random(n) < 0.2, 5 * b:5 * b + 5] = np.nan
    elif kind == "rare":  # few rows have feature 3, and no pattern is common
        x[rng.random(x.shape) < 0.1] = np.nan
        x[rng.random(n) > 0.01, 3] = np.nan
    elif kind == "ties":
        x = np.round(x[rng.integers(0, 30, n)], 1)
        x[::3, :5] = np.nan
    elif kind == "far":
        x = 1e7 + x
        x[::3, :5] = np.nan
    elif kind == "outlier":  # single precision would overflow
        x[5], x[7, 2] = 1e15, 1e30
        x[::3, :5] = np.nan
    return x


def brute(x, ids, i, k, feature=None):
    diff = x[i] - x
    shared = np.isfinite(diff).sum(axis=1)
    dist = np.round(np.sqrt(np.nansum(diff * diff, axis=1) * D / np.maximum(shared, 1)), 9)
    able = np.flatnonzero((shared > 0) & (True if feature is None else np.isfinite(x[:, feature])))
    first = able[np.lexsort((ids[able], dist[able]))][:k]
    return list(zip(ids[first], dist[first]))


def scanned(x, ids, k, fill):
    pattern = np.array([np.packbits(r).tobytes().hex() for r in np.isfinite(x)], object)
    order = np.argsort(pattern, kind="stable")
    queue, middle, unit = scan.tiles(x[order], ids[order], pattern[order], k, fill)
    blocks = scan._Blocks(middle, unit)
    for s in range(0, len(order), 300):
        part = order[::-1][s:s + 300]
        for block in blocks.add(x[part], ids[part], pattern[part]):
            for tile in queue:
                tile.meet(block)
    for block in blocks.last():
        for tile in queue:
            tile.meet(block)
    out = {}
    for tile in queue:
        r, donors, dist, _, gaps = tile.best()
        for n, row in enumerate(r):
            for j in np.flatnonzero(gaps[n]) if fill else [None]:
                out.setdefault((tile.ids[row], j), []).append((donors[n], dist[n]))
    return out


@pytest.mark.parametrize("fill", [False, True])
@pytest.mark.parametrize("kind", ["blocks", "rare", "ties", "far", "outlier"])
def test_tiles_find_what_brute_force_finds(monkeypatch, kind, fill):
    monkeypatch.setattr(scan, "BLOCK", 128)
    monkeypatch.setattr(scan, "TILE", 96)
    rng = np.random.default_rng(6)
    x, ids = rows_of(kind, 900, rng), np.array([f"s{i:04d}" for i in rng.permutation(900)], object)
    got, wanted = scanned(x, ids, 4, fill), 0
    for i in range(900):
        for j in np.flatnonzero(np.isnan(x[i])) if fill else [None]:
            want = brute(x, ids, i, 4, j)
            assert got.get((ids[i], j), []) == want
            wanted += bool(want)
    assert wanted == len(got) > 500


@pytest.mark.parametrize("pairs", [10 ** 10, 20_000])
def test_cells_of_a_grid_find_the_donors_of_each_group(spark, monkeypatch, pairs):
    monkeypatch.setattr(scan, "CELL_PAIRS", pairs)
    rng = np.random.default_rng(7)
    x, names, group = rows_of("blocks", 600, rng), [f"f{j}" for j in range(D)], np.arange(600) % 3
    ids = np.arange(600) // 3                                       # the same ids in every group
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(subjectkey=ids, run=group.astype("int32")))
    got = neighbors.nearest_donors(df, df, names, 3, by=["run"]).toPandas()
    found = {key: part.sort_values(["dist", "neighbor_id"]) for key, part in got.groupby(["run", "query_id", "feature"])}
    checked = 0
    for i in range(600):
        own = np.flatnonzero(group == group[i])
        for j in np.flatnonzero(np.isnan(x[i])):
            part, want = found.get((group[i], ids[i], f"f{j}")), brute(x[own], ids[own], ids[i], 3, j)
            assert (list(zip(part["neighbor_id"], part["dist"])) if part is not None else []) == want
            assert part is None or list(part["value"]) == [x[own][n, j] for n in part["neighbor_id"]]
            checked += bool(want)
    assert checked == len(found) > 500


def test_a_row_is_copied_a_few_times_whatever_the_number_of_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x, names = rng.normal(size=(6000, D)), [f"f{j}" for j in range(D)]
    x[::10, :5] = np.nan
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(subjectkey=range(6000)))
    moved = []
    repartition = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, *a: (moved.append(self) if "_second" in self.columns else None) or repartition(self, *a))
    neighbors._nearest(df, df, names, 5, "subjectkey", [], True, None)
    assert len(moved) == 1 and "_pattern" in moved[0].columns
    copies = moved[0].groupBy("_second").count().collect()
    each = {r["_second"]: r["count"] for r in copies}
    # At most about four cells a core: neither queries nor donors meet that in copies of their own.
    cells = 4 * spark.sparkContext.defaultParallelism
    assert each[False] <= 600 * cells and each[True] <= 6000 * cells
    assert each[False] + each[True] <= 6000 * 4


def test_validation_reads_rows_that_are_still_to_be_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rng = np.random.default_rng(9)
    frame = pd.DataFrame(rng.normal(size=(120, 3)), columns=["a", "b", "c"]).assign(subjectkey=range(120))
    rows = spark.createDataFrame(frame).mapInPandas(counted, "a double, b double, c double, subjectkey long")
    test = spark.createDataFrame(frame.assign(subjectkey=frame["subjectkey"] + 1000))
    config = stratify.StratifyConfig(ks=(2, 3), folds=2, rand_iter=2, vote_neighbors=3)
    result = stratify.run_validation(rows, test, test, ["a", "b", "c"], config)
    assert result.missing_by_cluster.count() and result.errors.count() == 2 and seen.value == 120


@pytest.mark.parametrize("m,labels,keep", [(3, 4, True), (10, 10, True), (10, 10, False), (15, 16, False)])
def test_votes_in_bits_are_those_of_plain_counts(m, labels, keep):
    rng = np.random.default_rng(m)
    held = {3: [np.array([5, 0, 20, 15][:labels] + [2] * max(0, labels - 4)), np.array([30, int(10 + 2 * max(0, labels - 4))])]}
    held[3][1][1] = held[3][0].sum() - 30
    codes = packed.Codes([2, 5], [np.arange(len(h)) for h in held[3]], held)
    n, q, iterations = int(held[3][0].sum()), 200, 7
    near, rank = rng.integers(0, n, (q, m)), rng.integers(0, n, q)
    label = lambda r: np.column_stack([np.searchsorted(np.cumsum(h), r, "right") for h in held[3]])
    got = packed.tables_of(codes, packed._Shuffles(codes, 3, iterations, 1, keep), near, label(near.ravel()).reshape(q, m, 2), rank,
                           label(rank), True, iterations)
    there = codes.shuffled(3, near.ravel(), label(near.ravel()).astype(np.uint16), iterations, 1).reshape(q, m, 2, iterations + 1)
    votes, truth = packed.voted(there, codes.most), codes.shuffled(3, rank, label(rank).astype(np.uint16), iterations, 1)
    sizes = [len(v) for v in codes.values]
    for i in range(iterations + 1):
        want = [np.bincount(truth[:, j, i].astype(int) * s + votes[:, j, i], minlength=s * s) for j, s in enumerate(sizes)]
        assert list(got[i]) == list(np.concatenate(want))


def test_rows_without_gaps_stay_where_they_are(spark):
    x = np.arange(60.0).reshape(20, 3)
    x[4, 1] = np.nan
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(subjectkey=range(20)))
    out = neighbors.impute_rows(df, df, ["a", "b", "c"], 2)
    got = out.toPandas().sort_values("subjectkey")
    x[4, 1] = (x[3, 1] + x[5, 1]) / 2
    assert list(got["subjectkey"]) == list(range(20)) and np.array_equal(got[["a", "b", "c"]].to_numpy(), x)
    assert "Union" in out._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]


@pytest.mark.parametrize("kind", ["normal", "ties", "one"])
def test_brackets_hold_the_wanted_ranks_and_little_else(spark, kind):
    rng = np.random.default_rng(11)
    n = 60_000
    x = rng.normal(size=n) if kind == "normal" else rng.integers(0, 5, n).astype(float) if kind == "ties" else np.full(n, 2.0)
    df = spark.createDataFrame(pd.DataFrame({"g": [0] * n, "x": x}))
    row = imputation_check.interval_brackets(df, ["g"], "x").first()
    x.sort()
    for b in row["_b"]:
        spread = 12 * np.sqrt(n * b.prob * (1 - b.prob)) + 42
        low, high = int(max(0, n * b.prob - spread)), int(min(n - 1, n * b.prob + spread))
        assert b.below == (0 if b.lo is None else (x < b.lo).sum())
        assert b.inside == (n if b.hi is None else (x <= b.hi).sum()) - b.below
        assert (b.lo is None or b.lo <= x[low]) and (b.hi is None or b.hi >= x[high])
        assert kind != "normal" or b.inside < n / 5
    with_them = ordering.exact_quantiles(df, ["g"], "x", imputation_check.QUANTILES, spark.createDataFrame([row])).collect()
    assert {r["prob"]: r["quantile"] for r in with_them} == {p: np.quantile(x, p) for p in imputation_check.QUANTILES}


def test_a_bracket_that_misses_its_rank_is_opened(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SAMPLE", 50)
    monkeypatch.setattr(ordering, "SAMPLE_SLACK", -3)
    df = spark.createDataFrame(pd.DataFrame({"g": [0] * 5000 + [1] * 3, "x": np.arange(5003.0)}))
    brackets = ordering.rank_brackets(df, ["g"], "x", [0.5], lambda n, p: F.lit(2.0))
    opened = {r["g"]: r["_b"][0] for r in brackets.collect()}
    assert opened[1].lo is None and opened[1].inside == 3
    assert opened[0].lo is None or opened[0].lo <= 2497
    got = {r["g"]: r["quantile"] for r in ordering.exact_quantiles(df, ["g"], "x", [0.5], brackets).collect()}
    assert got == {0: 2499.5, 1: 5001.0}
