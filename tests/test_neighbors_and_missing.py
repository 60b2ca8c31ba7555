"""Nearest neighbours, imputation, injection, against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import columns as X
from cohortlens.operators import celltree, missing, neighbors
from cohortlens.plans import imputation_check


def brute(train, query, ids, k):
    out = {}
    for q, row in query:
        diff = row - train
        shared = np.isfinite(diff).sum(axis=1)
        dist = np.round(np.sqrt(np.nansum(diff ** 2, axis=1) * train.shape[1] / np.maximum(shared, 1)), 9)
        order = np.lexsort((ids, np.where(shared > 0, dist, np.inf)))
        out[q] = [ids[i] for i in order if shared[i] > 0][:k]
    return out


def table(spark, data, **extra):
    names = [f"x{i}" for i in range(data.shape[1])]
    frame = pd.DataFrame(data, columns=names)
    frame.insert(0, "subjectkey", [f"s{i:05d}" for i in range(len(frame))])
    for c, v in extra.items():
        frame[c] = v
    return spark.createDataFrame(frame), names, frame


def neighbours_of(df):
    got = df.toPandas().sort_values(["query_id", "dist", "neighbor_id"])
    return got.groupby("query_id")["neighbor_id"].apply(list).to_dict()


@pytest.mark.parametrize("dims,rows,block", [(2, 2500, 32), (3, 1500, 16), (6, 800, 64)])
def test_neighbors_with_gaps_ties_and_pruning(spark, dims, rows, block):
    rng = np.random.default_rng(dims)
    data = np.round(rng.normal(size=(rows, dims)), 1)
    data[rng.random(data.shape) < 0.1] = np.nan
    data[: rows // 3] = data[0]  # a third of the rows are copies of one
    df, names, frame = table(spark, data)
    got = neighbours_of(neighbors.nearest_neighbors(df, df, names, 4, block_rows=block))
    ids = frame["subjectkey"].to_numpy()
    want = brute(data, [(ids[i], data[i]) for i in range(0, rows, 11)], ids, 4)
    assert all(got.get(q, []) == w for q, w in want.items())


def test_neighbors_within_groups(spark):
    rng = np.random.default_rng(5)
    data, group = rng.normal(size=(600, 2)), rng.integers(0, 3, 600)
    df, names, frame = table(spark, data, period=[f"P{g}" if g else None for g in group])
    got = neighbours_of(neighbors.nearest_neighbors(df, df, names, 3, by=["period"], block_rows=16))
    ids = frame["subjectkey"].to_numpy()
    for g in range(3):
        at = group == g
        want = brute(data[at], [(q, r) for q, r in zip(ids[at], data[at])], ids[at], 3)
        assert all(got[q] == w for q, w in want.items())


def test_fewer_rows_than_neighbors(spark):
    df, names, _ = table(spark, np.array([[0.0], [1.0], [np.nan]]))
    got = neighbours_of(neighbors.nearest_neighbors(df, df, names, 5))
    assert got == {"s00000": ["s00000", "s00001"], "s00001": ["s00001", "s00000"]}


def test_small_and_large_tables_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(6)
    data = rng.normal(size=(900, 3)) + 1e6                  # far from zero
    data[rng.random(data.shape) < 0.1] = np.nan
    df, names, frame = table(spark, data)
    assert neighbors._Search(df, df, names, 4, "subjectkey", [], False, None).tree.flat
    few = neighbours_of(neighbors.nearest_neighbors(df, df, names, 4))
    monkeypatch.setattr(celltree, "TINY_ROWS", 100)
    search = neighbors._Search(df, df, names, 4, "subjectkey", [], False, None)
    assert not search.tree.flat and search.tree.cuts
    assert neighbours_of(neighbors.nearest_neighbors(df, df, names, 4)) == few


def test_visited_rows_stay_flat_as_a_table_grows(spark):
    seen = []
    for n in (2_000, 20_000):
        df, names, _ = table(spark, np.random.default_rng(n).normal(size=(n, 2)))
        few = df.where("subjectkey < 's00500'")
        seen.append(neighbors.visited_rows(df, few, names, 5, block_rows=128).agg(F.avg("visited")).first()[0])
    assert seen[1] < 1.3 * seen[0] < 800


def test_bounds_hold_for_rows_with_gaps():
    rng = np.random.default_rng(3)
    q, rows = rng.normal(size=(40, 5)), rng.normal(size=(60, 5)) + 2
    q[rng.random(q.shape) < 0.2] = np.nan
    rows[:, 1] = np.nan
    limits = celltree._limits(rows)
    box = {c: np.frombuffer(limits[c]).reshape(1, -1) for c in ("lo", "hi", "count", "center")}
    box |= {"n": np.array([60.0]), "radius": np.array([limits["radius"]])}
    assert np.isfinite(limits["radius"])
    exact = neighbors._rough(q, rows) * 5
    lower, upper = celltree.box_bounds(q, box)
    ok = np.isfinite(exact)
    for bound in (lower[:, 0], celltree.ball_bound(q, box)[:, 0]):
        assert (np.where(ok, exact, np.inf).min(axis=1) >= bound - 1e-9).all()
    assert (np.where(ok, exact, -np.inf).max(axis=1) <= upper[:, 0] + 1e-9).all()


@pytest.mark.parametrize("block", [16, 1024])
def test_imputation_matches_brute_force(spark, block):
    rng = np.random.default_rng(7)
    data = rng.normal(size=(500, 4))
    data[rng.random(data.shape) < 0.25] = np.nan
    df, names, frame = table(spark, data)
    train = df.filter("subjectkey < 's00300'")
    got = neighbors.impute_rows(train, df, names, 3, block_rows=block).toPandas().sort_values("subjectkey")[names].to_numpy()
    t = data[:300]
    for i, row in enumerate(data):
        diff = row - t
        shared = np.isfinite(diff).sum(axis=1)
        dist = np.sqrt(np.nansum(diff ** 2, axis=1) * 4 / np.maximum(shared, 1))
        for j in range(4):
            if np.isfinite(row[j]):
                assert got[i, j] == row[j]
                continue
            able = np.flatnonzero(np.isfinite(t[:, j]) & (shared > 0))
            near = able[np.argsort(np.round(dist[able], 9), kind="stable")[:3]]
            want = t[near, j].mean() if len(near) else np.nanmean(t[:, j])
            assert abs(got[i, j] - want) < 1e-9


def test_no_comparable_donor_gives_the_train_mean(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 3.0, None), ("c", None, 5.0)], "subjectkey string, x double, y double")
    got = {r["subjectkey"]: (r["x"], r["y"]) for r in neighbors.impute_rows(df, df, ["x", "y"], 1).collect()}
    assert got == {"a": (1.0, 5.0), "b": (3.0, 5.0), "c": (2.0, 5.0)}


def test_impute_by_age_keeps_periods_apart(spark):
    df = spark.createDataFrame([("a", "P1", 1.0, 1.0), ("b", "P1", 1.0, None), ("c", "P2", 1.0, 9.0), ("d", "P2", 1.0, None)],
                               "subjectkey string, interview_period string, x double, y double")
    train, test = neighbors.impute_by_age(df, df.filter("y IS NULL"), ["x", "y"], 1)
    assert {r["subjectkey"]: r["y"] for r in train.collect()} == {"a": 1, "b": 1, "c": 9, "d": 9}
    assert {r["subjectkey"]: r["y"] for r in test.collect()} == {"b": 1, "d": 9}


def test_vote_prefers_the_smallest_label_on_ties(spark):
    near = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "c"), ("q", "d")], "query_id string, neighbor_id string")
    labels = spark.createDataFrame([("a", 2), ("b", 1), ("c", 2), ("d", 1)], "subjectkey string, label int")
    assert neighbors.vote(near, labels).first()["predicted"] == 1


def test_distance_summary_matches_all_pairs(spark):
    rng = np.random.default_rng(9)
    data, cluster = rng.normal(size=(60, 3)), rng.integers(0, 3, 60)
    df, names, frame = table(spark, data, cluster=cluster)
    got = {(r["cluster_a"], r["cluster_b"]): r for r in neighbors.distance_summary(df, "cluster", names).collect()}
    for a in range(3):
        for b in range(a, 3):
            sq = [((data[i] - data[j]) ** 2).sum() for i in range(60) for j in range(60)
                  if cluster[i] == a and cluster[j] == b and (a != b or i < j)]
            assert got[a, b]["pairs"] == len(sq) and abs(got[a, b]["mean_square"] - np.mean(sq)) < 1e-9
    rows = neighbors.distance_rows(df, df.filter("subjectkey = 's00004'"), names).toPandas().set_index("subjectkey")
    assert np.allclose(rows.loc[frame["subjectkey"], "dist"], np.sqrt(((data - data[4]) ** 2).sum(axis=1)))


def test_anchor_list_is_bounded(spark):
    df, names, _ = table(spark, np.zeros((1001, 1)))
    with pytest.raises(ValueError):
        neighbors.distance_rows(df, df, names)


def _with_missing(spark):
    rows = [("none", 0), ("under", 2), ("exact15", 3), ("at", 7), ("above", 8)]
    names = [f"q{i}" for i in range(20)]
    data = [(s, "P2", *[None if i < n else 1.0 for i in range(20)]) for s, n in rows]
    data.append(("other", "P1", *[None] * 20))
    return spark.createDataFrame(data, "subjectkey string, interview_period string, " + ", ".join(f"{n} double" for n in names))


def test_prepare_imputation_boundaries(spark):
    got = {r["subjectkey"]: r["countna"] for r in missing.prepare_imputation({"x": _with_missing(spark)}, "P2", 0.35)["x"].collect()}
    assert got == {"none": 0, "under": 0, "exact15": 1, "at": 1}
    got = {r["subjectkey"]: r["countna"] for r in missing.prepare_imputation({"x": _with_missing(spark)}, "P2", 0.95)["x"].collect()}
    assert got == {"none": 0, "under": 0, "exact15": 0, "at": 0, "above": 0}


def test_gate_looks_at_all_instruments(spark):
    gappy, full = _with_missing(spark), _with_missing(spark).fillna(1.0)
    both = missing.prepare_imputation({"gappy": gappy, "full": full}, "P2", 0.35)
    assert both["full"].count() == 5 and both["gappy"].count() == 4
    assert "countna" in both["full"].columns


def test_missing_frequency_adds_up(spark):
    got = missing.missing_frequency(_with_missing(spark)).toPandas()
    assert np.allclose(got.groupby("feature")["perc"].sum(), 100) and len(got) == 40


def test_mcar_share_and_blocks(spark):
    df = spark.range(4000).selectExpr("id AS subjectkey", "1.0D AS a", "1.0D AS b", "1.0D AS c")
    out = missing.inject_mcar(df, {"one": ["a", "b"], "two": ["c"]}, 0.2).toPandas()
    assert (out["a"].isna() == out["b"].isna()).all()
    assert not (out["a"].isna() & out["c"].isna()).any()
    assert abs(out["a"].isna().mean() - 0.05) < 0.01 and abs(out["c"].isna().mean() - 0.05) < 0.01
    again = missing.inject_mcar(df.repartition(3), {"one": ["a", "b"], "two": ["c"]}, 0.2).toPandas()
    assert set(out[out["c"].isna()]["subjectkey"]) == set(again[again["c"].isna()]["subjectkey"])


def test_mar_depends_on_observed_values(spark):
    names = ["a", "b", "c", "d"]
    df = spark.range(6000).select(F.col("id").alias("subjectkey"), *[F.rand(i).alias(n) for i, n in enumerate(names)])
    out = missing.inject_mar(df, names, 0.2).toPandas()
    share = out[names].isna().any(axis=1).mean()
    assert 0.08 < share < 0.32
    one = missing.inject_mar(df.limit(1), names, 0.2, patterns=1, seed=4)
    assert one.count() == 1


def _maritz_jarrett(x, p):
    from cohortlens.functions.probability import beta_cdf
    x, n = np.sort(x), len(x)
    m = int(p * n + 0.5)
    at = np.arange(1, n + 1) / n
    w = beta_cdf(m - 1, n - m, at) - beta_cdf(m - 1, n - m, at - 1 / n)
    se = np.sqrt(w @ x ** 2 - (w @ x) ** 2)
    k = int(np.clip(np.floor((n + 1) * p), 1, n - 1))
    part = np.clip((n + 1) * p - k, 0, 1)
    center = (1 - part) * x[k - 1] + part * x[k]
    return center - 1.959963984540054 * se, center + 1.959963984540054 * se


def test_quantile_intervals(spark):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=300), 2)
    df = spark.createDataFrame([("f", float(v)) for v in x], "feature string, value double")
    for r in imputation_check.quantile_intervals(df, ["feature"]).collect():
        low, high = _maritz_jarrett(x, r["prob"])
        assert abs(r["low"] - low) < 1e-9 and abs(r["high"] - high) < 1e-9


def test_mean_interval(spark):
    df = spark.createDataFrame([("f", float(v)) for v in range(10)], "feature string, value double")
    r = imputation_check.mean_intervals(df, ["feature"]).first()
    half = 2.262157162740992 * np.std(range(10)) / np.sqrt(10)
    assert abs(r["low"] - (4.5 - half)) < 1e-9 and abs(r["high"] - (4.5 + half)) < 1e-9


def test_imputation_quality_on_related_features(spark):
    rng = np.random.default_rng(13)
    base = rng.normal(10, 2, size=(400, 1))
    df, names, _ = table(spark, base + rng.normal(0, 0.2, size=(400, 4)))
    scores = imputation_check.evaluate_imputation(df, names, 0.2, 3, 5, "MCAR", {"l": names[:2], "r": names[2:]}).toPandas()
    assert set(scores["statistic"]) == {"mean", "q0.25", "q0.5", "q0.75"}
    assert (scores["percent_bias"] < 5).all() and (scores["coverage"] > 0.9).all() and (scores["width"] > 0).all()
    # A complete table stays as it is: no bias at all.
    base_df = df.select("subjectkey", *names)
    same = imputation_check.imputation_scores(base_df, base_df.withColumn("iteration", F.lit(0)), names)
    assert all(abs(r["raw_bias"]) < 1e-9 for r in same.collect())


def test_min_max(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 5.0), ("b", 9.0, 5.0), ("b", None, 5.0)], "g string, x double, y double")
    got = sorted((r["g"], r["x"] is None, r["x"] or 0.0, r["y"]) for r in X.with_min_max(df, ["x", "y"], ["g"]).collect())
    assert got == [("a", False, 0.0, 0.0), ("a", False, 1.0, 0.0), ("b", False, 0.0, 0.0), ("b", True, 0.0, 0.0)]


def test_visits_hand_on_packs_before_they_pile_up(monkeypatch):
    from cohortlens.operators import celltree
    monkeypatch.setattr(celltree, "OUT_BYTES", 10_000)
    d, rng = 8, np.random.default_rng(5)
    boxes = {c: v.tobytes() for c, v in (("lo", np.zeros((40, d))), ("hi", np.ones((40, d))), ("count", np.full((40, d), 9.0)),
                                         ("center", np.full((40, d), 0.5)))}
    pack = {"_group": "", "_node": "", "_ids": np.arange(50), "_m": rng.random((50, d)).tobytes(),
            "_far": np.full(50, np.inf).tobytes(), "_children": [f"c{j}" for j in range(40)], "n": [9] * 40, "radius": [np.inf] * 40, **boxes}
    names = ["_group", "_node", "_ids", "_m", "_far"]
    parts = list(celltree._visit([pd.DataFrame([pack] * 3)], ["_group"], names, d, 2, False))
    assert max(part["_m"].map(len).sum() for part in parts) <= 10_000 + 50 * 8 * d
    assert sum(part["_ids"].map(len).sum() for part in parts) == 3 * 40 * 50


@pytest.mark.parametrize("fill", [False, True])
def test_blocks_send_only_rows_within_reach(spark, fill):
    # 16 features prune little: a query visits nearly every block, but few of those hold a near row.
    x = np.random.default_rng(6).normal(size=(1500, 16))
    if fill:
        x[::3, 4] = np.nan
    names = [f"f{i}" for i in range(16)]
    rows = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(subjectkey=range(1500)))
    met = neighbors._nearest(rows, rows, names, 5, "subjectkey", [], fill, 64)
    visits = neighbors.visited_rows(rows, rows, names, 5, fill=fill, block_rows=64).agg(F.sum("visited")).first()[0]
    assert met.count() < 0.5 * 5 * visits / 64
