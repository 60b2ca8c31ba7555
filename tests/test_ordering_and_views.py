"""Ranks, quantiles, views, counts and co-occurrence."""

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cohortlens.operators import graph, ordering, views


def test_rank_within_a_dominant_key(spark):
    df = spark.range(20000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE id % 7 END AS g").withColumn(
        "h", ordering.hash32("id", seed=3))
    got = ordering.with_rank(df, ["g"], "h", ["id"], "r", "n").toPandas()
    got["want"] = got.sort_values(["h", "id"]).groupby("g", dropna=False).cumcount() + 1
    assert (got["r"] == got["want"]).all()
    assert (got["n"] == got.groupby("g", dropna=False)["id"].transform("size")).all()


def test_rank_by_skewed_numbers_and_weights(spark):
    df = spark.range(5000).selectExpr("id", "CASE WHEN id < 4000 THEN 1.0D ELSE pow(1.01D, id - 4000) END AS x", "id % 3 + 1 AS w")
    got = ordering.with_rank(df, [], "x", ["id"], "r", span=None).toPandas().sort_values(["x", "id"])
    assert (got["r"].to_numpy() == np.arange(1, 5001)).all()
    got = ordering.with_rank(df, [], "x", ["id"], "r", "n", span=None, weight="w").toPandas().sort_values(["x", "id"])
    assert (got["r"].to_numpy() == got["w"].cumsum().to_numpy()).all() and (got["n"] == got["w"].sum()).all()


def test_quantiles_small_and_large_groups(spark):
    rng = np.random.default_rng(1)
    big = np.concatenate([rng.normal(size=60000), np.full(40000, 0.25), rng.pareto(1, 20000)])
    frame = pd.DataFrame({"g": ["big"] * len(big) + ["one"] + ["few"] * 4, "v": np.concatenate([big, [7.0], [1, 2, 4, 8.0]])})
    df = spark.createDataFrame(frame).repartition(8)
    probs = [0.0, 0.001, 0.25, 0.5, 0.9999, 1.0]
    got = {(r["g"], r["prob"]): r["quantile"] for r in ordering.exact_quantiles(df, ["g"], "v", probs).collect()}
    for g, part in frame.groupby("g"):
        for p in probs:
            assert abs(got[g, p] - np.quantile(part["v"], p)) < 1e-9, (g, p)


def test_quantiles_skip_null_and_allow_no_key(spark):
    df = spark.createDataFrame([(None,), (1.0,), (3.0,)], "v double")
    assert ordering.exact_quantiles(df, [], "v", [0.5]).first()["quantile"] == 2.0


def test_first_rows_and_counts_treat_null_keys_as_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, o int")
    assert sorted(r["o"] for r in ordering.first_rows(df, ["k"], ["o"]).collect()) == [1, 3]
    assert sorted(r["n"] for r in ordering.with_group_count(df, ["k"], "n").collect()) == [1, 2, 2]


OBS = [("a", "x", 5, 1), ("a", "x", 5, 2), ("a", "x", 9, 3), ("a", "y", 1, 4), ("b", "x", 7, 5), ("c", "y", 2, 6), ("c", "y", 2, 7)]


def _obs(spark):
    return spark.createDataFrame([(s, i, a, None, o) for s, i, a, o in OBS],
                                 "subjectkey string, instrument string, interview_age int, interview_date timestamp, _ord int")


def test_longitudinal_and_cross_section(spark):
    df = _obs(spark)
    got = sorted((r["subjectkey"], r["instrument"], r["interview_age"]) for r in views.longitudinal(df).collect())
    assert got == [("a", "x", 5), ("a", "x", 9), ("c", "y", 2)]
    first = views.cross_section(df)
    assert sorted(r["_ord"] for r in first.collect()) == [4, 5, 6]
    assert views.cross_section(first).count() == first.count()
    r = views.repeated_assessments(df).first()
    assert (r["observations"], r["subjects"]) == (6, 2)
    assert {r["instrument"]: (r["observations"], r["subjects"]) for r in views.subject_counts(df).collect()} == {"x": (4, 2), "y": (3, 2)}


def test_module_tables_stay_out_of_cross_sections(spark):
    df = _obs(spark)
    assert set(views.cross_sections({"adi": df, "ados": df, "adosm1": df, "ados2m1": df, "adostm": df}, ["_ord"])) == {"adi", "ados", "adosm1"}


def test_combination_counts(spark):
    rng = np.random.default_rng(2)
    names = ["i", "j", "k", "l"]
    rows = [(int(s), n) for s in range(200) for n in names[:3] if rng.random() < 0.5]
    df = spark.createDataFrame(rows + rows[:50], "subjectkey int, instrument string")
    sets = {n: {s for s, m in rows if m == n} for n in names}
    want = {"&".join(c): len(set.intersection(*[sets[n] for n in c])) for size in range(1, 5) for c in combinations(names, size)}
    assert {r["combination"]: r["subjects"] for r in views.combination_counts(df, names).collect()} == want
    pairs = views.combination_counts(df, names, max_size=2).collect()
    assert len(pairs) == 10 and all(want[r["combination"]] == r["subjects"] for r in pairs)


def test_wide_views(spark):
    one = spark.createDataFrame([("a", 1, "P1", 5.0), ("b", 2, "P1", 6.0)], "subjectkey string, interview_age int, interview_period string, f double")
    two = spark.createDataFrame([("b", 3, "P2", 7.0), ("c", 4, "P2", 8.0)], "subjectkey string, interview_age int, interview_period string, g double")
    inner = views.wide_inner({"ados": one, "srs": two})
    assert inner.columns == ["subjectkey", "interview_age_ados", "interview_period_ados", "f", "interview_age_srs", "interview_period_srs", "g"]
    assert [r["subjectkey"] for r in inner.collect()] == ["b"]
    outer = views.wide_outer({"ados": one, "srs": two})
    assert outer.columns == ["subjectkey", "f_ados", "g"]
    assert sorted((r["subjectkey"], r["f_ados"], r["g"]) for r in outer.collect()) == [("a", 5.0, None), ("b", 6.0, 7.0), ("c", None, 8.0)]
    assert views.wide_inner({"ados": one.filter("false"), "srs": two}).count() == 0


def test_cooccurrence_matches_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(f"run{r}-{rng.integers(3)}", s) for s in range(40) for r in range(3) if rng.random() < 0.9]
    rows += [("everyone", s) for s in range(40)]
    df = spark.createDataFrame(rows + rows[:10], "group_id string, subjectkey int")
    groups = {s: {g for g, t in rows if t == s} for s in range(40)}
    want = {(a, b): len(groups[a] & groups[b]) for a in range(40) for b in range(40) if a != b and groups[a] & groups[b]}
    got = {(r["subjectkey"], r["other"]): r["n"] for r in graph.cooccurrence_rows(df, spark.range(40).select(F.col("id").cast("int").alias("subjectkey"))).collect()}
    assert got == want
    matrix = {(tuple(r["profile_a"]), tuple(r["profile_b"])): r["n"] for r in graph.cooccurrence(df).collect()}
    assert all(matrix[b, a] == n for (a, b), n in matrix.items())
    totals = {r["subjectkey"]: r["shared"] for r in graph.cooccurrence_totals(df).collect()}
    assert all(totals[s] == sum(n for (a, _), n in want.items() if a == s) for s in range(40))
    known = spark.createDataFrame([(1,), (2,)], "subjectkey int")
    assert all(r["subjects_a"] <= 2 for r in graph.cooccurrence(df, known).collect())
