"""Alignment, clustering, choice of k, statistics and sources."""

import random
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cohortlens.operators import compare, packed, stability
from cohortlens.operators.ordering import hash32
from cohortlens.plans import stratify
from cohortlens.session import shared_folder
from cohortlens.sources import readers, writers


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 5).flatmap(lambda k: st.lists(st.lists(st.integers(0, 9), min_size=k, max_size=k), min_size=k, max_size=k)))
def test_assignment_is_optimal(table):
    table = np.array(table, float)
    k = len(table)
    got = stability._assign(table)
    assert sorted(got) == list(range(k))
    assert table[np.arange(k), got].sum() == max(sum(table[i, p[i]] for i in range(k)) for p in permutations(range(k)))


def test_alignment_pads_missing_labels(spark):
    counts = spark.createDataFrame([(0, 0, 5, 3), (0, 1, 6, 2), (0, 1, 7, 9)], "run int, truth int, predicted int, n bigint")
    got = {r["predicted"]: r["aligned"] for r in stability.align_labels(counts, ["run"]).collect()}
    assert got[7] == 1 and got[5] == 0 and got[6] == -1
    assert abs(stability.aligned_loss(counts, ["run"]).first()["loss"] - (1 - 12 / 14)) < 1e-12
    plain = stability.plain_loss(counts, ["run"]).first()["loss"]
    assert stability.aligned_loss(counts, ["run"]).first()["loss"] <= plain


def blobs(spark, k=3, n=240, seed=0, spread=0.3):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, k, n)
    data = np.array([[6.0 * np.cos(2 * np.pi * c / k), 6.0 * np.sin(2 * np.pi * c / k)] for c in label]) + rng.normal(0, spread, (n, 2))
    frame = pd.DataFrame({"subjectkey": np.arange(n), "x": data[:, 0], "y": data[:, 1], "truth": label})
    return spark.createDataFrame(frame)


def test_ward_recovers_separate_groups(spark):
    df = blobs(spark)
    tree = stability.ward(df, ["x", "y"], 20)
    got = tree.label(df, [3]).groupBy("cluster_3").agg(F.count_distinct("truth").alias("n")).collect()
    assert len(got) == 3 and all(r["n"] == 1 for r in got)
    links = tree.linkage(spark).orderBy("step").collect()
    assert links[-1]["n"] == 240 and len(links) == len(tree.sizes) - 1
    heights = [r["height"] for r in links]
    assert all(b >= a - 1e-9 for a, b in zip(heights, heights[1:]))
    with pytest.raises(ValueError):
        stability.ward(df, ["x", "y"], 1001)


def test_merge_heights_match_direct_ward():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(12, 2))
    merges = stability._merge_centers(points, np.ones(12))
    member = {i: [i] for i in range(12)}
    for step, (a, b, height, n) in enumerate(merges):
        groups = list(member)
        cost = lambda g, h: np.sqrt(2 * len(member[g]) * len(member[h]) / (len(member[g]) + len(member[h]))) * np.linalg.norm(
            points[member[g]].mean(axis=0) - points[member[h]].mean(axis=0))
        best = min(cost(g, h) for i, g in enumerate(groups) for h in groups[i + 1:])
        assert abs(best - height) < 1e-9 and abs(cost(a, b) - height) < 1e-9
        member[12 + step] = member.pop(a) + member.pop(b)
        assert len(member[12 + step]) == n


def test_choose_k_on_separate_groups(spark):
    df = blobs(spark, 3)
    ward = lambda part, features: stability.ward(part, features, 15)
    choice = stability.choose_k(df, ["x", "y"], [2, 3, 4, 5], 3, 4, 5, cluster=ward)
    assert choice.best.first()["k"] == 3
    scores = {(r["k"], r["split"]): r for r in choice.scores.collect()}
    assert all(r["error"] < r["random_error"] for r in scores.values() if r["k"] == 3)
    curve = {(r["k"], r["split"]): r["mean"] for r in stability.stability_curve(choice.fold_scores).collect()}
    assert curve[3, "test"] == 0
    plain = stability.choose_k(df, ["x", "y"], [2, 3], 3, None, 5, cluster=ward)
    assert plain.scores.filter("random_error IS NOT NULL").count() == 0


def test_evaluate_labels_every_row(spark):
    df = stability.train_test(blobs(spark, 2), (), 0.45)
    train, test = (df.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    errors, labels = stability.evaluate(train, test, ["x", "y"], 2, 5, cluster=lambda d, f: stability.ward(d, f, 10))
    assert {r["split"]: r["error"] for r in errors.collect()} == {"train": 0.0, "test": 0.0}
    assert labels.count() == 240 and labels.filter("split = 'train'").count() == 132


def test_permuted_labels_keep_counts(spark):
    labels = spark.range(1000).selectExpr("0 AS run", "id AS subjectkey", "CAST(id % 10 = 0 AS INT) AS label")
    got = stability.permuted_labels(labels, 3, ["run"]).toPandas()
    assert len(got) == 3000 and (got.groupby("iter")["label"].sum() == 100).all()
    first = {i: frozenset(g[g["label"] == 1]["subjectkey"]) for i, g in got.groupby("iter")}
    assert len(set(first.values())) == 3


def test_keyed_permutations_are_one_to_one():
    for n in (1, 2, 3, 7, 64, 1000):
        seen = [tuple(packed.permuted(np.arange(n), n, key)) for key in range(30)]
        assert all(sorted(p) == list(range(n)) for p in seen)
        assert n < 64 or len(set(seen)) == 30
    # Over many keys every place is about equally likely.
    places = np.bincount([packed.permuted(np.array([3]), 10, key)[0] for key in range(5000)], minlength=10)
    assert places.min() > 400 and places.max() < 600


def brute_errors(labels, near, codes, iterations, seed, runs, ks):
    """Votes and losses one labelling at a time; alignment by trying every renaming."""
    out = {}
    for run in runs:
        train = sorted((r["_h"], r["id"]) for r in labels if r["run"] == run and r["split"] == "train" and r["k"] == ks[0])
        rank = {i: p for p, (_, i) in enumerate(train)}
        for j, k in enumerate(ks):
            own = {(r["split"], r["id"]): r["label"] for r in labels if r["run"] == run and r["k"] == k}
            deck = sorted(v for (s, _), v in own.items() if s == "train")
            for it in range(iterations + 1):
                to = packed.permuted(np.arange(len(train)), len(train), (seed * 1_000_003 + run) * 1_000_003 + it - 1)
                given = {i: own["train", i] if it == 0 else deck[to[p]] for i, p in rank.items()}
                for split in ("train", "test"):
                    pairs = []
                    for q in {x["query_id"] for x in near if x["run"] == run and x["split"] == split}:
                        votes = [given[x["neighbor_id"]] for x in near if x["run"] == run and x["split"] == split and x["query_id"] == q]
                        best = min(set(votes), key=lambda v: (-votes.count(v), v))
                        pairs.append((given[q] if split == "train" else own["test", q], best))
                    names = sorted({v for _, v in pairs} | {t for t, _ in pairs})
                    renamings = [dict(zip(names, p)) for p in permutations(names)] if split == "test" else [{v: v for v in names}]
                    loss = min(sum(t != m[v] for t, v in pairs) for m in renamings) / len(pairs)
                    out.setdefault((run, k, split), []).append(loss)
    return {key: (v[0], float(np.mean(v[1:]))) for key, v in out.items()}


def test_packed_errors_agree_with_one_labelling_at_a_time(spark):
    rng = random.Random(3)
    labels, near = [], []
    for run in (0, 1):
        for i in range(40):
            split = "train" if i < 25 else "test"
            labels += [(run, k, split, i, rng.randrange(k)) for k in (2, 4)]
            near += [(run, split, i, m) for m in rng.sample(range(25), 5 if i % 7 else 3)]
    ldf = spark.createDataFrame(labels, "run int, k int, split string, subjectkey int, label int")
    ndf = spark.createDataFrame(near, "run int, split string, query_id int, neighbor_id int")
    got = stability.Runs(ldf, ndf).all_errors(6, seed=2).collect()
    told = [{**r.asDict(), "id": r["subjectkey"]} for r in ldf.withColumn("_h", hash32("subjectkey", "run", seed=5)).collect()]
    want = brute_errors(told, [r.asDict() for r in ndf.collect()], None, 6, 2, (0, 1), (2, 4))
    assert len(got) == len(want) == 8
    for r in got:
        assert np.allclose((r["error"], r["random_error"]), want[r["run"], r["k"], r["split"]])
    plain = {(r["run"], r["k"], r["split"]): r["error"] for r in stability.Runs(ldf, ndf).errors().collect()}
    assert all(abs(plain[key] - v[0]) < 1e-12 for key, v in want.items())


def test_folds_have_equal_sizes(spark):
    got = stability.with_folds(spark.range(103).withColumnRenamed("id", "subjectkey"), 10).toPandas().sort_values("subjectkey")
    assert list(got["fold"]) == sorted(got["fold"]) and list(got.groupby("fold").size()) == [11] * 3 + [10] * 7


def test_split_is_stratified(spark):
    df = spark.range(1000).selectExpr("id AS subjectkey", "id % 3 AS g")
    got = stability.train_test(df, ["g"]).filter("split = 'train'").groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in got} == {0: 183, 1: 183, 2: 183}


def test_fold_scores_without_a_baseline(spark):
    errors = spark.createDataFrame([(0, 2, "train", 0.1), (0, 2, "test", 0.2)], "run int, k int, split string, error double")
    zero = spark.createDataFrame([(0, 2, "train", 0.0), (0, 2, "test", 0.0)], "run int, k int, split string, random_error double")
    for random in (None, zero):
        folds, scores = stability.score_folds(errors, random)
        assert all(r["normalized"] is None for r in folds.collect())
        assert {r["split"]: r["score"] for r in scores.collect()} == {"train": 0.1, "test": 0.2}


def test_best_k_takes_the_largest_on_ties(spark):
    scores = spark.createDataFrame([(2, 0.5), (3, 0.1), (4, 0.1), (5, 0.3)], "k int, score double")
    assert stability.best_k(scores).first()["k"] == 4


def test_stratify_end_to_end(spark):
    rng = np.random.default_rng(6)
    n = 160
    label = rng.integers(0, 2, n)
    names = ["receptive_vscore", "expressive_vscore", "written_vscore", "communicationdomain_totalb", "socializationdomain_totalb"]
    data = 10 + 8.0 * label[:, None] + rng.normal(0, 0.5, (n, 5))
    data[rng.random(data.shape) < 0.05] = np.nan
    frame = pd.DataFrame(data, columns=names)
    frame.insert(0, "subjectkey", [f"s{i:03d}" for i in range(n)])
    frame["interview_age"], frame["interview_period"], frame["_ord"] = 20, "P1", range(n)
    df = spark.createDataFrame(frame).select("subjectkey", "interview_age", "interview_period", "_ord",
                                             *[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in names])
    people = spark.createDataFrame([(f"s{i:03d}", "F", i % 3, "asd") for i in range(n)], "subjectkey string, sex string, site int, phenotype string")
    config = stratify.StratifyConfig(periods=["P1"], levels={"subdomain": "vscore"}, ks=[2, 3], folds=2, rand_iter=2, vote_neighbors=5,
                                     cluster=lambda d, f: stability.ward(d, f, 10))
    out = stratify.stratify(df, people, config=config)["P1"]
    data = out.data.toPandas()
    assert "written_vscore" not in data.columns and set(data["cluster_subdomain"]) <= {1, 2, 3}
    assert out.levels["subdomain"].k == 2 and data["sex"].notna().all()
    near = {(r["split"], r["cluster_a"], r["cluster_b"]): r["rms"]
            for r in out.distances("subdomain", ["receptive_vscore", "expressive_vscore"]).collect()}
    assert near["test", 1, 2] > near["test", 1, 1]
    folder = shared_folder(spark, "test-out")
    out.save(folder, "P1")
    assert spark.read.csv(f"{folder}/data_P1", header=True).count() == len(data)


# ---- statistics ----------------------------------------------------------------

def test_probabilities_agree_with_the_jvm(spark):
    dist = spark._jvm.org.apache.commons.math3.distribution
    rows = [(t, df) for t in (-3.2, -0.5, 0.0, 0.7, 2.5, 12.0) for df in (1.0, 2.5, 30.0, 900.0)]
    df = spark.createDataFrame(rows, "t double, df double")
    from cohortlens.functions import probability as P
    got = df.select("*", P.t_p_value("t", "df").alias("p"), P.t_p_value("t", "df", "less").alias("less"),
                    P.t_quantile("df").alias("q")).collect()
    for r in got:
        student = dist.TDistribution(r["df"])
        assert abs(r["p"] - 2 * student.cumulativeProbability(-abs(r["t"]))) < 1e-9
        assert abs(r["less"] - student.cumulativeProbability(r["t"])) < 1e-9
        assert abs(r["q"] / student.inverseCumulativeProbability(0.975) - 1) < 1e-6
    rows = [(x, a, b) for x in (0.01, 0.9, 3.0, 40.0) for a in (1.0, 4.0) for b in (5.0, 500.0)]
    df = spark.createDataFrame(rows, "x double, a double, b double")
    for r in df.select("*", P.f_p_value("x", "a", "b").alias("f"), P.chi2_p_value("x", "b").alias("c")).collect():
        assert abs(r["f"] - (1 - dist.FDistribution(r["a"], r["b"]).cumulativeProbability(r["x"]))) < 1e-9
        assert abs(r["c"] - (1 - dist.ChiSquaredDistribution(r["b"]).cumulativeProbability(r["x"]))) < 1e-9
    null = spark.createDataFrame([(None, 3.0)], "t double, df double")
    assert null.select(P.t_p_value("t", "df").alias("p")).first()["p"] is None


def test_chi_squared_correction_only_for_two_by_two(spark):
    rows = [("a", 0, 12), ("a", 1, 5), ("b", 0, 7), ("b", 1, 9)]
    table = spark.createDataFrame(rows, "category string, cluster int, n bigint")
    o = np.array([[12, 5], [7, 9]], float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    assert abs(compare.chi_squared(table).first()["chi2"] - ((np.abs(o - e) - 0.5) ** 2 / e).sum()) < 1e-9
    close = spark.createDataFrame([("a", 0, 10), ("a", 1, 10), ("b", 0, 10), ("b", 1, 10)], "category string, cluster int, n bigint")
    assert compare.chi_squared(close).first()["chi2"] == 0
    gap = spark.createDataFrame([("a", 0, 5), ("b", 1, 5), ("c", 0, 3), ("c", 1, 2)], "category string, cluster int, n bigint")
    o = np.array([[5, 0], [0, 5], [3, 2]], float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    r = compare.chi_squared(gap).first()
    assert abs(r["chi2"] - ((o - e) ** 2 / e).sum()) < 1e-9 and r["df"] == 2


def test_holm_is_monotone_and_not_below_raw(spark):
    rows = [("f", i, i + 1, p) for i, p in enumerate([0.04, 0.001, 0.02, 0.9, 0.5])] + [("f", 9, 10, None)]
    got = compare.holm(spark.createDataFrame(rows, "feature string, group_a int, group_b int, p double"), ["feature"]).toPandas()
    got = got.sort_values("p")
    assert np.allclose(got["p_holm"][:5].astype(float), [0.005, 0.08, 0.12, 1.0, 1.0]) and pd.isna(got["p_holm"].iloc[5])


def test_two_clusters_only_get_a_welch_test(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 4.0), (1, 6.0)], "c int, x double")
    assert [r["test"] for r in compare.compare_features(df, "c", ["x"]).collect()] == ["welch"]
    more = df.unionAll(spark.createDataFrame([(2, 3.0), (2, 5.0)], df.schema))
    assert sorted(r["test"] for r in compare.compare_features(more, "c", ["x"]).collect()) == ["anova"] + ["pairwise"] * 3


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0, 7.0), (1.0, 7.0), (0.5, 7.0), (None, 7.0)], "x double, y double")
    got = {(r["feature"], r["bin"]): r["n"] for r in compare.histogram(df, ["x", "y"]).collect()}
    assert got == {("x", 0): 1, ("x", 25): 1, ("x", 49): 1, ("y", 25): 4}


# ---- sources -------------------------------------------------------------------

def test_instrument_round_trip(spark, tmp_path):
    path = tmp_path / "toy01.txt"
    path.write_text('"subjectkey"\t"interview_age"\t"interview_date"\t"score"\n"The key"\t"Age"\t"Date"\t"Sum"\n'
                    'a\t12\t05/01/2010\t3\nb\tx\t2011-02-03\t\n')
    df = readers.with_file_order(readers.read_instrument(spark, str(path), {"interview_age": "int", "score": "double"}))
    rows = df.orderBy("_ord").collect()
    assert [(r["subjectkey"], r["interview_age"], r["score"]) for r in rows] == [("a", 12, 3.0), ("b", None, None)]
    assert str(rows[1]["interview_date"]) == "2011-02-03 00:00:00"
    assert readers.table_name(str(path)) == "toy01" and readers.table_name("adosmt.txt") == "adosmt"


def test_dictionary_first_table_wins(spark, tmp_path):
    (tmp_path / "a.txt").write_text("k\tx\nkey\tfirst\n1\t2\n")
    (tmp_path / "b.txt").write_text("k\tx\ty\nkey\tsecond\tthird\n1\t2\t3\n")
    got = readers.data_dictionary(spark, {"a": str(tmp_path / "a.txt"), "b": str(tmp_path / "b.txt")})
    assert {r["column"]: r["description"] for r in got.collect()} == {"k": "key", "x": "first", "y": "third"}


def test_tables_with_equal_headers_are_stacked(spark, tmp_path):
    for name, head in (("a", "k\ti\tx"), ("b", "k\tj\tx"), ("c", "k\ti\ty")):
        (tmp_path / f"{name}.txt").write_text(f"{head}\nd\td\td\n1\t2\t3\n")
    got = readers.read_stacked(spark, {n: str(tmp_path / f"{n}.txt") for n in "abc"})
    assert {n: df.count() for n, df in got.items()} == {"a": 2, "c": 1}


def test_codebook_and_csv(spark, tmp_path):
    (tmp_path / "book.csv").write_text("item,max_score,subscale,scale\nq1,3,A1,A\nq2,2,A1,A\n")
    rows = readers.read_codebook(spark, str(tmp_path / "book.csv")).orderBy("position").collect()
    assert [(r["item"], r["max_score"]) for r in rows] == [("q1", 3.0), ("q2", 2.0)]
    folder = shared_folder(spark, "csv")
    writers.save_csv(spark.createDataFrame([(2, "b"), (1, None)], "c int, s string"), folder, ["c"])
    assert [tuple(r) for r in readers.read_results(spark, folder, "c int, s string").orderBy("c").collect()] == [(1, None), (2, "b")]


def test_shuffles_do_not_travel_with_the_neighbours(spark):
    rows = spark.range(400).select(F.lit(0).alias("run"), F.lit("train").alias("split"), F.col("id").alias("subjectkey"),
                                   F.explode(F.array(F.lit(2), F.lit(3))).alias("k"))
    labels = rows.withColumn("label", (F.col("subjectkey") % F.col("k")).cast("int"))
    near = labels.where("k = 2").select("run", "split", F.col("subjectkey").alias("query_id"),
                                        F.explode(F.array("subjectkey", (F.col("subjectkey") + 6) % 400)).alias("neighbor_id"))
    few, many = (packed.labelling_errors(labels, near, n, "subjectkey", lambda t: int(np.trace(t))) for n in (1, 300))
    widths = []
    for df in (few, many):
        shuffled = df._jdf.queryExecution().optimizedPlan().toString()
        widths.append("_p#" in shuffled)
        assert df.where("split = 'train'").count() == 2
    assert widths == [False, False] and set(packed._ranked(labels, "subjectkey", 0).columns) == {"run", "split", "subjectkey", "_l", "_r"}
