"""Values and sizes at which earlier versions failed."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens import session
from cohortlens.functions.probability import beta_cdf, gamma_tail
from cohortlens.operators import graph, neighbors, ordering, stability
from cohortlens.sources import readers


def test_ward_of_fewer_distinct_rows_than_leaves(spark):
    rows = spark.range(92).select("id", (F.col("id") % 13).cast("double").alias("x"), F.floor(F.col("id") / 13).cast("double").alias("y"))
    for df, distinct in ((rows, 92), (rows.withColumn("y", F.lit(0.0)), 13)):
        tree = stability.ward(df, ["x", "y"])
        assert tree.sizes.sum() == 92 and len(tree.sizes) <= distinct and (tree.sizes > 0).all()
        assert tree.label(df, [2, 3]).select("cluster_2", "cluster_3").distinct().count() >= 3
        assert tree.linkage(spark).count() == len(tree.sizes) - 1


def test_cooccurrence_of_single_subjects(spark):
    members = spark.createDataFrame([("a", "g1"), ("b", "g1"), ("b", "g2"), ("c", "g1"), ("c", "g2"), ("d", "g3")], "subjectkey string, group_id string")
    got = {(tuple(r.profile_a), tuple(r.profile_b)): r.n for r in graph.cooccurrence(members).collect()}
    one, two = ("g1",), ("g1", "g2")
    assert got == {(one, two): 1, (two, one): 1, (two, two): 2}
    rows = graph.cooccurrence_rows(members, spark.createDataFrame([("b",), ("d",)], "subjectkey string")).collect()
    assert {(r.subjectkey, r.other): r.n for r in rows} == {("b", "a"): 1, ("b", "c"): 2}


def test_half_width_is_that_of_the_mean(spark):
    scores = spark.createDataFrame([(2, "test", .5), (2, "test", 1.4), (3, "test", 1.2), (3, "test", 1.4)], "k int, split string, normalized double")
    got = {r.k: (r["mean"], r.half_width) for r in stability.stability_curve(scores).collect()}
    assert got[2][0] == pytest.approx(.95) and got[2][1] == pytest.approx(1.96 * math.sqrt(.95 * .05 / 2))
    assert got[3][0] == pytest.approx(1.3) and got[3][1] is None


def test_distances_with_gaps_and_far_from_zero(spark):
    rows = spark.createDataFrame([("a", 1., None), ("a", 3., 1.), ("a", 5., 3.), ("b", 1e8, 1.), ("b", 1e8 + 1, 1.)], "c string, x double, y double")
    got = {(r.cluster_a, r.cluster_b): (r.pairs, r.mean_square) for r in neighbors.distance_summary(rows, "c", ["x", "y"]).collect()}
    assert got[("a", "a")] == (1, pytest.approx(8.0)) and got[("b", "b")] == (1, pytest.approx(1.0))
    assert got[("a", "b")][0] == 4


def test_folds_and_split_of_text_keys(spark):
    rows = spark.range(103).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("subjectkey"))
    keys = sorted(f"s{i}" for i in range(103))
    got = {r.subjectkey: r.fold for r in stability.with_folds(rows, 10).collect()}
    assert [got[k] for k in keys] == sorted(got.values()) and sorted(np.bincount(list(got.values()))) == [10] * 7 + [11] * 3
    big = spark.range(3000).withColumnRenamed("id", "subjectkey")
    assert stability.train_test(big, test_size=0.333).where("split = 'train'").count() == 2001


def test_ranks_in_one_key_use_many_tasks(spark):
    rows = spark.range(40000).select(F.lit(1).alias("k"), F.pmod(F.xxhash64("id"), F.lit(5000)).alias("v"), "id")
    ranked = ordering.with_rank(rows, ["k"], "v", ["id"], "r", span=None)
    assert ranked.select("r").distinct().count() == 40000
    least, most = ranked.groupBy("v").agg(F.min("r").alias("a"), F.max("r").alias("b")).orderBy("v").select(F.min("a"), F.max("b")).first()
    assert (least, most) == (1, 40000)


def test_tails_of_large_parameters():
    assert float(beta_cdf(1e8, 1e8, .5)) == pytest.approx(.5, abs=1e-5)
    assert float(gamma_tail(1e6, 1e6)) == pytest.approx(.49986702, abs=1e-6)
    assert float(gamma_tail(1e6, 1e6 + 1)) == pytest.approx(.49986702 - 1 / math.sqrt(2 * math.pi * 1e6), abs=1e-5)


def test_written_dates_and_missing_texts(spark, tmp_path):
    (tmp_path / "t.txt").write_text('"subjectkey"\t"interview_date"\t"v"\n"id"\t"when"\t"value"\na\t10/05/2009\tNaN\nb\t2009-10-05\t1.5\nc\tNA\tx\n')
    got = {r.subjectkey: r for r in readers.read_instrument(spark, str(tmp_path / "t.txt"), {"v": "double"}).collect()}
    assert str(got["a"].interview_date)[:10] == str(got["b"].interview_date)[:10] == "2009-10-05"
    assert got["c"].interview_date is None and got["a"].v is None and got["b"].v == 1.5 and got["c"].v is None


def test_a_cluster_needs_a_shared_folder():
    class Fake:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        session.shared_folder(Fake, "x")


def test_many_tails_of_large_parameters_at_once():
    # Each has converged at its own step; rounding errors keep some of them moving at any one.
    t, n = np.random.default_rng(1).normal(size=5000) * 3, 65_000.0
    many = beta_cdf(n / 2, 0.5, n / (n + t * t))
    alone = [float(beta_cdf(n / 2, 0.5, n / (n + v * v))) for v in t[:200]]
    assert many[:200] == pytest.approx(alone, rel=1e-12)
    assert many == pytest.approx([math.erfc(abs(v) / math.sqrt(2)) for v in t], abs=1e-4)
    a = np.full(5000, 3e4)
    x = a + np.random.default_rng(2).normal(size=5000) * np.sqrt(a)
    tails = gamma_tail(a, x)
    assert tails[:200] == pytest.approx([float(gamma_tail(a[0], v)) for v in x[:200]], rel=1e-12)
