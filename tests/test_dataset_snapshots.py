"""A saved build: levels computed once, views and wide tables derived from them."""

from pyspark.sql import functions as F

from cohortlens.operators import views
from cohortlens.plans.dataset import build_dataset, wide_tables
from workload import tables

SF = "/root/testdata/sf0.001"


def test_saved_build_equals_the_lazy_one(spark, tmp_path):
    built = build_dataset(tables._all_tables(spark, SF), tables.pheno(spark, SF), tables._config(), tables.PATTERN,
                          tables.EXCEPTION)
    counts = built.save(str(tmp_path)).collect()
    read = lambda part: spark.read.parquet(f"{tmp_path}/{part}")
    for stage, parts in (("level", built.levels), ("cross_section", built.cross_sections)):
        want = {n: (0, 0) for n in parts}
        want |= {r["instrument"]: (r["observations"], r["subjects"]) for r in views.subject_counts(views.stack(parts, [])).collect()}
        got = {r["instrument"]: (r["observations"], r["subjects"]) for r in counts if r["stage"] == stage}
        assert got == want and any(n for n, _ in want.values())
    long = views.subject_counts(built.longitudinal)
    assert sorted(map(tuple, views.subject_counts(read("longitudinal")).select(long.columns).collect())) == sorted(
        map(tuple, long.collect()))
    kept = {n: {r[0] for r in df.select("subjectkey").collect()} for n, df in built.cross_sections.items()}
    inner, outer = read("wide"), read("outer_wide")
    assert {r[0] for r in inner.select("subjectkey").collect()} == set.intersection(*kept.values())
    assert outer.count() == len(set.union(*kept.values()))
    assert {r["stage"] for r in counts} == {"level", "cross_section", "wide", "outer_wide", "demographics"}


def test_names_shared_by_instruments_carry_them(spark):
    one = spark.createDataFrame([(1, 5, 60, 0), (2, 6, 60, 1)], "subjectkey int, x int, interview_age int, _ord int")
    two = spark.createDataFrame([(2, 7, 1), (3, 8, 2)], "subjectkey int, x int, y int")
    three = spark.createDataFrame([(2, 9)], "subjectkey int, z int")
    inner, outer = wide_tables({"a": one, "b": two, "c": three})
    assert inner.collect() == [(2, 6, 60, 7, 1, 9)]
    assert inner.columns == ["subjectkey", "x_a", "interview_age_a", "x_b", "y", "z"]
    assert outer.columns == ["subjectkey", "x_a", "x_b", "y_b", "z"]
    assert sorted(outer.select(F.sum("x_a"), F.sum("x_b"), F.count("*")).first()) == [3, 11, 15]


def test_views_of_a_written_build_read_its_levels_only(spark):
    built = build_dataset(tables._all_tables(spark, SF), tables.pheno(spark, SF), tables._config(), tables.PATTERN,
                          tables.EXCEPTION)
    once = built.computed_once()
    plan = once.cross_sections["adi"]._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and "LeftSemi" in built.cross_sections["adi"]._jdf.queryExecution().optimizedPlan().toString()
    counts = lambda b: sorted(map(tuple, views.subject_counts(b.longitudinal).collect()))
    assert counts(once) == counts(built)
