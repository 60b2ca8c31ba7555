"""Every registered query against its SQL in DuckDB, on whole tables."""

import pytest

import __spark_entry__ as contract
from workload.check import compare, connect, row_by_row_joins

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert row_by_row_joins(df) == []
    assert compare(con, df, ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_has_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert row_by_row_joins(df) == []
    assert df.collect()


def test_entry(spark):
    assert contract.entry(spark).columns == ["interview_period", "n", "mean_a", "mean_b"]


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_same_rows_under_one_and_many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append([sorted(map(str, QUERIES[q](spark, SF).collect())) for q in (
            "l1_adi_levels", "d5_one_per_respondent", "d10_stratified_split", "o3_nearest_neighbors", "f11_quantiles",
            "s1a_select_first_row")])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
