"""Driver tables seen as assessment data, for Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.operators.levels import LevelMap
from cohortlens.session import allow_wide


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- observations ------------------------------------------------------------
# ``lineitem`` has no unique key, so the order is the tuple of its columns.

_ORD = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity",
        "l_discount", "l_tax")
_OBS = {
    "subjectkey": "o_custkey",
    "interview_age": "CAST((l_orderkey*7 + l_linenumber*31) % 240 AS INT)",
    "interview_date": "l_shipdate",
    "instrument": "l_returnflag",
    "i1": "CASE WHEN l_partkey%11=0 THEN 999 WHEN l_partkey%13=0 THEN -9 ELSE CAST(l_quantity AS INT)%6 END",
    "i2": "CASE WHEN l_suppkey%7=0 THEN NULL ELSE CAST(l_quantity AS INT)%4 END",
    "i3": "CASE WHEN l_partkey%5=0 THEN NULL ELSE CAST(floor(l_tax*100+0.5) AS INT)%4 END",
    "i4": "CASE WHEN l_suppkey%9=0 THEN 999 ELSE CAST(floor(l_discount*100+0.5) AS INT)%4 END",
    # Standard scores with floor values and two sentinels.
    "m1": "CASE WHEN l_partkey%11=0 THEN 777 WHEN l_partkey%13=0 THEN -1 ELSE CAST(l_quantity AS INT)+18 END",
    "m2": "CASE WHEN l_suppkey%7=0 THEN NULL WHEN l_suppkey%9=0 THEN 999 ELSE CAST(l_quantity AS INT)+19 END",
}
ITEMS = ["i1", "i2", "i3", "i4"]
LEVELS = LevelMap(
    items=("i1", "i2", "i3", "i4"),
    subscales={"A1": ("i1", "i2"), "A2": ("i3",), "B1": ("i4",)},
    scales={"A": ("A1", "A2"), "B": ("B1",)},
    max_scores={"i1": 3.0, "i2": 3.0, "i3": 3.0, "i4": 3.0},
)
OBS = ("obs", "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _OBS.items())
       + f", l_partkey, ROW({', '.join(_ORD)}) AS _ord FROM lineitem JOIN orders ON l_orderkey = o_orderkey")


def obs(spark, sf) -> DataFrame:
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"),
                                             F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(*[F.expr(e).alias(n) for n, e in _OBS.items()], "l_partkey", F.struct(*_ORD).alias("_ord"))


# ---- phenotype entries and demographics --------------------------------------

PATTERN, EXCEPTION, DESCRIPTION = "urgent|high|medium|spec", "not spec", "f"
_PHENO = {
    "subjectkey": "o_custkey",
    "phenotype": "CASE WHEN o_orderkey%37=0 THEN NULL ELSE o_orderpriority END",
    "phenotype_description": "CASE WHEN o_orderkey%41=0 THEN NULL ELSE o_orderstatus END",
    "sex": "CASE WHEN o_custkey%2=0 THEN 'F' ELSE 'M' END",
    "ethnic_group": "o_orderstatus",
    "dataset_id": "CAST(o_orderkey%7 AS INT)",
    "site": "CAST(o_orderkey%5 AS INT)",
    "_ord": "o_orderkey",
}
PHENO = ("pheno", "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _PHENO.items()) + " FROM orders")
_SELECTED = f"""SELECT * FROM pheno WHERE phenotype IS NOT NULL AND subjectkey IN (
  SELECT subjectkey FROM pheno WHERE phenotype IS NOT NULL GROUP BY subjectkey
  HAVING bool_and(regexp_matches(lower(phenotype), '{PATTERN}'))
     AND (NOT bool_or(regexp_matches(lower(phenotype), '{EXCEPTION}'))
          OR bool_or(COALESCE(regexp_matches(lower(phenotype_description), '{DESCRIPTION}'), false))))
QUALIFY row_number() OVER (PARTITION BY subjectkey ORDER BY _ord) = 1"""
SELECTED = ("sel", _SELECTED)


def pheno(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(*[F.expr(e).alias(n) for n, e in _PHENO.items()])


_PEOPLE = {"subjectkey": "c_custkey", "sex": "CASE WHEN c_custkey%2=0 THEN 'F' ELSE 'M' END", "site": "n_name",
           "phenotype": "c_mktsegment", "region": "r_name"}
PEOPLE = ("people", "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _PEOPLE.items())
          + " FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")


def people(spark, sf) -> DataFrame:
    joined = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = joined.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(*[F.expr(e).alias(n) for n, e in _PEOPLE.items()])


# ---- instrument membership ---------------------------------------------------

INSTRUMENTS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
MEMBERS = ("members", "SELECT o_custkey AS subjectkey, o_orderpriority AS instrument FROM orders")


def members(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("subjectkey"), F.col("o_orderpriority").alias("instrument"))


# ---- events as questionnaire rows --------------------------------------------

_EVENT = {
    "subjectkey": "user_id",
    "interview_age": "CAST((event_id*7) % 240 AS INT)",
    "interview_date": "ts",
    "instrument": "event_type",
    "_ord": "event_id",
    "respond": "CASE WHEN event_id%10=0 THEN NULL WHEN event_id%11=0 THEN 999 ELSE event_id%3 END",
    "relationship": "CASE WHEN event_id%10=0 THEN NULL WHEN event_id%13=0 THEN 27 ELSE event_id%4+1 END",
    "score": "value",
    "token": "CASE event_id%9 WHEN 0 THEN '>90' WHEN 1 THEN '?90' WHEN 2 THEN '.' WHEN 3 THEN '888' WHEN 4 THEN '-9'"
             " WHEN 5 THEN '999.0' WHEN 6 THEN ' 999 ' ELSE CAST(CAST(floor(value) AS INT) AS {text}) END",
    "whole": "CAST(CAST(floor(value/2) AS INT) AS {text})",
    "v": "CASE WHEN event_id%17=0 THEN -1 ELSE CAST(floor(value/4) AS INT) END",
    "d": "CASE WHEN event_id%7=0 THEN NULL ELSE CAST(floor(value) AS INT) END",
}
EVENT = ("ev", "SELECT " + ", ".join(f"{e.format(text='VARCHAR')} AS {n}" for n, e in _EVENT.items()) + " FROM events")


def event_rows(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(*[F.expr(e.format(text="STRING")).alias(n) for n, e in _EVENT.items()])


# ---- numeric features --------------------------------------------------------

FEATURES = [f"f{i}" for i in range(64)]
_GAP = "(vec_id*64+{i})%7=0"
_IDS = ("vec_id AS subjectkey", "CAST(label AS INT) AS cluster", "CAST(label%2 AS INT) AS half",
        "CAST(vec_id%3 AS INT) AS run", "concat('P', CAST(vec_id%3+1 AS {text})) AS interview_period",
        "CASE WHEN vec_id%20<11 THEN 'train' ELSE 'test' END AS split")
FULL = ("full_rows", "SELECT " + ", ".join(x.format(text="VARCHAR") for x in _IDS) + ", " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(64)) + " FROM embeddings")
GAPS = ("gaps", "SELECT " + ", ".join(x.format(text="VARCHAR") for x in _IDS) + ", " + ", ".join(
    f"CASE WHEN {_GAP.format(i=i)} THEN NULL ELSE CAST(embedding[{i + 1}] AS DOUBLE) END AS f{i}"
    for i in range(64)) + " FROM embeddings")
# Long form of the same, one row per (row, feature), present values only.
_LONG = """SELECT vec_id AS subjectkey, CAST(label AS INT) AS cluster, CAST(label%2 AS INT) AS half,
  CAST(vec_id%3 AS INT) AS run, CASE WHEN vec_id%20<11 THEN 'train' ELSE 'test' END AS split,
  unnest(range(0, 64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings"""
FULL_LONG = ("full_long", f"SELECT *, concat('f', j) AS feature FROM ({_LONG})")
GAPS_LONG = ("gaps_long", f"SELECT *, concat('f', j) AS feature FROM ({_LONG}) WHERE (subjectkey*64+j)%7<>0")


def _vectors(spark, sf, gaps: bool) -> DataFrame:
    value = lambda i: F.col("embedding")[i].cast("double")
    rows = table(spark, sf, "embeddings")
    if gaps:
        allow_wide(rows, FEATURES)
    return rows.select(
        *[F.expr(x.format(text="STRING")) for x in _IDS],
        *[(F.when(~F.expr(_GAP.format(i=i)), value(i)) if gaps else value(i)).alias(f"f{i}") for i in range(64)])


def full_rows(spark, sf) -> DataFrame:
    return _vectors(spark, sf, False)


def gaps(spark, sf) -> DataFrame:
    return _vectors(spark, sf, True)
