"""Boundary rows of the cleaning rules and level tables."""

from cohortlens.functions import columns as X
from cohortlens.operators import clean, cohort, levels
from cohortlens.operators.levels import LevelConfig, LevelMap
from pyspark.sql import functions as F

NAN = float("nan")


def values(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()]


def column(spark, data, kind, rule):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, x {kind}")
    return values(df.select("i", rule("x").alias("y")).orderBy("i"), "y")


def test_age_periods(spark):
    ages = [-1, 0, 1, 30, 31, 72, 73, 156, 157, 203, 204, None]
    assert column(spark, ages, "int", X.age_period) == [
        "P5", "P5", "P1", "P1", "P2", "P2", "P3", "P3", "P4", "P4", "P5", "P5"]


def test_item_recode(spark):
    data = [-999, -1, 0, 3, 4, 998, 999, None]
    assert column(spark, data, "int", X.recode_item) == [None, None, 0, 3, 0, 0, None, None]
    assert column(spark, data, "int", lambda c: X.recode_item(c, None)) == data
    assert column(spark, ["2", " 7", "x", "999"], "string", X.recode_item) == [2, 0, None, None]


def test_score_sentinels_and_floor(spark):
    assert column(spark, [20, 21, 776, 777, -1, None], "int", X.recode_scale_score) == [20, 21, 776, None, None, None]
    df = spark.createDataFrame([(1, 20.0, 50.0), (2, 21.0, None), (3, None, None), (4, None, 19.0)], "i int, a double, b double")
    assert values(clean.drop_floor_scores(df, ["a", "b"]).orderBy("i"), "i") == [2, 3]


def test_adaptive_ranges(spark):
    df = spark.createDataFrame([(140.0, 24.0, 26.0), (141.0, 25.0, 27.0), (-1.0, -1.0, 141.0)],
                               "d double, a_vscore double, relationship double")
    out = clean.recode(df, df.columns, X.recode_adaptive)
    assert values(out, *df.columns) == [(140, 24, 26), (None, None, None), (None, None, None)]
    older = clean.recode(df, df.columns, lambda c: X.recode_adaptive(c, mode="older"))
    assert values(older, *df.columns) == [(140, 24, 26), (141, 25, None), (None, None, 141)]


def test_token_scores(spark):
    data = [">90", "?90", '"', ".", "999", "999.0", "888", "-9", "200", "201", " 12 ", None, "abc"]
    assert column(spark, data, "string", X.recode_token_score) == [
        91, 90, None, None, None, None, None, None, 200, None, 12, None, None]
    assert column(spark, data, "string", lambda c: X.recode_token_score(c, "older")) == [
        91, 90, None, None, None, 999, 888, -9, 200, 201, 12, None, None]
    df = spark.createDataFrame([(999,), (2,), (None,)], "respond int")
    assert values(clean.recode_tokens(df, ["respond"]), "respond") == [None, 2, None]


def test_nan_is_missing(spark):
    assert column(spark, [1.0, NAN, None], "double", X.nan_to_null) == [1, None, None]


def test_uninformative_rows(spark):
    df = spark.createDataFrame([("a", None, None), ("a", 1, None), ("b", 0, 0), ("c", None, 0), ("d", 1, -1), ("e", 0, 2)],
                               "subjectkey string, x int, y int")
    assert values(clean.drop_uninformative(df, ["x", "y"]).orderBy("subjectkey"), "subjectkey") == ["a", "e"]
    assert values(clean.drop_uninformative(df, ["x", "y"], mode="subject"), "subjectkey") == ["e"]


def test_many_columns_plan_quickly(spark):
    names = [f"q{i}" for i in range(90)]
    df = spark.range(100).select(F.col("id").alias("subjectkey"), F.lit(5).alias("interview_age"), F.lit(None).cast("timestamp").alias("interview_date"),
                                 F.col("id").alias("_ord"), *[((F.col("id") + i) % 6).alias(n) for i, n in enumerate(names)])
    levels_of = LevelMap(tuple(names), {f"s{j}": tuple(names[10 * j:10 * j + 10]) for j in range(9)},
                         {"t": tuple(f"s{j}" for j in range(9))}, {n: 3.0 for n in names})
    rows = levels.adi_levels(df, levels_of).collect()
    assert len(rows) == 100
    for r in rows:
        item = lambda i: 0 if (r["subjectkey"] + i) % 6 > 3 else (r["subjectkey"] + i) % 6
        assert abs(r["s4"] - sum(item(i) for i in range(40, 50)) / 30) < 1e-12


def test_repeats_keep_last(spark):
    df = spark.createDataFrame([("a", 5, 1, None, 1), ("a", 5, 1, None, 2), ("a", 5, 2, None, 3), ("a", 6, 1, None, 4),
                                ("b", 5, None, 1, 5), ("b", 5, None, 1, 6), ("b", 5, None, 2, 7)],
                               "subjectkey string, interview_age int, x int, respond int, _ord int")
    out = clean.drop_repeats(df, ["x"], informant="respond")
    assert sorted(values(out, "_ord")) == [2, 3, 4, 6, 7]
    assert sorted(values(clean.drop_repeats(out, ["x"], informant="respond"), "_ord")) == [2, 3, 4, 6, 7]
    assert sorted(values(clean.drop_repeats(df, ["x"]), "_ord")) == [2, 3, 4, 7]


def test_repeats_of_a_dominant_key(spark):
    df = spark.range(30000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS subjectkey", "1 AS interview_age", "1 AS x", "id AS _ord")
    out = clean.drop_repeats(df, ["x"])
    assert out.count() == 20001 and out.filter("subjectkey = 0").first()["_ord"] == 29997


def test_one_per_respondent(spark):
    df = spark.createDataFrame([("a", 1, 9, 1), ("a", 1, 5, 2), ("a", None, 1, 3), ("b", None, 4, 4), ("b", None, 3, 5), ("c", 2, 1, 6)],
                               "subjectkey string, respond int, interview_age int, _ord int")
    assert sorted(values(clean.one_per_respondent(df), "_ord")) == [2, 5, 6]


def test_first_observation_puts_unknown_informant_last(spark):
    df = spark.createDataFrame([("a", 5, None, 1), ("a", 5, 3, 2), ("b", None, 1, 3), ("b", 9, None, 4)],
                               "subjectkey string, interview_age int, relationship int, _ord int")
    assert sorted(values(clean.first_observation(df, "relationship"), "_ord")) == [2, 4]


def test_most_complete(spark):
    df = spark.createDataFrame([("a", "P1", 1, None, 1), ("a", "P1", 1, 2, 2), ("a", "P1", 3, 4, 3), ("a", "P2", None, None, 4)],
                               "subjectkey string, interview_period string, x_score int, y_total int, _ord int")
    assert sorted(values(clean.most_complete(df), "_ord")) == [2, 4]


def test_merge_twins(spark):
    df = spark.createDataFrame([(1, None, 3, 4), (2, 5, None, 6)], "k int, a int, a2 int, b2 int")
    out = clean.merge_twins(df, {"a": "a2", "b": "b2", "c": "c2"})
    assert out.columns == ["k", "a", "b"] and values(out, "a", "b") == [(3, 4), (5, 6)]


MAP = LevelMap(("i1", "i2", "i3"), {"A1": ("i1", "i2"), "B1": ("i3",), "C1": ("zz",)}, {"A": ("A1", "B1"), "C": ("C1",)},
               {"i1": 3.0, "i2": 2.0, "i3": 3.0, "zz": 1.0})


def _items(spark):
    return spark.createDataFrame([("a", 40, None, 1, 3, 2, None), ("b", 40, None, 2, None, None, 3), ("c", 40, None, 3, 2, 1, 1)],
                                 "subjectkey string, interview_age int, interview_date timestamp, _ord int, i1 int, i2 int, i3 int")


def test_scores(spark):
    out = {r["subjectkey"]: r for r in levels.adi_levels(_items(spark), MAP).collect()}
    assert out["a"]["A1"] == 1.0 and out["a"]["B1"] is None and out["a"]["A"] == 1.0 and out["a"]["C"] is None
    assert out["b"]["A1"] is None and out["b"]["B1"] == 1.0
    assert abs(out["c"]["A1"] - 3 / 5) < 1e-12 and abs(out["c"]["A"] - (3 / 5 + 1 / 3) / 2) < 1e-12
    plain = LevelMap(MAP.items, MAP.subscales, MAP.scales, None)
    out = {r["subjectkey"]: r for r in levels.adi_levels(_items(spark), plain).collect()}
    assert out["c"]["A1"] == 3 and out["c"]["A"] == 4


def test_data_levels_reject_rows(spark):
    out = levels.data_levels(_items(spark), MAP, recode=3, extra=())
    assert values(out["level-1"], "subjectkey") == ["c"]
    assert out["level-2"].first()["C1"] is None and out["level-3"].count() == 1


def test_equal_feature_sets(spark):
    a = _items(spark).drop("i3")
    merged = levels.merge_equal_features({"m1": a, "m2": _items(spark), "m3": a}, MAP.items)
    assert {n: (df.count(), df.columns[3:]) for n, df in merged.items()} == {"m1": (6, ["i1", "i2"]), "m2": (3, ["i1", "i2", "i3"])}


def test_level_map_from_codebook(spark):
    book = spark.createDataFrame([("q2", 2.0, "A1", "A", 1), ("q1", 3.0, "A1", "A", 0), ("q3", 1.0, "A2", "A", 2)],
                                 "item string, max_score double, subscale string, scale string, position int")
    got = levels.level_map(book)
    assert got.items == ("q1", "q2", "q3") and got.subscales == {"A1": ("q1", "q2"), "A2": ("q3",)}
    assert got.scales == {"A": ("A1", "A2")} and got.max_scores["q2"] == 2.0
    assert levels.level_map(book, scaling=False).max_scores is None
    assert levels.codebook_name("doc/some_dsm5_adi_codebook.csv") == "adi"


def test_routing_by_name(spark):
    items = _items(spark)
    built = levels.build_levels({"adir": items, "adosm1": items, "ados2m1": items, "other": items},
                                LevelConfig(level_maps={"adi": MAP, "ados": MAP}))
    assert set(built) == {"adi", "ados", "adosm1"} and built["ados"].count() == 3


PHENO = [  # subject, phenotype, description, ord
    ("match", "Autism", "ASD", 1), ("mixed", "Autism", "", 2), ("mixed", "Control", "", 3),
    ("two", "autism", "", 4), ("two", "ASD", "", 5), ("null", None, "ASD", 6), ("null2", "asd", "", 7), ("null2", None, "", 8),
    ("exc_good", "non asd control", "autism spectrum", 9), ("exc_bad", "non asd control", "none", 10),
    ("exc_null", "non asd control", None, 11), ("exc_late", "asd", "x", 12), ("exc_late", "non asd control", "asd", 13),
    ("exc_second", "asd", "nothing", 14), ("exc_second", "non asd", "nothing", 15)]


def test_phenotype_selection(spark):
    df = spark.createDataFrame(PHENO, "subjectkey string, phenotype string, phenotype_description string, _ord int")
    picked = lambda **kw: {r["subjectkey"]: r["_ord"] for r in cohort.select_phenotype(df, "autism|asd", "^non", **kw).collect()}
    assert picked() == {"match": 1, "two": 4, "null2": 7, "exc_good": 9, "exc_late": 12}
    # First row only: a later exception does not count, a later NULL does.
    assert picked(mode="first_row") == {"match": 1, "two": 4, "exc_good": 9, "exc_late": 12, "exc_second": 14}
    assert cohort.select_phenotype(df).count() == 10


def test_exclusion_ignores_unknown(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "subjectkey string")
    assert values(cohort.exclude_listed(df, ["b", "zzz"]), "subjectkey") == ["a"]
    assert cohort.exclude_listed(df, []).count() == 3


def test_site_only_if_absent(spark):
    df = spark.createDataFrame([("a", 9)], "subjectkey string, site int")
    sel = spark.createDataFrame([("a", "x", 1)], "subjectkey string, phenotype string, site int")
    assert cohort.attach_phenotype(df, sel).first()["site"] == 9
    assert cohort.attach_phenotype(df.drop("site"), sel).first()["site"] == 1
