"""Queries over observation tables: sources, cleaning, views, levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import columns as X
from cohortlens.operators import clean, cohort, graph, levels, missing, views
from cohortlens.operators.levels import LevelConfig
from cohortlens.operators.ordering import first_rows
from cohortlens.plans.dataset import build_dataset
from cohortlens.session import shared_folder, written
from cohortlens.sources import readers, writers

from .adapters import (DESCRIPTION, EVENT, EXCEPTION, FULL, INSTRUMENTS, ITEMS, LEVELS, MEMBERS, OBS, PATTERN, PEOPLE,
                       PHENO, SELECTED, event_rows, full_rows, members, obs, people, pheno, table)
from .registry import query, r6, stamp, with_

DATE = stamp("interview_date") + " AS interview_date"


# ---- SQL pieces shared by several queries ------------------------------------

def sql_item(c):
    return f"CAST(CASE WHEN {c}>=999 OR {c}<0 THEN NULL WHEN {c}>3 THEN 0 ELSE {c} END AS DOUBLE)"


def sql_period(a="interview_age"):
    return (f"CASE WHEN {a}>0 AND {a}<=30 THEN 'P1' WHEN {a}>30 AND {a}<=72 THEN 'P2' WHEN {a}>72 AND {a}<=156 "
            f"THEN 'P3' WHEN {a}>156 AND {a}<204 THEN 'P4' ELSE 'P5' END")


def sql_subscale(items):
    total = "+".join(f"COALESCE({i},0)" for i in items)
    reach = "+".join(f"CASE WHEN {i} IS NOT NULL THEN 3.0 ELSE 0 END" for i in items)
    return f"CAST({total} AS DOUBLE)/NULLIF(CAST({reach} AS DOUBLE),0)"


def sql_mean(cols):
    n = "+".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in cols)
    return f"({'+'.join(f'COALESCE({c},0)' for c in cols)})/NULLIF(CAST({n} AS DOUBLE),0)"


def sql_sum(cols):
    return "+".join(f"COALESCE({c},0)" for c in cols)


RECODED = ("rec", "SELECT subjectkey, interview_age, interview_date, instrument, _ord, "
           + ", ".join(f"{sql_item(i)} AS {i}" for i in ITEMS) + " FROM obs")
INFORMATIVE = ("kept", f"SELECT * FROM rec WHERE {sql_sum(ITEMS)} <> 0")
LAST = ("dd", "SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY subjectkey, interview_age, i1, i2, i3, i4 "
        "ORDER BY _ord DESC) = 1")
SUBSCALED = ("sub", f"SELECT *, {sql_subscale(['i1', 'i2'])} AS A1, {sql_subscale(['i3'])} AS A2, "
             f"{sql_subscale(['i4'])} AS B1 FROM dd")
SCALED = ("lev", f"SELECT *, {sql_mean(['A1', 'A2'])} AS A, {sql_mean(['B1'])} AS B, "
          f"{sql_period()} AS interview_period FROM sub")
LEVEL_PARTS = [OBS, RECODED, INFORMATIVE, LAST, SUBSCALED, SCALED]
ITEM_OUT = ", ".join(f"{r6(c)} AS {c}" for c in ITEMS)
SCORE_OUT = ", ".join(f"{r6(c)} AS {c}" for c in ["A1", "A2", "B1", "A", "B"])


def recoded(spark, sf):
    return clean.recode_items(obs(spark, sf), ITEMS)


def level_table(spark, sf):
    return levels.adi_levels(obs(spark, sf), LEVELS)


# ---- flagship ----------------------------------------------------------------

@query("levels_profile", with_(LEVEL_PARTS, f"""
SELECT interview_period, CAST(count(*) AS BIGINT) AS n, {r6('avg(A)')} AS mean_a, {r6('avg(B)')} AS mean_b FROM (
  SELECT * FROM lev QUALIFY row_number() OVER (PARTITION BY subjectkey ORDER BY interview_age, _ord) = 1)
GROUP BY interview_period"""))
def levels_profile(spark, sf):
    """Clean, deduplicate, score, bin, take the cross-section, profile by period."""
    first = views.cross_section(level_table(spark, sf))
    return first.groupBy("interview_period").agg(
        F.count("*").alias("n"), F.avg("A").alias("mean_a"), F.avg("B").alias("mean_b"))


# ---- sources and sinks -------------------------------------------------------

_STAGED = ["subjectkey", "interview_age", "interview_date", "instrument", "token", "v", "d"]


def _stage(spark, df, name):
    path = shared_folder(spark, name)
    writers.save_instrument(df, path, [f"about {c}" for c in df.columns])
    return path, f"{path}/part-00000*"


_STAGED_OUT = f"""SELECT CAST(subjectkey AS BIGINT) AS subjectkey, CAST(interview_age AS BIGINT) AS interview_age, {DATE},
  instrument, token, CAST(v AS DOUBLE) AS v, CAST(d AS DOUBLE) AS d"""
_TYPES = {"subjectkey": "bigint", "interview_age": "int", "v": "double", "d": "double"}


@query("a1_read_instrument", with_([EVENT], f"{_STAGED_OUT} FROM ev"))
def a1(spark, sf):
    """Tab-separated table with a description line, written and read back."""
    path, header = _stage(spark, event_rows(spark, sf).select(*_STAGED), "a1")
    return readers.read_instrument(spark, path, _TYPES, header_path=header)


@query("a2_data_dictionary")
def a2(spark, sf):
    """Column descriptions, first table to define a column wins."""
    rows = event_rows(spark, sf)
    _, one = _stage(spark, rows.select("subjectkey", "interview_age", "token"), "a2a")
    _, two = _stage(spark, rows.select("subjectkey", "interview_date", "v", "d"), "a2b")
    return readers.data_dictionary(spark, {"one": one, "two": two})


@query("a3_stack_equal_headers", with_([EVENT], f"""
SELECT tbl, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT subjectkey) AS BIGINT) AS subjects, {r6('sum(v)')} AS total FROM (
  SELECT CASE WHEN instrument IN ('click','view','error') THEN 'click' WHEN instrument IN ('purchase','signup') THEN 'purchase'
  ELSE instrument END AS tbl, subjectkey, v FROM ev) GROUP BY tbl"""))
def a3(spark, sf):
    """Tables whose headers agree from the third column on are stacked."""
    rows, paths, headers = event_rows(spark, sf), {}, {}
    shapes = {"click": ["v", "d"], "view": ["v", "d"], "purchase": ["v", "token"], "signup": ["v", "token"], "error": ["v", "d"]}
    for name, extra in shapes.items():
        part = rows.filter(F.col("instrument") == name).select("subjectkey", "interview_age", "interview_date", *extra)
        paths[name], headers[name] = _stage(spark, part, f"a3-{name}")
    stacked = readers.read_stacked(spark, paths, _TYPES, headers)
    both = views.stack(stacked, ["v"]).withColumnRenamed("instrument", "tbl")
    return both.groupBy("tbl").agg(F.count("*").alias("n"), F.count_distinct("subjectkey").alias("subjects"),
                                   F.sum("v").alias("total"))


def _codebook(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "CAST(p_partkey AS STRING) AS item", "CAST(p_size AS DOUBLE) AS max_score", "p_brand AS subscale",
        "p_type AS scale", "p_partkey AS position")


@query("a4_codebook_levels", """
SELECT p_brand AS subscale, CAST(count(*) AS BIGINT) AS n_items, CAST(sum(p_size) AS DOUBLE) AS max_total
FROM part GROUP BY p_brand""")
def a4(spark, sf):
    """Items and highest reachable sum per subscale of a codebook."""
    return levels.codebook_subscales(_codebook(spark, sf))


@query("a4_codebook_scales", "SELECT DISTINCT p_type AS scale, p_brand AS subscale FROM part")
def a4_scales(spark, sf):
    return levels.codebook_scales(_codebook(spark, sf))


@query("a6_snapshot_round_trip", with_(LEVEL_PARTS, f"""
SELECT interview_period, CAST(count(*) AS BIGINT) AS n, {r6('sum(A)')} AS total FROM lev GROUP BY interview_period"""))
def a6(spark, sf):
    """Level table saved by period and read back."""
    path = shared_folder(spark, "a6")
    writers.save_snapshot(level_table(spark, sf).drop("_ord"), path, ["interview_period"])
    return spark.read.parquet(path).groupBy("interview_period").agg(F.count("*").alias("n"), F.sum("A").alias("total"))


@query("a7_csv_round_trip", with_([EVENT], f"""
SELECT CAST(subjectkey AS BIGINT) AS subjectkey, CAST(interview_age AS BIGINT) AS interview_age, instrument,
  CASE WHEN respond IS NULL THEN 1 ELSE 0 END AS respond_missing FROM ev"""))
def a7_a8(spark, sf):
    """CSV sink, sorted, and its scan with a known schema (A7, A8)."""
    path = shared_folder(spark, "a7")
    marked = clean.missing_indicators(event_rows(spark, sf), ["respond"], ["subjectkey", "interview_age", "instrument"])
    writers.save_csv(marked.withColumnRenamed("respond", "respond_missing"), path, ["subjectkey"])
    return readers.read_results(spark, path, "subjectkey bigint, interview_age int, instrument string, respond_missing int")


@query("a9_shared_columns", with_([OBS], f"""
SELECT instrument, CAST(subjectkey AS BIGINT) AS subjectkey, CAST(interview_age AS BIGINT) AS interview_age, {DATE} FROM obs"""))
def a9(spark, sf):
    """Shared columns of all instruments stacked."""
    rows = obs(spark, sf)
    tables = {k: rows.filter(F.col("instrument") == k).drop("instrument") for k in ("A", "N", "R")}
    return views.stack(tables, ["interview_age", "interview_date"])


# ---- cohort ------------------------------------------------------------------

def selected(spark, sf, mode="consistent"):
    return cohort.select_phenotype(pheno(spark, sf), PATTERN, EXCEPTION, DESCRIPTION, mode=mode)


@query("s1_select_phenotype", with_([PHENO, SELECTED], """
SELECT subjectkey, phenotype, phenotype_description, sex, ethnic_group, CAST(dataset_id AS BIGINT) AS dataset_id,
  CAST(site AS BIGINT) AS site FROM sel"""))
def s1(spark, sf):
    return selected(spark, sf)


@query("s1_all_subjects", with_([PHENO], """
SELECT subjectkey, phenotype, CAST(dataset_id AS BIGINT) AS dataset_id FROM pheno
QUALIFY row_number() OVER (PARTITION BY subjectkey ORDER BY _ord) = 1"""))
def s1_all(spark, sf):
    """No pattern: every subject, first row (D1)."""
    return cohort.select_phenotype(pheno(spark, sf)).select("subjectkey", "phenotype", "dataset_id")


@query("s1a_select_first_row", with_([PHENO], f"""
SELECT subjectkey, lower(phenotype) AS phenotype, CAST(site AS BIGINT) AS site FROM (
  SELECT *, bool_and(regexp_matches(lower(COALESCE(phenotype,'nan')), '{PATTERN}')) OVER (PARTITION BY subjectkey) AS ok,
    row_number() OVER (PARTITION BY subjectkey ORDER BY _ord) AS rn FROM pheno)
WHERE ok AND rn = 1 AND (NOT regexp_matches(lower(phenotype), '{EXCEPTION}')
  OR COALESCE(regexp_matches(lower(phenotype_description), '{DESCRIPTION}'), false))"""))
def s1a(spark, sf):
    return selected(spark, sf, "first_row").select("subjectkey", F.lower("phenotype").alias("phenotype"), "site")


@query("s2_demographics", with_([PHENO, SELECTED], """
SELECT subjectkey AS gui, sex, lower(phenotype) AS phenotype, ethnic_group, CAST(dataset_id AS BIGINT) AS dataset_id FROM sel"""))
def s2(spark, sf):
    return cohort.demographics(selected(spark, sf))


@query("j1_cohort_restriction", with_([PHENO, SELECTED, OBS], f"""
SELECT subjectkey, CAST(interview_age AS BIGINT) AS interview_age, {DATE}, instrument FROM obs
WHERE subjectkey IN (SELECT subjectkey FROM sel)"""))
def j1(spark, sf):
    return cohort.restrict(obs(spark, sf), selected(spark, sf)).select(
        "subjectkey", "interview_age", "interview_date", "instrument")


@query("j2_exclude_subjects", with_([PHENO, SELECTED, OBS], """
SELECT instrument, CAST(count(*) AS BIGINT) AS n FROM obs WHERE subjectkey NOT IN (SELECT subjectkey FROM sel) GROUP BY 1"""))
def j2(spark, sf):
    return cohort.exclude(obs(spark, sf), selected(spark, sf)).groupBy("instrument").agg(F.count("*").alias("n"))


@query("j3_attach_phenotype", with_([PHENO, SELECTED, OBS], """
SELECT obs.subjectkey, CAST(interview_age AS BIGINT) AS interview_age, instrument, phenotype, CAST(site AS BIGINT) AS site
FROM obs JOIN sel ON obs.subjectkey = sel.subjectkey"""))
def j3(spark, sf):
    rows = obs(spark, sf).select("subjectkey", "interview_age", "instrument")
    return cohort.attach_phenotype(rows, selected(spark, sf))


@query("j6_join_demographics", with_([PEOPLE], f"""
SELECT o_custkey AS subjectkey, {r6('o_totalprice')} AS price, sex, site, phenotype
FROM orders LEFT JOIN people ON o_custkey = subjectkey"""))
def j6(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("subjectkey"), F.col("o_totalprice").alias("price"))
    return cohort.join_demographics(rows, people(spark, sf))


@query("j7_attach_descriptions", with_([PHENO, OBS], """
SELECT obs.subjectkey, CAST(interview_age AS BIGINT) AS interview_age, phenotype, phenotype_description FROM obs LEFT JOIN (
  SELECT * FROM pheno QUALIFY row_number() OVER (PARTITION BY subjectkey ORDER BY _ord) = 1) p
ON obs.subjectkey = p.subjectkey"""))
def j7(spark, sf):
    return cohort.attach_descriptions(obs(spark, sf).select("subjectkey", "interview_age"), pheno(spark, sf))


@query("d1_first_phenotype", with_([PHENO], """
SELECT subjectkey, phenotype, phenotype_description FROM pheno
QUALIFY row_number() OVER (PARTITION BY subjectkey ORDER BY _ord) = 1"""))
def d1(spark, sf):
    return first_rows(pheno(spark, sf), ["subjectkey"], [F.col("_ord")]).select(
        "subjectkey", "phenotype", "phenotype_description")


@query("s13_exclude_listed", with_([OBS], """
SELECT instrument, CAST(count(*) AS BIGINT) AS n FROM obs WHERE subjectkey NOT IN (3, 17, 42, 99999999) GROUP BY 1"""))
def s13(spark, sf):
    rows = cohort.exclude_listed(obs(spark, sf), [3, 17, 42, 99999999])
    return rows.groupBy("instrument").agg(F.count("*").alias("n"))


@query("s18_placeholder_phenotype", with_([OBS], """
SELECT subjectkey, instrument, 'NA' AS phenotype FROM obs"""))
def s18(spark, sf):
    return cohort.placeholder_phenotype(obs(spark, sf).select("subjectkey", "instrument"))


# ---- recodes and filters -----------------------------------------------------

@query("s3_item_recode", with_([OBS, RECODED], f"SELECT subjectkey, instrument, {ITEM_OUT} FROM rec"))
def s3(spark, sf):
    return recoded(spark, sf).select("subjectkey", "instrument", *ITEMS)


def sql_score(c, top=777):
    return f"CAST(CASE WHEN {c}>={top} OR {c}<0 THEN NULL ELSE {c} END AS DOUBLE)"


MULLEN = ("mul", f"SELECT subjectkey, interview_age, interview_date, _ord, {sql_score('m1')} AS m1, {sql_score('m2')} AS m2 FROM obs")


@query("s4_score_sentinels", with_([OBS, MULLEN], f"SELECT subjectkey, {r6('m1')} AS m1, {r6('m2')} AS m2 FROM mul"))
def s4(spark, sf):
    return clean.recode(obs(spark, sf), ["m1", "m2"], X.recode_scale_score).select("subjectkey", "m1", "m2")


@query("s5_floor_rule", with_([OBS, MULLEN], f"""
SELECT subjectkey, {r6('m1')} AS m1, {r6('m2')} AS m2 FROM mul WHERE COALESCE(m1>20, true) AND COALESCE(m2>20, true)"""))
def s5(spark, sf):
    rows = clean.recode(obs(spark, sf), ["m1", "m2"], X.recode_scale_score)
    return clean.drop_floor_scores(rows, ["m1", "m2"]).select("subjectkey", "m1", "m2")


def sql_adaptive(c, kind):
    extra = {"v": " OR {c}>24", "rel": " OR {c}=27", "d": ""}[kind].format(c=c)
    return f"CAST(CASE WHEN {c}>140 OR {c}<0{extra} THEN NULL ELSE {c} END AS DOUBLE)"


@query("s6_adaptive_ranges", with_([EVENT], f"""
SELECT subjectkey, {sql_adaptive('relationship', 'rel')} AS relationship, {sql_adaptive('v', 'v')} AS receptive_vscore,
  {sql_adaptive('d', 'd')} AS communicationdomain_totalb FROM ev"""))
def s6(spark, sf):
    names = ["relationship", "receptive_vscore", "communicationdomain_totalb"]
    rows = clean.rename(event_rows(spark, sf), {"v": "receptive_vscore", "d": "communicationdomain_totalb"})
    return clean.recode(rows, names, X.recode_adaptive).select("subjectkey", *names)


def sql_token(c):
    return (f"CASE WHEN trim({c}) IN ('999','999.0','888','-9','\"','.') THEN NULL WHEN trim({c})='>90' THEN 91 "
            f"WHEN trim({c})='?90' THEN 90 WHEN TRY_CAST(trim({c}) AS DOUBLE)>200 THEN NULL "
            f"ELSE TRY_CAST(trim({c}) AS DOUBLE) END")


@query("s7_token_scores", with_([EVENT], f"""
SELECT subjectkey, CAST(CASE WHEN respond=999 THEN NULL ELSE respond END AS DOUBLE) AS respond,
  CAST({sql_token('token')} AS DOUBLE) AS token FROM ev"""))
def s7(spark, sf):
    return clean.recode_tokens(event_rows(spark, sf), ["respond", "token"]).select("subjectkey", "respond", "token")


@query("s8_drop_uninformative", with_([OBS, RECODED, INFORMATIVE], f"SELECT subjectkey, instrument, {ITEM_OUT} FROM kept"))
def s8(spark, sf):
    return clean.drop_uninformative(recoded(spark, sf), ITEMS).select("subjectkey", "instrument", *ITEMS)


@query("s8a_drop_uninformative_subjects", with_([OBS, RECODED], f"""
SELECT subjectkey, instrument, {ITEM_OUT} FROM rec
WHERE subjectkey NOT IN (SELECT subjectkey FROM rec WHERE {sql_sum(ITEMS)} = 0)"""))
def s8a(spark, sf):
    return clean.drop_uninformative(recoded(spark, sf), ITEMS, mode="subject").select("subjectkey", "instrument", *ITEMS)


@query("s9_merge_twins", with_([EVENT], """
SELECT subjectkey, CAST(COALESCE(d, v) AS DOUBLE) AS d, CAST(respond AS DOUBLE) AS answer FROM ev"""))
def s9(spark, sf):
    """Column filled from its twin; a lone twin is renamed."""
    rows = event_rows(spark, sf).select("subjectkey", "d", "v", "respond")
    return clean.merge_twins(rows, {"d": "v", "answer": "respond"}).select(
        "subjectkey", F.col("d").cast("double").alias("d"), F.col("answer").cast("double").alias("answer"))


@query("s10_s11_harmonize_columns", with_([EVENT], "SELECT subjectkey, token AS aware_t_score, whole AS cog_t_score FROM ev"))
def s10(spark, sf):
    """Rename to canonical names, keep listed columns that exist."""
    rows = clean.rename(event_rows(spark, sf), {"token": "aware_t_score", "whole": "cog_t_score"})
    return clean.keep_listed(rows, ["aware_t_score", "cog_t_score", "motiv_t_score"], ["subjectkey"])


@query("s12_pick_columns", with_([OBS], "SELECT instrument, i1, i2, i3, i4 FROM (SELECT instrument, CAST(i1 AS DOUBLE) AS i1, "
       "CAST(i2 AS DOUBLE) AS i2, CAST(i3 AS DOUBLE) AS i3, CAST(i4 AS DOUBLE) AS i4 FROM obs)"))
def s12(spark, sf):
    rows = obs(spark, sf)
    names = X.pick_columns(X.pick_columns(rows.columns, "i", anchored=True), "interview", drop=True)
    return rows.select(*[F.col(c).cast("double").alias(c) if c in ITEMS else F.col(c) for c in names])


@query("s14_age_periods", with_([OBS], f"""
SELECT {sql_period()} AS interview_period, CAST(count(*) AS BIGINT) AS n, CAST(min(interview_age) AS BIGINT) AS youngest,
  CAST(max(interview_age) AS BIGINT) AS oldest FROM obs GROUP BY 1"""))
def s14(spark, sf):
    return levels.add_period(obs(spark, sf)).groupBy("interview_period").agg(
        F.count("*").alias("n"), F.min("interview_age").alias("youngest"), F.max("interview_age").alias("oldest"))


@query("s15_period_filter", with_([OBS], f"""
SELECT instrument, interview_period, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, {sql_period()} AS interview_period FROM obs)
WHERE regexp_matches(interview_period, 'P1|P2|P3') GROUP BY 1, 2"""))
def s15(spark, sf):
    rows = clean.in_period(levels.add_period(obs(spark, sf)), "P1|P2|P3")
    return rows.groupBy("instrument", "interview_period").agg(F.count("*").alias("n"))


@query("s16_scoreless_subjects", with_([OBS], """
SELECT subjectkey, instrument FROM obs WHERE subjectkey NOT IN (
  SELECT subjectkey FROM obs WHERE i2 IS NULL AND i3 IS NULL)"""))
def s16(spark, sf):
    return clean.drop_scoreless_subjects(obs(spark, sf), ["i2", "i3"]).select("subjectkey", "instrument")


@query("s17_excluded_features", with_(LEVEL_PARTS, f"""
SELECT subjectkey, {r6('A1')} AS A1, {r6('A2')} AS A2 FROM lev"""))
def s17(spark, sf):
    rows = level_table(spark, sf).select("subjectkey", "A1", "A2", F.col("B1").alias("B2"))
    return clean.drop_excluded_features(rows, "ados")


@query("s19_missing_indicator", with_([OBS], """
SELECT subjectkey, CAST(i2 IS NULL AS BIGINT) AS i2, CAST(i3 IS NULL AS BIGINT) AS i3 FROM obs"""))
def s19(spark, sf):
    return clean.missing_indicators(obs(spark, sf), ["i2", "i3"], ["subjectkey"])


# ---- deduplication and windows -----------------------------------------------

@query("d2_cross_section", with_([OBS], f"""
SELECT subjectkey, instrument, CAST(interview_age AS BIGINT) AS interview_age, {DATE} FROM obs
QUALIFY row_number() OVER (PARTITION BY subjectkey, instrument ORDER BY interview_age, _ord) = 1"""))
def d2(spark, sf):
    return views.cross_section(obs(spark, sf), ["subjectkey", "instrument"]).select(
        "subjectkey", "instrument", "interview_age", "interview_date")


@query("d3_exact_repeats", with_([OBS, RECODED, INFORMATIVE, LAST], f"""
SELECT subjectkey, CAST(interview_age AS BIGINT) AS interview_age, {DATE}, {ITEM_OUT} FROM dd"""))
def d3(spark, sf):
    rows = clean.drop_repeats(clean.drop_uninformative(recoded(spark, sf), ITEMS), ITEMS)
    return rows.select("subjectkey", "interview_age", "interview_date", *ITEMS)


@query("d4_repeats_with_informant", with_([EVENT], f"""
SELECT subjectkey, CAST(interview_age AS BIGINT) AS interview_age, {DATE}, CAST(respond AS DOUBLE) AS respond,
  CAST(d AS DOUBLE) AS d FROM ev
QUALIFY row_number() OVER (PARTITION BY subjectkey, interview_age, respond, d ORDER BY _ord DESC) = 1"""))
def d4(spark, sf):
    rows = clean.drop_repeats(event_rows(spark, sf), ["d"], informant="respond")
    return rows.select("subjectkey", "interview_age", "interview_date", F.col("respond").cast("double").alias("respond"),
                       F.col("d").cast("double").alias("d"))


@query("d5_one_per_respondent", with_([EVENT], """
SELECT subjectkey, CAST(respond AS DOUBLE) AS respond, CAST(interview_age AS BIGINT) AS interview_age, _ord AS row_no FROM (
  SELECT *, count(*) OVER (PARTITION BY subjectkey) AS c FROM (SELECT * FROM ev
    QUALIFY row_number() OVER (PARTITION BY subjectkey, respond ORDER BY interview_age, _ord) = 1))
WHERE c = 1 OR respond IS NOT NULL"""))
def d5(spark, sf):
    rows = clean.one_per_respondent(event_rows(spark, sf))
    return rows.select("subjectkey", F.col("respond").cast("double").alias("respond"), "interview_age",
                       F.col("_ord").alias("row_no"))


@query("d6_first_observation", with_([EVENT], """
SELECT subjectkey, CAST(interview_age AS BIGINT) AS interview_age, CAST(relationship AS DOUBLE) AS relationship, _ord AS row_no FROM ev
QUALIFY row_number() OVER (PARTITION BY subjectkey ORDER BY interview_age NULLS LAST, relationship NULLS LAST, _ord) = 1"""))
def d6(spark, sf):
    rows = clean.first_observation(event_rows(spark, sf), informant="relationship")
    return rows.select("subjectkey", "interview_age", F.col("relationship").cast("double").alias("relationship"),
                       F.col("_ord").alias("row_no"))


COMPLETE = ("best", f"""SELECT * FROM (SELECT *, {sql_period()} AS interview_period FROM obs)
QUALIFY row_number() OVER (PARTITION BY subjectkey, interview_period ORDER BY
  CAST(i2 IS NULL AS INT)+CAST(i3 IS NULL AS INT), _ord) = 1""")


def most_complete(spark, sf):
    return clean.most_complete(levels.add_period(obs(spark, sf)), ["i2", "i3"])


@query("d7_most_complete", with_([OBS, COMPLETE], f"""
SELECT subjectkey, interview_period, CAST(interview_age AS BIGINT) AS interview_age, {DATE}, CAST(i2 AS DOUBLE) AS i2,
  CAST(i3 AS DOUBLE) AS i3 FROM best"""))
def d7(spark, sf):
    return most_complete(spark, sf).select("subjectkey", "interview_period", "interview_age", "interview_date",
                                           F.col("i2").cast("double").alias("i2"), F.col("i3").cast("double").alias("i3"))


@query("d8_period_count", with_([OBS, COMPLETE], """
SELECT subjectkey, interview_period, CAST(count(*) OVER (PARTITION BY subjectkey) AS BIGINT) AS intersection_count FROM best"""))
def d8(spark, sf):
    rows = views.with_period_count(most_complete(spark, sf))
    return rows.select("subjectkey", "interview_period", "intersection_count")


@query("d9_longitudinal", with_([OBS], f"""
SELECT DISTINCT subjectkey, instrument, CAST(interview_age AS BIGINT) AS interview_age, {DATE} FROM (
  SELECT *, count(*) OVER (PARTITION BY subjectkey, instrument) AS c FROM obs) WHERE c > 1"""))
def d9(spark, sf):
    return views.longitudinal(obs(spark, sf))


@query("d12_repeated_assessments", with_([OBS], """
SELECT instrument, CAST(COALESCE(sum(CASE WHEN c>1 THEN c END),0) AS BIGINT) AS observations,
  CAST(count(CASE WHEN c>1 THEN 1 END) AS BIGINT) AS subjects FROM (
  SELECT instrument, subjectkey, count(*) AS c FROM obs GROUP BY 1, 2) GROUP BY 1"""))
def d12(spark, sf):
    return views.repeated_assessments(obs(spark, sf), ["instrument"])


# ---- scores and counts -------------------------------------------------------

@query("g1_subscale_scores", with_([OBS, RECODED, ("dd", "SELECT * FROM rec"), SUBSCALED], f"""
SELECT subjectkey, instrument, {r6('A1')} AS A1, {r6('A2')} AS A2, {r6('B1')} AS B1 FROM sub"""))
def g1(spark, sf):
    return levels.score_subscales(recoded(spark, sf), LEVELS).select("subjectkey", "instrument", "A1", "A2", "B1")


@query("g1_subscale_sums", with_([OBS, RECODED], f"""
SELECT subjectkey, {r6('CASE WHEN i1 IS NOT NULL OR i2 IS NOT NULL THEN COALESCE(i1,0)+COALESCE(i2,0) END')} AS plain FROM rec"""))
def g1_plain(spark, sf):
    """Without maximum scores a subscale is the plain sum."""
    return recoded(spark, sf).select("subjectkey", X.subscale_score(["i1", "i2"]).alias("plain"))


@query("g2_scale_scores", with_([OBS, RECODED, ("dd", "SELECT * FROM rec"), SUBSCALED, SCALED], f"""
SELECT subjectkey, instrument, {r6('A')} AS A, {r6('B')} AS B FROM lev"""))
def g2(spark, sf):
    rows = levels.score_scales(levels.score_subscales(recoded(spark, sf), LEVELS), LEVELS)
    return rows.select("subjectkey", "instrument", "A", "B")


G3_PARTS = [OBS, RECODED,
            ("kept", f"SELECT * FROM rec WHERE subjectkey NOT IN (SELECT subjectkey FROM rec WHERE {sql_sum(ITEMS)} = 0)"),
            LAST, SUBSCALED, SCALED]


@query("g3_level_tables", with_(G3_PARTS, f"""
SELECT subjectkey, CAST(interview_age AS BIGINT) AS interview_age, {SCORE_OUT} FROM lev
WHERE A1 IS NOT NULL AND A2 IS NOT NULL AND B1 IS NOT NULL"""))
def g3(spark, sf):
    """Subscale and scale tables with row rejection, side by side."""
    out = levels.data_levels(obs(spark, sf), LEVELS, recode=3, extra=())
    two, three = out["level-2"], out["level-3"]
    # Both come from the same rows, in which (subject, age, order) is unique.
    return two.join(three, ["subjectkey", "interview_age", "_ord"]).select(
        "subjectkey", "interview_age", "A1", "A2", "B1", "A", "B")


@query("g4_subject_counts", with_([OBS], """
SELECT instrument, CAST(count(*) AS BIGINT) AS observations, CAST(count(DISTINCT subjectkey) AS BIGINT) AS subjects
FROM obs GROUP BY 1"""))
def g4(spark, sf):
    return views.subject_counts(obs(spark, sf))


def _sql_combinations():
    from itertools import combinations
    flags = [f"bool_or(instrument='{n}') AS b{i}" for i, n in enumerate(INSTRUMENTS)]
    parts = []
    for size in range(1, len(INSTRUMENTS) + 1):
        for c in combinations(range(len(INSTRUMENTS)), size):
            name = "&".join(INSTRUMENTS[i] for i in c)
            test = " AND ".join(f"b{i}" for i in c)
            parts.append(f"SELECT '{name}' AS combination, CAST({size} AS BIGINT) AS size, "
                         f"CAST(count(CASE WHEN {test} THEN 1 END) AS BIGINT) AS subjects FROM fl")
    return with_([MEMBERS, ("fl", f"SELECT subjectkey, {', '.join(flags)} FROM members GROUP BY 1")], "\nUNION ALL ".join(parts))


@query("g5_combination_counts", _sql_combinations())
def g5(spark, sf):
    return views.combination_counts(members(spark, sf), INSTRUMENTS)


@query("g14_observation_records", with_([EVENT], f"""
SELECT DISTINCT subjectkey, instrument, CAST(interview_age AS BIGINT) AS interview_age, {DATE},
  CAST(relationship AS DOUBLE) AS relationship FROM ev"""))
def g14(spark, sf):
    rows = views.observation_records(event_rows(spark, sf), ["relationship"])
    return rows.withColumn("relationship", F.col("relationship").cast("double"))


# ---- wide views and sets -----------------------------------------------------

def _wide_tables(spark, sf):
    rows = levels.add_period(obs(spark, sf))
    first = views.cross_section(rows, ["subjectkey", "instrument"])
    keep = ["subjectkey", "interview_age", "interview_date", "interview_period"]
    return {
        "ados": first.filter("instrument = 'A'").select(*keep, F.col("i2").cast("double").alias("i2"), F.col("i3").cast("double").alias("i3")),
        "mullen": first.filter("instrument = 'N'").select(*keep, F.col("m1").cast("double").alias("m1")),
        "srs": first.filter("instrument = 'R'").select(*keep, F.col("m2").cast("double").alias("m2")),
    }


WIDE = [OBS, ("cs", f"""SELECT *, {sql_period()} AS interview_period FROM obs
  QUALIFY row_number() OVER (PARTITION BY subjectkey, instrument ORDER BY interview_age, _ord) = 1"""),
        ("a", "SELECT * FROM cs WHERE instrument='A'"), ("b", "SELECT * FROM cs WHERE instrument='N'"),
        ("c", "SELECT * FROM cs WHERE instrument='R'")]


@query("j4_wide_inner", with_(WIDE, f"""
SELECT a.subjectkey, CAST(a.interview_age AS BIGINT) AS interview_age_ados, CAST(b.interview_age AS BIGINT) AS interview_age_mullen,
  CAST(c.interview_age AS BIGINT) AS interview_age_srs, {stamp('a.interview_date')} AS interview_date_ados,
  {stamp('b.interview_date')} AS interview_date_mullen, {stamp('c.interview_date')} AS interview_date_srs,
  a.interview_period AS interview_period_ados, b.interview_period AS interview_period_mullen,
  c.interview_period AS interview_period_srs, CAST(a.i2 AS DOUBLE) AS i2, CAST(a.i3 AS DOUBLE) AS i3,
  CAST(b.m1 AS DOUBLE) AS m1, CAST(c.m2 AS DOUBLE) AS m2
FROM a JOIN b ON a.subjectkey=b.subjectkey JOIN c ON a.subjectkey=c.subjectkey"""))
def j4(spark, sf):
    return views.wide_inner(_wide_tables(spark, sf))


@query("j5_wide_outer", with_(WIDE, """
SELECT COALESCE(a.subjectkey, b.subjectkey, c.subjectkey) AS subjectkey, CAST(a.i2 AS DOUBLE) AS i2_ados,
  CAST(a.i3 AS DOUBLE) AS i3_ados, CAST(b.m1 AS DOUBLE) AS m1, CAST(c.m2 AS DOUBLE) AS m2
FROM a FULL JOIN b ON a.subjectkey=b.subjectkey FULL JOIN c ON COALESCE(a.subjectkey,b.subjectkey)=c.subjectkey"""))
def j5(spark, sf):
    return views.wide_outer(_wide_tables(spark, sf))


@query("u4_shared_subjects", with_(WIDE, """
SELECT subjectkey FROM a INTERSECT SELECT subjectkey FROM b INTERSECT SELECT subjectkey FROM c"""))
def u4(spark, sf):
    return views.shared_subjects(_wide_tables(spark, sf))


GROUPS = ("grp", """SELECT concat('label', label) AS group_id, vec_id AS subjectkey FROM embeddings
  UNION ALL SELECT concat('run', vec_id%3), vec_id FROM embeddings""")


def groups(spark, sf):
    rows = full_rows(spark, sf)
    label = rows.select(F.concat(F.lit("label"), "cluster").alias("group_id"), "subjectkey")
    return label.unionByName(rows.select(F.concat(F.lit("run"), "run").alias("group_id"), "subjectkey"))


@query("j8_cooccurrence", with_([GROUPS], """
, pr AS (SELECT subjectkey, string_agg(group_id, ',' ORDER BY group_id) AS profile FROM grp GROUP BY 1),
sz AS (SELECT profile, count(*) AS c FROM pr GROUP BY 1),
pairs AS (SELECT a.subjectkey AS sa, b.subjectkey AS sb, count(*) AS n FROM grp a JOIN grp b
  ON a.group_id=b.group_id AND a.subjectkey<>b.subjectkey GROUP BY 1, 2)
SELECT pa.profile AS profile_a, pb.profile AS profile_b, CAST(max(x.c) AS BIGINT) AS subjects_a,
  CAST(max(y.c) AS BIGINT) AS subjects_b, CAST(max(n) AS BIGINT) AS n
FROM pairs JOIN pr pa ON sa=pa.subjectkey JOIN pr pb ON sb=pb.subjectkey JOIN sz x ON x.profile=pa.profile
JOIN sz y ON y.profile=pb.profile GROUP BY 1, 2 HAVING max(n)=min(n)""".replace("\n, pr", ", pr", 1)))
def j8(spark, sf):
    """Co-occurrence between membership profiles; the SQL builds all subject pairs."""
    return graph.cooccurrence(groups(spark, sf))


@query("j8_cooccurrence_totals", with_([GROUPS], """
SELECT subjectkey, CAST(sum(c-1) AS BIGINT) AS shared FROM grp JOIN
  (SELECT group_id AS g, count(*) AS c FROM grp GROUP BY 1) ON g=group_id GROUP BY 1"""))
def j8_totals(spark, sf):
    return graph.cooccurrence_totals(groups(spark, sf))


@query("u1_union_versions", with_([EVENT], """
SELECT subjectkey, CASE WHEN instrument='click' THEN NULL ELSE token END AS token, CAST(d AS DOUBLE) AS d FROM ev"""))
def u1(spark, sf):
    """Versions with different columns; what a version lacks is NULL."""
    rows = event_rows(spark, sf)
    one = rows.filter("instrument = 'click'").select("subjectkey", "d")
    two = rows.filter("instrument <> 'click'").select("subjectkey", "token", "d")
    return two.unionByName(one, allowMissingColumns=True).withColumn("d", F.col("d").cast("double"))


def _modules(spark, sf, rows=None):
    rows = obs(spark, sf) if rows is None else rows
    base = ["subjectkey", "interview_age", "interview_date", "_ord"]
    return {
        "adosm1": rows.filter("instrument = 'A'").select(*base, *ITEMS),
        "adosm2": rows.filter("instrument = 'N'").select(*base, "i1", "i2", "i3", F.col("i4").alias("x4")),
        "ados2m1": rows.filter("instrument = 'R'").select(*base, *[F.col(c).cast("string").alias(c) for c in ("i1", "i2", "i3")]),
    }


@query("u2_union_equal_features", with_([OBS], """
SELECT tbl, CAST(count(*) AS BIGINT) AS n, CAST(sum(i1) AS DOUBLE) AS total FROM (
  SELECT CASE WHEN instrument='R' THEN 'ados2m1' ELSE 'adosm1' END AS tbl, i1 FROM obs) GROUP BY 1"""))
def u2(spark, sf):
    tables = {n: clean.rename(df, {"x4": "i4"}) for n, df in _modules(spark, sf).items()}
    merged = levels.merge_equal_features(tables, ITEMS)
    both = views.stack(merged, ["i1"]).withColumnRenamed("instrument", "tbl")
    return both.groupBy("tbl").agg(F.count("*").alias("n"), F.sum("i1").alias("total"))


# Two merged modules with four items, one with three and no B1.
_ADOS = [OBS, ("raw", "SELECT *, CASE WHEN instrument='R' THEN 'ados2m1' ELSE 'adosm1' END AS tbl FROM obs"),
         ("rec", "SELECT subjectkey, interview_age, interview_date, tbl, _ord, " + ", ".join(
             f"{sql_item(i)} AS {i}" for i in ITEMS[:3])
          + f", CASE WHEN tbl='ados2m1' THEN NULL ELSE {sql_item('i4')} END AS i4 FROM raw"), INFORMATIVE,
         ("dd", "SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY tbl, subjectkey, interview_age, i1, i2, i3, i4 "
          "ORDER BY _ord DESC) = 1"), SUBSCALED, SCALED]


@query("u3_l2_ados_levels", with_(_ADOS, f"""
SELECT subjectkey, CAST(interview_age AS BIGINT) AS interview_age, {DATE}, interview_period, {SCORE_OUT} FROM lev"""))
def u3(spark, sf):
    """Subscales and scales of all modules in one table (U3, L2)."""
    both, _ = levels.ados_levels(_modules(spark, sf), LEVELS, {"x4": "i4"})
    return both


@query("u3_ados_item_tables", with_(_ADOS, f"""
SELECT tbl, subjectkey, CAST(interview_age AS BIGINT) AS interview_age, interview_period, {ITEM_OUT} FROM lev"""))
def u3_items(spark, sf):
    _, items = levels.ados_levels(_modules(spark, sf), LEVELS, {"x4": "i4"})
    parts = [df.select(F.lit(n).alias("tbl"), "subjectkey", "interview_age", "interview_period",
                       *[c for c in ITEMS if c in df.columns]) for n, df in items.items()]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


# ---- level composites --------------------------------------------------------

@query("l1_adi_levels", with_(LEVEL_PARTS, f"""
SELECT subjectkey, CAST(interview_age AS BIGINT) AS interview_age, {DATE}, interview_period, {ITEM_OUT}, {SCORE_OUT} FROM lev"""))
def l1(spark, sf):
    return level_table(spark, sf)


_MUL_DD = ("dd", """SELECT * FROM mul WHERE COALESCE(m1>20, true) AND COALESCE(m2>20, true) AND COALESCE(m1,0)+COALESCE(m2,0)<>0
  QUALIFY row_number() OVER (PARTITION BY subjectkey, interview_age, m1, m2 ORDER BY _ord DESC) = 1""")
_MUL_OUT = f"""SELECT subjectkey, CAST(interview_age AS BIGINT) AS interview_age, {DATE}, {sql_period()} AS interview_period,
  {r6('m1')} AS m1, {r6('m2')} AS m2 FROM dd"""


@query("l3_mullen_levels", with_([OBS, MULLEN, _MUL_DD], _MUL_OUT))
def l3(spark, sf):
    return levels.mullen_levels(obs(spark, sf), ["m1", "m2"])


@query("l3_mullen_levels_older", with_([OBS, ("mul", MULLEN[1].replace("777", "999")), ("dd", """
  SELECT * FROM mul WHERE subjectkey NOT IN (SELECT subjectkey FROM mul WHERE COALESCE(m1,0)+COALESCE(m2,0)=0)
  QUALIFY row_number() OVER (PARTITION BY subjectkey, interview_age, m1, m2 ORDER BY _ord DESC) = 1""")], _MUL_OUT))
def l3_older(spark, sf):
    return levels.mullen_levels(obs(spark, sf), ["m1", "m2"], mode="older")


_VINE = ["relationship", "receptive_vscore", "written_vscore", "communicationdomain_totalb"]
_BASE = ["subjectkey", "interview_age", "interview_date", "_ord"]


def _vineland_versions(spark, sf):
    rows = event_rows(spark, sf)
    v, d = F.col("v"), F.col("d")
    part = lambda *names: rows.filter(F.col("instrument").isin(*names))
    return {
        "vinelands": part("click", "view").select(*_BASE, "relationship", v.alias("receptive_vscore"), d.alias("communicationdomain_totalb")),
        "vinelandp": part("purchase").select(*_BASE, "relationship", v.alias("rec_f_vscore"), d.alias("communicationdomain_totalb")),
        "vineland3": part("signup", "error").select(*_BASE, "relationship", F.when(F.col("_ord") % 2 == 0, v).alias("receptive_vscore"),
                                                    v.alias("rec_f_vscore"), v.alias("written_vscore")),
    }


_VINE_PARTS = [EVENT, ("ver", f"""SELECT subjectkey, interview_age, interview_date, _ord,
  {sql_adaptive('relationship', 'rel')} AS relationship, {sql_adaptive('v', 'v')} AS receptive_vscore,
  CASE WHEN instrument IN ('signup','error') THEN {sql_adaptive('v', 'v')} END AS written_vscore,
  CASE WHEN instrument NOT IN ('signup','error') THEN {sql_adaptive('d', 'd')} END AS communicationdomain_totalb FROM ev""")]


@query("l4_vineland_levels", with_(_VINE_PARTS + [("dd", """
  SELECT * FROM ver WHERE subjectkey NOT IN (2, 5) AND
    COALESCE(receptive_vscore,0)+COALESCE(written_vscore,0)+COALESCE(communicationdomain_totalb,0)<>0
  QUALIFY row_number() OVER (PARTITION BY subjectkey, interview_age, relationship, receptive_vscore, written_vscore,
    communicationdomain_totalb ORDER BY _ord DESC) = 1""")], f"""
SELECT subjectkey, CAST(interview_age AS BIGINT) AS interview_age, {DATE}, {sql_period()} AS interview_period, relationship,
  receptive_vscore, written_vscore, communicationdomain_totalb FROM dd"""))
def l4(spark, sf):
    return levels.vineland_levels(_vineland_versions(spark, sf), _VINE, {"receptive_vscore": "rec_f_vscore"}, [2, 5])


_SRS = ["respond", "aware_t_score", "cog_t_score"]


def _srs_versions(spark, sf):
    rows = event_rows(spark, sf)
    t, w = F.col("token"), F.col("whole")
    part = lambda *names: rows.filter(F.col("instrument").isin(*names))
    return {
        "srs": part("click").select(*_BASE, "respond", t.alias("aware_t_score"), w.alias("cog_t_score")),
        "srs2": part("view").select(*_BASE, "respond", F.when(F.col("_ord") % 2 == 0, t).alias("aware_m_t"), t.alias("aware_f_t"),
                                    w.alias("cog_t_score")),
        "srsadults": part("purchase", "signup", "error").select(*_BASE, "respond", t.alias("aware_m_t")),
    }


def _srs_parts(token):
    return [EVENT, ("ver", f"""SELECT subjectkey, interview_age, interview_date, _ord,
  CAST(CASE WHEN respond=999 THEN NULL ELSE respond END AS DOUBLE) AS respond,
  CAST({token('token')} AS DOUBLE) AS aware_t_score,
  CASE WHEN instrument IN ('click','view') THEN CAST({token('whole')} AS DOUBLE) END AS cog_t_score FROM ev""")]


_SRS_ARGS = (_SRS, {"aware_m_t": "aware_f_t"}, {"aware_m_t": "aware_t_score"})


@query("l5_srs_levels", with_(_srs_parts(sql_token) + [("dd", """
  SELECT * FROM ver WHERE COALESCE(aware_t_score,0)+COALESCE(cog_t_score,0)<>0
  QUALIFY row_number() OVER (PARTITION BY subjectkey, interview_age, respond, aware_t_score, cog_t_score ORDER BY _ord DESC) = 1""")], f"""
SELECT subjectkey, CAST(interview_age AS BIGINT) AS interview_age, {DATE}, {sql_period()} AS interview_period, respond,
  aware_t_score, cog_t_score FROM dd"""))
def l5(spark, sf):
    return levels.srs_levels(_srs_versions(spark, sf), *_SRS_ARGS)


def sql_token_older(c):
    return (f"CASE WHEN trim({c}) IN ('999','\"','.') THEN NULL WHEN trim({c})='>90' THEN 91 WHEN trim({c})='?90' THEN 90 "
            f"ELSE TRY_CAST(trim({c}) AS DOUBLE) END")


@query("l5_srs_levels_older", with_(_srs_parts(sql_token_older) + [("dd", """
  SELECT * FROM ver WHERE subjectkey NOT IN (SELECT subjectkey FROM ver WHERE COALESCE(aware_t_score,0)+COALESCE(cog_t_score,0)=0)
  QUALIFY row_number() OVER (PARTITION BY subjectkey, interview_age, respond, aware_t_score, cog_t_score ORDER BY _ord DESC) = 1"""),
    ("fr", "SELECT * FROM dd QUALIFY row_number() OVER (PARTITION BY subjectkey, respond ORDER BY interview_age, _ord) = 1")], f"""
SELECT subjectkey, CAST(interview_age AS BIGINT) AS interview_age, {DATE}, {sql_period()} AS interview_period, respond,
  aware_t_score, cog_t_score FROM (SELECT *, count(*) OVER (PARTITION BY subjectkey) AS c FROM fr) WHERE c=1 OR respond IS NOT NULL"""))
def l5_older(spark, sf):
    return levels.srs_levels(_srs_versions(spark, sf), *_SRS_ARGS, mode="older")


def _config():
    return LevelConfig(level_maps={"adi": LEVELS, "ados": LEVELS}, ados_renames={"x4": "i4"}, mullen_scores=["m1", "m2"],
                       vineland_columns=_VINE, vineland_twins={"receptive_vscore": "rec_f_vscore"},
                       vineland_excluded=[2, 5], srs_columns=_SRS, srs_twins=_SRS_ARGS[1], srs_renames=_SRS_ARGS[2])


def _all_tables(spark, sf):
    # Joined once: every table of observations reads the same rows.
    rows = written(obs(spark, sf), "observations")
    return {"adir": rows, "mullen": rows, **_modules(spark, sf, rows), **_vineland_versions(spark, sf), **_srs_versions(spark, sf)}


@query("a5_route_instruments")
def a5(spark, sf):
    """Level builders chosen by table name; rows and subjects of each result."""
    built = levels.build_levels(_all_tables(spark, sf), _config())
    return views.subject_counts(views.stack(built, []))


@query("dataset_build")
def dataset_build(spark, sf):
    """Cohort, levels, longitudinal index and cross-sections in one build."""
    built = build_dataset(_all_tables(spark, sf), pheno(spark, sf), _config(), PATTERN, EXCEPTION).computed_once()
    sections = views.subject_counts(views.stack(built.cross_sections, [])).withColumn("part", F.lit("cross_section"))
    long = views.subject_counts(built.longitudinal).withColumn("part", F.lit("longitudinal"))
    return sections.unionByName(long)


# ---- sorts -------------------------------------------------------------------

@query("o1_sorted_observations", with_([OBS], "SELECT subjectkey, CAST(interview_age AS BIGINT) AS interview_age, instrument FROM obs"))
def o1(spark, sf):
    return obs(spark, sf).select("subjectkey", "interview_age", "instrument").orderBy("subjectkey", "interview_age")


@query("o2_sorted_by_cluster", with_([FULL], "SELECT CAST(cluster AS BIGINT) AS cluster, subjectkey FROM full_rows"))
def o2(spark, sf):
    return writers.by_cluster(full_rows(spark, sf).select("cluster", "subjectkey"), "cluster")


# ---- missingness of observation tables ---------------------------------------

_MISS = ["i1", "i2", "i3", "i4"]


@query("g6_missing_percent", with_([OBS, RECODED], "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, {r6(f'100.0*avg(CAST({c} IS NULL AS DOUBLE))')} AS missing_perc FROM rec" for c in _MISS)))
def g6(spark, sf):
    return missing.missing_percent(recoded(spark, sf), _MISS)


@query("g6_missing_summary", with_([OBS, RECODED, ("m", "\nUNION ALL ".join(
    f"SELECT 100.0*avg(CAST({c} IS NULL AS DOUBLE)) AS p FROM rec" for c in _MISS))],
    f"SELECT {r6('max(p)')} AS max_perc, {r6('avg(p)')} AS mean_perc FROM m"))
def g6_summary(spark, sf):
    return missing.missing_summary(recoded(spark, sf), _MISS)


@query("g7_p2_missing_frequency", with_([OBS, RECODED, ("m", "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, 100.0*avg(CAST({c} IS NULL AS DOUBLE)) AS p FROM rec" for c in _MISS))],
    f"SELECT feature, '0' AS status, {r6('p')} AS perc FROM m UNION ALL SELECT feature, '1', {r6('100-p')} FROM m"))
def g7(spark, sf):
    return missing.missing_frequency(recoded(spark, sf), _MISS)


@query("g8_missing_by_cluster", with_([OBS, RECODED], "\nUNION ALL ".join(
    f"SELECT instrument, '{c}' AS feature, {r6(f'100.0*avg(CAST({c} IS NULL AS DOUBLE))')} AS missing_perc FROM rec GROUP BY 1"
    for c in _MISS)))
def g8(spark, sf):
    return missing.missing_by_cluster(recoded(spark, sf), "instrument", _MISS)


@query("p1_missing_grid", with_([OBS], "\nUNION ALL ".join(
    f"SELECT subjectkey, '{c}' AS feature, CAST({c} IS NULL AS BIGINT) AS missing FROM obs" for c in ("i2", "i3"))))
def p1(spark, sf):
    return missing.missing_grid(obs(spark, sf), ["i2", "i3"])


@query("i2_prepare_wide", with_(WIDE + [("w", """SELECT a.i2 AS i2, a.i3 AS i3, b.m1 AS m1, c.m2 AS m2
FROM a FULL JOIN b ON a.subjectkey=b.subjectkey FULL JOIN c ON COALESCE(a.subjectkey,b.subjectkey)=c.subjectkey"""),
    ("m", "\nUNION ALL ".join(f"SELECT 100.0*avg(CAST({c} IS NULL AS DOUBLE)) AS p FROM w" for c in ("i2", "i3", "m1", "m2")))],
    f"SELECT {r6('max(p)')} AS max_perc, {r6('avg(p)')} AS mean_perc FROM m"))
def i2(spark, sf):
    _, summary = missing.prepare_wide(_wide_tables(spark, sf))
    return summary


#: More items, so that shares of gaps lie on both sides of the label's and of
#: the drop's limit, and one item is missing often enough to reach the gate.
_MORE = {f"x{i}": f"CASE WHEN {when} THEN NULL ELSE CAST({i} AS DOUBLE) END" for i, when in enumerate(
    ("subjectkey % 5 < 2", "subjectkey % 7 = 0", "subjectkey % 10 = 0", "subjectkey % 25 = 0"), 1)}


def _prepare_sql(threshold):
    every = [*ITEMS, *_MORE]
    flags = "+".join(f"CAST({c} IS NULL AS DOUBLE)" for c in every)
    worst = ", ".join(f"100.0*avg(CAST({c} IS NULL AS DOUBLE))" for c in every)
    more = ", ".join(f"{e} AS {c}" for c, e in _MORE.items())
    return with_([OBS, RECODED, ("w", f"SELECT *, {more} FROM rec"),
                  ("p", f"SELECT *, ({flags})/8 AS share FROM w WHERE {sql_period()}='P2'"),
                  ("gate", f"SELECT greatest({worst}) >= {threshold * 100} AS g FROM p")], f"""
SELECT subjectkey, {ITEM_OUT}, CAST(CASE WHEN (SELECT g FROM gate) AND share>=0.15 THEN 1 ELSE 0 END AS BIGINT) AS countna
FROM p WHERE NOT (SELECT g FROM gate) OR subjectkey NOT IN (SELECT subjectkey FROM p WHERE share>{threshold})""")


def _prepared(spark, sf, threshold):
    rows = levels.add_period(recoded(spark, sf)).select(
        "subjectkey", "interview_age", "interview_period", *ITEMS, *[F.expr(e).alias(c) for c, e in _MORE.items()])
    return missing.prepare_imputation({"adi": rows}, "P2", threshold)["adi"].select("subjectkey", *ITEMS, "countna")


@query("i1_prepare_imputation", _prepare_sql(0.3))
def i1(spark, sf):
    """Gate reached: subjects with too many gaps go, the rest are labelled."""
    return _prepared(spark, sf, 0.3)


@query("i1_prepare_below_gate", _prepare_sql(0.6))
def i1_below(spark, sf):
    """Gate not reached: nothing is dropped."""
    return _prepared(spark, sf, 0.6)
