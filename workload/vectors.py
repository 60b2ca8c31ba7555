"""Queries over numeric features: imputation, neighbours, stability, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from cohortlens.functions import columns as X
from cohortlens.operators import compare, missing, neighbors, stability
from cohortlens.operators.ordering import exact_quantiles
from cohortlens.plans import imputation_check, stratify

from .adapters import (EVENT, FEATURES, FULL, FULL_LONG, GAPS_LONG, PEOPLE, event_rows, full_rows, gaps, people, table)
from .registry import query, r6, with_

ID = "subjectkey"


# ---- neighbours and imputation -----------------------------------------------

def sql_distances(source, same_run=False):
    run = " AND q.run=t.run" if same_run else ""
    return ("pd", f"""SELECT q.subjectkey AS q, t.subjectkey AS t,
  round(sqrt(sum((q.value-t.value)*(q.value-t.value))*64.0/count(*)), 9) AS dist
  FROM {source} q JOIN {source} t ON q.j=t.j AND t.split='train'{run} GROUP BY 1, 2""")


def sql_imputed(same_run=False):
    run = " AND t.run=c.run" if same_run else ""
    return with_([FULL_LONG, GAPS_LONG, sql_distances("gaps_long", same_run),
                  ("cells", "SELECT * FROM full_long WHERE (subjectkey*64+j)%7=0"),
                  ("cand", f"""SELECT c.subjectkey, c.feature, t.value, row_number() OVER (
  PARTITION BY c.subjectkey, c.j ORDER BY dist, t.subjectkey) AS rn
  FROM cells c JOIN gaps_long t ON t.j=c.j AND t.split='train'{run} JOIN pd ON pd.q=c.subjectkey AND pd.t=t.subjectkey""")],
                 f"""SELECT subjectkey, feature, {r6('avg(value)')} AS value FROM cand WHERE rn<=5 GROUP BY 1, 2
UNION ALL SELECT subjectkey, feature, {r6('value')} FROM gaps_long""")


def _train(df):
    return df.filter(F.col("split") == "train")


@query("i5_knn_impute", sql_imputed())
def i5(spark, sf):
    """Train and test rows with gaps filled from train donors."""
    rows = gaps(spark, sf)
    return X.to_long(neighbors.impute_rows(_train(rows), rows, FEATURES, 5, ID), [ID], FEATURES)


@query("i6_knn_impute_by_period", sql_imputed(True))
def i6(spark, sf):
    rows = gaps(spark, sf)
    filled = neighbors.impute_rows(_train(rows), rows, FEATURES, 5, ID, ["interview_period"])
    return X.to_long(filled, [ID], FEATURES)


NEAR = [FULL_LONG, sql_distances("full_long"),
        ("near", "SELECT * FROM pd QUALIFY row_number() OVER (PARTITION BY q ORDER BY dist, t) <= 10")]
VOTE = NEAR + [("pred", """SELECT q AS query_id, cluster AS predicted FROM (
  SELECT q, cluster, count(*) AS v FROM near JOIN (SELECT DISTINCT subjectkey, cluster FROM full_long) ON subjectkey=t GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY q ORDER BY v DESC, cluster) = 1""")]


@query("o3_nearest_neighbors", with_(NEAR, f"SELECT q AS query_id, t AS neighbor_id, {r6('dist')} AS dist FROM near"))
def o3(spark, sf):
    """Ten nearest train rows of every row."""
    rows = full_rows(spark, sf)
    return neighbors.nearest_neighbors(_train(rows), rows, FEATURES, 10, ID)


@query("v3_knn_classify", with_(VOTE, "SELECT query_id, CAST(predicted AS BIGINT) AS predicted FROM pred"))
def v3(spark, sf):
    rows = full_rows(spark, sf)
    return neighbors.classify(_train(rows), rows, FEATURES, "cluster", 10, ID)


@query("v12_distance_rows", with_([FULL_LONG, ("anch", """
  SELECT DISTINCT subjectkey FROM full_long QUALIFY dense_rank() OVER (PARTITION BY cluster ORDER BY subjectkey) = 1""")], f"""
SELECT a.subjectkey AS anchor, b.subjectkey, {r6('sqrt(sum((a.value-b.value)*(a.value-b.value)))')} AS dist
FROM full_long a JOIN anch ON anch.subjectkey=a.subjectkey JOIN full_long b ON a.j=b.j GROUP BY 1, 2"""))
def v12(spark, sf):
    """Distance matrix rows of each cluster's first subject to all subjects."""
    rows = full_rows(spark, sf)
    first = rows.groupBy("cluster").agg(F.min(ID).alias(ID)).select(ID)
    return neighbors.distance_rows(rows, rows.join(first, ID, "left_semi"), FEATURES, ID)


SCALED = ("sc", """SELECT subjectkey, split, half, feature, j, CASE WHEN hi>lo THEN (value-lo)/(hi-lo) ELSE 0 END AS value FROM (
  SELECT *, min(value) OVER (PARTITION BY split, j) AS lo, max(value) OVER (PARTITION BY split, j) AS hi FROM full_long)""")


@query("f7_min_max", with_([FULL_LONG, SCALED], f"SELECT subjectkey, feature, {r6('value')} AS value FROM sc"))
def f7(spark, sf):
    """Features scaled by the range of their own split."""
    return X.to_long(X.with_min_max(full_rows(spark, sf), FEATURES, ["split"]), [ID], FEATURES)


@query("f7_min_max_ungrouped", with_([FULL_LONG], f"""
SELECT subjectkey, feature, {r6('(value-lo)/(hi-lo)')} AS value FROM (
  SELECT *, min(value) OVER (PARTITION BY j) AS lo, max(value) OVER (PARTITION BY j) AS hi FROM full_long)"""))
def f7_all(spark, sf):
    return X.to_long(X.with_min_max(full_rows(spark, sf), FEATURES), [ID], FEATURES)


@query("v14_distance_summary", with_([FULL_LONG, SCALED, ("pr", """
  SELECT a.split, a.half AS ca, b.half AS cb, sum((a.value-b.value)*(a.value-b.value)) AS sq
  FROM sc a JOIN sc b ON a.j=b.j AND a.split=b.split AND (a.half<b.half OR (a.half=b.half AND a.subjectkey<b.subjectkey))
  GROUP BY a.split, a.half, b.half, a.subjectkey, b.subjectkey""")], f"""
SELECT split, CAST(ca AS BIGINT) AS cluster_a, CAST(cb AS BIGINT) AS cluster_b, CAST(count(*) AS BIGINT) AS pairs,
  {r6('avg(sq)')} AS mean_square, {r6('sqrt(avg(sq))')} AS rms FROM pr GROUP BY 1, 2, 3"""))
def v14(spark, sf):
    """Distances within and between clusters, train and test; SQL forms all pairs."""
    rows = X.with_min_max(full_rows(spark, sf), FEATURES, ["split"])
    return neighbors.distance_summary(rows, "half", FEATURES, ["split"])


# ---- injection and its evaluation --------------------------------------------

BLOCKS = {f"block{b}": FEATURES[16 * b:16 * b + 16] for b in range(4)}


def sql_draw(x, salt):
    step = f"((({x})%2147483648)*2654435761+{salt * 40503 + 12345})"
    mixed = f"({step}%4294967296)"
    return f"((CAST(floor({mixed}/65536) AS BIGINT)+({mixed}%65536)*48271)%4294967296)"


def sql_bit(x, salt):
    return f"(CAST(floor({sql_draw(x, salt)}/67108864) AS BIGINT)%2)"


INJECTED = ("hole", f"""SELECT f.*, NOT (rn<=ceil(0.2*sz) AND pattern<15 AND (pattern>>(j//16))&1=1) AS kept FROM full_long f JOIN (
  SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY d, id) AS rn, count(*) OVER (PARTITION BY pattern) AS sz FROM (
    SELECT vec_id AS id, {' + '.join(f'{sql_bit("vec_id", b + 1)}*{1 << b}' for b in range(4))} AS pattern,
      {sql_draw('vec_id', 0)} AS d FROM embeddings)) ON id=subjectkey""")


@query("i3_inject_mcar", with_([FULL_LONG, INJECTED], f"""
SELECT subjectkey, feature, CASE WHEN kept THEN {r6('value')} END AS value FROM hole"""))
def i3(spark, sf):
    """Blocks of features lost completely at random, arithmetic draws."""
    holes = missing.inject_mcar(full_rows(spark, sf), BLOCKS, 0.2, ID, draw=lambda c, salt: missing.arithmetic_draw(c, salt))
    return X.to_long(holes, [ID], FEATURES)


MAR = [FULL_LONG, ("flags", f"""
  SELECT p, j, {sql_bit('p*64+j', 2)}=1 AS keep, {sql_bit('p*64+j', 3)}=1 AS weigh
  FROM (SELECT unnest(range(0, 16)) AS p), (SELECT unnest(range(0, 64)) AS j)"""), ("odds", f"""
  SELECT p, q, CASE WHEN q=0 THEN 1 ELSE floor({sql_draw('(p*3+q-1)', 4)}/(4294967296/5.0)) END AS o
  FROM (SELECT unnest(range(0, 16)) AS p), (SELECT unnest(range(0, 4)) AS q)"""),
    ("chances", "SELECT p, q, 0.2*o/(sum(o) OVER (PARTITION BY p)/4) AS chance FROM odds"), ("sums", f"""
  SELECT subjectkey, p, COALESCE(sum(CASE WHEN keep AND weigh THEN value END), 0) AS s, bool_and(keep) AS whole
  FROM (SELECT *, {sql_draw('subjectkey', 1)}%16 AS p FROM full_long) JOIN flags USING (p, j) GROUP BY 1, 2"""), ("quarters", """
  SELECT *, least(floor(4*(rank() OVER (PARTITION BY p ORDER BY s)-1)/count(*) OVER (PARTITION BY p)), 3) AS q,
    count(*) OVER (PARTITION BY p) AS sz FROM sums"""), ("hits", f"""
  SELECT subjectkey, p, NOT whole AND (sz=1 OR {sql_draw('subjectkey', 5)}/4294967296.0<chance) AS hit
  FROM quarters JOIN chances USING (p, q)"""), ("hole", """
  SELECT f.*, NOT hit OR keep AS kept FROM full_long f JOIN hits USING (subjectkey) JOIN flags USING (p, j)""")]


def _mar(spark, sf):
    return missing.inject_mar(full_rows(spark, sf), FEATURES, 0.2, ID, draw=missing.arithmetic_draw)


@query("i4_inject_mar", with_(MAR, f"""
SELECT feature, {r6('100*avg(CAST(NOT kept AS DOUBLE))')} AS missing_perc FROM hole GROUP BY 1"""))
def i4(spark, sf):
    """Features lost depending on observed values: how many."""
    return missing.missing_percent(_mar(spark, sf), FEATURES)


@query("i4_injected_values", with_(MAR, f"SELECT subjectkey, feature, CASE WHEN kept THEN {r6('value')} END AS value FROM hole"))
def i4_values(spark, sf):
    """Features lost depending on observed values: every value, arithmetic draws."""
    return X.to_long(_mar(spark, sf), [ID], FEATURES)


_COPY = "(subjectkey*16+iteration)"
_COPY_ID = "(vec_id*16+iteration)"
INJECTIONS = 10
# All blocks are lost whole: a distance is a sum of block distances, which the
# SQL computes once for all injections, and a block's cells share their donors.
INJECTED_COPIES = [FULL_LONG, ("its", f"SELECT unnest(range(0, {INJECTIONS})) AS iteration"), ("copy_rows", f"""
  SELECT *, row_number() OVER (PARTITION BY iteration, pattern ORDER BY d, id) AS rn,
    count(*) OVER (PARTITION BY iteration, pattern) AS sz FROM (
    SELECT vec_id AS id, iteration, {' + '.join(f'{sql_bit(_COPY_ID, b + 1)}*{1 << b}' for b in range(4))} AS pattern,
      {sql_draw(_COPY_ID, 0)} AS d FROM embeddings, its)"""), ("gone", """
  SELECT id, iteration, CASE WHEN rn<=ceil(0.2*sz) AND pattern<15 THEN pattern ELSE 0 END AS lost FROM copy_rows"""),
    ("bl", "SELECT subjectkey, " + ", ".join(f"list(value ORDER BY j) FILTER (WHERE j//16={b}) AS v{b}" for b in range(4))
     + " FROM full_long GROUP BY 1"),
    ("bd", "SELECT q.subjectkey AS q, t.subjectkey AS t, " + ", ".join(f"pow(list_distance(q.v{b}, t.v{b}), 2) AS d{b}" for b in range(4))
     + " FROM bl q, bl t"),
    ("sh", "SELECT a.iteration, q, t, a.lost AS lq, b.lost AS lt, " + ", ".join(f"d{b}, 1-(((a.lost|b.lost)>>{b})&1) AS c{b}" for b in range(4))
     + " FROM bd JOIN gone a ON a.id=q AND a.lost>0 JOIN gone b ON b.id=t AND b.iteration=a.iteration"),
    ("pd", """SELECT iteration, q, t, lq, lt, round(sqrt((c0*d0+c1*d1+c2*d2+c3*d3)*64.0/(16*(c0+c1+c2+c3))), 9) AS dist
  FROM sh WHERE c0+c1+c2+c3>0"""), ("cand", """
  SELECT iteration, q, t, b FROM pd, (SELECT unnest(range(0, 4)) AS b) WHERE (lq>>b)&1=1 AND (lt>>b)&1=0
  QUALIFY row_number() OVER (PARTITION BY iteration, q, b ORDER BY dist, t)<=5"""), ("filled", """
  SELECT iteration, q AS subjectkey, j, avg(value) AS value FROM cand JOIN full_long ON subjectkey=t AND j//16=b GROUP BY 1, 2, 3
  UNION ALL SELECT iteration, subjectkey, j, value FROM full_long JOIN gone ON id=subjectkey WHERE (lost>>(j//16))&1=0""")]
_STATS = {"mean": "avg(value)", "q0.25": "quantile_cont(value, CAST(0.25 AS DOUBLE))",
          "q0.5": "quantile_cont(value, CAST(0.5 AS DOUBLE))", "q0.75": "quantile_cont(value, CAST(0.75 AS DOUBLE))"}


def _copies_draw(c, salt):
    return missing.arithmetic_draw(F.col(c) * 16 + F.col("iteration"), salt)


def _evaluated(spark, sf):
    return imputation_check.evaluate_imputation(full_rows(spark, sf), FEATURES, 0.2, INJECTIONS, 5, "MCAR", BLOCKS, ID,
                                                draw=_copies_draw)


@query("i7_imputation_bias", with_(INJECTED_COPIES, "\nUNION ALL ".join(f"""
SELECT '{n}' AS statistic, {r6('e-t')} AS raw_bias, {r6('100*abs((e-t)/t)')} AS percent_bias FROM
  (SELECT avg(x) AS e FROM (SELECT {s} AS x FROM filled GROUP BY iteration, j)),
  (SELECT avg(x) AS t FROM (SELECT {s} AS x FROM full_long GROUP BY j))""" for n, s in _STATS.items())))
def i7_bias(spark, sf):
    """Bias of mean and quartiles after injecting and imputing."""
    return _evaluated(spark, sf).select("statistic", "raw_bias", "percent_bias")


@query("i7_imputation_scores_mcar")
def i7(spark, sf):
    """All scores, with coverage and width of the intervals."""
    return _evaluated(spark, sf)


@query("i7_imputation_scores_mar")
def i7_mar(spark, sf):
    return imputation_check.evaluate_imputation(full_rows(spark, sf), FEATURES, 0.2, INJECTIONS, 5, "MAR", row_id=ID)


@query("f9_mean_intervals")
def f9(spark, sf):
    """Mean with its 95% t interval per feature and cluster."""
    rows = X.to_long(full_rows(spark, sf), ["cluster"], FEATURES)
    return imputation_check.mean_intervals(rows, ["feature", "cluster"])


# ---- splits ------------------------------------------------------------------

@query("d10_stratified_split", with_([PEOPLE], f"""
SELECT subjectkey, CASE WHEN rn <= floor(n*55/100.0) THEN 'train' ELSE 'test' END AS split FROM (
  SELECT subjectkey, row_number() OVER (PARTITION BY sex, phenotype ORDER BY {sql_draw('subjectkey', 42)}, subjectkey) AS rn,
    count(*) OVER (PARTITION BY sex, phenotype) AS n FROM people)"""))
def d10(spark, sf):
    rows = people(spark, sf)
    return stability.train_test(rows, ["sex", "phenotype"], 0.45, ID, draw=missing.arithmetic_draw(ID, 42)).select(ID, "split")


@query("d11_contiguous_folds", """
SELECT o_orderkey AS subjectkey, CAST(ntile(10) OVER (ORDER BY o_orderkey)-1 AS BIGINT) AS fold FROM orders""")
def d11(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias(ID))
    return stability.with_folds(rows, 10, ID)


@query("d11_stratified_folds", """
SELECT o_orderkey AS subjectkey, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey)-1)%10 AS BIGINT) AS fold
FROM orders""")
def d11_strata(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias(ID), "o_orderpriority")
    return stability.with_folds(rows, 10, ID, ["o_orderpriority"]).select(ID, "fold")


# ---- clustering and stability ------------------------------------------------

KS, FOLDS, SHUFFLES = list(range(2, 11)), 10, 100
AXES = ["e0", "e1"]


def _embedded(spark, sf):
    rows = full_rows(spark, sf).select(ID, "split", *FEATURES)
    parts = [rows.filter(F.col("split") == s).drop("split") for s in ("train", "test")]
    return stability.embed(parts[0], parts[1:], FEATURES)


def _embedded_whole(spark, sf):
    return stability.embed(full_rows(spark, sf).select(ID, *FEATURES), [], FEATURES)[0]


@query("v1_ward_clusters")
def v1(spark, sf):
    """Sizes of the clusters for several k from one merge tree (V1, G9)."""
    rows = _embedded_whole(spark, sf)
    labelled = stability.ward(rows, AXES).label(rows, KS)
    each = [compare.cluster_sizes(labelled.select(F.lit(k).alias("k"), F.col(f"cluster_{k}").alias("cluster")), "cluster")
            .withColumn("k", F.lit(k)) for k in KS]
    return reduce(lambda a, b: a.unionByName(b), each)


@query("v15_merge_tree")
def v15(spark, sf):
    return stability.ward(_embedded_whole(spark, sf), AXES).linkage(spark)


@query("v2_p4_embedding_points")
def v2(spark, sf):
    """Two-dimensional points, fitted on train, with their cluster (V2, P4)."""
    train, test = _embedded(spark, sf)
    tree = stability.ward(train, AXES, 60)
    return tree.label(train.withColumn("split", F.lit("train")), [4]).unionByName(
        tree.label(test.withColumn("split", F.lit("test")), [4]))


@query("v6_zero_one_loss", with_([FULL], f"""
SELECT CAST(run AS BIGINT) AS run, {r6('avg(CASE WHEN half<>cluster%3 THEN 1.0 ELSE 0.0 END)')} AS loss FROM full_rows GROUP BY 1"""))
def v6(spark, sf):
    rows = full_rows(spark, sf).withColumn("third", F.col("cluster") % 3)
    return stability.zero_one_loss(rows, "half", "third", ["run"])


def _permutations(total="n"):
    from itertools import permutations
    sums = [" + ".join(f"sum(CASE WHEN p={i} AND t={v} THEN n ELSE 0 END)" for i, v in enumerate(order))
            for order in permutations(range(3))]
    return f"1 - greatest({', '.join(sums)})*1.0/sum({total})"


@query("v7_aligned_loss", with_([FULL, ("c", """
  SELECT half, cluster%3 AS t, run AS p, count(*) AS n FROM full_rows GROUP BY 1, 2, 3""")], f"""
SELECT CAST(half AS BIGINT) AS half, {r6(_permutations())} AS loss FROM c GROUP BY 1"""))
def v7(spark, sf):
    """Loss after the best renaming of labels; SQL tries every renaming."""
    rows = full_rows(spark, sf)
    counts = rows.groupBy("half", (F.col("cluster") % 3).alias("truth"), F.col("run").alias("predicted")).agg(F.count("*").alias("n"))
    return stability.aligned_loss(counts, ["half"])


@query("v7_label_alignment")
def v7_labels(spark, sf):
    rows = full_rows(spark, sf)
    counts = rows.groupBy("run", F.col("cluster").alias("truth"), ((F.col("cluster") + F.col("half")) % 10).alias("predicted")).agg(
        F.count("*").alias("n"))
    return stability.align_labels(counts, ["run"])


V45 = NEAR + [("lab", "SELECT DISTINCT subjectkey, split, cluster%3 AS label FROM full_long"), ("pred", """
  SELECT q, label AS predicted FROM (SELECT q, label, count(*) AS v FROM near JOIN lab ON subjectkey=t GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY q ORDER BY v DESC, label) = 1"""), ("c", """
  SELECT split, label AS t, predicted AS p, count(*) AS n FROM pred JOIN lab ON subjectkey=q GROUP BY 1, 2, 3""")]


@query("v4_v5_errors_given_labels", with_(V45, f"""
SELECT CAST(0 AS BIGINT) AS run, CAST(3 AS BIGINT) AS k, 'train' AS split,
  {r6('1-sum(CASE WHEN t=p THEN n ELSE 0 END)*1.0/sum(n)')} AS error FROM c WHERE split='train'
UNION ALL SELECT 0, 3, 'test', {r6(_permutations())} FROM c WHERE split='test'"""))
def v4_v5(spark, sf):
    """Train and test error of the classifier, clustering labels given."""
    rows = full_rows(spark, sf).withColumn("run", F.lit(0))
    labels = rows.select("run", F.lit(3).alias("k"), "split", ID, (F.col("cluster") % 3).alias("label"))
    near = neighbors.nearest_neighbors(_train(rows), rows, FEATURES, 10, ID, ["run"])
    near = near.join(rows.select("run", "split", F.col(ID).alias("query_id")), ["run", "query_id"])
    return stability.Runs(labels, near, ID).errors()


@query("v8_random_baseline")
def v8(spark, sf):
    """Mean errors with shuffled train labels."""
    train, test = _embedded(spark, sf)
    runs = stability.cluster_runs([(0, train, test)], AXES, KS, 10, ID)
    return runs.random_errors(SHUFFLES)


def _choice(spark, sf):
    train, _ = _embedded(spark, sf)
    return stability.choose_k(train, AXES, KS, FOLDS, SHUFFLES, 10, ID, ID)


@query("v9_choose_k")
def v9(spark, sf):
    """Stability scores of each k by cross-validation."""
    return _choice(spark, sf).scores


@query("p3_stability_curve")
def p3(spark, sf):
    return stability.stability_curve(_choice(spark, sf).fold_scores)


ERRORS = [("err", """SELECT event_id%5 AS run, 2+user_id%4 AS k, CASE WHEN event_type IN ('click','view') THEN 'train' ELSE 'test' END
  AS split, avg(value)/100 AS error, max(value)/400 AS random_error FROM events GROUP BY 1, 2, 3"""),
          ("base", "SELECT k, split, avg(random_error) AS random_error FROM err GROUP BY 1, 2")]


def _errors(spark, sf):
    rows = table(spark, sf, "events")
    split = F.when(F.col("event_type").isin("click", "view"), "train").otherwise("test")
    both = rows.groupBy((F.col("event_id") % 5).alias("run"), (2 + F.col("user_id") % 4).alias("k"), split.alias("split")).agg(
        (F.avg("value") / 100).alias("error"), (F.max("value") / 400).alias("random_error"))
    return both.drop("random_error"), both.drop("error")


@query("v10_fold_scores", with_(ERRORS, f"""
SELECT run AS fold, e.k, e.split, {r6('error')} AS error, {r6('error/b.random_error')} AS normalized
FROM err e JOIN base b ON e.k=b.k AND b.split='train'"""))
def v10(spark, sf):
    """Fold errors over the mean random train error of their k."""
    return stability.score_folds(*_errors(spark, sf))[0]


@query("o4_best_k", with_(ERRORS, f"""
SELECT e.k, {r6('avg(error)/max(b.random_error)')} AS score FROM err e JOIN base b ON e.k=b.k AND e.split=b.split
WHERE e.split='test' GROUP BY e.k ORDER BY avg(error)/max(b.random_error), e.k DESC LIMIT 1"""))
def o4(spark, sf):
    """Smallest normalized test error, the largest k on ties."""
    return stability.best_k(stability.score_folds(*_errors(spark, sf))[1].filter("split = 'test'"))


@query("v11_evaluate")
def v11(spark, sf):
    """Errors on train and held-out test for a chosen k."""
    train, test = _embedded(spark, sf)
    return stability.evaluate(train, test, AXES, 3, 10, ID)[0]


@query("v13_run_validation")
def v13(spark, sf):
    """Whole validation of one feature level: missingness of the test clusters."""
    rows = gaps(spark, sf)
    raw = rows.filter(F.col("split") == "test")
    parts = neighbors.impute(_train(rows), raw, FEATURES, 5, ID)
    config = stratify.StratifyConfig(ks=KS, folds=FOLDS, rand_iter=SHUFFLES)
    result = stratify.run_validation(*parts, raw, FEATURES, config, ID)
    return result.missing_by_cluster.withColumn("k", F.lit(result.k))


# ---- statistics --------------------------------------------------------------

def sql_beta(x, a, b):
    """Regularized incomplete beta I_x(a, b), as one minus Simpson's rule on
    the angle from the far end: the integrand is as wide as the range there."""
    top = f"asin(sqrt(1-{x}))"
    w = "(CASE WHEN i=0 OR i=600 THEN 1.0 WHEN i%2=1 THEN 4.0 ELSE 2.0 END)"
    f = f"pow(sin({top}*i/600.0), 2*{b}-1)*pow(cos({top}*i/600.0), 2*{a}-1)"
    return (f"(1-2*exp(lgamma({a}+{b})-lgamma({a})-lgamma({b}))*({top}/1800.0)"
            f"*list_sum(list_transform(range(0, 601), lambda i: {w}*{f})))")


def sql_t_p(t, df):
    return sql_beta(f"(({df})/(({df})+({t})*({t})))", f"(({df})/2.0)", "0.5")


def sql_gamma_tail(a, x):
    w = "(CASE WHEN i=0 OR i=2000 THEN 1.0 WHEN i%2=1 THEN 4.0 ELSE 2.0 END)"
    f = f"pow(sqrt({x})*i/2000.0, 2*{a}-1)*exp(-({x})*i*i/4000000.0)"
    return f"(1-2*exp(-lgamma({a}))*(sqrt({x})/6000.0)*list_sum(list_transform(range(0, 2001), lambda i: {w}*{f})))"


def sql_moments(cluster="cluster", source="full_long"):
    return ("mom", f"""SELECT feature, {cluster} AS cluster, CAST(count(value) AS DOUBLE) AS n, avg(value) AS mean,
  var_samp(value) AS var FROM {source} GROUP BY 1, 2""")


WELCH = ("tt", """SELECT a.feature, a.mean AS mean_a, b.mean AS mean_b,
  (a.mean-b.mean)/sqrt(a.var/a.n+b.var/b.n) AS t,
  pow(a.var/a.n+b.var/b.n, 2)/(pow(a.var/a.n,2)/(a.n-1)+pow(b.var/b.n,2)/(b.n-1)) AS df
  FROM mom a JOIN mom b ON a.feature=b.feature AND a.cluster<b.cluster""")


@query("t1_wide_to_long", with_([FULL_LONG], f"SELECT CAST(cluster AS BIGINT) AS cluster, feature, {r6('value')} AS value FROM full_long"))
def t1(spark, sf):
    return X.to_long(full_rows(spark, sf), ["cluster"], FEATURES)


@query("t2_welch", with_([FULL_LONG, sql_moments("half"), WELCH], f"""
SELECT feature, {r6('t')} AS t, {r6('df')} AS df, {r6('mean_a')} AS mean_a, {r6('mean_b')} AS mean_b, {r6(sql_t_p('t', 'df'))} AS p FROM tt"""))
def t2(spark, sf):
    return compare.welch(compare.moments(full_rows(spark, sf), "half", FEATURES))


@query("t3_welch_less", with_([FULL_LONG, sql_moments("half"), WELCH], f"""
SELECT feature, {r6('t')} AS t, {r6(f"CASE WHEN t<0 THEN 0.5*{sql_t_p('t', 'df')} ELSE 1-0.5*{sql_t_p('t', 'df')} END")} AS p FROM tt"""))
def t3(spark, sf):
    return compare.welch(compare.moments(full_rows(spark, sf), "half", FEATURES), "less").select("feature", "t", "p")


ANOVA = ("av", """SELECT feature, count(*)-1.0 AS d1, sum(n)-count(*) AS d2, sum(n*(mean-g)*(mean-g)) AS sb, sum((n-1)*var) AS sw
  FROM (SELECT *, sum(n*mean) OVER (PARTITION BY feature)/sum(n) OVER (PARTITION BY feature) AS g FROM mom) GROUP BY 1""")


@query("t4_anova", with_([FULL_LONG, sql_moments(), ANOVA, ("ff", "SELECT *, (sb/d1)/(sw/d2) AS f FROM av")], f"""
SELECT feature, {r6('d1')} AS df_between, {r6('d2')} AS df_within, {r6('sb')} AS ss_between, {r6('sw')} AS ss_within, {r6('f')} AS f,
  {r6(sql_beta('(d2/(d2+d1*f))', '(d2/2.0)', '(d1/2.0)'))} AS p FROM ff"""))
def t4(spark, sf):
    return compare.anova(compare.moments(full_rows(spark, sf), "cluster", FEATURES))


def sql_pairwise(key, group):
    return [("po", f"SELECT {key}, sum(n)-count(*) AS df, sum((n-1)*var) AS ss FROM mom GROUP BY 1"),
            ("pt", f"""SELECT a.{key}, a.{group} AS group_a, b.{group} AS group_b, df,
  (a.mean-b.mean)/sqrt(ss/df*(1/a.n+1/b.n)) AS t FROM mom a JOIN mom b ON a.{key}=b.{key} AND a.{group}<b.{group}
  JOIN po ON po.{key}=a.{key}"""),
            ("pp", f"SELECT *, {sql_t_p('t', 'df')} AS p FROM pt"),
            ("ho", f"""SELECT *, least(1.0, max(m*p) OVER (PARTITION BY {key} ORDER BY p, group_a, group_b ROWS UNBOUNDED PRECEDING)) AS p_holm
  FROM (SELECT *, count(*) OVER (PARTITION BY {key})-row_number() OVER (PARTITION BY {key} ORDER BY p, group_a, group_b)+1 AS m FROM pp)""")]


@query("t5_pairwise_t", with_([FULL_LONG, sql_moments(), *sql_pairwise("feature", "cluster")], f"""
SELECT feature, CAST(group_a AS BIGINT) AS group_a, CAST(group_b AS BIGINT) AS group_b, {r6('t')} AS t, {r6('df')} AS df, {r6('p')} AS p,
  {r6('p_holm')} AS p_holm FROM ho"""))
def t5(spark, sf):
    return compare.pairwise_t(compare.moments(full_rows(spark, sf), "cluster", FEATURES))


@query("t6_feature_pairs", with_([FULL_LONG, sql_moments("half"), *sql_pairwise("cluster", "feature")], f"""
SELECT CAST(cluster AS BIGINT) AS cluster, group_a, group_b, {r6('t')} AS t, {r6('df')} AS df, {r6('p')} AS p, {r6('p_holm')} AS p_holm FROM ho"""))
def t6(spark, sf):
    return compare.feature_comparison(full_rows(spark, sf), "half", FEATURES)


def sql_chi2(category, cluster, name="x"):
    return [(f"{name}_c", f"SELECT CAST({category} AS VARCHAR) AS category, {cluster} AS cluster, count(*) AS n FROM people GROUP BY 1, 2"),
            (f"{name}_g", f"""SELECT r.category, k.cluster, COALESCE(n, 0) AS o, rn*cn*1.0/tot AS e, nr, nc FROM
  (SELECT category, sum(n) AS rn, count(*) OVER () AS nr FROM {name}_c GROUP BY 1) r CROSS JOIN
  (SELECT cluster, sum(n) AS cn, count(*) OVER () AS nc FROM {name}_c GROUP BY 1) k CROSS JOIN
  (SELECT sum(n) AS tot FROM {name}_c) LEFT JOIN {name}_c c ON c.category=r.category AND c.cluster=k.cluster"""),
            (name, f"""SELECT sum(pow(abs(o-e)-y, 2)/e) AS chi2, max((nr-1)*(nc-1))*1.0 AS df FROM (
  SELECT *, CASE WHEN nr=2 AND nc=2 THEN least(0.5, min(abs(o-e)) OVER ()) ELSE 0 END AS y FROM {name}_g)""")]


_CHI_OUT = f"{r6('chi2')} AS chi2, {r6('df')} AS df, {r6(sql_gamma_tail('(df/2.0)', '(chi2/2.0)'))} AS p"


@query("t7_chi_squared", with_([PEOPLE, *sql_chi2("site", "phenotype", "x"), *sql_chi2("sex", "phenotype", "y"),
                                *sql_chi2("sex", "subjectkey%7=0", "z")], "\nUNION ALL ".join(
    f"SELECT '{label}' AS variable, {_CHI_OUT} FROM {n}" for n, label in (("x", "site"), ("y", "sex"), ("z", "two")))))
def t7(spark, sf):
    """Independence tests, one of them 2 x 2 with continuity correction."""
    rows = people(spark, sf).withColumn("two", F.col(ID) % 7 == 0)
    tests = [("site", "site", "phenotype"), ("sex", "sex", "phenotype"), ("two", "sex", "two")]
    out = [compare.chi_squared(compare.contingency(rows, a, b)).withColumn("variable", F.lit(n)) for n, a, b in tests]
    return out[0].unionByName(out[1]).unionByName(out[2])


# A balance per customer and its cluster, for reports over two and more clusters.
CUST = ("cust", """SELECT people.*, c_acctbal AS balance, CAST(c_nationkey%2 AS INT) AS two, CAST(c_nationkey%4 AS INT) AS four
  FROM people JOIN customer ON c_custkey=subjectkey""")


def _customers(spark, sf):
    extra = table(spark, sf, "customer").selectExpr("c_custkey AS subjectkey", "c_acctbal AS balance",
                                                    "CAST(c_nationkey%2 AS INT) AS two", "CAST(c_nationkey%4 AS INT) AS four")
    return people(spark, sf).join(extra, ID)


def _report_chi(name, variable):
    return f"SELECT 'chi2' AS test, '{variable}' AS variable, {r6('chi2')} AS statistic, {r6('df')} AS df, {r6(sql_gamma_tail('(df/2.0)', '(chi2/2.0)'))} AS p FROM {name}"


@query("t8_confounders_two", with_([PEOPLE, CUST, ("people2", "SELECT 1"), *[
    (n, s.replace("FROM people", "FROM cust")) for n, s in sql_chi2("sex", "two", "a") + sql_chi2("phenotype", "two", "b")],
    ("lg", "SELECT 'balance' AS feature, two AS cluster, balance AS value FROM cust"), sql_moments(source="lg"), WELCH],
    _report_chi("a", "sex") + "\nUNION ALL " + _report_chi("b", "phenotype") + f"""
UNION ALL SELECT 'welch', feature, {r6('t')}, {r6('df')}, {r6(sql_t_p('t', 'df'))} FROM tt"""))
def t8_two(spark, sf):
    """Two clusters: categories by chi-squared, the numeric one by Welch."""
    return compare.confounders(_customers(spark, sf), "two", ["sex", "phenotype"], "balance")


@query("t8_confounders_more", with_([PEOPLE, CUST, *[
    (n, s.replace("FROM people", "FROM cust")) for n, s in sql_chi2("sex", "four", "a")],
    ("lg", "SELECT 'balance' AS feature, four AS cluster, balance AS value FROM cust"), sql_moments(source="lg"), ANOVA,
    ("ff", "SELECT *, (sb/d1)/(sw/d2) AS f FROM av"), *sql_pairwise("feature", "cluster")],
    _report_chi("a", "sex") + f"""
UNION ALL SELECT 'anova', feature, {r6('f')}, {r6('d2')}, {r6(sql_beta('(d2/(d2+d1*f))', '(d2/2.0)', '(d1/2.0)'))} FROM ff
UNION ALL SELECT 'pairwise', concat(feature, ':', group_a, ':', group_b), {r6('t')}, {r6('df')}, {r6('p_holm')} FROM ho"""))
def t8_more(spark, sf):
    """More clusters: analysis of variance and pairwise tests."""
    return compare.confounders(_customers(spark, sf), "four", ["sex"], "balance")


FLAGS_LONG = ("fl", "SELECT subjectkey, cluster, half, feature, CASE WHEN (subjectkey*64+j)%7=0 THEN 1.0 ELSE 0.0 END AS value FROM full_long")


@query("t9_missingness_by_cluster", with_([FULL_LONG, FLAGS_LONG, sql_moments("half", "fl"), WELCH], f"""
SELECT 'welch' AS test, feature AS variable, {r6('t')} AS statistic, {r6('df')} AS df, {r6(sql_t_p('t', 'df'))} AS p FROM tt"""))
def t9(spark, sf):
    return compare.compare_missingness(gaps(spark, sf), "half", FEATURES)


@query("t10_feature_report", with_([FULL_LONG, sql_moments(), ANOVA, ("ff", "SELECT *, (sb/d1)/(sw/d2) AS f FROM av"),
                                    *sql_pairwise("feature", "cluster")], f"""
SELECT 'anova' AS test, feature AS variable, {r6('f')} AS statistic, {r6('d2')} AS df,
  {r6(sql_beta('(d2/(d2+d1*f))', '(d2/2.0)', '(d1/2.0)'))} AS p FROM ff
UNION ALL SELECT 'pairwise', concat(feature, ':', group_a, ':', group_b), {r6('t')}, {r6('df')}, {r6('p_holm')} FROM ho"""))
def t10(spark, sf):
    return compare.compare_features(full_rows(spark, sf), "cluster", FEATURES)


# ---- counts, distributions, intervals ----------------------------------------

@query("g9_cluster_sizes", with_([FULL], "SELECT CAST(cluster AS BIGINT) AS cluster, CAST(count(*) AS BIGINT) AS n FROM full_rows GROUP BY 1"))
def g9(spark, sf):
    return compare.cluster_sizes(full_rows(spark, sf), "cluster")


@query("g10_distribution", with_([FULL_LONG], f"""
SELECT feature, CAST(count(value) AS BIGINT) AS n, {r6('min(value)')} AS minimum, {r6('max(value)')} AS maximum, {r6('avg(value)')} AS mean,
  {r6('median(value)')} AS median FROM full_long GROUP BY 1"""))
def g10(spark, sf):
    return compare.distribution(full_rows(spark, sf), FEATURES)


@query("g10_histogram", """
SELECT 'price' AS feature, CAST(least(floor((v-lo)/(hi-lo)*50), 49) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT l_extendedprice AS v, min(l_extendedprice) OVER () AS lo, max(l_extendedprice) OVER () AS hi FROM lineitem) GROUP BY 1, 2""")
def g10_histogram(spark, sf):
    return compare.histogram(table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("price")), ["price"])


@query("g11_contingency", with_([PEOPLE], """
SELECT site AS category, phenotype AS cluster, CAST(count(*) AS BIGINT) AS n FROM people GROUP BY 1, 2"""))
def g11(spark, sf):
    return compare.contingency(people(spark, sf), "site", "phenotype")


@query("g11_contingency_wide", with_([FULL], """
SELECT CAST(cluster AS VARCHAR) AS category, CAST(count(CASE WHEN half=0 THEN 1 END) AS BIGINT) AS cluster_0,
  CAST(count(CASE WHEN half=1 THEN 1 END) AS BIGINT) AS cluster_1 FROM full_rows GROUP BY 1"""))
def g11_wide(spark, sf):
    return compare.contingency_wide(full_rows(spark, sf), "cluster", "half", [0, 1])


def _q(p):
    return r6(f"quantile_cont(value, CAST({p} AS DOUBLE))")


@query("g12_boxplots", with_([FULL_LONG], f"""
SELECT feature, CAST(cluster AS BIGINT) AS cluster, CAST(count(value) AS BIGINT) AS n, {r6('min(value)')} AS minimum, {_q(0.25)} AS q1,
  {_q(0.5)} AS median, {_q(0.75)} AS q3, {r6('max(value)')} AS maximum FROM full_long GROUP BY 1, 2"""))
def g12(spark, sf):
    return compare.boxplots(full_rows(spark, sf), "cluster", FEATURES)


@query("g13_membership_flow", with_([FULL], """
SELECT CAST(cluster AS BIGINT) AS cluster, CAST(run AS BIGINT) AS run, split, CAST(count(*) AS BIGINT) AS n FROM full_rows GROUP BY 1, 2, 3"""))
def g13(spark, sf):
    return compare.membership_flow(full_rows(spark, sf), "cluster", "run", "split")


@query("f8_proportion_interval", f"""
SELECT event_type, {r6('p')} AS p, {r6('1.96*sqrt(p*(1-p)/n)')} AS half_width FROM (
  SELECT event_type, avg(CASE WHEN value>50 THEN 1.0 ELSE 0.0 END) AS p, count(*) AS n FROM events GROUP BY 1)""")
def f8(spark, sf):
    shares = table(spark, sf, "events").groupBy("event_type").agg(
        F.avg((F.col("value") > 50).cast("double")).alias("p"), F.count("*").alias("n"))
    return shares.select("event_type", "p", X.proportion_half_width("p", "n").alias("half_width"))


@query("f10_label_shift", with_([FULL], "SELECT subjectkey, CAST(cluster+1 AS BIGINT) AS cluster FROM full_rows"))
def f10(spark, sf):
    return full_rows(spark, sf).select(ID, (F.col("cluster") + 1).alias("cluster"))


@query("f11_quantiles", "\nUNION ALL ".join(
    f"SELECT l_returnflag, CAST({p} AS DOUBLE) AS prob, {r6(f'quantile_cont(l_extendedprice, CAST({p} AS DOUBLE))')} AS quantile FROM lineitem GROUP BY 1"
    for p in (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)))
def f11(spark, sf):
    """Interpolated quantiles per group, exact."""
    return exact_quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0])


@query("f1_f6_scalar_functions", with_([EVENT], f"""
SELECT subjectkey, CAST(regexp_matches(lower(instrument), 'click|view') AS BIGINT) AS found,
  CAST(regexp_matches(instrument, '^(?:sign|err)') AS BIGINT) AS starts, TRY_CAST(token AS DOUBLE) AS number,
  CAST(COALESCE(d, v) AS DOUBLE) AS filled, CAST(COALESCE(d,0)+COALESCE(v,0) AS DOUBLE) AS row_sum,
  CAST((CASE WHEN d IS NULL THEN 0 ELSE 1 END)+(CASE WHEN v IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS row_count,
  {r6('(COALESCE(d,0)+COALESCE(v,0))/NULLIF(CAST((CASE WHEN d IS NULL THEN 0 ELSE 1 END)+(CASE WHEN v IS NULL THEN 0 ELSE 1 END) AS DOUBLE),0)')} AS row_mean
FROM ev"""))
def f1_f6(spark, sf):
    """Text matches, casts, fill, and reductions over a row that skip NULL."""
    return event_rows(spark, sf).select(
        ID, X.found("instrument", "click|view").alias("found"), X.starts("instrument", "sign|err").alias("starts"),
        X.number("token").alias("number"), F.coalesce("d", "v").cast("double").alias("filled"),
        X.row_sum(["d", "v"]).alias("row_sum"), X.row_count(["d", "v"]).alias("row_count"), X.row_mean(["d", "v"]).alias("row_mean"))
