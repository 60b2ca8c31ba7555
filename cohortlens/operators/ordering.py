"""First rows, group counts, exact ranks and exact quantiles that do not need
a whole group in one task.

Subjects and strata may hold a large share of all rows, so each helper either
reduces on the map side before it shuffles or spreads a group over buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import col, join_on_keys, join_summary
from ..session import written

HASH_SPAN = 1 << 32
SKETCH_ACCURACY = 10_000
SMALL_GROUP = 5 * SKETCH_ACCURACY
GRID = 1_000
BUCKET_ROWS = 1_000_000
#: Rows of a key from which brackets are read, and standard deviations of their ranks left on either side.
SAMPLE, SAMPLE_SLACK = 20_000, 5


def hash32(*cols, seed: int = 0) -> Column:
    """Reproducible hash of the columns, uniform on [0, 2**32)."""
    return F.pmod(F.xxhash64(F.lit(seed), *[col(c) for c in cols]), F.lit(HASH_SPAN))


def first_rows(df: DataFrame, keys: Sequence, order: Sequence, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key.

    Spark turns the rank filter into a per-task limit before the shuffle, so a
    key with very many rows sends at most ``n`` of them per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def last_rows(df: DataFrame, keys: Sequence, order: Sequence[str]) -> DataFrame:
    """The last row of each key under an ascending order."""
    return first_rows(df, keys, [col(c).desc() for c in order])


def with_group_count(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows per key, attached to each row: partial counts and a join, whose
    skewed partitions adaptive execution splits."""
    return join_on_keys(df, df.groupBy(*keys).agg(F.count("*").alias(name)), keys)


def with_rank(df: DataFrame, keys: Sequence[str], order: str, tiebreak: Sequence[str],
              name: str = "rank", size: str | None = None, span: int | None = HASH_SPAN,
              buckets: int | None = None, weight: str | None = None) -> DataFrame:
    """Exact 1-based rank of each row in its key, ordered by a numeric column.

    A rank is the offset of a bucket of the order plus the rank inside it.  With
    ``span`` the order is uniform on [0, span), as a hash is, and cut into
    ``buckets``, by default 256 or as many as leave BUCKET_ROWS rows in one.  With ``span=None`` the order has any type, and the buckets are
    the range partitions of (keys, order, tiebreak), as many as the session's
    shuffle has: a key of many rows spreads over its share of them.  They are
    written once, as sampled borders would differ in a second run.  ``size``
    names an optional column for the number of rows of the key.  With
    ``weight`` a row stands for that many equal rows, and its rank is that of
    the last of them.
    """
    if span is not None:
        buckets = buckets or max(256, -(-df.count() // BUCKET_ROWS))
        bucket = F.floor(col(order) * F.lit(buckets / span)).cast("int")
    else:
        by = list(dict.fromkeys([*keys, order, *tiebreak]))
        df = written(df.repartitionByRange(*[col(c) for c in by]).withColumn("_bucket", F.spark_partition_id()), "ranges")
        bucket = F.col("_bucket")
    keyed = df.withColumn("_bucket", bucket)
    slots = [*keys, "_bucket"]
    counts = keyed.groupBy(*slots).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    earlier = Window.partitionBy(*[col(k) for k in keys], F.lit(0)).orderBy("_bucket")
    offsets = counts.select(
        *slots,
        F.coalesce(F.sum("_n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*[col(k) for k in keys], F.lit(0))).alias("_total"),
    )
    inside = Window.partitionBy(*slots).orderBy(col(order), *[col(t) for t in tiebreak])
    if weight:
        place = F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    else:
        place = F.row_number().over(inside)
    ranked = join_summary(keyed.withColumn(name, place), offsets, slots).withColumn(name, F.col("_before") + F.col(name))
    if size:
        ranked = ranked.withColumn(size, F.col("_total"))
    return ranked.drop("_bucket", "_before", "_total")


def rank_brackets(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                  spread: Callable[[Column, float], Column]) -> DataFrame:
    """Values around a rank of each key: ``(*keys, _n, _b)``, ``_b`` an array of
    ``(prob, pos, lo, hi, below, inside)``.  Between ``lo`` and ``hi`` are all values whose
    rank is within ``spread(n, prob)`` of ``n * prob``; NULL is open; ``below`` values are
    smaller, ``inside`` are not beyond either end.

    The ends come from some SAMPLE drawn rows of a key and are counted over all
    rows: one that leaves out a wanted rank is opened.  Unlike a sketch of each task,
    which holds about as much as the task's rows, this moves a bounded part of a key.
    """
    keys, probs = list(keys), [float(p) for p in probs]
    data = df.select(*keys, col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    counts = written(data.groupBy(*keys).agg(F.count("*").alias("_n")), "counts")
    drawn = join_summary(data.withColumn("_draw", F.rand(17)), counts, keys).filter(F.col("_draw") * F.col("_n") < SAMPLE)
    some = drawn.groupBy(*keys, "_n").agg(F.sort_array(F.collect_list("_v")).alias("_s"))
    n, m = F.col("_n").cast("double"), F.size("_s")

    def ends(p):
        wide = m * spread(n, p) / n + F.lit(SAMPLE_SLACK) * F.sqrt(m * F.lit(p * (1 - p))) + 2
        left, right = F.floor(m * F.lit(p) - wide).cast("int"), F.ceil(m * F.lit(p) + wide).cast("int")
        return F.struct(F.lit(p).alias("prob"), ((F.col("_n") - 1) * F.lit(p)).alias("pos"),
                        F.when(left >= 0, F.get("_s", left)).alias("lo"), F.when(right < m, F.get("_s", right)).alias("hi"))

    read = written(some.select(*keys, "_n", *[ends(p).alias(f"_b{i}") for i, p in enumerate(probs)]), "sample")
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    marked = join_summary(data, read, keys)
    told = marked.groupBy(*keys).agg(*[x for i in range(len(probs)) for x in (
        count(F.col("_v") < F.col(f"_b{i}.lo"), f"_l{i}"), count(F.col("_v") <= F.col(f"_b{i}.hi"), f"_h{i}"))])

    def checked(i, p):
        b = F.col(f"_b{i}")
        # A key of which nothing was drawn has no ends.
        lo = F.when(F.col(f"_l{i}") <= n * p - spread(n, p), b.lo)
        hi = F.when(F.col(f"_h{i}") >= n * p + spread(n, p), b.hi)
        below = F.when(lo.isNull(), 0).otherwise(F.col(f"_l{i}")).cast("bigint")
        upto = F.when(hi.isNull(), F.col("_n")).otherwise(F.col(f"_h{i}")).cast("bigint")
        return F.struct(F.lit(p).alias("prob"), ((F.col("_n") - 1) * F.lit(p)).alias("pos"), lo.alias("lo"), hi.alias("hi"),
                        below.alias("below"), (upto - below).alias("inside"))

    known = join_on_keys(counts, join_on_keys(read.drop("_n"), told, keys), keys, "left")
    return written(known.select(*keys, "_n", F.array(*[checked(i, p) for i, p in enumerate(probs)]).alias("_b")), "brackets")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    brackets: DataFrame | None = None) -> DataFrame:
    """Linearly interpolated quantiles per key: ``(*keys, prob, quantile)``.

    A selection by counts.  A mergeable sketch per key brackets each wanted rank;
    its rank error is at most n / SKETCH_ACCURACY, and the bracket is twice that
    on either side, so the wanted order statistics lie inside.  While the rows
    strictly inside the widest bracket may be more than SMALL_GROUP, another pass
    counts them and sketches them alone, which narrows a bracket about 400 times,
    equal values or not.  The last pass counts the values below the bracket and
    sorts only those within, equal ones as one.  Keys with few rows use their
    full range as the bracket.  However large a key is, no task sorts more than
    about SMALL_GROUP of its values.  ``brackets`` that were made already
    (``rank_brackets`` of the same rows and ``probs``) take the place of the sketches.
    """
    probs = [float(p) for p in probs]
    slack = 2.0 / SKETCH_ACCURACY
    edges = [max(p - slack, 0.0) for p in probs] + [min(p + slack, 1.0) for p in probs]
    keys = list(keys) or ["_all"]
    data = (df if keys != ["_all"] else df.withColumn("_all", F.lit(0))).select(
        *keys, col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if brackets is None:
        brackets = _sketched(data, keys, probs, edges)
        most = 6 * (brackets.agg(F.max("_n")).first()[0] or 0) / SKETCH_ACCURACY
    else:
        most = brackets.agg(F.max(F.array_max(F.col("_b.inside")))).first()[0] or 0
        ends = lambda b: F.struct(*[b[c].alias(c) for c in ("prob", "pos", "lo", "hi")])
        brackets = brackets.withColumn("_b", F.transform("_b", ends))
    if most > SMALL_GROUP:
        brackets = _narrow(data, keys, brackets)
    joined = join_summary(data, brackets.select(*keys, "_b"), keys)
    # Below or inside, per (key, prob, value): equal values collapse before the
    # shuffle and everything below a bracket collapses into one row.
    lo, hi = F.col("_b.lo"), F.col("_b.hi")
    spots = joined.select(*keys, "_v", F.explode("_b").alias("_b")).filter(hi.isNull() | (F.col("_v") <= hi)).select(
        *keys, "_b.prob", "_b.pos", F.when(lo.isNull() | (F.col("_v") >= lo), F.col("_v")).alias("_v"))
    slot = [*keys, "prob"]
    counted = spots.groupBy(*slot, "pos", "_v").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*slot).orderBy(F.col("_v").asc_nulls_first())
    cumulative = counted.withColumn("_upto", F.sum("_c").over(upto))
    floor = F.floor("pos")
    first = F.min(F.when(F.col("_upto") > floor, F.col("_v")))
    second = F.min(F.when(F.col("_upto") > floor + 1, F.col("_v")))
    out = cumulative.groupBy(*slot, "pos").agg(first.alias("_a"), second.alias("_z"))
    part = F.col("pos") - F.floor("pos")
    quantile = F.when(part > 0, F.col("_a") + part * (F.col("_z") - F.col("_a"))).otherwise(F.col("_a"))
    return out.select(*[k for k in slot if k != "_all"], quantile.alias("quantile"))


def _sketched(data: DataFrame, keys: Sequence[str], probs: Sequence[float], edges: Sequence[float]) -> DataFrame:
    """Brackets from the ``edges`` of a sketch of each key; an end that is NULL is
    open to that side."""
    slack = 2.0 / SKETCH_ACCURACY
    sketch = data.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.percentile_approx("_v", edges, SKETCH_ACCURACY).alias("_e"))
    small = F.col("_n") <= SMALL_GROUP
    return written(sketch.select(
        *keys, "_n",
        F.array(*[
            F.struct(
                F.lit(p).alias("prob"),
                ((F.col("_n") - 1) * F.lit(p)).alias("pos"),
                F.when(~small & F.lit(p > slack), F.col("_e")[i]).alias("lo"),
                F.when(~small & F.lit(p < 1 - slack), F.col("_e")[len(probs) + i]).alias("hi"),
            ) for i, p in enumerate(probs)]).alias("_b")), "brackets")


def _narrow(data: DataFrame, keys: Sequence[str], brackets: DataFrame) -> DataFrame:
    """Brackets with at most SMALL_GROUP rows strictly inside.

    A round counts the rows below and inside each bracket and takes a grid of
    quantiles of those inside.  The new ends are the grid points around the
    wanted ranks, or the old end where a rank lies on it; values equal to an end
    are not inside, so each round leaves at most about 1/400 of the rows.
    """
    slack = 2.0 / SKETCH_ACCURACY
    grid = [i / GRID for i in range(GRID + 1)]
    lo, hi = F.col("_b.lo"), F.col("_b.hi")
    while True:
        each = join_summary(data, brackets.select(*keys, "_b"), keys).select(*keys, "_v", F.explode("_b").alias("_b"))
        above = lo.isNull() | (F.col("_v") > lo)
        counted = written(each.select(
            *keys, "_b", (~above).alias("_low"), F.when(above & (hi.isNull() | (F.col("_v") < hi)), F.col("_v")).alias("_v"))
            .groupBy(*keys, "_b").agg(
                F.count(F.when(F.col("_low"), 1)).alias("_below"), F.count("_v").alias("_inside"),
                F.percentile_approx("_v", grid, SKETCH_ACCURACY).alias("_e")), "narrowed")
        if counted.agg(F.max("_inside")).first()[0] <= SMALL_GROUP:
            return brackets
        rank, inside = F.floor("_b.pos") - F.col("_below"), F.greatest(F.col("_inside"), F.lit(1))
        left = F.floor((rank / inside - slack) * GRID)
        right = F.ceil(((rank + 2) / inside + slack) * GRID)
        point = lambda i: F.get(F.col("_e"), i.cast("int"))
        wide = F.col("_inside") > SMALL_GROUP
        # A wanted rank at or below the lower end, or at or above the upper one,
        # keeps that end; the grid point nearest to it closes the other side.
        new_lo = F.when(wide & (left > 0), point(F.least(left, F.lit(GRID)))).otherwise(lo)
        new_hi = F.when(wide & (right < GRID), point(F.greatest(right, F.lit(0)))).otherwise(hi)
        struct = F.struct(F.col("_b.prob").alias("prob"), F.col("_b.pos").alias("pos"), new_lo.alias("lo"), new_hi.alias("hi"))
        brackets = written(counted.groupBy(*keys).agg(F.collect_list(struct).alias("_b")), "brackets")


def five_numbers(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Minimum, quartiles and maximum per key, as one row."""
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    ends = df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("minimum"), F.max(value).alias("maximum"))
    middle = exact_quantiles(df, keys, value, list(probs.values())).groupBy(*keys).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name) for name, p in probs.items()])
    return join_on_keys(ends, middle, keys, "left").select(*keys, "n", "minimum", *probs, "maximum")
