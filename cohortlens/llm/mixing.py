"""Mix sources to target weights: exact word budgets cut from a random order.

Each source gets a share of all words by its weight, but no more than a number
of passes over its texts; what is above is shared out again.  The rows of a
source are put in a random order by a hash, sorted within ranges of that hash;
the words in the ranges before it and in the rows before it inside its range
tell where a row begins.  A source's budget is so many whole passes and the
words up to an exact place of the next one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import col, join_summary
from ..operators.ordering import with_rank
from ..session import written
from .exprs import clear_of, words

#: Hash keys are the first 60 bits of MD5.
KEY_BITS = 60
RANGE_ROWS = 100_000
WHOLE = "decimal(38,0)"


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def random_key(row_id: str, seed: str) -> Column:
    """A number on [0, 2**60) that depends on the id alone."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(col(row_id).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(told), 1, KEY_BITS // 4), 16, 10).cast("bigint")


def weights_in_turn(sources: DataFrame, source: str, weights: Sequence[int]) -> DataFrame:
    """``weight`` of each of the rows, which are one per source: the given ones in
    turn over the sources by code point, a null last."""
    told = sources.withColumn("_order", F.struct(col(source).isNull().alias("gone"), col(source).alias("name")))
    ranked = with_rank(told, [], "_order", [], "_rank", span=None)
    turn = (F.col("_rank") - 1) % len(weights)
    return ranked.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int"))).drop(
        "_order", "_rank")


def with_targets(sources: DataFrame, most_passes: int) -> DataFrame:
    """``target`` (double) and ``_budget`` (its whole part) of rows with
    ``source_size`` and ``weight``.

    The words left for the sources that are not full, over their weights, only
    rise when a source proves full, so each round tells from two totals which
    sources are full; only totals come to the driver, and ``sources`` is read in
    every round.
    """
    cap = F.col("source_size").cast(WHOLE) * F.lit(most_passes)
    total, weights = sources.agg(F.sum("source_size").cast(WHOLE), F.sum("weight").cast(WHOLE)).first()
    left, shares, known = total or 0, weights or 0, -1

    def full():
        return F.lit(left).cast(WHOLE) * F.col("weight") > cap * F.lit(shares).cast(WHOLE)

    while True:
        held, taken, n = sources.where(full()).agg(F.sum(cap), F.sum("weight").cast(WHOLE), F.count("*")).first()
        if n == known:
            break
        left, shares, known = (total or 0) - (held or 0), (weights or 0) - (taken or 0), n
    share = F.lit(left).cast(WHOLE) * F.col("weight")
    open_target = share.cast("double") / F.nullif(F.lit(shares).cast("double"), F.lit(0.0))
    exact = F.expr(f"(cast({left} as {WHOLE}) * weight) div nullif(cast({shares} as {WHOLE}), 0)").cast("bigint")
    return sources.select("*", F.when(full(), cap.cast("double")).otherwise(F.coalesce(open_target, F.lit(0.0))).alias("target"),
                          F.when(full(), cap.cast("bigint")).otherwise(F.coalesce(exact, F.lit(0))).alias("_budget"))


def mix(df: DataFrame, weights: Sequence[int] = (5, 2, 1), row_id: str = "doc_id", source: str = "source",
        text: str = "text", size: str | None = None, most_passes: int = 3, seed: str = "mix",
        range_rows: int = RANGE_ROWS) -> DataFrame:
    """Every row with the words that the mix takes of it.

    Adds ``size`` (words of the text, or the column named by ``size``),
    ``source_size``, ``target`` (words the mix wants of the source), ``start``
    (words of the source's random order before this row) and ``taken``: the row's
    words once for each whole pass that the target holds, and those of the last,
    partial pass, which ends at an exact word.  A source's ``taken`` adds up to
    the whole part of its target.  Columns of those names are replaced, others
    stay.  A null source is a source of its own; a null text has no words and
    is taken 0 times; without words every target is 0.  The order depends on the
    seed and the ids alone; rows of one id follow each other by size and share
    a range.  Runs small jobs for the totals per source, which are written.
    """
    out = ["size", "source_size", "target", "start", "taken"]
    length = col(size).cast("bigint") if size else word_count(col(text))
    # Inner names cannot meet those of the table: its columns ride in one struct.
    rows = df.select(F.struct(*[col(c) for c in clear_of(df, out).columns]).alias("_row"), col(source).alias("_source"),
                     col(row_id).alias("_id"), random_key(row_id, seed).alias("_key"), F.coalesce(length, F.lit(0)).alias("size"))
    rows = rows.withColumn("_name", F.when(F.col("_source").isNull(), "").otherwise(F.concat(F.lit("s"), F.col("_source").cast("string"))))
    per_source = rows.groupBy("_name", "_source").agg(F.count("*").alias("_rows"), F.sum("size").alias("source_size"))
    sources = written(weights_in_turn(per_source, "_source", weights), "sources")
    plan = written(with_targets(sources, most_passes).select(
        "_name", "source_size", "target", "_budget", F.ceil(F.col("_rows") / range_rows).cast("bigint").alias("_ranges")), "targets")
    dealt = join_summary(rows, plan, ["_name"]).withColumn(
        "_range", F.expr(f"_key div ({1 << KEY_BITS}L div _ranges + 1)"))
    slots = ["_name", "_range"]
    earlier = Window.partitionBy("_name").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy(*slots).agg(F.sum("size").alias("_words")).select(
        *slots, F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*slots).orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = join_summary(dealt.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))), before, slots)
    start = F.col("_before") + F.col("_inside")
    passes = F.expr("coalesce(_budget div nullif(source_size, 0), 0)")
    rest = F.col("_budget") - passes * F.col("source_size")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return placed.select("_row.*", "size", "source_size", "target", start.alias("start"), taken.cast("bigint").alias("taken"))


def mixed_texts(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The texts that the mix holds, one row per pass of a text with ``pass_no``
    from 0: whole texts as they are, and in a partial pass its first words,
    joined by a space.  Rows of which nothing is taken are left out."""
    again = F.sequence(F.lit(0), F.expr("cast((taken - 1) div size as int)"))
    each = mixed.where((F.col("taken") > 0) & (F.col("size") > 0)).withColumn("pass_no", F.explode(again))
    n = F.least(F.col("size"), F.col("taken") - F.col("pass_no") * F.col("size"))
    part = F.array_join(F.slice(words(col(text)), F.lit(1), n.cast("int")), " ")
    return each.withColumn(text, F.when(n == F.col("size"), col(text)).otherwise(part))
