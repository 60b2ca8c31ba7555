"""Column helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

#: Characters between words: space and the five ASCII line and tab controls.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used.

    A lambda variable holds the value; a plain alias could be put back into
    the lambdas of later expressions and then be computed for each element.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text; none for a null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def running_sums(values: Column, block: int = 256) -> Column:
    """Running sums of an array of whole numbers, in blocks, so that a very
    long array costs ``n * block / 2`` additions and not ``n * n / 2``."""
    zero = F.lit(0).cast("bigint")

    def total(a):
        return F.aggregate(a, zero, lambda s, v: s + v)

    def per_block(v):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")),
                             lambda b: total(F.slice(v, b * block + 1, block)))
        return let(blocks, lambda sums: let(
            F.transform(F.sequence(F.lit(0), F.size(sums) - 1),
                        lambda b: F.when(b == 0, zero).otherwise(total(F.slice(sums, 1, b)))),
            lambda offsets: F.transform(v, lambda _, i: F.get(offsets, F.floor(i / block).cast("int")) + total(
                F.slice(v, (F.floor(i / block) * block + 1).cast("int"), (i % block + 1).cast("int"))))))

    return F.when(F.size(values) > 0, let(values, per_block)).otherwise(F.array().cast("array<bigint>"))


def pieces_and_matches(text: Column, pattern: str, body: Callable[[Column, Column], Column]) -> Column:
    """``body(pieces, matches)`` of a text cut by a pattern that never matches
    nothing: one piece more than matches."""
    return let(F.split(text, pattern, -1), lambda pieces: let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: body(pieces, found)))


def interleave(pieces: Column, between: Column) -> Column:
    """The text of pieces with a string after each but the last."""
    return F.array_join(F.flatten(F.zip_with(pieces, between, lambda p, m: F.array(p, F.coalesce(m, F.lit(""))))), "")


def clear_of(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without columns whose names an operator is about to add."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def set_apart(df: DataFrame) -> tuple[DataFrame, Callable[[str], str], dict[str, Column]]:
    """``df`` with its columns under names that an operator's own columns cannot
    meet, the inner name of an old one, and the columns that restore the old
    names, in order."""
    inner = [f"in_{i}" for i in range(len(df.columns))]
    at = {c.lower(): n for c, n in zip(df.columns, inner)}
    return df.toDF(*inner), lambda c: at[c.lower()], {c: F.col(n).alias(c) for c, n in zip(df.columns, inner)}
