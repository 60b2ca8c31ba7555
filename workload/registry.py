"""Registry of queries, output normalization and SQL assembly."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under a name, with its SQL if there is one."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: whole numbers as bigint, fractions rounded to 6
    places (adding 0.0 turns -0.0 into 0.0), dates as text, helpers dropped."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name.startswith("_"):
            continue
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        out.append(c.alias(f.name))
    return df.select(*out)


# ---- SQL side ----------------------------------------------------------------

def r6(x: str) -> str:
    return f"(ROUND(CAST({x} AS DOUBLE), 6) + 0.0)"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def with_(parts: Sequence[tuple[str, str]], body: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in parts) + "\n" + body
