"""Run registered queries next to their SQL in DuckDB and compare the rows.

    python -m workload.check [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _text(v) -> str:
    if v is None or v != v:
        return "NULL"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return repr(v)
    return f"{type(v).__name__}:{v}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_text(r[i]) for i in order) for r in rows)


def row_by_row_joins(df) -> list[str]:
    """Joins in the plan that would meet every row with every row."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip()[:200] for line in plan.splitlines()
            if "CartesianProduct" in line or "BroadcastNestedLoopJoin" in line]


def compare(con, df, sql: str) -> str:
    """Empty if both agree, else what differs."""
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} != {len(theirs[1])}: {mine[1][:2]} {theirs[1][:2]}"
    bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    return f"{len(bad)} of {len(mine[1])} rows differ, e.g. {bad[0]}" if bad else ""


def main():
    from cohortlens.session import build_session
    from workload import ORACLE, QUERIES

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    failed = 0
    for name, run in QUERIES.items():
        if args.names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in args.names):
            continue
        start = time.time()
        try:
            if name in ORACLE:
                problem = compare(con, run(spark, args.sf), ORACLE[name])
            else:
                problem = "" if len(run(spark, args.sf).collect()) else "no rows"
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} {time.time() - start:6.2f}s "
              f"{'sql' if name in ORACLE else 'rows'} {problem}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
