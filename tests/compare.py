"""Compares every query that has SQL with what DuckDB makes of it: python tests/compare.py [names]."""

from __future__ import annotations

import math
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None:
        return None
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if hasattr(x, "tolist"):
        return str(x.tolist())
    return x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([cell(r[k]) for k in order] for r in found), key=repr)


def difference(spark, name, query, sql, sf_dir) -> str | None:
    """None if both give the same, else what differs."""
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    result = connection.execute(sql)
    theirs_columns = [d[0] for d in result.description]
    theirs = rows(theirs_columns, result.fetchall())
    df = query(spark, sf_dir)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(df.columns) != sorted(theirs_columns):
        return f"columns {sorted(df.columns)} and {sorted(theirs_columns)}"
    if ours == theirs:
        return None
    first = next(((a, b) for a, b in zip(ours, theirs) if a != b), None)
    return f"{len(ours)} and {len(theirs)} rows; first difference {str(first)[:600]}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from scriptorium.session import session

    spark = session("local[4]", spark__ui__enabled="false", spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false", spark__driver__memory="6g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in sys.argv[1:] or sorted(sql):
        try:
            print(name, difference(spark, name, queries[name], sql[name], os.environ.get("SF_DIR", "/root/testdata/sf0.001")) or "same", flush=True)
        except Exception as e:
            print(name, "ERROR", str(e)[:700], flush=True)
