"""Run queries against their DuckDB text on the driver's tables."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{directory}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def as_bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short text."""
    mine = as_bag(df.columns, df.collect())
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    theirs = as_bag(names, got.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if mine == theirs:
        return None
    only_mine = [r for r in mine if r not in set(theirs)][:3]
    only_theirs = [r for r in theirs if r not in set(mine)][:3]
    return f"rows {len(mine)} vs {len(theirs)}; only spark {only_mine}; only sql {only_theirs}"


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from usagelens.session import build_session

    directory, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(directory)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or list(queries):
        start = time.time()
        try:
            df = queries[name](spark, directory)
            if name in oracles:
                problem = difference(df, con, oracles[name])
                count = con.execute(f"SELECT count(*) FROM ({oracles[name]})").fetchone()[0]
            else:
                problem, count = None, f"{df.count()} (no sql)"
        except Exception as e:  # report and go on with the next query
            problem, count = f"{type(e).__name__}: {str(e)[:700]}", "-"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:28s} {time.time() - start:6.2f}s rows={count} {problem or ''}", flush=True)
    print(f"{failed} failed")
