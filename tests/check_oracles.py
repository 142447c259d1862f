"""Run registered queries next to their oracle SQL and compare the rows.

Usage: python tests/check_oracles.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6))
    if isinstance(value, decimal.Decimal):
        return f"dec:{value}"
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return repr(value)
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in value.items()) + "}"
    if isinstance(value, (list, tuple)):
        if hasattr(value, "asDict"):
            return plain(value.asDict())
        return "[" + ",".join(plain(v) for v in value) + "]"
    return repr(value)


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def oracle_rows(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return columns, cursor.fetchall()


def compare(spark, con, sf_dir, query, sql):
    """None when equal, else a short description of the difference."""
    df = query(spark, sf_dir)
    got_columns, got = normalized(df.columns, [tuple(r) for r in df.collect()])
    want_columns, want = normalized(*oracle_rows(con, sql))
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}", len(got)
    if got != want:
        only_got = [r for r in got if r not in set(want)][:2]
        only_want = [r for r in want if r not in set(got)][:2]
        return f"{len(got)} rows vs {len(want)}; only ours {only_got}; only oracle {only_want}", len(got)
    return None, len(got)


def main():
    import __spark_entry__ as entry
    from hallkeeper.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    prefixes = tuple(sys.argv[2:])
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem, rows = compare(spark, con, sf_dir, query, oracles[name])
            else:
                problem, rows = None, len(query(spark, sf_dir).collect())
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            problem, rows = f"{type(error).__name__}: {str(error)[:600]}", -1
        bad += problem is not None
        mark = "ok  " if problem is None else "BAD "
        kind = "" if name in oracles else " (rows only)"
        print(f"{mark}{name}{kind}: {rows} rows, {time.time() - start:.2f}s" + (f"\n     {problem}" if problem else ""), flush=True)
    unknown = set(oracles) - set(queries)
    print(f"{bad} bad; oracles without query: {sorted(unknown)}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
