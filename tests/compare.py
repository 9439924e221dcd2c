"""Compare registered queries with their check SQL.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def difference(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    """None when schema names, rows and values agree, otherwise a short description."""
    df = fn(spark, sf_dir)
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} <> {sorted(rel.columns)}"
    got = rows_of(df.columns, df.collect())
    want = rows_of(rel.columns, rel.fetchall())
    if got != want:
        return (
            f"{sum(got.values())} rows against {sum(want.values())}; columns {sorted(df.columns)}; "
            f"only here {list((got - want).items())[:3]}; only expected {list((want - got).items())[:3]}"
        )
    return None


if __name__ == "__main__":
    from chartloom.plans import CHECK_SQL, QUERIES
    from chartloom.session import build_session

    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    chosen = sys.argv[2:] or list(QUERIES)
    session = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    connection = connect(directory)
    failed = 0
    for key in chosen:
        start = time.time()
        try:
            if key in CHECK_SQL:
                found = difference(session, connection, QUERIES[key], CHECK_SQL[key], directory)
            else:
                found = None
                print(key, "rows", QUERIES[key](session, directory).count())
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        failed += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {key} {time.time() - start:.1f}s {found or ''}", flush=True)
    print("failed:", failed, "of", len(chosen))
