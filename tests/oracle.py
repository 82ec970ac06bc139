"""Runs a query on Spark and its SQL on DuckDB and compares the rows."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings chunks copy_groups backend_chunks "
    "loaded_documents sources chunk_vectors split_limits pack_capacities mix_targets name_list"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return c


def cell(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(cell(y) for y in x)
    return x if isinstance(x, (str, bytes)) else (int(x) if isinstance(x, bool) else x)


def rows(columns, data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in data)


def compare(spark, name: str, query, sql: str, folder: str) -> tuple[Counter, Counter, list, list]:
    df = query(spark, folder)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck(folder).execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows(names, cur.fetchall())
    return mine, theirs, sorted(df.columns), sorted(names)


if __name__ == "__main__":
    import time

    root = Path(__file__).resolve().parent.parent
    sys.path.insert(0, str(root))
    import __spark_entry__ as entry
    from granary.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    folder = sys.argv[1]
    wanted = sys.argv[2:] or list(entry.queries())
    for n in wanted:
        began = time.time()
        try:
            if n not in entry.oracle_sql():
                df = entry.queries()[n](spark, folder)
                print(f"{n}: rows only {df.count()} {time.time() - began:.1f}s")
                continue
            a, b, ca, cb = compare(spark, n, entry.queries()[n], entry.oracle_sql()[n], folder)
            ok = a == b and ca == cb
            print(f"{n}: {'ok' if ok else 'DIFFERS'} {sum(a.values())} {sum(b.values())} {time.time() - began:.1f}s")
            if not ok:
                print("  columns", ca, cb, "\n  only spark", list((a - b).items())[:3], "\n  only sql", list((b - a).items())[:3])
        except Exception as e:  # noqa: BLE001
            print(f"{n}: FAILED {str(e)[:700]}")
