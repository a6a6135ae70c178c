"""Compare named queries with their DuckDB oracles.

    python tests/compare.py [--sf DIR] [--explain] [name ...]
"""

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from traceloom.plans.lens import TABLES  # noqa: E402


def duck_connection(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(plain(v) for v in r) for r in df.select(*names).collect())


def duck_rows(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return (
        [names[i] for i in order],
        Counter(tuple(plain(r[i]) for i in order) for r in cursor.fetchall()),
    )


def difference(df, con, sql):
    """None when equal, else a short description."""
    names, left = spark_rows(df)
    duck_names, right = duck_rows(con, sql)
    if names != duck_names:
        return f"columns {names} != {duck_names}"
    if left != right:
        only_left, only_right = left - right, right - left
        return (
            f"{sum(left.values())} vs {sum(right.values())} rows; {sum(only_left.values())} differ; "
            f"spark {list(only_left)[:3]} duck {list(only_right)[:3]}"
        )
    types_left = {tuple(type(v).__name__ for v in row) for row in list(left)[:50]}
    types_right = {tuple(type(v).__name__ for v in row) for row in list(right)[:50]}
    for a, b in zip(zip(*types_left), zip(*types_right)):
        a, b = set(a) - {"NoneType"}, set(b) - {"NoneType"}
        if a and b and a != b:
            return f"types differ {a} {b} in {names}"
    return None if left else "EMPTY"


def main(argv):
    from traceloom.plans.catalog import load
    from traceloom.session import build_session

    sf_dir = "/root/testdata/sf0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf_dir = argv[at + 1]
        del argv[at : at + 2]
    explain = "--explain" in argv
    names = [a for a in argv if not a.startswith("--")]
    queries, oracles = load()
    spark = build_session(
        "compare",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck_connection(sf_dir)
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if explain:
                df.explain("formatted")
            if name in oracles:
                result = difference(df, con, oracles[name])
            else:
                result = None if df.count() else "EMPTY"
        except Exception as exc:  # noqa: BLE001
            result = f"{type(exc).__name__}: {str(exc)[:700]}"
        failed += bool(result)
        mark = "ok  " if not result else "FAIL"
        kind = "" if name in oracles else " (rows only)"
        print(f"{mark} {name}{kind} {time.time() - start:.1f}s {result or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
