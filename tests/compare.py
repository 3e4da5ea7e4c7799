"""Run a registered query and its SQL check on the same tables and compare all rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (bool, str)):
        return value
    return float(value) + 0.0


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(normal(r[i]) for i in order) for r in rows]
    body.sort(key=lambda r: tuple((v is None, str(type(v)), v) for v in r))
    return [columns[i] for i in order], body


def run_spark(spark, fn, sf_dir):
    df = fn(spark, sf_dir)
    return table(df.columns, [tuple(r) for r in df.collect()])


def run_sql(con, sql):
    con.execute(sql)
    columns = [d[0] for d in con.description]
    return table(columns, con.fetchall())


def type_differences(df, con, sql):
    """Columns whose Spark type has another name in SQL."""
    same = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER", "float": "FLOAT"}
    con.execute(f"DESCRIBE {sql}")
    kinds = {r[0]: r[1] for r in con.fetchall()}
    return {c: (t, kinds.get(c)) for c, t in df.dtypes if same.get(t, t) != kinds.get(c)}


def difference(got, want):
    """None if equal, else a short description."""
    if got[0] != want[0]:
        return f"columns {got[0]} / {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} / {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        return f"{len(bad)} of {len(got[1])} rows differ, first {bad[0]}"
    return None


def main():
    from tessera import plans
    from tessera.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = plans.queries(), plans.oracles()
    failed = 0
    for name, fn in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            got = table(df.columns, [tuple(r) for r in df.collect()])
            t1 = time.time()
            if name in oracles and (kinds := type_differences(df, con, oracles[name])):
                print(f"{name:34s} types {kinds}", flush=True)
            if name in oracles:
                want = run_sql(con, oracles[name])
                diff = difference(got, want)
                state = "ok" if diff is None else "DIFF " + diff
            else:
                state = "rows only" if got[1] else "EMPTY"
            t2 = time.time()
            print(f"{name:34s} {len(got[1]):7d} spark {t1 - t0:6.2f}s sql {t2 - t1:6.2f}s {state}", flush=True)
            failed += state not in ("ok", "rows only")
        except Exception as exc:  # report and go on with the next query
            failed += 1
            print(f"{name:34s} ERROR {type(exc).__name__} {str(exc)[:1500]}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
