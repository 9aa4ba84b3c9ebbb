"""Run registered queries against their DuckDB oracle: ``python tests/compare.py [prefix ...]``."""

from __future__ import annotations

import os
import signal
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str = SF):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def kind(s: pd.Series) -> str:
    v = s.dropna()
    if not len(v):
        return "empty"
    if pd.api.types.is_bool_dtype(s) or (len(v) and all(isinstance(x, bool) for x in v.head(20))):
        return "bool"
    if pd.api.types.is_integer_dtype(s):
        return "int"
    if pd.api.types.is_float_dtype(s):
        return "float"
    return "other"


def norm(v) -> str:
    if v is None or v is pd.NA or (isinstance(v, float) and v != v) or v is pd.NaT:
        return "~"
    if isinstance(v, bool):
        return str(v)
    try:
        f = float(v)
        return f"{f + 0.0:.6f}".replace("-0.000000", "0.000000")
    except (TypeError, ValueError):
        return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(norm(v) for v in r) for r in df.astype(object).itertuples(index=False, name=None))


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for c in got.columns:
        a, b = kind(got[c]), kind(want[c])
        if a != b and "empty" not in (a, b):
            return f"type of {c}: {a} != {b}"
    a, b = rows(got), rows(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first {bad[0][0]} != {bad[0][1]}" if bad else None


def main(prefixes: list[str]) -> int:
    import __spark_entry__ as entry
    from ledgerloom.session import local_session

    spark = local_session()
    con = connect()
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0

    def late(*_):
        raise TimeoutError("too slow")

    signal.signal(signal.SIGALRM, late)
    for name, fn in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        signal.alarm(int(os.environ.get("QUERY_SECONDS", "60")))
        try:
            got = fn(spark, SF).toPandas()
            took = time.time() - start
            if name in oracles:
                diff = difference(got, con.execute(oracles[name]).df())
            else:
                diff = None if len(got) else "no rows"
        except Exception as e:  # report and go on with the next query
            took, diff, got = time.time() - start, f"{type(e).__name__}: {str(e)[:600]}", []
            spark.sparkContext.cancelAllJobs()
        signal.alarm(0)
        failed += diff is not None
        mark = "ok  " if diff is None else "FAIL"
        print(f"{mark} {name} rows={len(got)} {took:.2f}s{'' if name in oracles else ' (rows only)'} {diff or ''}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
