"""Run registered queries against their DuckDB oracles the way the driver does (counts, names, values)."""

from __future__ import annotations

import math
import sys
import time

import os
import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from cadence.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _sort_key(r):
    return tuple((x is None, f"{x:.3f}" if isinstance(x, float) else str(x)) for x in r)


def frame_rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None)]
    return sorted(rows, key=_sort_key)


def _same(x, y) -> bool:
    if isinstance(x, float) and isinstance(y, (int, float)) and not isinstance(y, bool):
        return round(x, 6) == round(y, 6)
    if isinstance(x, tuple) and isinstance(y, tuple):
        return len(x) == len(y) and all(_same(a, b) for a, b in zip(x, y))
    return x == y


def compare(spark_df: pd.DataFrame, oracle_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(oracle_df.columns):
        return f"columns differ: {sorted(spark_df.columns)} vs {sorted(oracle_df.columns)}"
    if len(spark_df) != len(oracle_df):
        return f"row count {len(spark_df)} vs {len(oracle_df)}"
    a, b = frame_rows(spark_df), frame_rows(oracle_df)
    for i, (x, y) in enumerate(zip(a, b)):
        if not all(_same(p, q) for p, q in zip(x, y)):
            return f"row {i} differs: {x} vs {y}"
    return None


def run(names: list[str] | None, sf_dir: str) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from cadence.session import build_session

    spark = build_session()
    qs, oracles = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or list(qs):
        t = time.time()
        try:
            got = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:3000]}")
            bad += 1
            continue
        ts = time.time() - t
        if name not in oracles:
            print(f"rows {name}: {len(got)} rows, {ts:.1f}s (no oracle)")
            continue
        try:
            exp = con.execute(oracles[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: oracle error {str(e)[:400]}")
            bad += 1
            continue
        msg = compare(got, exp)
        print(("ok   " if msg is None else "FAIL ") + f"{name}: {len(got)} rows, {ts:.1f}s" + ("" if msg is None else f" -- {msg}"))
        bad += msg is not None
    return bad


if __name__ == "__main__":
    sf = "/root/testdata/sf0.01"
    args = sys.argv[1:]
    if args and args[0].startswith("/"):
        sf, args = args[0], args[1:]
    sys.exit(1 if run(args or None, sf) else 0)
