"""Compare registered queries with their SQL forms in DuckDB.

python tests/oracle_check.py [sf dir] [name part ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

ROOT = Path(__file__).resolve().parent.parent
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype)[:3] in ("Int", "UIn", "Flo", "boo") and df[c].isna().any():  # nullable numbers
            df[c] = df[c].astype(object).where(df[c].notna(), None).astype(float)
        elif df[c].dtype.kind == "f" or (len(df) and type(df[c].iloc[0]).__name__ == "Decimal"):
            df[c] = df[c].astype(float)
        elif df[c].dtype.kind in "iub":
            df[c] = df[c].astype("int64")
        else:
            df[c] = df[c].map(lambda v: v if v is None or isinstance(v, (int, float)) else str(v))
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def compare(ours: pd.DataFrame, theirs: pd.DataFrame) -> str:
    """Empty when equal to the last bit after sorting rows and columns."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    a, b = canonical(ours), canonical(theirs)
    for c in a.columns:
        if a[c].dtype.kind != b[c].dtype.kind:
            return f"column {c}: type {a[c].dtype} / {b[c].dtype}"
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = int(np.argmin(same.to_numpy()))
            return f"column {c} differs in {int((~same).sum())} of {len(a)} rows: {a.iloc[i].to_dict()} / {b.iloc[i].to_dict()}"
    return ""


def check(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[str, float, float, int]:
    start = time.time()
    ours = fn(spark, sf_dir).toPandas()
    spent = time.time() - start
    if sql is None:
        return ("" if len(ours) else "no rows"), spent, 0.0, len(ours)
    start = time.time()
    theirs = con.execute(sql).df()
    return compare(ours, theirs), spent, time.time() - start, len(ours)


def main() -> None:
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry
    from bench import session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark, con = session(), connect(sf_dir)
    sql = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if args and not any(a in name for a in args):
            continue
        try:
            problem, ours, theirs, n = check(spark, con, name, fn, sql.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            problem, ours, theirs, n = f"{type(e).__name__}: {str(e)[:1500]}", 0.0, 0.0, 0
        bad += bool(problem)
        kind = "sql" if name in sql else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} {kind} n={n} spark {ours:.1f}s duckdb {theirs:.1f}s {problem}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
