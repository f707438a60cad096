"""Compare registered queries with their SQL: python tests/check_queries.py [folder] [name ...]."""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from faultline.session import local_session  # noqa: E402


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object and len(df) and not df[c].map(lambda x: isinstance(x, str) or x is None).all():
            df[c] = pd.to_numeric(df[c])
        if pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(float) + 0.0
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(name: str, spark, con, folder: str) -> str:
    began = time.monotonic()
    ours = entry.queries()[name](spark, folder).toPandas()
    spent = time.monotonic() - began
    statement = entry.oracle_sql().get(name)
    if statement is None:
        return f"rows {len(ours)} ({spent:.1f}s)"
    began = time.monotonic()
    theirs = con.sql(statement).df()
    theirs_spent = time.monotonic() - began
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"COLUMNS {sorted(ours.columns)} / {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"ROWS {len(ours)} / {len(theirs)}"
    a, b = normal(ours), normal(theirs)
    wrong = [c for c in a.columns if not a[c].equals(b[c])]
    if wrong:
        at = [(c, int((~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))).sum())) for c in wrong]
        return f"VALUES {at[:6]}"
    return f"ok {len(ours)} ({spent:.1f}s / {theirs_spent:.1f}s)"


def connection(folder: str):
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(entry.queries())
    spark, con = local_session(8), connection(folder)
    for name in chosen:
        try:
            verdict = compare(name, spark, con, folder)
        except Exception as e:  # report and go on to the next query
            verdict = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        print(f"{name:32s} {verdict}", flush=True)
