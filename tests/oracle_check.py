"""Compare every query with its SQL in DuckDB: ``python tests/oracle_check.py [folder] [query ...]``."""

from __future__ import annotations

import pathlib
import sys
import time

import duckdb
import pandas as pd

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    """Rows with columns by name, values as text, in one order."""

    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, float):
            return f"{v:.6f}"
        return str(v.date()) if isinstance(v, pd.Timestamp) and v == v.normalize() else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(text(v) for v in row) for row in df.astype(object).itertuples(index=False))


def differences(spark_df, con, sql: str) -> list[str]:
    ours = spark_df.toPandas()
    theirs = con.execute(sql).fetchdf()
    if sorted(ours.columns) != sorted(theirs.columns):
        return [f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"]
    a, b = normal(ours), normal(theirs)
    if a == b:
        return []
    out = [f"rows {len(a)} / {len(b)}"]
    out += [f"{x} / {y}" for x, y in zip(a, b) if x != y][:3]
    return out


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tillpulse.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = local_session(8)
    con = oracle_connection(folder)
    chosen = sys.argv[2:] or list(entry.oracle_sql())
    bad = 0
    for name in chosen:
        started = time.time()
        try:
            found = differences(entry.queries()[name](spark, folder), con, entry.oracle_sql()[name])
        except Exception as e:  # noqa: BLE001
            found = [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - started:.1f}s", *found, sep="\n     " if found else " ", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} equal")
    sys.exit(bool(bad))
