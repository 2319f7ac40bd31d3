"""Compare registered queries with their SQL in DuckDB. Usage: check.py [name-prefix ...]"""

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(float)
        else:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else str(v))
    return df.sort_values(list(df.columns), ignore_index=True, na_position="last", key=lambda s: s if s.dtype == float else s.fillna("").astype(str))


def differences(a: pd.DataFrame, b: pd.DataFrame) -> str:
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(set(a.columns) ^ set(b.columns))}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    a, b = canonical(a), canonical(b)
    for c in a.columns:
        if a[c].dtype == float and b[c].dtype == float:
            bad = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        else:
            bad = a[c].fillna("\0").astype(str) != b[c].fillna("\0").astype(str)
        if bad.any():
            i = bad.idxmax()
            return f"{c}: {int(bad.sum())} differ, e.g. {a[c][i]!r} vs {b[c][i]!r} in {a.loc[i].to_dict()} / {b.loc[i].to_dict()}"
    return ""


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "10g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf = os.environ.get("SF", "/root/testdata/sf0.01")
    spark, con = session(), connect(sf)
    q, s = entry.queries(), entry.oracle_sql()
    names = [n for n in q if not sys.argv[1:] or any(n.startswith(p) for p in sys.argv[1:])]
    failed = 0
    for n in names:
        t = time.time()
        try:
            a = q[n](spark, sf).toPandas()
            took = time.time() - t
            if n in s:
                t = time.time()
                d = differences(a, con.execute(s[n]).df())
                sql = time.time() - t
                failed += bool(d)
                print(f"{'OK ' if not d else 'BAD'} {n} rows={len(a)} spark={took:.1f}s sql={sql:.1f}s {d[:700]}", flush=True)
            else:
                print(f"--- {n} rows={len(a)} spark={took:.1f}s", flush=True)
        except Exception as e:  # noqa: BLE001
            failed += 1
            print(f"ERR {n} {type(e).__name__}: {str(e)[:900]}", flush=True)
    print("failed", failed)
