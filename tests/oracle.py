"""Compares a query's rows with those of its SQL in DuckDB over the same tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def canon(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and np.isnan(v):
        return None
    if isinstance(v, (float, np.floating)):
        return round(float(v), 6)
    if isinstance(v, (list, np.ndarray)):
        return tuple(canon(x) for x in v)
    if isinstance(v, np.integer):
        return int(v)
    if isinstance(v, np.bool_):
        return bool(v)
    if isinstance(v, pd.Timestamp):
        return v.tz_localize(None) if v.tzinfo else v
    return v


def rows_of(frame):
    cols = sorted(frame.columns)
    return cols, sorted((tuple(map(canon, r)) for r in frame[cols].itertuples(index=False)), key=repr)


def same_rows(df, sql, sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = rows_of(df.toPandas()), rows_of(con.execute(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    assert not bad, bad[:2]
