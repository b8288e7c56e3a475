"""Comparison of a query's rows with those of its SQL oracle in DuckDB."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*')" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return c


def _text(v):
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return "null"
    if isinstance(v, pd.Timestamp) or hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if isinstance(v, (bool,)) or type(v).__name__ == "bool_":
        return str(bool(v))
    try:
        return f"{float(v):.9g}" if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted(tuple(_text(v) for v in r) for r in df.itertuples(index=False, name=None))


def assert_same(got, want):
    a, b = rows(got), rows(want)
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    wrong = [(x, y) for x, y in zip(a[1], b[1], strict=True) if x != y]
    assert not wrong, wrong[:3]
