"""Order-insensitive comparison of a query with its SQL twin."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str(list(v))
    if v is None or pd.isna(v):
        return None
    return v if isinstance(v, (str, bool)) or type(v).__name__ == "bool_" else round(float(v), 6) + 0.0


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(str(tuple(plain(v) for v in r)) for r in df[cols].itertuples(index=False, name=None))


def twin(sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con.execute(sql).df()
