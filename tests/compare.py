"""Row-by-row comparison of a Spark result with DuckDB on the same tables."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def shown(x) -> str:
    if isinstance(x, (list, np.ndarray)):
        return "[" + ",".join(map(shown, x)) + "]"
    if x is None or x is pd.NA or isinstance(x, float) and np.isnan(x):
        return "null"
    if isinstance(x, (bool, np.bool_, int, np.integer, float, np.floating)):
        return repr(round(float(x), 5) + 0.0)
    return str(x)


def rows(frame: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(shown, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))
