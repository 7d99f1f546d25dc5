"""Runs a query in Spark and its SQL in DuckDB and compares rows as multisets."""

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def difference(df, con, sql):
    """(Spark rows missing in SQL, SQL rows missing in Spark, names that differ)."""
    names = sorted(df.columns)
    ours = Counter(tuple(norm(r[c]) for c in names) for r in df.collect())
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    theirs = Counter(tuple(norm(r[cols.index(c)]) for c in names) for r in cur.fetchall()) if sorted(cols) == names else Counter()
    return list((ours - theirs).items()), list((theirs - ours).items()), sorted(set(names) ^ set(cols))
