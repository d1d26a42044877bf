"""Runs a query and its SQL on the same tables and compares rows as multisets."""

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v if not isinstance(v, (list, dict)) else str(v)


def sql_rows(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(_plain(r[i]) for i in order) for r in cur.fetchall())


def spark_rows(frame):
    names = sorted(frame.columns)
    return names, Counter(tuple(_plain(v) for v in r) for r in frame.select(*names).collect())


def differences(spark, sf_dir, query, sql):
    names, got = spark_rows(query(spark, sf_dir))
    wanted_names, want = sql_rows(sf_dir, sql)
    if names != wanted_names:
        return f"columns {names} and {wanted_names}"
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:3]}; only in SQL {list((want - got).items())[:3]}"
    return ""
