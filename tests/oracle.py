"""Compares queries with their SQL in DuckDB over the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "NULL"
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return f"{float(x) + 0.0:.6g}"
    return str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def differences(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    got, expected = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, want.fetchall())
    if got == expected:
        return None if got else "no rows"
    only = [r for r in got if r not in set(expected)][:3], [r for r in expected if r not in set(got)][:3]
    return f"{len(got)} and {len(expected)} rows; {sorted(df.columns)}: only here {only[0]}, only in SQL {only[1]}"
