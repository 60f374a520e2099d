"""Rows of a query and of its SQL, in one comparable form."""

import datetime
import decimal
import math
import os


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return f"{round(float(v), 6) + 0.0:.6f}"
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


def duck(sql, folder):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folder):
        p = f"{folder}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    out = con.execute(sql)
    return rows([c[0] for c in out.description], out.fetchall())


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])
