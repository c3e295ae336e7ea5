"""Comparison of a Spark result with that of its SQL."""

import math


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def sql_rows(con, sql):
    rel = con.sql(sql)
    names, at = sorted(rel.columns), {c: i for i, c in enumerate(rel.columns)}
    return names, sorted((tuple(plain(r[at[c]]) for c in names) for r in rel.fetchall()), key=repr)
