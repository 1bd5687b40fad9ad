"""Rows of a Spark result and of SQL in one form, to compare."""

import math


def plain(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float | int):
        return (2, "nan" if math.isnan(v) else repr(round(float(v), 6) + 0.0))
    return (3, str(v))


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[c]) for c in names) for r in df.collect())


def sql_rows(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted(tuple(plain(r[k]) for k in order) for r in result.fetchall())
