"""Rows of a query and of its SQL in one form."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") if math.isfinite(v) else str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v).replace(" 00:00:00", "") if hasattr(v, "isoformat") else v


def rows_of(records, names):
    at = [names.index(c) for c in sorted(names)]
    return sorted((tuple(plain(r[i]) for i in at) for r in records), key=lambda r: tuple((x is None, str(x)) for x in r))


def duck(sf, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    c = con.execute(sql)
    names = [d[0] for d in c.description]
    return names, rows_of(c.fetchall(), names)


def same(df, sf, sql):
    names, expected = duck(sf, sql)
    assert sorted(df.columns) == sorted(names)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    assert len(got) == len(expected)
    assert got == expected, [x for x in got if x not in expected][:3]
