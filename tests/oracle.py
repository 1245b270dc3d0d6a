"""Compares a query with its SQL over the same tables."""

import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if hasattr(x, "asDict"):
        return tuple(plain(v) for v in x)
    if isinstance(x, list | tuple):
        return tuple(plain(v) for v in x)
    return str(x) if x is not None and not isinstance(x, bool | int | str) else x


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def check(spark, query, sql, sf_dir=DATA):
    frame = query(spark, sf_dir)
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    asked = con.execute(sql)
    names = [c[0] for c in asked.description]
    assert sorted(names) == sorted(frame.columns)
    assert rows(frame.columns, frame.collect()) == rows(names, asked.fetchall())
