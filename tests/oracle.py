"""Compares a query with its SQL the way the driver does: as bags of rows."""

import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


def rows_of(columns, rows):
    def plain(v):
        return f"{v:.6f}" if isinstance(v, float) else None if v is None else str(v)

    order = sorted(columns)
    return sorted([tuple(plain(r[c]) for c in order) for r in rows], key=str)


def same(df, con, sql):
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    want = rows_of(rel.columns, [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()])
    got = rows_of(df.columns, [r.asDict() for r in df.collect()])
    assert got == want
