"""Rows of a Spark frame against those of a SQL query in DuckDB."""

import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return c


def plain(v):
    if v is None or v != v:
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([columns[k] for k in order] for _ in (0,)), sorted(tuple(plain(r[k]) for k in order) for r in values)


def same(frame, sql, connection):
    found = connection.execute(sql)
    theirs = rows([d[0] for d in found.description], found.fetchall())
    ours = rows(frame.columns, [tuple(r) for r in frame.collect()])
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    assert ours[1] == theirs[1]
    return len(ours[1])
