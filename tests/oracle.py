"""Runs a query and its DuckDB text side by side."""

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def both(query, sql, spark, sf):
    frame = query(spark, sf)
    columns = sorted(frame.columns)
    rows = Counter(tuple(plain(v) for v in r) for r in frame.select(*[f"`{c}`" for c in columns]).collect())
    with duckdb.connect() as db:
        db.execute("SET timezone = 'UTC'")
        for t in TABLES:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        found = db.execute(sql)
        names = [c[0] for c in found.description]
        told = found.fetchall()
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    return rows, Counter(tuple(plain(r[i]) for i in order) for r in told)
