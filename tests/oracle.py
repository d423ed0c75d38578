"""Runs a query and its SQL over the same tables and compares columns and rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


def assert_same(spark, folder, query, sql):
    got = query(spark, folder)
    con = connect(folder)
    want = con.execute(sql)
    names, rows = [d[0] for d in want.description], want.fetchall()
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, rows)
