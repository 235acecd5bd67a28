"""Compares a query with its SQL on the same Parquet tables, without regard to row order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def assert_same(spark, sf, query, sql):
    df = query(spark, sf)
    columns = sorted(df.columns)
    ours = sorted((tuple(r) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=repr)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)
    assert len(ours) == len(theirs)
    assert [repr(r) for r in ours] == [repr(r) for r in theirs]
