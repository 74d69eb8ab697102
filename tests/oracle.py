"""Holds a query's rows against DuckDB's over the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def rows_of_sql(sql: str, sf_dir: str, columns: list[str]) -> list[tuple]:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    assert sorted(c.sql(sql).columns) == columns
    return c.sql(f"SELECT {', '.join(chr(34) + x + chr(34) for x in columns)} FROM ({sql})").fetchall()


def same(df, sql: str, sf_dir: str) -> None:
    columns = sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=key)
    want = sorted(rows_of_sql(sql, sf_dir, columns), key=key)
    assert len(got) == len(want)
    assert got == want
