"""Comparison of a query with its SQL in DuckDB."""

import decimal
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal, int)):
        return float(f"{float(value):.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return str(value)


def oracle_rows(sf: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), Counter(tuple(plain(row[i]) for i in order) for row in found.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(row[n]) for n in names) for row in df.collect())


def assert_same(df, sf: str, sql: str) -> None:
    names, want = oracle_rows(sf, sql)
    own, got = spark_rows(df)
    assert own == names
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
