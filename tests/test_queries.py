"""Every query with SQL against DuckDB on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"


def plain(v):
    import datetime as dt

    if isinstance(v, float):
        return round(v, 4) + 0.0
    if isinstance(v, dt.datetime) and v.tzinfo:
        return v.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_all_against_sql(spark):
    from pyspark.sql import functions as F

    from loomstone import plans

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    wrong = []
    for name, sql in plans.oracle_sql().items():
        df = plans.queries()[name](spark, DATA)
        order = sorted(df.columns)
        rel = con.sql(sql)
        assert sorted(rel.columns) == order, name
        types = dict(zip(rel.columns, map(str, rel.types)))
        cols = ", ".join(f"{c} AT TIME ZONE 'UTC' AS {c}" if "TIME ZONE" in types[c] else c for c in order)
        want = con.sql(f"SELECT {cols} FROM ({sql})").fetchall()
        kinds = dict(df.dtypes)
        got = df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if kinds[c] == "timestamp" else F.col(c) for c in order]).collect()
        a, b = (sorted((tuple(map(plain, r)) for r in rows), key=str) for rows in (got, want))
        if a != b:
            wrong.append(name)
    assert not wrong


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_all_over_empty_and_null_tables(spark, odd_tables):
    from loomstone import plans

    for kind, folder in odd_tables.items():
        for name, query in plans.queries().items():
            rows = query(spark, folder).collect()
            assert kind == "null" or len(rows) <= 13, name
