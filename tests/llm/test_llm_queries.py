"""The queries of this package run over the smallest tables; those with SQL are held against it."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["signal_a", "signal_b"], "p2_found": ["signal_id"], "p3_found": ["session_id", "turn_no", "uuid"], "p4_found": ["signal_id", "foreign_part"],
    "p5_found": ["place", "record_id", "item_no", "pii_kind"], "p6_found": ["first_signal_id", "signal_id"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_a", "doc_b"],
}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_queries(spark):
    import duckdb

    from loomstone.llm import queries as Q

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    for name, query in Q.queries().items():
        df = query(spark, DATA)
        if name in COLUMNS:
            assert df.columns == COLUMNS[name]
        rows = [tuple(map(str, r)) for r in df.collect()]
        if name.endswith("_found"):
            assert len(rows) == len(set(rows)), name
        if name in Q.oracle_sql():
            assert sorted(rows) == sorted(tuple(map(str, r)) for r in con.sql(Q.oracle_sql()[name]).fetchall()), name


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_queries_over_empty_and_null_tables(spark, odd_tables):
    from loomstone.llm import queries as Q

    for folder in odd_tables.values():
        for name, query in Q.queries().items():
            rows = query(spark, folder).collect()
            assert not rows or not name.endswith("_found"), name
