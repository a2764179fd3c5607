"""Every pN query runs over the smallest tables; those with SQL agree with it."""

import os

import duckdb
import pytest

from tamarisk.llm import queries as llm

D = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": {"query_id_a", "query_id_b"}, "p2_found": {"passage_id_a", "passage_id_b"}, "p3_found": {"group_id", "doc_id", "doi"},
    "p4_found": {"item_field", "item_id", "cut"}, "p5_found": {"group_id", "query_id"}, "p6_found": {"lexeme", "mark"},
    "p7_found": {"doc_id_a", "doc_id_b"}, "p8_ids": {"doc_id", "ids"}, "p10_found": {"doc_id"},
}


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query(spark, name):
    df = llm.queries()[name](spark, D)
    rows = [tuple(r) for r in df.collect()]
    assert set(df.columns) == COLUMNS.get(name, set(df.columns)) and (rows or name in ("p5_found", "p10_found"))  # these tables have no such case
    if name in llm.oracle_sql():
        con = duckdb.connect()
        con.execute("set timezone='UTC'")
        for f in os.listdir(D):
            con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{D}/{f}'")
        cur = con.execute(llm.oracle_sql()[name])
        order = [[c[0] for c in cur.description].index(c) for c in df.columns]
        assert sorted(rows) == sorted(tuple(r[i] for i in order) for r in cur.fetchall())


def test_changed_counts_are_the_full_counts(spark):
    rows = lambda name: sorted(tuple(r) for r in llm.queries()[name](spark, D).collect())
    assert rows("p6_after_changes") == rows("p6_lexeme_df")
