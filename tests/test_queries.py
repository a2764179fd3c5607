"""Every core query against its SQL on DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

from tamarisk import queries as core

D = "/root/testdata/sf0.001"
SQL = core.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(D):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{D}/{f}'")
    return con


def rows(cols, table):
    order = sorted(cols)
    ix = [cols.index(c) for c in order]
    return order, sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in ix) for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = core.queries()[name](spark, D)
    cur = duck.execute(SQL[name])
    want = rows([c[0] for c in cur.description], cur.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want


def test_limits_commute():
    assert SQL["join_before_limit"] == SQL["join_after_limit"]


def test_every_query_is_registered():
    assert set(SQL) <= set(core.queries())
    assert set(core.queries()) - set(SQL) == {
        "hybrid_rerank", "ablation_all_arms", "ann_lsh", "embedded_passages", "stemmed_lexemes"}
