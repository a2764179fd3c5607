import random

import pytest
from pyspark.sql import functions as F

from tamarisk.operators import store
from tamarisk.operators.components import connected_components
from tamarisk.plans.materialise import numbered

DOC = "doc_id long, source string, ext_id string, title string, abstract string, cited_by int, pmid string"


def test_upsert_documents(spark):
    old = spark.createDataFrame([(5, "MED", "1", "a", "abs", 1, "p"), (7, "MED", "2", "b", None, 2, "q")], DOC)
    new = spark.createDataFrame(
        [("MED", "1", "a2", None, 9, "zz", 1), ("PPR", "9", "n", "x", 0, None, 2), ("PPR", "9", "n2", "y", 3, None, 3), ("AGR", "3", "m", None, 1, None, 1)],
        "source string, ext_id string, title string, abstract string, cited_by int, pmid string, arrived int")
    got = {r.doc_id: tuple(r)[1:] for r in store.upsert_documents(old, new, "arrived").collect()}
    assert got == {
        5: ("MED", "1", "a2", "abs", 9, "p"), 7: ("MED", "2", "b", None, 2, "q"),
        8: ("AGR", "3", "m", None, 1, None), 9: ("PPR", "9", "n2", "y", 3, None)}
    first = store.upsert_documents(old.where("false"), new, "arrived")
    assert sorted(r.doc_id for r in first.collect()) == [1, 2, 3]


def test_insert_ignore_and_labels(spark):
    have = spark.createDataFrame([(1, 0, "s", "old")], "doc_id long, ordinal int, section string, text string")
    more = spark.createDataFrame([(1, 0, "s", "new"), (1, 1, "s", "x"), (1, 1, "s", "w")], have.schema)
    assert sorted(tuple(r) for r in store.insert_passages(have, more).collect()) == [(1, 0, "s", "old"), (1, 1, "s", "w")]
    lab = spark.createDataFrame([(1, 1, 1)], "query_id long, doc_id long, relevance int")
    new = spark.createDataFrame([(1, 1, 3), (1, 1, 2), (2, 1, 0)], lab.schema)
    assert sorted(tuple(r) for r in store.upsert_labels(lab, new, True).collect()) == [(1, 1, 3), (2, 1, 0)]
    assert sorted(tuple(r) for r in store.upsert_labels(lab, new, False).collect()) == [(1, 1, 1), (2, 1, 0)]
    ctx = spark.createDataFrame([(1, 2, "t"), (1, 2, "t"), (1, 2, "u")], "citing_doc_id long, cited_doc_id long, context_text string")
    assert store.insert_contexts(ctx.where("false"), ctx).count() == 2


def test_delete(spark):
    docs = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "doc_id long, canonical_doc_id long")
    ps = spark.createDataFrame([(10, 1), (11, 2)], "passage_id long, doc_id long")
    cs = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "citing_doc_id long, cited_doc_id long")
    out = store.delete_documents(spark.createDataFrame([(1,)], "doc_id long"), docs, passages=ps, contexts=cs)
    assert sorted(tuple(r) for r in out["documents"].collect()) == [(2, None), (3, 2)]
    assert [r.passage_id for r in out["passages"].collect()] == [11]
    assert [tuple(r) for r in out["contexts"].collect()] == [(2, 3)]


def test_publish_replaces_what_it_reads(spark, tmp_path):
    path = str(tmp_path / "t")
    assert store.publish(spark.range(3), path).count() == 3
    assert [r.id for r in store.publish(store.VersionedTable(spark, path).read().where("id > 1"), path).collect()] == [2]


def test_queries_and_log(spark):
    have = spark.createDataFrame([(5, "a", "citation", "train"), (6, "b", "manual", "dev")], "query_id long, query_text string, origin string, split string")
    new = spark.createDataFrame([("a", "test"), ("d", "test"), ("c", "train"), (None, "test"), ("c", "train")], "query_text string, split string")
    key = lambda df: sorted(tuple(r) for r in df.select("query_id", "query_text", "origin", "split").collect())
    derived, ids = store.upsert_queries(have, new, judged=False)
    assert key(derived) == [(5, "a", "citation", "test"), (6, "b", "manual", "dev"), (7, "c", "citation", "train"), (8, "d", "citation", "test")]
    assert {r.query_text: r.query_id for r in ids.collect()} == {"a": 5, "c": 7, "d": 8}
    judged, _ = store.upsert_queries(have, new.limit(1), judged=True)
    assert key(judged)[0] == (5, "a", "manual", "test")
    assert store.upsert_queries(have.where("false"), new.where("false"), True)[0].count() == 0
    log = spark.createDataFrame([("q", 1, "2024-01-01"), ("q", 2, "2024-01-02"), ("r", 9, "2024-01-01")], "query string, n_docs int, at string").select(
        "query", "n_docs", F.to_timestamp("at").alias("fetched_at"))
    more = log.where("query = 'r'").withColumn("n_docs", F.lit(3))
    assert sorted((r.query, r.n_docs) for r in store.upsert_log(log, more).collect()) == [("q", 2), ("r", 3)]



def test_numbering(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 1), (None, 0)], "s string, e int")
    assert [(r.s, r.e, r.n) for r in numbered(df, ["s", "e"], 4).orderBy("n").collect()] == [(None, 0, 4), ("a", 1, 5), ("a", 2, 6), ("b", 1, 7)]
    many = numbered(spark.range(1000).repartition(7), ["id"])
    assert all(r.id == r.n for r in many.collect())
    assert numbered(df.where("false"), ["s"]).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 160)] + [(500, j) for j in range(501, 560)]
    edges += [(7, 7), (None, 3), (3, None)]
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long").withColumn("node", F.lit(1))
    assert {r.node: r.component for r in connected_components(df, "a", "b").collect()} == {x: find(x) for x in up}
    assert connected_components(df.where("false"), "a", "b").count() == 0
