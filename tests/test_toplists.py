"""Matches grow with queries times passages; what is shuffled must not."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tamarisk.config import Settings
from tamarisk.operators import arms
from tamarisk.operators.corpus import counted_statistics, lexeme_statistics, unique_passages
from tamarisk.operators.cover import cover_density
from tamarisk.operators.search import Corpus
from tamarisk.operators.toplists import Buckets, lexical_candidates

N = 3000


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """Tables in which every word is in one of 25 passages."""
    d, rng = tmp_path_factory.mktemp("crowded"), np.random.default_rng(0)
    text = lambda n: " ".join(f"w{i}" for i in rng.choice(200, n, replace=False))
    docs = pd.DataFrame({"doc_id": range(1, N // 2 + 1), "source": "MED", "title": [f"document number {i}" for i in range(N // 2)]})
    passages = pd.DataFrame({"passage_id": range(10, 10 * N + 1, 10), "doc_id": [i // 2 + 1 for i in range(N)], "ordinal": [i % 2 for i in range(N)], "section": "abstract",
                             "text": [text(8) for _ in range(N)], "embedding": list(rng.standard_normal((N, 64)).astype("float32"))})
    asked = pd.DataFrame({"query_id": range(1, 401), "query_text": [text(8) for _ in range(400)], "origin": "citation", "split": ["train"] * 300 + ["test"] * 100})
    qrels = pd.DataFrame([(q, int(x), 1) for q in range(1, 401) for x in rng.choice(N // 2, 3, replace=False) + 1], columns=["query_id", "doc_id", "relevance"])
    contexts = pd.DataFrame({"citing_doc_id": range(1, 401), "cited_doc_id": range(2, 402), "context_text": asked["query_text"]})
    for name, t in {"documents": docs, "passages": passages, "eval_queries": asked, "eval_qrels": qrels, "citation_contexts": contexts}.items():
        t.astype({c: "int32" for c in t.columns if c in ("ordinal", "relevance")}).to_parquet(f"{d}/{name}.parquet")
    return str(d)


def shuffled(spark) -> int:
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    jvm = sc._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


# Rows shuffled on these tables before, when each match was a row, and since.
@pytest.mark.parametrize(("name", "most"), [
    ("fts_negation", 40_000),  # 148,784, now 20,913
    ("fts_web_or", 40_000),  # 113,232, now 21,817
    ("fts_phrase", 15_000),  # 40,671, now 8,783
    ("fts_all_words", 15_000),  # 107,867, now 7,440
    ("fts_topk", 40_000),  # 267,020, now 24,202
    ("join_after_limit", 40_000),  # 267,020, now 24,202
    ("join_before_limit", 40_000),  # 514,039, now 24,202
    ("rrf_fuse", 250_000),  # 354,021, now 195,210
    ("rrf_weight_sweep", 1_570_000),  # 1,650,242, now 1,491,431
    ("pool_for_judging", 330_000),  # 428,991, now 270,180
    ("hard_negatives", 150_000),  # 311,807, now 94,524
    ("training_pairs", 170_000),  # 333,468, now 116,185
    ("mining_stats", 170_000),  # 335,269, now 117,986
    ("hybrid_rerank", 640_000),  # 739,683, now 541,710
    ("ablation_all_arms", 710_000),  # 810,359, now 609,386
])
def test_rows_shuffled(spark, crowded, name, most):
    before = shuffled(spark)
    queries()[name](spark, crowded).write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < most


def test_counted_statistics(spark):
    p = spark.createDataFrame([(1, "Ab ab-c 1"), (2, "c \u00c4b \u212a"), (3, None), (4, "")], "passage_id long, text string")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(counted_statistics(p)) == key(lexeme_statistics(p))
    assert counted_statistics(p.where("false")).count() == 0


TREES = ["'a' <-> 'b'", "'a' <-> 'a'", "'a' & 'b'", "'a' & 'b' & 'c'", "'a' & !'b'", "('a' | 'b') | (('c') & !'d')", "'a' | !'b'", "('a' | 'b' <-> 'c') & !( 'd' <2> 'a' )",
         "'a' & ( 'b' <-> 'c' )", "'a' <2> 'b' <-> 'c'", "'zz' & 'a'", "'b':*", "('a' | 'b':*) & !'c'", "!'a'", "'a' & ('b' | 'c' & 'd')"]


def test_trees_like_one_by_one(spark):
    """All forms of trees, by chunk and part, as by scoring each pair; ties go by id."""
    rng = np.random.default_rng(3)
    texts = {i: " ".join(rng.choice(["a", "b", "c", "d", "bb", "x"], rng.integers(0, 12))) for i in range(1, 300)}
    p = spark.createDataFrame([*texts.items(), (300, None)], "passage_id long, text string")
    plans = spark.createDataFrame([(i, t, [], []) for i, t in enumerate(TREES)], "query_id long, tree string, wanted array<string>, banned array<string>")
    for k in (5, 2**31 - 1):
        got = {}
        for r in arms.top(lexical_candidates(plans, len(TREES), p, k, prefixes=True).withColumn("score", F.round("score", 6)).where("score > 0"), k).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append((r.passage_id, r.score))
        for q, tree in enumerate(TREES):
            each = [(i, s) for i, t in texts.items() if (s := round(cover_density(tree, t.split()), 6)) > 0]
            assert got.get(q, []) == sorted(each, key=lambda x: (-x[1], x[0]))[:k], tree


def test_all_that_come_before_the_cut(spark):
    """Many words: scores that are equal once they are rounded go by id."""
    p = spark.createDataFrame([(9, "a " * 40_000), (5, "a " * 39_000), (7, "a " * 39_999), (3, "b")], "passage_id long, text string")
    plans = spark.createDataFrame([(1, None, ["a"], [])], "query_id long, tree string, wanted array<string>, banned array<string>")
    got = arms.top(lexical_candidates(plans, 1, p, 2).withColumn("score", F.round("score", 6)), 2).collect()
    same = arms.top(lexical_candidates(plans, 1, p, 100).withColumn("score", F.round("score", 6)), 2).collect()
    assert [(r.passage_id, r.score) for r in got] == [(r.passage_id, r.score) for r in same]


def test_alternatives_have_their_own_negations(spark):
    """a b or c -d."""
    docs = spark.createDataFrame([(1, "t")], "doc_id long, title string")
    p = spark.createDataFrame([(1, 1, 0, "s", "a d"), (2, 1, 1, "s", "c d"), (3, 1, 2, "s", "c"), (4, 1, 3, "s", "a c d"), (5, 1, 4, "s", "e")],
                              "passage_id long, doc_id long, ordinal int, section string, text string")
    q = spark.createDataFrame([(1, "a b or c -d"), (2, "-a")], "query_id long, query_text string")
    hits = Corpus(docs, p, Settings(prune_common=False)).search(q, "fts", 10).orderBy("rank").collect()
    assert [(r.query_id, r.passage_id) for r in hits] == [(1, 4), (1, 1), (1, 3)]


def test_web_or_asks_with_a_negation(spark, crowded):
    """passages that have only the third word, and the fourth too, are no hits of the query."""
    hits = {(r.query_id, r.passage_id) for r in queries()["fts_web_or"](spark, crowded).collect()}
    said = {r.passage_id: r.text.split() for r in unique_passages(spark.read.parquet(f"{crowded}/passages.parquet")).collect()}
    assert hits and not [1 for q, p in hits if not {*said[q][:2]} & {*said[p]} and said[q][3] in said[p]]


def test_titles_before_the_limit(spark):
    """the joined table is cut, so a passage without a document takes no place."""
    docs = spark.createDataFrame([(1, "t")], "doc_id long, title string")
    p = spark.createDataFrame([(1, 7, 0, "s", "a a a"), (2, 1, 0, "s", "a")], "passage_id long, doc_id long, ordinal int, section string, text string")
    q = spark.createDataFrame([(1, "a")], "query_id long, query_text string")
    hits = Corpus(docs, p, Settings(prune_common=False, join_after_limit=False)).search(q, "fts", 1).collect()
    assert [(r.passage_id, r.title, r["rank"]) for r in hits] == [(2, "t", 1)]


def test_buckets_take_few(spark):
    """of the pairs that a bucket proposes only those over the least cosine leave the blocks."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 64))
    x[300:] = x[:300] + 0.2 * rng.standard_normal((300, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<float>")
    packed = arms._packed(df, 128).localCheckpoint()
    b = Buckets(0.8, 64, 12, 0.6, 1)
    got = {(r.query_id, r.passage_id) for r in arms.near_candidates(packed, packed.count(), packed, 10, arms._unpacked, b).collect()}
    codes, cos = b.of(unit), unit @ unit.T
    assert got == {(i, j) for i, j in zip(*np.nonzero(cos >= 0.8)) if (codes[i] == codes[j]).any()}
    assert len(got) > 1000
