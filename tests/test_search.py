import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarisk.operators import arms
from tamarisk.config import Settings
from tamarisk.operators.corpus import (
    NotFound, documents_with_passages, english_vectors, get_document, positions, stemmed_postings, unique_passages,
)
from tamarisk.operators.metrics import distinct_documents
from tamarisk.operators.ml import HashingEncoder, embed_missing, load_model, save_model, save_vectors
from tamarisk.operators.search import Corpus, eval_queries
from tamarisk.sources.records import ResponseCache, ablation_markdown, read_runs, reference_lists, write_runs

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus(spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/passages.parquet"))


def test_arms(spark, corpus, tmp_path):
    raw, qrels = spark.read.parquet(f"{D}/eval_queries.parquet"), spark.read.parquet(f"{D}/eval_qrels.parquet")
    q = eval_queries(raw, "test")
    dense = corpus.rank(q, "dense", 20)
    alone = arms.fuse({"fts": corpus.rank(q, "fts", 20), "dense": dense}, 20, 60, {"fts": 0.0})
    key = lambda df: sorted((r.query_id, r["rank"], r.passage_id) for r in df.collect())
    assert key(alone) == key(dense)  # an arm of weight 0 is no arm
    fallback = corpus.search(q, "hybrid_rerank", 5)
    assert {r.reranked for r in fallback.collect()} == {False}
    hybrid = corpus.rank(q, "hybrid", 5)
    assert key(fallback) == key(hybrid)
    model = corpus.train(eval_queries(raw, "train", "citation"), qrels, spark.read.parquet(f"{D}/citation_contexts.parquet"))
    assert model is not None
    hits = corpus.search(q, "hybrid_rerank", 5).collect()
    assert all(r.reranked and {"rrf", "rerank"} <= set(r.components) for r in hits)
    table = corpus.ablation(q, qrels)
    assert {r.run for r in table.collect()} == set(arms.ARMS)
    assert all(0 <= r.recall <= 1 and 0 <= r.ndcg <= 1 for r in table.collect())
    assert "weak supervision" in ablation_markdown(table, "citation") and "weak" not in ablation_markdown(table, "manual")
    save_model(model, str(tmp_path / "m"), corpus.settings, pairs=1)
    back, stale = load_model(str(tmp_path / "m"), corpus.settings)
    assert back is not None and not stale
    assert load_model(str(tmp_path / "none"), corpus.settings) == (None, False)


def test_edges(spark, corpus):
    none = spark.createDataFrame([(1, ""), (2, None), (3, "zzzzqqq")], "query_id long, query_text string")
    assert corpus.rank(none, "fts", 5).count() == 0
    assert corpus.search(none.where("false"), "dense", 5).count() == 0
    with pytest.raises(ValueError):
        corpus.rank(none, "bm25", 5)
    with pytest.raises(ValueError):
        arms.fuse({"fts": none}, 5, 60, {"fts": 0})
    one = corpus.search_one("insulator clusters regulator", "hybrid", 3)
    assert len(one["hits"]) == 3 and [h["rank"] for h in one["hits"]] == [1, 2, 3] and one["latency_ms"] > 0


def test_dense_is_exact(spark):
    rows = [(i, [float((i * k) % 7 - 3) for k in range(1, 5)]) for i in range(50)] + [(60, None), (61, [1.0]), (62, [0.0] * 4), (63, [float("nan")] * 4), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "id long, v array<float>").withColumn("vec", F.lit("clash"))
    v = arms.unit_vectors(df, "id", "v", 4)
    got = {}
    for r in arms.dense(v.where("id < 5"), v, 3, block=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.passage_id, r.score))
    ok = {i: x for i, x in rows if i is not None and i < 60 and any(x)}

    def cos(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5), 6)

    for q in [i for i in ok if i < 5]:
        want = sorted(((-cos(ok[q], x), i) for i, x in ok.items()))[:3]
        assert [(p, s) for _, p, s in sorted(got[q])] == [(i, -s) for s, i in want]


def test_ann_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 64))
    x = np.concatenate([x, x[:100] + 0.3 * rng.standard_normal((100, 64))])
    v = arms.unit_vectors(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i long, v array<double>"), "i", "v")
    pairs = lambda df: {(r.query_id, r.passage_id) for r in df.where("score >= 0.8").collect()}
    want, got = pairs(arms.dense(v, v, 5)), pairs(arms.dense_ann(v, v, 5))
    assert len(want & got) >= 0.9 * len(want) and got <= want
    assert arms.dense_ann(v.where("false"), v, 5).count() == 0


def test_ann_finds_all_k(spark):
    """The k nearest come out however far they lie."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 64))
    x[:60] = x[0] + 0.2 * rng.standard_normal((60, 64))  # these have their ten over 0.8, the others don't
    v = arms.unit_vectors(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i long, v array<double>"), "i", "v")
    pairs = lambda df: {(r.query_id, r.passage_id) for r in df.collect()}
    want, got = pairs(arms.dense(v, v, 10)), pairs(arms.dense_ann(v, v, 10))
    assert len(got) == 4000 and len(want & got) >= 0.9 * len(want)


def test_embedding_resumes(spark):
    p = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None), (4, "")], "passage_id long, text string")
    have = spark.createDataFrame([(2, [1.0])], "id long, vec array<float>")
    got = {r.id: r.vec for r in embed_missing(p, have).collect()}
    assert set(got) == {1, 4} and sum(x * x for x in got[1]) == pytest.approx(1) and not any(got[4])
    assert got[1] == pytest.approx(HashingEncoder().encode(["a b"])[0].tolist())


def test_stemmed_and_nested(spark):
    p = spark.createDataFrame([(1, 7, 0, "s", "cats cat running"), (2, 7, 1, "s", "cat"), (2, 7, 1, "s", "cat"), (3, 8, 0, "s", None)], "passage_id long, doc_id long, ordinal int, section string, text string")
    got = {(r.passage_id, r.lexeme): r.tf for r in stemmed_postings(unique_passages(p)).collect()}
    assert got == {(1, "cat"): 2, (1, "run"): 1, (2, "cat"): 1}
    where = {(r.passage_id, r.lexeme): r.positions for r in positions(unique_passages(p)).collect()}
    assert where[1, "running"] == [3]
    docs = documents_with_passages(spark.createDataFrame([(7,), (9,)], "doc_id long"), p)
    assert {r.doc_id: [x.passage_id for x in r.passages] for r in docs.collect()} == {7: [1, 2], 9: []}
    rows = {r.run: (r.mean_docs, r.min_docs) for r in distinct_documents(spark.createDataFrame([("a", 1, 1, 5), ("a", 1, 2, 5), ("a", 2, 1, 5), ("a", 2, 2, 6)], "run string, query_id int, rank int, doc_id int")).collect()}
    assert rows == {"a": (1.5, 1)}


def test_reference_lists(spark, tmp_path):
    ResponseCache(str(tmp_path)).put("references", {"source": "MED", "ext_id": "1"}, {"referenceList": {"reference": [{"id": 5}, {"doi": "10.1/x"}]}})
    docs = spark.createDataFrame([(1, "MED", "1"), (2, "MED", "2")], "doc_id long, source string, ext_id string")
    assert sorted(tuple(r) for r in reference_lists(docs, str(tmp_path)).collect()) == [(1, 0, "5", None, None, None), (1, 1, None, None, None, "10.1/x")]
    write_runs(docs, str(tmp_path / "runs"), "x")
    assert read_runs(spark, str(tmp_path / "runs"), "x").count() == 2


def small(spark, **kw):
    texts = ["heron low tide", "tide low heron", "eel stress", "stress only", "heron stress low tide", None, ""]
    docs = spark.createDataFrame([(i, "t", "MED") for i in range(7)], "doc_id long, title string, source string")
    p = spark.createDataFrame([(i, i, 0, "s", t, None) for i, t in enumerate(texts)], "passage_id long, doc_id long, ordinal int, section string, text string, embedding array<float>")
    return Corpus(docs, p, Settings(prune_common=False, **kw))


@pytest.mark.parametrize(("text", "want"), [
    ("heron -stress", {0, 1}), ("-stress", set()), ('"low tide"', {0, 4}), ('"low tide" -stress', {0}), ("eel or heron", {0, 1, 2, 4}),
    ('heron -"low tide"', {1}), ('eel or heron -"tide low"', {0, 2, 4}), ("heron eel -only", {0, 1, 2, 4}), ("zzz", set()), ('"', set()), ("  ", set()),
])
def test_grammar_in_search(spark, text, want):
    hits = small(spark).search_one(text, "fts", 10)["hits"]
    assert {h["passage_id"] for h in hits} == want
    assert all(h["components"] == {"fts": h["score"]} for h in hits)


def test_switches_change_plans(spark):
    q = spark.createDataFrame([(1, "heron stress")], "query_id long, query_text string")
    loose, strict = small(spark), small(spark, or_semantics=False)
    ids = lambda c: sorted(r.passage_id for r in c.search(q, "fts", 10).collect())
    assert ids(loose) == [0, 1, 2, 3, 4] and ids(strict) == [4]
    after, before = loose.search(q, "fts", 10), small(spark, join_after_limit=False).search(q, "fts", 10)
    tree = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert tree(after).index("Window") > tree(after).index("Join") and tree(before).index("Window") < tree(before).index("Join")
    assert sorted((r.passage_id, r["rank"]) for r in after.collect()) == sorted((r.passage_id, r["rank"]) for r in before.collect())
    assert Settings(requests_per_second=1).fingerprint() == Settings().fingerprint() != Settings(or_semantics=False).fingerprint()


def test_english_analysis(spark):
    c = small(spark, analyzer="english")
    assert {h["passage_id"] for h in c.search_one("the herons", "fts", 9)["hits"]} == {0, 1, 4}
    assert {h["passage_id"] for h in c.search_one('"lows tides"', "fts", 9)["hits"]} == {0, 4}
    p = spark.createDataFrame([(1, "The running of the eels running"), (2, "of the"), (3, None)], "passage_id long, text string")
    assert {(r.passage_id, r.lexeme): r.positions for r in english_vectors(p).collect()} == {(1, "run"): [2, 6], (1, "eel"): [5]}


def test_pair_scorer(spark):
    class Length:
        def score(self, queries, texts):
            return np.array([float(len(t)) for t in texts])

    c = small(spark)
    c.pair_scorer = Length()
    hits = c.search_one("heron stress", "hybrid_rerank", 3)
    assert hits["reranked"] and [h["passage_id"] for h in hits["hits"]] == [4, 0, 1] and hits["hits"][0]["components"]["rerank"] == 21.0


@pytest.mark.parametrize(("text", "arm", "k"), [("", "fts", 5), ("x" * 1001, "fts", 5), ("x", "fts", 0), ("x", "fts", 101), ("x", "nope", 5), ("x", "fts", True)])
def test_limits_of_a_search(spark, text, arm, k):
    with pytest.raises(ValueError):
        small(spark).search_one(text, arm, k)


def test_point_lookup(spark):
    c = small(spark)
    one = get_document(c.documents, c.raw_passages, 4)
    assert one["doc_id"] == 4 and [p["text"] for p in one["passages"]] == ["heron stress low tide"]
    with pytest.raises(NotFound):
        get_document(c.documents, c.raw_passages, 99)
    for bad in (0, -1, "4", None, True):
        with pytest.raises(ValueError):
            get_document(c.documents, c.raw_passages, bad)


def test_vectors_are_kept(spark):
    stored = spark.createDataFrame([(1, "a", [1.0]), (2, "b", None), (3, "c", None)], "passage_id long, text string, embedding array<float>")
    new = spark.createDataFrame([(1, [9.0]), (2, [2.0]), (7, [7.0])], "id long, vec array<float>")
    assert {r.passage_id: r.embedding for r in save_vectors(stored, new).collect()} == {1: [1.0], 2: [2.0], 3: None}
