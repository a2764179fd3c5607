import math

import pytest

from tamarisk.operators import metrics


def run(spark, ranking, labels, k=50):
    ranked = spark.createDataFrame([("r", 1, d, i + 1) for i, d in enumerate(ranking)], "run string, query_id long, doc_id long, rank int")
    lab = spark.createDataFrame([(1, d, g) for d, g in labels.items()], "query_id long, doc_id long, relevance int")
    return metrics.query_metrics(ranked, lab, ["r"], k).first()


def test_measures(spark):
    assert run(spark, [7, 3, 9], {7: 1, 3: 1}).recall == 1.0
    m = run(spark, [2, 1], {1: 3, 2: 1})
    assert m.ndcg == pytest.approx(0.7967, abs=1e-4) and m.rr == 1.0 and m.precision == pytest.approx(0.2)
    none = run(spark, [], {5: 1})
    assert (none.recall, none.rr, none.ndcg, none.precision) == (0, 0, 0, 0)
    zeros = run(spark, [5], {5: 0})
    assert (zeros.recall, zeros.rr, zeros.ndcg) == (0, 0, 0)


def test_collapse(spark):
    rows = [("r", 1, d, i + 1) for i, d in enumerate([1] * 30 + [900] + [2] * 19)]
    runs = spark.createDataFrame(rows, "run string, query_id long, cluster long, rank int")
    docs = {r.doc_id: r["rank"] for r in metrics.collapse_to_documents(runs).collect()}
    assert docs == {1: 1, 900: 2, 2: 3}
    lab = spark.createDataFrame([(1, 900, 1)], "query_id long, doc_id long, relevance int")
    assert metrics.query_metrics(metrics.collapse_to_documents(runs), lab, ["r"]).first().ndcg == pytest.approx(1 / math.log2(3))
    grades = spark.createDataFrame([(1, 5, 1), (1, 5, 3), (1, 6, None)], "query_id long, cluster long, relevance int")
    assert [tuple(r) for r in metrics.collapse_labels(grades).collect()] == [(1, 5, 3)]


def test_percentiles(spark):
    ten = spark.range(1, 11).selectExpr("cast(id as double) v")
    assert [ten.agg(metrics.nearest_rank("v", p).alias("x")).first().x for p in (0.0, 0.5, 0.95, 1.0)] == [1, 5, 10, 10]
    assert ten.where("false").agg(metrics.nearest_rank("v", 0.5).alias("x")).first().x == 0


def test_summary_and_baseline(spark):
    per = spark.createDataFrame([("a", 1, 0.5, 0.1, 1.0, 0.2), ("a", 2, 0.0, 0.1, 0.0, 0.0), ("b", 1, 1.0, 0.1, 1.0, 0.4)],
                                "run string, query_id long, recall double, precision double, rr double, ndcg double")
    t = {r.run: r for r in metrics.against_baseline(metrics.summary(per), "a", ["ndcg"]).collect()}
    assert t["a"].n == 2 and t["a"].recall == 0.25 and t["b"].ndcg_delta == pytest.approx(3.0) and t["a"].ndcg_delta == 0
