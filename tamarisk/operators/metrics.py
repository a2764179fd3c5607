"""Retrieval metrics over all queries of all runs in one plan.

A ranking is (run, query_id, doc_id, rank), ranks from 1 without gaps; labels are
(query_id, doc_id, relevance). A label over 0 is relevant. Queries without hits
count as 0, queries without labels take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def collapse_to_documents(runs: DataFrame, by: str = "cluster") -> DataFrame:
    """Passage rankings to document rankings: a document stands where it first appears."""
    first = runs.groupBy("run", "query_id", F.col(by).alias("doc_id")).agg(F.min("rank").alias("at"))
    w = Window.partitionBy("run", "query_id").orderBy("at", "doc_id")
    return first.select("run", "query_id", "doc_id", F.row_number().over(w).alias("rank"))


def collapse_labels(qrels: DataFrame, by: str = "cluster") -> DataFrame:
    """(query_id, doc_id, relevance): the highest grade of a cluster; null grades are no label."""
    return qrels.where("relevance is not null").groupBy("query_id", F.col(by).alias("doc_id")).agg(F.max("relevance").alias("relevance"))


def query_metrics(ranked: DataFrame, labels: DataFrame, runs: list[str], k_recall: int = 50, k_ndcg: int = 10, k_precision: int = 10) -> DataFrame:
    """(run, query_id, recall, precision, rr, ndcg) of every labelled query in each of the named runs.

    nDCG has linear gain; its ideal takes all labels of the query. No relevant
    label gives recall 0, no positive gain nDCG 0.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id")
    ideal = labels.withColumn("i", F.row_number().over(order)).groupBy("query_id").agg(
        F.count_if(F.col("relevance") > 0).alias("n_rel"),
        F.sum(F.when(F.col("i") <= k_ndcg, F.col("relevance") / F.log2(F.col("i") + 1))).alias("idcg"))
    hits = ranked.join(labels, ["query_id", "doc_id"])
    relevant, at = F.col("relevance") > 0, F.col("rank")
    got = hits.groupBy("run", "query_id").agg(
        F.count_if(relevant & (at <= k_recall)).alias("found"), F.count_if(relevant & (at <= k_precision)).alias("top"),
        F.min(F.when(relevant, at)).alias("first"),
        F.sum(F.when(at <= k_ndcg, F.col("relevance") / F.log2(at + 1))).alias("dcg"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    each = ideal.select(F.explode(F.array(*map(F.lit, runs))).alias("run"), *ideal.columns)
    return each.join(got, ["run", "query_id"], "left").select(
        "run", "query_id", zero(F.try_divide("found", "n_rel")).alias("recall"), zero(F.col("top") / F.lit(k_precision)).alias("precision"),
        zero(1 / F.col("first")).alias("rr"), zero(F.try_divide("dcg", "idcg")).alias("ndcg"))


def nearest_rank(value: str, p: float) -> Column:
    """The smallest value with at least p of all at or under it; 0 if there is none."""
    return F.coalesce(F.expr(f"percentile_disc({p}) within group (order by {value})"), F.lit(0.0))


def summary(per_query: DataFrame) -> DataFrame:
    """A row a run: macro means over its queries."""
    return per_query.groupBy("run").agg(
        F.count(F.lit(1)).alias("n"), F.avg("recall").alias("recall"), F.avg("precision").alias("precision"),
        F.avg("ndcg").alias("ndcg"), F.avg("rr").alias("mrr"))


def against_baseline(table: DataFrame, baseline: str, measures: list[str]) -> DataFrame:
    """Adds <measure>_delta, relative to the baseline run's row; null where that is 0."""
    whole = Window.partitionBy()  # over one row a run
    base = {m: F.max(F.when(F.col("run") == baseline, F.col(m))).over(whole) for m in measures}
    return table.select("*", *[(F.try_divide(F.col(m), b) - 1).alias(f"{m}_delta") for m, b in base.items()])


def distinct_documents(runs: DataFrame, depth: int = 50) -> DataFrame:
    """A row a run: mean and least number of different documents in the first ``depth`` passages."""
    n = runs.where(F.col("rank") <= depth).groupBy("run", "query_id").agg(F.count_distinct("doc_id").alias("n"))
    return n.groupBy("run").agg(F.avg("n").alias("mean_docs"), F.min("n").alias("min_docs"))
