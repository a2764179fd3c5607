"""Hard negatives and training pairs, for all queries at once.

``cands`` is (query_id, passage_id, doc_id, rank, cluster); ``labels`` is (query_id,
doc_id, relevance, cluster); ``blocked`` is (query_id, cluster): the query's own papers.
Graded zeros are no positives, and may come out as negatives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarisk.plans.materialise import written


def own_papers(queries: DataFrame, contexts: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents whose citation contexts have the query's text."""
    return queries.select("query_id", F.col("query_text").alias("context_text")).join(
        contexts.select("context_text", F.col("citing_doc_id").alias("doc_id")).distinct(), "context_text").select("query_id", "doc_id").distinct()


def _flagged(cands: DataFrame, labels: DataFrame, blocked: DataFrame, skip: int) -> DataFrame:
    pos = labels.where("relevance > 0").select("query_id", "cluster").distinct().withColumn("is_pos", F.lit(True))
    judged = labels.where("relevance > 0").select("query_id", "doc_id").distinct().withColumn("is_judged", F.lit(True))
    own = blocked.select("query_id", "cluster").distinct().withColumn("is_own", F.lit(True))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return cands.where(F.col("rank") > skip).join(pos, ["query_id", "cluster"], "left").join(judged, ["query_id", "doc_id"], "left").join(
        own, ["query_id", "cluster"], "left").select("query_id", "passage_id", "doc_id", "rank", "cluster", no("is_pos"), no("is_judged"), no("is_own"))


def _selected(flagged: DataFrame, most: int) -> DataFrame:
    free = flagged.where("not is_pos and not is_own")
    once = free.withColumn("_i", F.row_number().over(Window.partitionBy("query_id", "cluster").orderBy("rank"))).where("_i = 1")
    return once.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("_n") <= most)


def hard_negatives(cands: DataFrame, labels: DataFrame, blocked: DataFrame, most: int = 8, skip: int = 0) -> DataFrame:
    """(query_id, passage_id, doc_id, rank): best-ranked candidates of other clusters than the
    query's positives and own papers, one a cluster, ``most`` a query."""
    return _selected(_flagged(cands, labels, blocked, skip), most).select("query_id", "passage_id", "doc_id", "rank")


def positives(cands: DataFrame, labels: DataFrame, leads: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, passage_id, doc_id, kind): per positive cluster its best retrieved passage, or
    else the lead passage of its first document that has one; in doc_id order."""
    wanted = labels.where("relevance > 0").select("query_id", "cluster", F.col("doc_id").alias("judged"))
    best = cands.groupBy("query_id", "cluster").agg(F.min_by(F.struct("passage_id", "doc_id"), "rank").alias("hit"))
    lead = leads.select(F.col("doc_id").alias("judged"), F.struct("passage_id", F.col("doc_id").alias("doc_id")).alias("lead"))
    found = wanted.join(best, ["query_id", "cluster"], "left").join(lead, "judged", "left").withColumn("p", F.coalesce("hit", "lead")).where("p is not null")
    once = found.withColumn("_i", F.row_number().over(Window.partitionBy("query_id", "cluster").orderBy("judged"))).where("_i = 1")
    capped = once.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("judged"))).where(F.col("_n") <= most)
    return capped.select("query_id", "p.passage_id", "p.doc_id", F.when(F.col("hit").isNotNull(), "positive_retrieved").otherwise("positive_fallback").alias("kind"))


def training_pairs(cands: DataFrame, labels: DataFrame, blocked: DataFrame, leads: DataFrame, max_neg: int = 8, max_pos: int = 8, skip: int = 0) -> DataFrame:
    """(query_id, passage_id, doc_id, label, kind) of queries with a positive and a negative."""
    neg = written(hard_negatives(cands, labels, blocked, max_neg, skip), "mining")
    pos = written(positives(cands, labels, leads, max_pos), "mining")
    both = pos.select("query_id").intersect(neg.select("query_id"))
    rows = pos.select("query_id", "passage_id", "doc_id", F.lit(1.0).alias("label"), "kind").unionByName(
        neg.select("query_id", "passage_id", "doc_id", F.lit(0.0).alias("label"), F.lit("hard_negative").alias("kind")))
    return rows.join(both, "query_id", "left_semi")


def mining_statistics(queries: DataFrame, cands: DataFrame, labels: DataFrame, blocked: DataFrame, leads: DataFrame,
                      max_neg: int = 8, max_pos: int = 8, skip: int = 0) -> DataFrame:
    """One row of counters. Blocked twins and own papers count up to the last negative taken
    where the cap binds, and over all candidates otherwise; with a cap of 0 none do."""
    flagged = written(_flagged(cands, labels, blocked, skip), "mining")
    neg = written(_selected(flagged, max_neg), "mining")
    pos = written(positives(cands, labels, leads, max_pos), "mining")
    full = neg.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_neg"), F.max("rank").alias("last"))
    edge = F.when(F.coalesce("n_neg", F.lit(0)) >= max_neg, F.coalesce("last", F.lit(0))).otherwise(F.lit(2**31 - 1))
    seen = flagged.join(full, "query_id", "left").where(F.col("rank") < edge)
    blocks = seen.groupBy("query_id").agg(
        F.count_if(F.col("is_pos") & ~F.col("is_judged")).alias("twins"), F.count_if(~F.col("is_pos") & F.col("is_own")).alias("own"))
    each = queries.select("query_id").join(full.select("query_id", "n_neg"), "query_id", "left").join(
        pos.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_pos")), "query_id", "left").join(blocks, "query_id", "left").fillna(0)
    used = (F.col("n_neg") > 0) & (F.col("n_pos") > 0)
    return each.agg(
        F.count(F.lit(1)).alias("queries_seen"), F.count_if(used).alias("queries_used"),
        F.count_if(F.col("n_neg") == 0).alias("queries_without_negatives"),
        F.count_if((F.col("n_neg") > 0) & (F.col("n_pos") == 0)).alias("queries_without_positives"),
        F.coalesce(F.sum(F.when(used, F.col("n_pos"))), F.lit(0)).alias("positives"),
        F.coalesce(F.sum(F.when(used, F.col("n_neg"))), F.lit(0)).alias("negatives"),
        F.coalesce(F.sum("twins"), F.lit(0)).alias("twins_blocked"), F.coalesce(F.sum("own"), F.lit(0)).alias("self_matches_blocked"))
