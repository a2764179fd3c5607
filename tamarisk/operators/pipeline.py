"""Ingest rounds: raw records of queries to documents, passages and the log, with totals.

A round is a function of table states: what comes out is what the tables are to
hold next, and ``store.VersionedTable`` or ``store.publish`` puts it there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.config import Settings
from tamarisk.operators.corpus import chunk_documents
from tamarisk.operators.evalset import citation_eval_set, citation_pairs
from tamarisk.operators.store import insert_passages, upsert_documents, upsert_labels, upsert_log, upsert_queries
from tamarisk.plans.materialise import written
from tamarisk.sources.records import normalise_records


@dataclass(frozen=True)
class Round:
    documents: DataFrame
    passages: DataFrame  # (doc_id, ordinal, section, text)
    log: DataFrame
    totals: DataFrame  # one row: documents, passages, skipped


def document_ids(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows with the doc_id that their (source, ext_id) has in the stored table."""
    return rows.join(documents.groupBy("source", "ext_id").agg(F.min("doc_id").alias("doc_id")), ["source", "ext_id"])


def ingest_round(raw: DataFrame, documents: DataFrame, passages: DataFrame, log: DataFrame, now, s: Settings = Settings(), skip_seen: bool = True) -> Round:
    """``raw`` has (query, record JSON). Queries the log holds are skipped whole, unless told not to; a
    query without a usable record leaves no entry. Stored documents are updated by the upsert's
    rules, stored passages stay; of a record in several queries each counts it."""
    asked = raw.select("query").distinct()
    seen = asked.join(log.select("query").distinct(), "query", "left_semi") if skip_seen else asked.where("false")
    fresh = raw.join(seen, "query", "left_anti")
    rows = written(normalise_records(fresh, keep=("query",)), "records")
    per_query = rows.groupBy("query").agg(F.count(F.lit(1)).cast("int").alias("n_docs"))
    arrived = rows.drop("query").withColumns({"ingested_at": now, "canonical_doc_id": F.lit(None).cast("long")})
    after = written(upsert_documents(documents, arrived, "ingested_at"), "documents")
    keyed = document_ids(rows.select("query", "source", "ext_id", "title", "abstract"), after)
    once = keyed.groupBy("doc_id").agg(F.max(F.struct("title", "abstract")).alias("r")).select("doc_id", "r.*")
    chunks = written(chunk_documents(once, s), "chunks")
    made = keyed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")), "doc_id")
    totals = per_query.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("documents")).crossJoin(
        made.agg(F.coalesce(F.sum(F.col("n") * F.col("c")), F.lit(0)).alias("passages"))).crossJoin(seen.agg(F.count(F.lit(1)).alias("skipped")))  # one row each
    return Round(after, insert_passages(passages.select("doc_id", "ordinal", "section", "text"), chunks),
                 upsert_log(log, per_query.withColumn("fetched_at", now)), totals)


def harvest_totals(asked: DataFrame, resolved: DataFrame, documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row: documents asked for, those with a resolved reference, those with enough of them, and
    the contexts these give."""
    per = resolved.groupBy("doc_id").agg(F.count_distinct("cited_doc_id").alias("n"))
    counts = asked.select("doc_id").distinct().join(per, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("documents"), F.count("n").alias("with_references"), F.count_if(F.col("n") >= s.min_refs).alias("with_enough"))
    pairs = citation_pairs(resolved.join(asked.select("doc_id").distinct(), "doc_id", "left_semi"), documents, s.min_refs)
    return counts.crossJoin(pairs.agg(F.count(F.lit(1)).alias("contexts")))  # one row each


def build_eval_set(contexts: DataFrame, queries: DataFrame, qrels: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(eval_queries, eval_qrels) after the derived queries and labels came in, by the ids the upsert returns."""
    derived, labels = citation_eval_set(contexts, s.test_fraction, s.min_positives)
    after, ids = upsert_queries(queries, derived, judged=False)
    after = written(after, "queries")
    new = labels.join(ids, "query_text").select("query_id", "doc_id", "relevance")
    return after, upsert_labels(qrels, new, judged=False)
