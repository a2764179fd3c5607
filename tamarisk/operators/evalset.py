"""Labelled query sets: from citations, from judges, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarisk.config import Settings
from tamarisk.functions.text import hash_split, identifier, strip


def clean_split(queries: DataFrame) -> DataFrame:
    """Queries with their split trimmed and lower-cased."""
    return queries.withColumn("split", F.lower(F.trim("split")))


def labels_of(qrels: DataFrame) -> DataFrame:
    """(query_id, doc_id, relevance): of a pair given again the highest grade; null grades are none."""
    return qrels.where("relevance is not null and doc_id is not null").groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance"))


def load_eval_set(queries: DataFrame, qrels: DataFrame, split: str = "test", origin: str = "manual") -> DataFrame:
    """(query_id, query_text, qrels map): queries of a split and origin that have labels."""
    picked = clean_split(queries).where((F.col("split") == split) & (F.col("origin") == origin)).select("query_id", "query_text")
    got = picked.join(labels_of(qrels), "query_id", "left")
    return got.groupBy("query_id", "query_text").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "relevance"))))).alias("qrels")
    ).where(F.size("qrels") > 0)


def resolve_references(references: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, cited_doc_id): references {doc_id, ref_no, id, pmid, pmcid, doi} resolved by the
    first of their keys that some document has; all keys share one namespace, and a
    key of several documents means the lowest doc_id. Self-citations are left out."""
    keys = documents.select("doc_id", F.explode(F.array("pmid", "pmcid", "doi")).alias("k")).select(
        identifier(F.col("k")).alias("key"), F.col("doc_id").alias("cited")).where("key is not null").groupBy("key").agg(F.min("cited").alias("cited"))
    wanted = references.select("doc_id", "ref_no", F.posexplode(F.array("id", "pmid", "pmcid", "doi")).alias("place", "k")).select(
        "doc_id", "ref_no", "place", identifier(F.col("k")).alias("key")).where("key is not null")
    hit = wanted.join(keys, "key").groupBy("doc_id", "ref_no").agg(F.min_by("cited", "place").alias("cited_doc_id"))
    return hit.where("cited_doc_id <> doc_id").select("doc_id", "cited_doc_id").distinct()


def citation_pairs(resolved: DataFrame, documents: DataFrame, min_refs: int = Settings.min_refs) -> DataFrame:
    """(citing_doc_id, cited_doc_id, context_text): the title as context, for documents with
    enough resolved references."""
    enough = resolved.groupBy("doc_id").agg(F.count_distinct("cited_doc_id").alias("n")).where(F.col("n") >= min_refs)
    return resolved.join(enough.select("doc_id"), "doc_id", "left_semi").join(documents.select("doc_id", "title"), "doc_id").select(
        F.col("doc_id").alias("citing_doc_id"), "cited_doc_id", F.col("title").alias("context_text"))


def to_harvest(documents: DataFrame, contexts: DataFrame, limit: int = 2000) -> DataFrame:
    """Documents without contexts, best cited first (nulls before all, then by id)."""
    done = contexts.select(F.col("citing_doc_id").alias("doc_id"))
    return documents.join(done, "doc_id", "left_anti").orderBy(F.desc_nulls_first("cited_by"), "doc_id").limit(limit).select(
        "doc_id", "source", "ext_id", "title", "cited_by")


def citation_eval_set(contexts: DataFrame, test_fraction: float = Settings.test_fraction, min_positives: int = Settings.min_positives) -> tuple[DataFrame, DataFrame]:
    """(queries: query_text, split; labels: query_text, doc_id, relevance 1) from contexts.

    A context of a citing document with enough citations is a query; the split is a
    hash of the citing document, of several the last by id decides.
    """
    kept = contexts.where("context_text is not null").groupBy("citing_doc_id", "context_text").agg(
        F.count("cited_doc_id").alias("n")).where(F.col("n") >= min_positives)
    queries = kept.groupBy("context_text").agg(F.max("citing_doc_id").alias("last")).select(
        F.col("context_text").alias("query_text"), hash_split(F.col("last"), test_fraction).alias("split"))
    labels = contexts.where("cited_doc_id is not null").join(kept.select("citing_doc_id", "context_text"), ["citing_doc_id", "context_text"]).select(
        F.col("context_text").alias("query_text"), F.col("cited_doc_id").alias("doc_id"), F.lit(1).alias("relevance")).distinct()
    return queries, labels


def pool_for_judging(runs: DataFrame, passages: DataFrame, documents: DataFrame, queries: DataFrame, arms: tuple[str, ...], depth: int = 10) -> DataFrame:
    """(query, doc_id, title, passage, found_by, relevance): documents any arm ranks in its
    first ``depth``, each once, with the text of its first showing (arms in the order given)."""
    place = F.array_position(F.array(*map(F.lit, arms)), F.col("run"))
    hit = runs.where(F.col("rank") <= depth).join(passages.select("passage_id", "doc_id", "text"), "passage_id")
    pooled = hit.groupBy("query_id", "doc_id").agg(
        F.array_join(F.sort_array(F.collect_set("run")), "|").alias("found_by"),
        F.min_by(F.substring("text", 1, 300), F.struct(place, F.col("rank"))).alias("passage"))
    return pooled.join(documents.select("doc_id", "title"), "doc_id").join(queries.select("query_id", F.col("query_text").alias("query")), "query_id").select(
        "query", "doc_id", "title", "passage", "found_by", F.lit("").alias("relevance"))


def import_judgements(judged: DataFrame) -> DataFrame:
    """(query, doc_id, relevance) of rows a judge has filled in: blank or unreadable grades are
    left out, never read as 0; of a pair judged again the highest grade counts."""
    grade = F.expr("try_cast(trim(relevance) as int)")
    return judged.select(strip(F.col("query")).alias("query"), F.col("doc_id").cast("long").alias("doc_id"), grade.alias("relevance")).where(
        "relevance is not null").groupBy("query", "doc_id").agg(F.max("relevance").alias("relevance"))


def ranked_prefix(queries: DataFrame, n: int | None) -> DataFrame:
    """The first n queries by id; all of them for None."""
    ordered = queries.orderBy("query_id")
    return ordered if n is None else ordered.limit(n)


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in the given order."""
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_i = 1").drop("_i")
