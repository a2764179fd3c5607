"""The pN_ queries: each over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.llm import mixture, near, oracles, overlap, pieces, repetition, splits, survivors, terms, tokens, vectors
from tamarisk.plans.materialise import folder, written

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_pairs(_table(spark, d, "eval_queries")).select(
        F.col("id_a").alias("query_id_a"), F.col("id_b").alias("query_id_b"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(_table(spark, d, "eval_queries"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_classes(_table(spark, d, "eval_queries")).withColumnRenamed("id", "query_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every passage asks; the floor of the pairs wanted goes into the search."""
    found = vectors.most_similar(_table(spark, d, "passages"), "passage_id", "embedding", min_cosine=0.9)
    return vectors.neighbour_pairs(found).select(F.col("id_a").alias("passage_id_a"), F.col("id_b").alias("passage_id_b"))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar, however similar, of every passage whose id is divisible by 100, against all."""
    return vectors.most_similar(_table(spark, d, "passages"), "passage_id", "embedding", queries=F.col("id") % 100 == 0).withColumn("cosine", F.round("cosine", 6))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.best_representatives(_table(spark, d, "documents"), texts=()).select("group_id", "doc_id", "doi")


def p3_golden(spark: SparkSession, d: str) -> DataFrame:
    return survivors.best_representatives(_table(spark, d, "documents"))


def _split_items(spark: SparkSession, d: str) -> DataFrame:
    passages = pieces.split_oversized(_table(spark, d, "passages"), "passage_id", "text", 1200)
    abstracts = pieces.split_oversized(_table(spark, d, "documents"), "doc_id", "abstract", 2500)
    return passages.withColumn("item_field", F.lit("passages.text")).unionByName(
        abstracts.withColumn("item_field", F.lit("documents.abstract")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _split_items(spark, d).select("item_field", "item_id", "cut")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _split_items(spark, d).select("item_field", "item_id", F.posexplode("pieces").alias("ordinal", "p")).select(
        "item_field", "item_id", "ordinal", "p.start", "p.stop", "p.text")


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    related = splits.related_queries(*(_table(spark, d, t) for t in ("eval_queries", "citation_contexts", "documents")))
    return splits.assign_splits(written(related, "splits"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.straddling(_assigned(spark, d))


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d)


def _terms(spark: SparkSession, d: str) -> DataFrame:
    """Persistent counts, first built as the delta from nothing."""
    store = terms.TermCounts(spark, folder(spark, "counts"))
    return terms.term_table(store.apply(terms.signed_changes(None, terms.record_rows(_table(spark, d, "passages"))), "all passages"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.marks(_terms(spark, d))


def p6_lexeme_df(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d)


def p6_after_changes(spark: SparkSession, d: str) -> DataFrame:
    """The same counts by another way: of an earlier state of the passages (some with another text,
    some not there yet, some that were dropped since), then brought up to date by the signed delta."""
    now = written(terms.record_rows(_table(spark, d, "passages")), "terms")
    text = F.when(F.col("id") % 10 == 3, F.concat(F.lit("draft "), F.col("text"))).otherwise(F.col("text"))
    before = now.where("id % 10 <> 4").select("id", text.alias("text")).unionByName(now.where("id % 10 = 5").select((-F.col("id") - 1).alias("id"), "text"))
    store = terms.TermCounts(spark, folder(spark, "counts"))
    store.apply(terms.signed_changes(None, before), "first build")
    changes = terms.signed_changes(before, now)
    store.apply(changes, "update")
    return terms.term_table(store.apply(changes, "update"))  # a retry counts once


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    groups = near.near_duplicate_groups(_table(spark, d, "documents"), run=3, threshold=0.5)
    return near.group_pairs(groups).select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return near.near_duplicate_groups(_table(spark, d, "documents"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_table(_table(spark, d, "documents"))


def p8_offsets(spark: SparkSession, d: str) -> DataFrame:
    return tokens.offsets_table(_table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return p8_ids(spark, d).select("doc_id", tokens.decoded(F.col("ids")).alias("text"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix_sources(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix_sources(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose share is over the threshold; by that definition the estimate decides none of these
    rows (all over it are rejected, outliers or not), it decides outlier and rejected in p10_outliers."""
    return repetition.repetition_outliers(_table(spark, d, "documents")).where("over").select("doc_id")


def p10_outliers(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition_outliers(_table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        p1_found, p1_report, p1_classes, p2_found, p2_neighbours, p3_found, p3_golden, p4_found, p4_pieces, p5_found, p5_splits,
        p6_found, p6_lexeme_df, p6_after_changes, p7_found, p7_groups, p8_ids, p8_offsets, p8_decoded, p9_mixture, p9_report, p10_found, p10_outliers)}


P3_CTES = r"""WITH RECURSIVE link AS (SELECT d.doc_id AS a, d.canonical_doc_id AS b FROM documents d JOIN documents c ON c.doc_id = d.canonical_doc_id WHERE d.doc_id <> d.canonical_doc_id),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, a AS b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
grp AS (SELECT a AS doc_id, min(b) AS group_id FROM reach GROUP BY 1),
norm AS (SELECT d.*, g.group_id, regexp_replace(regexp_replace(lower(trim(d.doi, chr(9) || chr(10) || chr(13) || ' ')), '^(https?://[^/]*/|doi:)\s*', ''), '\.+$', '') AS nd FROM documents d JOIN grp g USING (doc_id)),
ranked AS (SELECT *, regexp_matches(nd, '^10\.[0-9]{4,9}/\S+$') AS usable,
  coalesce(list_position(['MED', 'PMC', 'AGR', 'CTX', 'ETH', 'PAT', 'PPR'], upper(trim(source))), 8) AS trust,
  coalesce(regexp_matches(pmid, '\S'), false)::INT + coalesce(regexp_matches(pmcid, '\S'), false)::INT + coalesce(regexp_matches(nd, '^10\.[0-9]{4,9}/\S+$'), false)::INT
  + coalesce(regexp_matches(abstract, '\S'), false)::INT + coalesce(regexp_matches(journal, '\S'), false)::INT + (pub_year IS NOT NULL)::INT AS filled FROM norm),
placed AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY trust, filled DESC, ingested_at DESC NULLS LAST, doc_id) AS place FROM ranked)"""

P3_SQL = P3_CTES + """
SELECT group_id, min(doc_id) FILTER (WHERE place = 1) AS doc_id, coalesce(arg_min(nd, place) FILTER (WHERE usable), '') AS doi FROM placed GROUP BY 1"""

P3_GOLDEN_SQL = P3_CTES + r""",
said AS (SELECT group_id, place, ingested_at, unnest(['journal', 'pub_year', 'cited_by']) AS field, unnest([journal, pub_year::VARCHAR, cited_by::VARCHAR]) AS value FROM placed),
vals AS (SELECT group_id, field, value, max(ingested_at) AS last, min(place) AS rk FROM said WHERE regexp_matches(value, '\S') GROUP BY 1, 2, 3),
step AS (SELECT lag(value) OVER w AS e, value AS l, lag(last) OVER w AS was, last FROM vals WHERE field = 'journal' AND last IS NOT NULL WINDOW w AS (PARTITION BY group_id ORDER BY last, value)),
seen AS (SELECT e, l, count(*) AS n FROM step WHERE e IS NOT NULL AND was < last GROUP BY 1, 2),
prec AS (SELECT e, l FROM (SELECT e, l, n FROM seen UNION ALL SELECT l, e, -n FROM seen) GROUP BY 1, 2 HAVING sum(n) > 0),
path AS (SELECT e, l, 1 AS k FROM prec UNION SELECT a.e, p.l, a.k + 1 FROM path a JOIN prec p ON a.l = p.e WHERE a.k < 8),
far AS (SELECT DISTINCT e, l FROM path),
judged AS (SELECT v.*, coalesce(v.last < max(v.last) OVER (PARTITION BY v.group_id, v.field), false) AS past, EXISTS (SELECT 1 FROM vals w WHERE w.group_id = v.group_id AND w.field = v.field AND w.value <> v.value
  AND (v.last IS NULL OR w.last IS NULL OR v.last = w.last) AND CASE WHEN v.field = 'journal' THEN (v.value, w.value) IN (SELECT (e, l) FROM far) AND (w.value, v.value) NOT IN (SELECT (e, l) FROM far)
  ELSE TRY_CAST(w.value AS DOUBLE) > TRY_CAST(v.value AS DOUBLE) END) AS learned FROM vals v),
curr AS (SELECT group_id, field, value FROM judged QUALIFY row_number() OVER (PARTITION BY group_id, field ORDER BY past OR learned, past, rk) = 1)
SELECT p.group_id, min(doc_id) FILTER (WHERE place = 1) AS doc_id, count(*) AS n_members, coalesce(arg_min(nd, place) FILTER (WHERE usable), '') AS doi,
  arg_min(pmid, place) FILTER (WHERE regexp_matches(pmid, '\S')) AS pmid, arg_min(pmcid, place) FILTER (WHERE regexp_matches(pmcid, '\S')) AS pmcid,
  arg_min(title, place) FILTER (WHERE regexp_matches(title, '\S')) AS title, arg_min(abstract, place) FILTER (WHERE regexp_matches(abstract, '\S')) AS abstract,
  (SELECT any_value(value) FROM curr c WHERE c.group_id = p.group_id AND field = 'journal') AS current_journal, (SELECT any_value(value) FROM curr c WHERE c.group_id = p.group_id AND field = 'pub_year') AS current_pub_year,
  (SELECT any_value(value) FROM curr c WHERE c.group_id = p.group_id AND field = 'cited_by') AS current_cited_by FROM placed p GROUP BY p.group_id"""

P4_SQL = """WITH item AS (SELECT 'passages.text' AS item_field, passage_id AS item_id, min(text) AS t, 1200 AS most FROM passages WHERE length(text) > 1200 AND passage_id IS NOT NULL GROUP BY passage_id
  UNION ALL SELECT 'documents.abstract', doc_id, min(abstract), 2500 FROM documents WHERE length(abstract) > 2500 AND doc_id IS NOT NULL GROUP BY doc_id)
SELECT item_field, item_id, CASE WHEN list_max(list_transform(regexp_split_to_array(t, '[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}.!?;。]'),
  lambda x: length(x))) > most THEN 'forced' ELSE 'natural' END AS cut FROM item"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries it can express exactly over whole tables. The others need a tokenizer,
    codebooks, iterations or an assignment; they are tested by brute force."""
    return {"p3_found": P3_SQL, "p3_golden": P3_GOLDEN_SQL, "p4_found": P4_SQL, **oracles.SQL}
