"""Every operator as a query over the test tables, and the SQL it must agree with.

Searches ask with every passage whose id is divisible by 100, against all
passages; metrics and mining use the labelled query sets whole.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.config import Settings
from tamarisk.functions.text import ABBREVIATIONS, CITATION_MARK, citing_sentences, hash_split, plain_query, sentences, tokens
from tamarisk.operators import arms, corpus, evalset, metrics, mining, pipeline, schema, store, tsquery
from tamarisk.operators.cover import cover_score
from tamarisk.operators.ml import embed_missing
from tamarisk.operators.search import Corpus, eval_queries
from tamarisk.plans.materialise import folder, shared_dir, written
from tamarisk.sources.records import normalise_records, read_runs, write_runs
from tamarisk.streaming.ingest import documents_table, in_order, ingest_stream, windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
K_FTS, K_RUN, DEPTH = 10, 50, 100
SWEEP = (0.0, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.7, 1.0)
CUTOFF = "2024-08-01 00:00:00"
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def sql(name: str, *ctes: str, body: str) -> None:
    _SQL[name] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def the_corpus(spark: SparkSession, d: str) -> Corpus:
    return Corpus(table(spark, d, "documents"), table(spark, d, "passages"))


# --- SQL that several queries share -------------------------------------------------

P = "p AS (SELECT DISTINCT passage_id, doc_id, ordinal, section, text FROM passages WHERE passage_id IS NOT NULL)"
TOK = "tok AS (SELECT passage_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS lexeme FROM p)"
STATS = """stats AS (SELECT lexeme, count(DISTINCT passage_id) AS ndoc, count(*) AS nentry,
  CAST(count(DISTINCT passage_id)::DOUBLE / (SELECT count(*) FROM p) AS FLOAT) AS df_frac FROM tok GROUP BY lexeme)"""
Q_PASSAGES = "q AS (SELECT passage_id AS query_id, text AS query_text FROM p WHERE passage_id % 100 = 0)"  # read as plain words


def q_eval(split: str, origin: str | None = None) -> str:
    more = f" AND origin = '{origin}'" if origin else ""
    return f"q AS (SELECT query_id, query_text FROM eval_queries WHERE lower(trim(split)) = '{split}'{more})"


TERMS = """w AS (SELECT query_id, lower(toks[i]) AS lexeme, min(i) AS pos FROM (
  SELECT query_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM (SELECT query_id, list_filter(regexp_extract_all(query_text, '[A-Za-z0-9]+'), lambda t: lower(t) <> 'or') AS toks FROM q)) GROUP BY 1, 2),
k AS (SELECT w.*, CASE WHEN s.df_frac > 0.05::DOUBLE THEN s.ndoc END AS nd FROM w LEFT JOIN stats s USING (lexeme)),
r AS (SELECT *, count(*) FILTER (WHERE nd IS NULL) OVER (PARTITION BY query_id) AS rare,
  row_number() OVER (PARTITION BY query_id, nd IS NULL ORDER BY nd, pos) AS place FROM k),
terms AS (SELECT query_id, lexeme FROM r WHERE nd IS NULL OR place <= 3 - rare)"""


def fts_cte(k: int) -> str:
    return f"""fts AS (SELECT query_id, passage_id, score, rank::INT AS rank FROM (SELECT query_id, passage_id, score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM (
    SELECT query_id, passage_id, round((count(*) * 0.1::DOUBLE) / (1 + count(*) * 0.1::DOUBLE), 6) AS score
    FROM tok JOIN terms USING (lexeme) GROUP BY 1, 2)) WHERE rank <= {k})"""


def dense_cte(k: int) -> str:
    return f"""v AS (SELECT passage_id, min(embedding) AS e FROM passages WHERE passage_id IS NOT NULL AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
dense AS (SELECT query_id, passage_id, score, rank::INT AS rank FROM (SELECT query_id, passage_id, score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM (
    SELECT a.passage_id AS query_id, b.passage_id, round(list_cosine_similarity(a.e::DOUBLE[], b.e::DOUBLE[]), 6) + 0.0 AS score
    FROM v a CROSS JOIN v b WHERE a.passage_id % 100 = 0)) WHERE rank <= {k})"""


RRF = f"""rrf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id)::INT AS rank FROM (
  SELECT query_id, passage_id, round(sum(part), 9) AS score, max(fts_score) AS fts_score, max(dense_score) AS dense_score FROM (
    SELECT query_id, passage_id, 0.5::DOUBLE / (60 + rank) AS part, score AS fts_score, NULL::DOUBLE AS dense_score FROM fts
    UNION ALL SELECT query_id, passage_id, 1.0::DOUBLE / (60 + rank), NULL, score FROM dense) GROUP BY 1, 2) QUALIFY rank <= {DEPTH})"""
HYBRID = (P, TOK, STATS, Q_PASSAGES, TERMS, fts_cte(DEPTH), dense_cte(DEPTH))
TITLE_KEY = "lower(regexp_replace(title, '[^A-Za-z0-9]', '', 'g'))"
CANON = f"""keyed AS (SELECT doc_id, source, {TITLE_KEY} AS nk FROM documents WHERE length({TITLE_KEY}) >= 10),
canon AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY nk ORDER BY coalesce(source = 'PPR', false), doc_id) AS canonical_doc_id FROM keyed)"""
LABELS = """labels AS (SELECT query_id, doc_id, max(relevance) AS relevance FROM eval_qrels WHERE relevance IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1, 2)"""
CLABELS = """cl AS (SELECT l.query_id, coalesce(c.canonical_doc_id, l.doc_id) AS doc_id, max(l.relevance) AS relevance
  FROM labels l LEFT JOIN canon c USING (doc_id) WHERE l.query_id IN (SELECT query_id FROM q) GROUP BY 1, 2)"""
CANDS = """cands AS (SELECT f.query_id, f.passage_id, p.doc_id, f.rank, coalesce(c.canonical_doc_id, p.doc_id) AS cluster
  FROM fts f JOIN p USING (passage_id) LEFT JOIN canon c ON c.doc_id = p.doc_id)"""
RANKED = """ranked AS (SELECT query_id, cluster AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY seen, cluster)::INT AS rank
  FROM (SELECT query_id, cluster, min(rank) AS seen FROM cands GROUP BY 1, 2))"""
METRICS = f"""ideal AS (SELECT query_id, count(*) FILTER (WHERE relevance > 0) AS n_rel,
  coalesce(sum(relevance / log2(i + 1)) FILTER (WHERE i <= 10), 0) AS idcg FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS i FROM cl) GROUP BY 1),
got AS (SELECT query_id, count(*) FILTER (WHERE relevance > 0 AND rank <= {K_RUN}) AS found, count(*) FILTER (WHERE relevance > 0 AND rank <= 10) AS top,
  min(rank) FILTER (WHERE relevance > 0) AS first, sum(relevance / log2(rank + 1)) FILTER (WHERE rank <= 10) AS dcg FROM ranked JOIN cl USING (query_id, doc_id) GROUP BY 1),
m AS (SELECT query_id, coalesce(CASE WHEN n_rel > 0 THEN found::DOUBLE / n_rel END, 0) AS recall, coalesce(top / 10.0::DOUBLE, 0) AS precision,
  coalesce(1.0::DOUBLE / first, 0) AS rr, coalesce(CASE WHEN idcg > 0 THEN dcg / idcg END, 0) AS ndcg FROM ideal LEFT JOIN got USING (query_id))"""
EVAL = (P, TOK, STATS, q_eval("test"), TERMS, fts_cte(K_RUN), CANON, LABELS, CLABELS, CANDS, RANKED)


# --- text and corpus ----------------------------------------------------------------

@query
def lexeme_df(spark, d):
    return corpus.lexeme_statistics(corpus.unique_passages(table(spark, d, "passages")))


sql("lexeme_df", P, TOK, STATS, body="SELECT lexeme, ndoc, nentry, df_frac FROM stats")


@query
def common_lexemes(spark, d):
    return corpus.common_lexemes(lexeme_df(spark, d))


sql("common_lexemes", P, TOK, STATS, body="SELECT lexeme, ndoc FROM stats WHERE df_frac > 0.05::DOUBLE")


@query
def stored_common_lexemes(spark, d):
    """The threshold scan over the stored statistics."""
    return corpus.common_lexemes(table(spark, d, "lexeme_df"))


sql("stored_common_lexemes", body="SELECT lexeme, ndoc FROM lexeme_df WHERE df_frac > 0.05::DOUBLE")


@query
def split_sentences(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(sentences(F.col("abstract"))).alias("ordinal", "sentence"))


_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ABBR = ", ".join(f"'{a}'" for a in ABBREVIATIONS)


def sents_cte(col: str) -> str:
    strip = lambda x: f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"
    tail = r"rtrim(lower(regexp_extract(acc, '([A-Za-z.]+)\.$', 1)), '.')"
    return rf"""parts AS (SELECT doc_id, title, string_split(regexp_replace({strip(f"regexp_replace(coalesce({col}, ''), '{_WS}+', ' ', 'g')")},
  '([.!?]) ([A-Z0-9(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ps FROM documents),
sents AS (SELECT doc_id, title, list_filter(list_transform(string_split(list_reduce(ps,
  lambda acc, x: CASE WHEN {tail} IN ({_ABBR}) OR length({tail}) = 1 THEN acc || ' ' || x ELSE acc || chr(1) || x END), chr(1)),
  lambda s: {strip('s')}), lambda s: s <> '') AS ss FROM parts)"""


sql("split_sentences", sents_cte("abstract"), body="SELECT doc_id, unnest(range(0, len(ss)))::INT AS ordinal, unnest(ss) AS sentence FROM sents")


@query
def passages_chunked(spark, d):
    return corpus.chunk_documents(table(spark, d, "documents"))


CHUNKS = rf"""wins AS (SELECT doc_id, title, ss, CASE WHEN len(ss) = 0 THEN []::VARCHAR[] ELSE list_filter(list_transform(
    range(0, CASE WHEN len(ss) <= 3 THEN 1 ELSE ceil((len(ss) - 3) / 2.0)::INT + 1 END),
    lambda i: CASE WHEN length(array_to_string(ss[i * 2 + 1 : i * 2 + 3], ' ')) > 1200
      THEN regexp_replace(substring(array_to_string(ss[i * 2 + 1 : i * 2 + 3], ' '), 1, 1200), ' [^ ]*$', '')
      ELSE array_to_string(ss[i * 2 + 1 : i * 2 + 3], ' ') END), lambda t: t <> '') END AS w FROM sents),
folded AS (SELECT doc_id, title, ss, CASE WHEN len(w) > 1 AND length(w[-1]) < 80
  THEN list_concat(w[1 : len(w) - 2], [substring(w[-2] || ' ' || w[-1], 1, 1200)]) ELSE w END AS w FROM wins),
heads AS (SELECT doc_id, w, substring(regexp_replace(regexp_replace(coalesce(title, ''), '^{_WS}+|{_WS}+$', '', 'g') || ' ' || coalesce(ss[1], ''), '^{_WS}+|{_WS}+$', '', 'g'), 1, 1200) AS head FROM folded),
pieces AS (SELECT doc_id, head, list_concat([head], w) AS ts FROM heads),
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ordinal, CASE WHEN t = head THEN 'title' ELSE 'abstract' END AS section, t AS text
  FROM (SELECT doc_id, any_value(head) AS head, t, min(i) AS i FROM (SELECT doc_id, head, unnest(ts) AS t, unnest(range(0, len(ts))) AS i FROM pieces) WHERE t <> '' GROUP BY doc_id, t))"""
sql("passages_chunked", sents_cte("abstract"), CHUNKS, body="SELECT doc_id, ordinal::INT AS ordinal, section, text FROM chunks")


@query
def citing_sentences_of_texts(spark, d):
    """Whole texts with a citation mark planted at each stop, as they have none of their own."""
    marked = F.regexp_replace("text", r"\. ", " [3, 14]. ")
    return table(spark, d, "documents").select("doc_id", F.explode(citing_sentences(marked)).alias("sentence"))


_MARK = CITATION_MARK
sql("citing_sentences_of_texts", sents_cte(r"regexp_replace(text, '\. ', ' [3, 14]. ', 'g')"), body=rf"""SELECT doc_id, s AS sentence FROM (SELECT doc_id,
  regexp_replace(regexp_replace(regexp_replace(s, '{_MARK}', '', 'g'), '^{_WS}+|{_WS}+$', '', 'g'), '{_WS}{{2,}}', ' ', 'g') AS s
  FROM (SELECT doc_id, unnest(ss) AS s FROM sents) WHERE regexp_matches(s, '{_MARK}')) WHERE length(s) BETWEEN 60 AND 400""")


@query
def lead_passages(spark, d):
    return corpus.lead_passages(table(spark, d, "passages"))


LEADS = "leads AS (SELECT doc_id, passage_id, text FROM p WHERE ordinal IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, passage_id) = 1)"
sql("lead_passages", P, LEADS, body="SELECT doc_id, passage_id, text FROM leads")


@query
def canonical_docs(spark, d):
    return corpus.canonical_documents(table(spark, d, "documents"))


sql("canonical_docs", CANON, body="SELECT doc_id, canonical_doc_id FROM canon")


@query
def canonical_stats(spark, d):
    return corpus.canonical_statistics(canonical_docs(spark, d))


sql("canonical_stats", CANON, body="""SELECT count(*) FILTER (WHERE canonical_doc_id <> doc_id) AS merged,
  count(DISTINCT canonical_doc_id) FILTER (WHERE canonical_doc_id <> doc_id) AS clusters FROM canon""")


@query
def split_assignment(spark, d):
    return table(spark, d, "documents").select("doc_id", hash_split(F.col("doc_id"), 0.2).alias("split"))


sql("split_assignment", body="""SELECT doc_id, CASE WHEN ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 100 < 20 THEN 'test' ELSE 'train' END AS split FROM documents""")


@query
def unembedded_passages(spark, d):
    return corpus.unembedded(table(spark, d, "passages"))


sql("unembedded_passages", P, body="""SELECT passage_id, doc_id, text FROM p
  WHERE passage_id NOT IN (SELECT passage_id FROM passages WHERE embedding IS NOT NULL AND passage_id IS NOT NULL)""")


@query
def corpus_stats(spark, d):
    return corpus.corpus_statistics(*(table(spark, d, t) for t in ("documents", "passages", "citation_contexts", "eval_queries", "eval_qrels")))


sql("corpus_stats", body="""SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS documents,
  (SELECT count(DISTINCT passage_id) FROM passages) AS passages,
  (SELECT count(*) FROM (SELECT passage_id FROM passages WHERE passage_id IS NOT NULL GROUP BY 1 HAVING count(embedding) = 0)) AS unembedded,
  (SELECT count(*) FROM (SELECT DISTINCT citing_doc_id, cited_doc_id, md5(context_text) FROM citation_contexts)) AS citation_contexts,
  (SELECT count(DISTINCT query_id) FROM eval_queries) AS eval_queries,
  (SELECT count(*) FROM (SELECT DISTINCT query_id, doc_id FROM eval_qrels)) AS eval_qrels""")


@query
def doc_with_passages(spark, d):
    nested = corpus.documents_with_passages(table(spark, d, "documents"), table(spark, d, "passages"))
    return nested.select("doc_id", "title", F.size("passages").alias("n_passages"),
                         F.array_join(F.transform("passages", lambda p: p["passage_id"].cast("string")), ",").alias("passage_ids"))


sql("doc_with_passages", P, body="""SELECT d.doc_id, any_value(d.title) AS title, count(p.passage_id)::INT AS n_passages,
  coalesce(string_agg(p.passage_id::VARCHAR, ',' ORDER BY p.ordinal NULLS FIRST, p.passage_id), '') AS passage_ids FROM documents d LEFT JOIN p USING (doc_id) GROUP BY d.doc_id""")


# --- arms ---------------------------------------------------------------------------

def _asked(spark, d) -> tuple[Corpus, DataFrame]:
    """Passages as queries: prose, so read as plain words."""
    c = the_corpus(spark, d)
    return c, c.passages.where("passage_id % 100 = 0").select(F.col("passage_id").alias("query_id"), F.col("text").alias("query_text"), plain_query(F.col("text")).alias("ask"))


def _fts(spark, d, k):
    c, q = _asked(spark, d)
    return c.lexical(q, k)


def _vectors(spark, d):
    return written(arms.unit_vectors(table(spark, d, "passages"), "passage_id", "embedding"), "vectors")


def _dense(spark, d, k):
    v = _vectors(spark, d)
    return arms.dense(v.where("id % 100 = 0"), v, k)


@query
def pruned_terms(spark, d):
    c, q = _asked(spark, d)
    return arms.query_terms(q, c.statistics, query_col="ask")


sql("pruned_terms", P, TOK, STATS, Q_PASSAGES, TERMS, body="SELECT query_id, lexeme FROM terms")


@query
def fts_topk(spark, d):
    return _fts(spark, d, K_FTS)


sql("fts_topk", P, TOK, STATS, Q_PASSAGES, TERMS, fts_cte(K_FTS), body="SELECT query_id, passage_id, score, rank FROM fts")


@query
def join_after_limit(spark, d):
    c, q = _asked(spark, d)
    return arms.with_titles(c.lexical(q, K_FTS), c.passages, c.documents).select(
        "query_id", "passage_id", "doc_id", "score", "rank", "title")


sql("join_after_limit", P, TOK, STATS, Q_PASSAGES, TERMS, fts_cte(K_FTS),
    body="SELECT f.query_id, f.passage_id, p.doc_id, f.score, f.rank, d.title FROM fts f JOIN p USING (passage_id) JOIN documents d ON d.doc_id = p.doc_id")


@query
def join_before_limit(spark, d):
    c, q = _asked(spark, d)
    return arms.titled_first(lambda p: c.lexical_scored(q, p, K_FTS), c.passages, c.documents, K_FTS).select("query_id", "passage_id", "doc_id", "score", "rank", "title")


_SQL["join_before_limit"] = _SQL["join_after_limit"]


@query
def dense_topk(spark, d):
    return _dense(spark, d, K_FTS)


sql("dense_topk", dense_cte(K_FTS), body="SELECT query_id, passage_id, score, rank FROM dense")


@query
def dense_with_titles(spark, d):
    """The dense arm's hits with document and title, joined after the cut."""
    c = the_corpus(spark, d)
    return arms.with_titles(_dense(spark, d, K_FTS), c.passages, c.documents).select("query_id", "passage_id", "doc_id", "score", "rank", "title")


sql("dense_with_titles", P, dense_cte(K_FTS),
    body="SELECT f.query_id, f.passage_id, p.doc_id, f.score, f.rank, d.title FROM dense f JOIN p USING (passage_id) JOIN documents d ON d.doc_id = p.doc_id")


@query
def ann_lsh(spark, d):
    """The approximate option: buckets where they give the k, exact otherwise."""
    v = _vectors(spark, d)
    return arms.dense_ann(v.where("id % 100 = 0"), v, K_FTS)


@query
def embedded_passages(spark, d):
    """Vectors by the default encoder for passages that have none stored."""
    have = arms.unit_vectors(table(spark, d, "passages"), "passage_id", "embedding")
    return embed_missing(corpus.unique_passages(table(spark, d, "passages")), have)


@query
def stemmed_lexemes(spark, d):
    return corpus.stemmed_postings(corpus.unique_passages(table(spark, d, "passages"))).groupBy("lexeme").agg(
        F.count(F.lit(1)).alias("ndoc"), F.sum("tf").alias("nentry"))


def _fused(spark, d, weights, k=DEPTH):
    return arms.fuse({"fts": _fts(spark, d, DEPTH), "dense": _dense(spark, d, DEPTH)}, k, 60, weights)


@query
def rrf_fuse(spark, d):
    return _fused(spark, d, {"fts": 0.5, "dense": 1.0}).select("query_id", "passage_id", "score", "rank")


sql("rrf_fuse", *HYBRID, RRF, body="SELECT query_id, passage_id, score, rank FROM rrf")


@query
def rrf_components(spark, d):
    c = F.col("components")
    return _fused(spark, d, {"fts": 0.5, "dense": 1.0}).select(
        "query_id", "passage_id", c.getItem("fts").alias("fts_score"), c.getItem("dense").alias("dense_score"))


sql("rrf_components", *HYBRID, RRF, body="SELECT query_id, passage_id, fts_score, dense_score FROM rrf")


def _own_citations(spark, d) -> DataFrame:
    """Labels for passage queries: what the passage's document cites."""
    p = corpus.unique_passages(table(spark, d, "passages")).where("passage_id % 100 = 0")
    c = table(spark, d, "citation_contexts").where("cited_doc_id is not null").select(F.col("citing_doc_id").alias("doc_id"), "cited_doc_id").distinct()
    return p.select(F.col("passage_id").alias("query_id"), "doc_id").join(c, "doc_id").select(
        "query_id", F.col("cited_doc_id").alias("doc_id"), F.lit(1).alias("relevance"))


@query
def rrf_weight_sweep(spark, d):
    """Retrieve once, keep the runs by label, fuse what is read back with every weight, score them in
    one plan; the best by nDCG is marked."""
    c, cache = the_corpus(spark, d), folder(spark, "runs")
    write_runs(_fts(spark, d, DEPTH), cache, "fts")
    write_runs(_dense(spark, d, DEPTH), cache, "dense")
    fts, dense = (read_runs(spark, cache, label).drop("label") for label in ("fts", "dense"))
    runs = None
    for w in SWEEP:
        one = arms.fuse({"fts": fts, "dense": dense}, K_RUN, 60, {"fts": w, "dense": 1.0}).select(F.lit(str(w)).alias("run"), "query_id", "passage_id", "rank")
        runs = one if runs is None else runs.unionByName(one)
    hits = runs.join(c.passages.select("passage_id", "doc_id"), "passage_id")
    per = metrics.query_metrics(metrics.collapse_to_documents(hits, "doc_id"), _own_citations(spark, d), [str(w) for w in SWEEP])
    t = metrics.summary(per).select("run", "n", F.round("recall", 6).alias("recall"), F.round("ndcg", 6).alias("ndcg"), F.round("mrr", 6).alias("mrr"))
    best = t.agg(F.max_by("run", F.struct("ndcg", F.col("run").cast("double")))).first()[0]
    return t.withColumn("best", F.col("run") == F.lit(best))


_SWEEP_VALUES = ", ".join(f"('{w}', {w}::DOUBLE)" for w in SWEEP)
sql("rrf_weight_sweep", *HYBRID, f"ws AS (SELECT * FROM (VALUES {_SWEEP_VALUES}) t(run, w))",
    f"""fr AS (SELECT run, query_id, passage_id, row_number() OVER (PARTITION BY run, query_id ORDER BY score DESC, passage_id) AS rank FROM (
  SELECT run, query_id, passage_id, round(sum(part), 9) AS score FROM (
    SELECT run, query_id, passage_id, w / (60 + rank) AS part FROM fts, ws WHERE w <> 0 UNION ALL SELECT run, query_id, passage_id, 1.0::DOUBLE / (60 + rank) FROM dense, ws)
  GROUP BY 1, 2, 3) QUALIFY rank <= {K_RUN})""",
    "dr AS (SELECT run, query_id, doc_id, row_number() OVER (PARTITION BY run, query_id ORDER BY seen, doc_id) AS rank FROM (SELECT run, query_id, doc_id, min(rank) AS seen FROM fr JOIN p USING (passage_id) GROUP BY 1, 2, 3))",
    "cl AS (SELECT DISTINCT p.passage_id AS query_id, c.cited_doc_id AS doc_id, 1 AS relevance FROM p JOIN citation_contexts c ON c.citing_doc_id = p.doc_id WHERE p.passage_id % 100 = 0 AND c.cited_doc_id IS NOT NULL)",
    """ideal AS (SELECT query_id, count(*) AS n_rel, sum(1 / log2(i + 1)) FILTER (WHERE i <= 10) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS i FROM cl) GROUP BY 1)""",
    f"""got AS (SELECT run, query_id, count(*) FILTER (WHERE rank <= {K_RUN}) AS found, min(rank) AS first, sum(1 / log2(rank + 1)) FILTER (WHERE rank <= 10) AS dcg FROM dr JOIN cl USING (query_id, doc_id) GROUP BY 1, 2)""",
    """t AS (SELECT run, count(*) AS n, round(avg(coalesce(found::DOUBLE / n_rel, 0)), 6) AS recall, round(avg(coalesce(dcg / idcg, 0)), 6) AS ndcg, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr
  FROM (SELECT run, i.* FROM ideal i, ws) LEFT JOIN got USING (run, query_id) GROUP BY 1)""",
    body="SELECT *, run = (SELECT run FROM t ORDER BY ndcg DESC, run::DOUBLE DESC LIMIT 1) AS best FROM t")


# Each sampled passage's first words, asked in the web grammar.
FIRST_WORDS = """fw AS (SELECT passage_id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda t: lower(t)), lambda t: t <> 'or') AS t FROM p WHERE passage_id % 100 = 0)"""
TOK_AT = """tp AS (SELECT passage_id, lower(ts[i]) AS lexeme, i AS pos FROM (SELECT passage_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM (
  SELECT passage_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS ts FROM p)))"""


def _first_words(c: Corpus) -> DataFrame:
    words = F.filter(tokens(F.col("text")), lambda t: t != "or")
    return c.passages.where("passage_id % 100 = 0").select(F.col("passage_id").alias("query_id"), words.alias("t"))


def _asked_with(spark, d, text, s: Settings = Settings()) -> DataFrame:
    c = Corpus(table(spark, d, "documents"), table(spark, d, "passages"), s)
    return c.search(_first_words(c).where(F.size("t") > 5).select("query_id", text.alias("query_text")), "fts", K_FTS).select(
        "query_id", "passage_id", "doc_id", "score", "rank")


def _word(i: int):
    return F.get("t", i)


@query
def fts_negation(spark, d):
    """a b c -d: any of three words, and not the fourth."""
    return _asked_with(spark, d, F.concat_ws(" ", _word(0), _word(1), _word(2), F.concat(F.lit("-"), _word(3))))


@query
def fts_web_or(spark, d):
    """a b or c -d: alternatives by name; each has its own negations. Beside them "-a", which gives nothing."""
    c = the_corpus(spark, d)
    w = _first_words(c).where(F.size("t") > 5)
    both = w.select("query_id", F.concat_ws(" ", _word(0), _word(1), F.lit("or"), _word(2), F.concat(F.lit("-"), _word(3))).alias("query_text")).unionByName(
        w.select((-F.col("query_id")).alias("query_id"), F.concat(F.lit("-"), _word(0)).alias("query_text")))
    return c.search(both, "fts", K_FTS).select("query_id", "passage_id", "doc_id", "score", "rank")


@query
def fts_phrase(spark, d):
    """"a b" in quotes: the words next to each other, in this order."""
    return _asked_with(spark, d, F.concat(F.lit('"'), _word(0), F.lit(" "), _word(1), F.lit('"')))


@query
def fts_all_words(spark, d):
    """Without or_semantics all of the words must be there (by the plan that joins before the limit)."""
    hits = _asked_with(spark, d, F.concat_ws(" ", _word(0), _word(1), _word(2), F.concat(F.lit("-"), _word(5))), Settings(or_semantics=False, join_after_limit=False))
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > 0).alias("n_scored"))


_HITS = """hit AS (SELECT query_id, passage_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id)::INT AS rank FROM (
  SELECT query_id, passage_id, round((n * 0.1::DOUBLE) / (1 + n * 0.1::DOUBLE), 6) AS score FROM n) QUALIFY rank <= 10)"""
_WITH_DOC = "SELECT query_id, passage_id, doc_id, score, rank FROM hit JOIN p USING (passage_id)"
sql("fts_negation", P, TOK, STATS, FIRST_WORDS, "q AS (SELECT passage_id AS query_id, array_to_string(t[1:3], ' ') AS query_text, t[4] AS ban FROM fw WHERE len(t) > 5)", TERMS,
    """n AS (SELECT t.query_id, k.passage_id, count(*) AS n FROM tok k JOIN terms t USING (lexeme) JOIN q USING (query_id)
  WHERE NOT EXISTS (SELECT 1 FROM tok b WHERE b.passage_id = k.passage_id AND b.lexeme = q.ban) GROUP BY 1, 2)""", _HITS, body=_WITH_DOC)
sql("fts_web_or", P, TOK, STATS, FIRST_WORDS, "q AS (SELECT passage_id AS query_id, array_to_string(t[1:3], ' ') AS query_text, t[1:2] AS ab, t[4] AS ban FROM fw WHERE len(t) > 5)", TERMS,
    """n AS (SELECT t.query_id, k.passage_id, count(*) AS n FROM tok k JOIN terms t USING (lexeme) JOIN q USING (query_id) GROUP BY t.query_id, k.passage_id, q.ab, q.ban
  HAVING bool_or(list_contains(q.ab, lexeme)) OR NOT EXISTS (SELECT 1 FROM tok b WHERE b.passage_id = k.passage_id AND b.lexeme = q.ban))""", _HITS, body=_WITH_DOC)
sql("fts_phrase", P, TOK_AT, FIRST_WORDS, """n AS (SELECT f.passage_id AS query_id, a.passage_id, count(*) AS n FROM fw f JOIN tp a ON a.lexeme = f.t[1]
  JOIN tp b ON b.passage_id = a.passage_id AND b.pos = a.pos + 1 AND b.lexeme = f.t[2] WHERE len(f.t) > 5 GROUP BY 1, 2)""", _HITS, body=_WITH_DOC)
sql("fts_all_words", P, TOK, FIRST_WORDS, """m AS (SELECT f.passage_id AS query_id, k.passage_id FROM fw f JOIN tok k ON k.lexeme IN (f.t[1], f.t[2], f.t[3]) WHERE len(f.t) > 5
  GROUP BY f.passage_id, f.t, k.passage_id HAVING count(DISTINCT k.lexeme) = len(list_distinct(f.t[1:3])) AND NOT EXISTS (SELECT 1 FROM tok b WHERE b.passage_id = k.passage_id AND b.lexeme = f.t[6]))""",
    body="SELECT query_id, least(count(*), 10) AS n, least(count(*), 10) AS n_scored FROM m GROUP BY 1")


PHRASE = "'insulator' <-> 'clusters' | 'splice' <-> 'site' & !'stress'"


@query
def phrase_match(spark, d):
    """A tree of phrases, conjunction and negation, compiled to one predicate."""
    toks = tokens(F.col("text"))
    p = corpus.unique_passages(table(spark, d, "passages")).select("passage_id", toks.alias("toks"))
    return p.where(tsquery.predicate(tsquery.parse(PHRASE), F.col("toks"))).select("passage_id")


sql("phrase_match", P, "t AS (SELECT passage_id, ' ' || lower(array_to_string(regexp_extract_all(text, '[A-Za-z0-9]+'), ' ')) || ' ' AS t FROM p)",
    body="SELECT passage_id FROM t WHERE contains(t, ' insulator clusters ') OR (contains(t, ' splice site ') AND NOT contains(t, ' stress '))")


@query
def conjunctive_cover_density(spark, d):
    """AND semantics: only matching passages are scored, by minimal covers."""
    q = "'insulator' & 'clusters' & 'regulator'"
    p = corpus.unique_passages(table(spark, d, "passages")).select("passage_id", tokens(F.col("text")).alias("toks"))
    hit = p.where(tsquery.predicate(tsquery.parse(q), F.col("toks"))).select(F.lit(1).alias("query_id"), "passage_id", F.round(cover_score(F.lit(q), F.col("toks")), 6).alias("score"))
    return arms.top(hit, DEPTH)


sql("conjunctive_cover_density", P, TOK_AT, "hw AS (SELECT * FROM tp WHERE lexeme IN ('insulator', 'clusters', 'regulator'))",
    """ends AS (SELECT passage_id, pos AS z, least(max(CASE WHEN lexeme = 'insulator' THEN pos END) OVER w, max(CASE WHEN lexeme = 'clusters' THEN pos END) OVER w,
  max(CASE WHEN lexeme = 'regulator' THEN pos END) OVER w) AS a, count(DISTINCT lexeme) OVER w AS n FROM hw WINDOW w AS (PARTITION BY passage_id ORDER BY pos))""",
    "covers AS (SELECT passage_id, a, min(z) AS z FROM ends WHERE n = 3 GROUP BY 1, 2)",  # of those with one start the shortest
    "part AS (SELECT c.passage_id, c.a, 0.1::DOUBLE / (1 + (c.z - c.a + 1) - count(*)) AS r FROM covers c JOIN hw h ON h.passage_id = c.passage_id AND h.pos BETWEEN c.a AND c.z GROUP BY c.passage_id, c.a, c.z)",
    "hit AS (SELECT passage_id, round(sum(r) / (1 + sum(r)), 6) AS score FROM part GROUP BY 1)",
    body="SELECT 1 AS query_id, passage_id, score, row_number() OVER (ORDER BY score DESC, passage_id)::INT AS rank FROM hit QUALIFY rank <= 100")


@query
def hybrid_rerank(spark, d):
    """The flagship: all four stages for every labelled test query, with a reranker trained
    on pairs mined from the training split."""
    c = the_corpus(spark, d)
    raw = table(spark, d, "eval_queries")
    c.train(eval_queries(raw, "train", "citation"), table(spark, d, "eval_qrels"), table(spark, d, "citation_contexts"))
    return c.search(eval_queries(raw, "test"), "hybrid_rerank", K_FTS).select("query_id", "passage_id", "doc_id", "title", "rank", F.round("score", 6).alias("score"), "reranked")


@query
def ablation_all_arms(spark, d):
    c = the_corpus(spark, d)
    raw, qrels = table(spark, d, "eval_queries"), table(spark, d, "eval_qrels")
    c.train(eval_queries(raw, "train", "citation"), qrels, table(spark, d, "citation_contexts"))
    return c.ablation(eval_queries(raw, "test"), qrels)


# --- labels and metrics -------------------------------------------------------------

def _references(spark, d) -> DataFrame:
    """A reference list as a service returns it: what citing documents cite, by outer ids."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ref_no"), F.lit(None).cast("string").alias("id"), "pmid", "pmcid", "doi")
    edges = table(spark, d, "citation_contexts").select(F.col("citing_doc_id").alias("doc_id"), F.col("cited_doc_id").alias("ref_no")).distinct()
    return edges.where("doc_id is not null").join(docs, "ref_no").select("doc_id", "ref_no", "id", "pmid", "pmcid", "doi")


_ID = f"nullif(lower(regexp_replace(%s, '^{_WS}+|{_WS}+$', '', 'g')), '')"
RESOLVED = f"""idmap AS (SELECT key, min(doc_id) AS cited FROM (SELECT doc_id, {_ID % 'k'} AS key FROM (SELECT doc_id, unnest([pmid, pmcid, doi]) AS k FROM documents)) WHERE key IS NOT NULL GROUP BY 1),
refs AS (SELECT DISTINCT c.citing_doc_id AS doc_id, c.cited_doc_id AS ref_no, d.pmid, d.pmcid, d.doi FROM citation_contexts c JOIN documents d ON d.doc_id = c.cited_doc_id WHERE c.citing_doc_id IS NOT NULL),
wanted AS (SELECT doc_id, ref_no, place, {_ID % 'k'} AS key FROM (SELECT doc_id, ref_no, unnest([pmid, pmcid, doi]) AS k, unnest([1, 2, 3]) AS place FROM refs)),
resolved AS (SELECT DISTINCT doc_id, cited_doc_id FROM (SELECT w.doc_id, w.ref_no, arg_min(m.cited, w.place) AS cited_doc_id FROM wanted w JOIN idmap m USING (key) GROUP BY 1, 2) WHERE cited_doc_id <> doc_id)"""


@query
def citation_resolve(spark, d):
    return evalset.resolve_references(_references(spark, d), table(spark, d, "documents"))


sql("citation_resolve", RESOLVED, body="SELECT doc_id, cited_doc_id FROM resolved")


@query
def citation_pairs(spark, d):
    docs = table(spark, d, "documents")
    return evalset.citation_pairs(written(evalset.resolve_references(_references(spark, d), docs), "refs"), docs)


sql("citation_pairs", RESOLVED, body="""SELECT r.doc_id AS citing_doc_id, r.cited_doc_id, d.title AS context_text FROM resolved r JOIN documents d USING (doc_id)
  WHERE r.doc_id IN (SELECT doc_id FROM resolved GROUP BY 1 HAVING count(DISTINCT cited_doc_id) >= 3)""")


@query
def to_harvest(spark, d):
    """Top documents still without contexts (the limit is the feature)."""
    return evalset.to_harvest(table(spark, d, "documents"), table(spark, d, "citation_contexts"))


sql("to_harvest", body="""SELECT doc_id, source, ext_id, title, cited_by FROM documents d WHERE NOT EXISTS (SELECT 1 FROM citation_contexts c WHERE c.citing_doc_id = d.doc_id)
  ORDER BY cited_by DESC NULLS FIRST, doc_id LIMIT 2000""")


@query
def eval_queries_built(spark, d):
    return evalset.citation_eval_set(table(spark, d, "citation_contexts"))[0]


BUILT = """kept AS (SELECT citing_doc_id, context_text FROM citation_contexts WHERE context_text IS NOT NULL GROUP BY 1, 2 HAVING count(cited_doc_id) >= 2)"""
sql("eval_queries_built", BUILT, body="""SELECT context_text AS query_text,
  CASE WHEN ('0x' || substr(sha256(max(citing_doc_id)::VARCHAR), 1, 8))::BIGINT % 100 < 20 THEN 'test' ELSE 'train' END AS split FROM kept GROUP BY 1""")


@query
def qrels_built(spark, d):
    return evalset.citation_eval_set(table(spark, d, "citation_contexts"))[1]


sql("qrels_built", BUILT, body="""SELECT DISTINCT c.context_text AS query_text, c.cited_doc_id AS doc_id, 1 AS relevance FROM citation_contexts c
  JOIN kept k ON c.citing_doc_id = k.citing_doc_id AND c.context_text = k.context_text WHERE c.cited_doc_id IS NOT NULL""")


@query
def eval_set(spark, d):
    """Labelled manual test queries, the label map as sorted text."""
    s = evalset.load_eval_set(table(spark, d, "eval_queries"), table(spark, d, "eval_qrels"))
    entry = lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))
    return s.select("query_id", "query_text", F.array_join(F.transform(F.map_entries("qrels"), entry), ",").alias("qrels"))


sql("eval_set", q_eval("test", "manual"), LABELS, body="""SELECT q.query_id, q.query_text, string_agg(l.doc_id || ':' || l.relevance, ',' ORDER BY l.doc_id) AS qrels
  FROM q JOIN labels l USING (query_id) GROUP BY 1, 2""")


def _eval_run(spark, d):
    c, q = the_corpus(spark, d), eval_queries(table(spark, d, "eval_queries"), "test")
    cands = written(c.candidates(q, "fts", K_RUN), "run").withColumn("run", F.lit("fts"))
    labels = metrics.collapse_labels(corpus.to_canonical(evalset.labels_of(table(spark, d, "eval_qrels")), c.clusters)).join(q.select("query_id"), "query_id", "left_semi")
    return cands, labels


@query
def qrels_collapsed(spark, d):
    cmap = corpus.canonical_map(corpus.canonical_documents(table(spark, d, "documents")))
    return metrics.collapse_labels(corpus.to_canonical(evalset.labels_of(table(spark, d, "eval_qrels")), cmap))


sql("qrels_collapsed", CANON, LABELS, body="""SELECT l.query_id, coalesce(c.canonical_doc_id, l.doc_id) AS doc_id, max(l.relevance) AS relevance
  FROM labels l LEFT JOIN canon c USING (doc_id) GROUP BY 1, 2""")


@query
def doc_ranking(spark, d):
    return metrics.collapse_to_documents(_eval_run(spark, d)[0]).select("query_id", "doc_id", "rank")


sql("doc_ranking", *EVAL, body="SELECT query_id, doc_id, rank FROM ranked")


def _per_query(spark, d):
    cands, labels = _eval_run(spark, d)
    return metrics.query_metrics(metrics.collapse_to_documents(cands), labels, ["fts"])


def _measure(name: str, column: str) -> None:
    def run(spark, d):
        return _per_query(spark, d).select("query_id", F.round(column, 6).alias(column))

    run.__name__ = name
    query(run)
    sql(name, *EVAL, METRICS, body=f"SELECT query_id, round({column}, 6) AS {column} FROM m")


for _name, _column in (("recall_at_k", "recall"), ("precision_at_k", "precision"), ("reciprocal_rank", "rr"), ("ndcg_at_k", "ndcg")):
    _measure(_name, _column)


@query
def ablation_fts(spark, d):
    t = metrics.summary(_per_query(spark, d))
    return t.select("run", "n", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "ndcg", "mrr")])


sql("ablation_fts", *EVAL, METRICS, body="""SELECT 'fts' AS run, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision,
  round(avg(ndcg), 6) AS ndcg, round(avg(rr), 6) AS mrr FROM m""")


@query
def distinct_docs_in_run(spark, d):
    return metrics.distinct_documents(_eval_run(spark, d)[0])


sql("distinct_docs_in_run", *EVAL, body="""SELECT 'fts' AS run, avg(n) AS mean_docs, min(n) AS min_docs FROM (SELECT query_id, count(DISTINCT doc_id) AS n FROM cands GROUP BY 1)""")


@query
def latency_percentiles(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(metrics.nearest_rank("value", 0.5).alias("p50"), metrics.nearest_rank("value", 0.95).alias("p95"))


sql("latency_percentiles", body="SELECT event_type, coalesce(quantile_disc(value, 0.5), 0) AS p50, coalesce(quantile_disc(value, 0.95), 0) AS p95 FROM events GROUP BY 1")


@query
def pool_for_judging(spark, d):
    """What three arms rank first, for a person to judge (the fourth needs a trained model; it is in ``Corpus``)."""
    c, q = _asked(spark, d)
    base = {"fts": written(_fts(spark, d, DEPTH), "runs"), "dense": written(_dense(spark, d, DEPTH), "runs")}
    runs = arms.fuse(base, K_FTS, 60, {"fts": 0.5, "dense": 1.0}).drop("components").withColumn("run", F.lit("hybrid"))
    for arm, run in base.items():
        runs = runs.unionByName(run.where(F.col("rank") <= K_FTS).withColumn("run", F.lit(arm)))
    return evalset.pool_for_judging(written(runs, "runs"), c.passages, c.documents, q, ("fts", "dense", "hybrid"))


sql("pool_for_judging", *HYBRID, RRF,
    """hit AS (SELECT r.*, p.doc_id, p.text FROM (SELECT query_id, passage_id, rank, 'fts' AS run, 1 AS place FROM fts UNION ALL SELECT query_id, passage_id, rank, 'dense', 2 FROM dense
  UNION ALL SELECT query_id, passage_id, rank, 'hybrid', 3 FROM rrf) r JOIN p USING (passage_id) WHERE rank <= 10)""",
    body="""SELECT q.query_text AS query, h.doc_id, d.title, h.passage, h.found_by, '' AS relevance FROM (
  SELECT query_id, doc_id, string_agg(DISTINCT run, '|' ORDER BY run) AS found_by, arg_min(substring(text, 1, 300), place * 1000 + rank) AS passage FROM hit GROUP BY 1, 2) h
  JOIN documents d USING (doc_id) JOIN q USING (query_id)""")


@query
def eval_set_prefix(spark, d):
    """The first 25 labelled queries by id (the limit is the feature)."""
    s = evalset.load_eval_set(table(spark, d, "eval_queries"), table(spark, d, "eval_qrels"), "train", "citation")
    return evalset.ranked_prefix(s, 25).select("query_id", "query_text", F.size("qrels").alias("n_labels"))


sql("eval_set_prefix", q_eval("train", "citation"), LABELS, body="""SELECT q.query_id, q.query_text, count(*)::INT AS n_labels FROM q JOIN labels l USING (query_id) GROUP BY 1, 2
  ORDER BY query_id LIMIT 25""")


@query
def deltas_to_baseline(spark, d):
    """Each event type's mean value against that of the first type, as runs are held against a baseline run."""
    t = table(spark, d, "events").groupBy(F.col("event_type").alias("run")).agg(F.avg("value").alias("mean"))
    first = table(spark, d, "events").agg(F.min("event_type")).first()[0]
    return metrics.against_baseline(t, first, ["mean"]).select("run", F.round("mean", 6).alias("mean"), F.round("mean_delta", 6).alias("mean_delta"))


sql("deltas_to_baseline", "t AS (SELECT event_type AS run, avg(value) AS mean FROM events GROUP BY 1)",
    body="SELECT run, round(mean, 6) AS mean, round(mean / (SELECT mean FROM t ORDER BY run LIMIT 1) - 1, 6) AS mean_delta FROM t")


@query
def import_qrels(spark, d):
    """Judged rows as a person would leave them: blanks where there is no grade."""
    j = table(spark, d, "eval_qrels").join(table(spark, d, "eval_queries").select("query_id", F.col("query_text").alias("query")), "query_id")
    return evalset.import_judgements(j.select("query", "doc_id", F.coalesce(F.concat(F.lit(" "), F.col("relevance").cast("string")), F.lit("")).alias("relevance")))


sql("import_qrels", body=f"""SELECT regexp_replace(e.query_text, '^{_WS}+|{_WS}+$', '', 'g') AS query, r.doc_id, max(r.relevance) AS relevance FROM eval_qrels r JOIN eval_queries e USING (query_id)
  WHERE r.relevance IS NOT NULL GROUP BY 1, 2""")


# --- mining -------------------------------------------------------------------------

def _mining(spark, d):
    c = the_corpus(spark, d)
    q = eval_queries(table(spark, d, "eval_queries"), "train", "citation")
    cands = written(c.candidates(q, "fts", K_RUN), "mining")
    labels = corpus.to_canonical(evalset.labels_of(table(spark, d, "eval_qrels")), c.clusters).join(q.select("query_id"), "query_id", "left_semi")
    blocked = corpus.to_canonical(mining.own_papers(q, table(spark, d, "citation_contexts")), c.clusters)
    with_labels = q.join(labels.select("query_id").distinct(), "query_id", "left_semi")
    cands = cands.join(with_labels.select("query_id"), "query_id", "left_semi")
    return written(with_labels, "mining"), cands, written(labels, "mining"), written(blocked, "mining"), corpus.lead_passages(table(spark, d, "passages"))


MINING = (P, TOK, STATS, q_eval("train", "citation"), TERMS, fts_cte(K_RUN), CANON, LABELS, CANDS,
          """lb AS (SELECT l.*, coalesce(c.canonical_doc_id, l.doc_id) AS cluster FROM labels l LEFT JOIN canon c USING (doc_id) WHERE query_id IN (SELECT query_id FROM q))""",
          """own AS (SELECT DISTINCT q.query_id, coalesce(c.canonical_doc_id, x.citing_doc_id) AS cluster FROM q JOIN citation_contexts x ON x.context_text = q.query_text
  LEFT JOIN canon c ON c.doc_id = x.citing_doc_id)""",
          """fl AS (SELECT c.*, (c.query_id, c.cluster) IN (SELECT (query_id, cluster) FROM lb WHERE relevance > 0) AS is_pos,
  (c.query_id, c.doc_id) IN (SELECT (query_id, doc_id) FROM lb WHERE relevance > 0) AS is_judged,
  (c.query_id, c.cluster) IN (SELECT (query_id, cluster) FROM own) AS is_own FROM cands c WHERE c.query_id IN (SELECT query_id FROM lb))""",
          """neg AS (SELECT query_id, passage_id, doc_id, rank FROM (SELECT * FROM fl WHERE NOT is_pos AND NOT is_own QUALIFY row_number() OVER (PARTITION BY query_id, cluster ORDER BY rank) = 1)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 8)""", LEADS,
          """pos AS (SELECT query_id, passage_id, doc_id, kind FROM (SELECT l.query_id, l.cluster, l.doc_id AS judged, coalesce(b.passage_id, ld.passage_id) AS passage_id,
    CASE WHEN b.passage_id IS NOT NULL THEN b.doc_id ELSE ld.doc_id END AS doc_id, CASE WHEN b.passage_id IS NOT NULL THEN 'positive_retrieved' ELSE 'positive_fallback' END AS kind
    FROM lb l LEFT JOIN (SELECT query_id, cluster, arg_min(passage_id, rank) AS passage_id, arg_min(doc_id, rank) AS doc_id FROM fl GROUP BY 1, 2) b USING (query_id, cluster)
    LEFT JOIN leads ld ON ld.doc_id = l.doc_id WHERE l.relevance > 0 AND coalesce(b.passage_id, ld.passage_id) IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY l.query_id, l.cluster ORDER BY l.doc_id) = 1) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY judged) <= 8)""")


@query
def hard_negatives(spark, d):
    _, cands, labels, blocked, _ = _mining(spark, d)
    return mining.hard_negatives(cands, labels, blocked)


sql("hard_negatives", *MINING, body="SELECT query_id, passage_id, doc_id, rank FROM neg")


@query
def training_pairs(spark, d):
    _, cands, labels, blocked, leads = _mining(spark, d)
    return mining.training_pairs(cands, labels, blocked, leads)


sql("training_pairs", *MINING, body="""SELECT * FROM (SELECT query_id, passage_id, doc_id, 1.0::DOUBLE AS label, kind FROM pos UNION ALL SELECT query_id, passage_id, doc_id, 0.0::DOUBLE, 'hard_negative' FROM neg)
  WHERE query_id IN (SELECT query_id FROM pos) AND query_id IN (SELECT query_id FROM neg)""")


@query
def mining_stats(spark, d):
    return mining.mining_statistics(*_mining(spark, d))


sql("mining_stats", *MINING,
    "nn AS (SELECT query_id, count(*) AS n_neg, max(rank) AS last FROM neg GROUP BY 1)", "np AS (SELECT query_id, count(*) AS n_pos FROM pos GROUP BY 1)",
    """bl AS (SELECT f.query_id, count(*) FILTER (WHERE is_pos AND NOT is_judged) AS twins, count(*) FILTER (WHERE NOT is_pos AND is_own) AS own FROM fl f LEFT JOIN nn USING (query_id)
  WHERE f.rank < CASE WHEN coalesce(nn.n_neg, 0) >= 8 THEN nn.last ELSE 2147483647 END GROUP BY 1)""",
    """e AS (SELECT x.query_id, coalesce(n_neg, 0) AS n_neg, coalesce(n_pos, 0) AS n_pos, coalesce(twins, 0) AS twins, coalesce(own, 0) AS own
  FROM (SELECT DISTINCT query_id FROM lb) x LEFT JOIN nn USING (query_id) LEFT JOIN np USING (query_id) LEFT JOIN bl USING (query_id))""",
    body="""SELECT count(*) AS queries_seen, count(*) FILTER (WHERE n_neg > 0 AND n_pos > 0) AS queries_used, count(*) FILTER (WHERE n_neg = 0) AS queries_without_negatives,
  count(*) FILTER (WHERE n_neg > 0 AND n_pos = 0) AS queries_without_positives, coalesce(sum(n_pos) FILTER (WHERE n_neg > 0 AND n_pos > 0), 0)::BIGINT AS positives,
  coalesce(sum(n_neg) FILTER (WHERE n_neg > 0 AND n_pos > 0), 0)::BIGINT AS negatives, coalesce(sum(twins), 0)::BIGINT AS twins_blocked, coalesce(sum(own), 0)::BIGINT AS self_matches_blocked FROM e""")


# --- write path, sources, streams ---------------------------------------------------

def _redelivered(docs: DataFrame) -> DataFrame:
    """All documents delivered again, with changed titles and counts, some without abstract."""
    return docs.select("source", "ext_id", "pmid", "pmcid", "doi", F.concat(F.coalesce("title", F.lit("")), F.lit(" (v2)")).alias("title"),
                       F.when(F.col("pub_year") % 2 == 0, F.col("abstract")).alias("abstract"), "journal", "pub_year",
                       (F.coalesce("cited_by", F.lit(0)) + 1).alias("cited_by"), "is_open_access", "ingested_at", F.col("doc_id").alias("arrived"))


def _stored(docs: DataFrame) -> DataFrame:
    old = docs.where(F.col("ingested_at") < F.lit(CUTOFF).cast("timestamp"))
    once = evalset.first_per(old, ["source", "ext_id"], ["doc_id"])
    return once.select("doc_id", "source", "ext_id", "pmid", "pmcid", "doi", "title", "abstract", "journal", "pub_year", "cited_by", "is_open_access", "ingested_at")


@query
def upsert_documents(spark, d):
    docs = table(spark, d, "documents")
    new = _redelivered(docs)
    out = store.upsert_documents(_stored(docs), new.withColumn("ingested_at", F.col("ingested_at")), "arrived")
    return out.select("doc_id", "source", "ext_id", "pmid", "title", "abstract", "cited_by")


sql("upsert_documents",
    f"st AS (SELECT * FROM documents WHERE ingested_at < TIMESTAMPTZ '{CUTOFF}+00' QUALIFY row_number() OVER (PARTITION BY source, ext_id ORDER BY doc_id) = 1)",
    """nw AS (SELECT source, ext_id, pmid, coalesce(title, '') || ' (v2)' AS title, CASE WHEN pub_year % 2 = 0 THEN abstract END AS abstract, coalesce(cited_by, 0) + 1 AS cited_by
  FROM documents QUALIFY row_number() OVER (PARTITION BY source, ext_id ORDER BY doc_id DESC) = 1)""",
    body="""SELECT s.doc_id, s.source, s.ext_id, s.pmid, n.title, coalesce(n.abstract, s.abstract) AS abstract, n.cited_by FROM st s JOIN nw n ON s.source = n.source AND s.ext_id = n.ext_id
UNION ALL SELECT (SELECT max(doc_id) FROM st) + row_number() OVER (ORDER BY n.source, n.ext_id), n.source, n.ext_id, n.pmid, n.title, n.abstract, n.cited_by
  FROM nw n ANTI JOIN st s ON s.source = n.source AND s.ext_id = n.ext_id""")


@query
def insert_ignore_passages(spark, d):
    """Stored passages, and chunks of all documents where (doc_id, ordinal) is new."""
    have = corpus.unique_passages(table(spark, d, "passages")).groupBy("doc_id", "ordinal").agg(F.min(F.struct("section", "text")).alias("r")).select("doc_id", "ordinal", "r.*")
    return store.insert_passages(have, corpus.chunk_documents(table(spark, d, "documents")))


sql("insert_ignore_passages", sents_cte("abstract"), CHUNKS, P,
    "have AS (SELECT doc_id, ordinal, section, text FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, ordinal ORDER BY section NULLS FIRST, text NULLS FIRST) = 1)",
    body="SELECT * FROM have UNION ALL SELECT c.doc_id, c.ordinal::INT, c.section, c.text FROM chunks c ANTI JOIN have h ON h.doc_id = c.doc_id AND h.ordinal = c.ordinal")


@query
def insert_ignore_contexts(spark, d):
    c = table(spark, d, "citation_contexts").select("citing_doc_id", "cited_doc_id", "context_text")
    return store.insert_contexts(c.where("false"), c)


sql("insert_ignore_contexts", body="SELECT DISTINCT citing_doc_id, cited_doc_id, context_text FROM citation_contexts")


@query
def upsert_qrels(spark, d):
    """Judged grades over derived ones: citations label 1, then the judgements replace."""
    derived = _own_labels(spark, d)
    return store.upsert_labels(derived, evalset.labels_of(table(spark, d, "eval_qrels")), judged=True)


def _own_labels(spark, d) -> DataFrame:
    q = table(spark, d, "eval_queries").select("query_id", F.col("query_text").alias("context_text"))
    c = table(spark, d, "citation_contexts").where("cited_doc_id is not null").select("context_text", F.col("cited_doc_id").alias("doc_id")).distinct()
    return q.join(c, "context_text").select("query_id", "doc_id", F.lit(1).alias("relevance")).distinct()


sql("upsert_qrels", LABELS, "der AS (SELECT DISTINCT q.query_id, c.cited_doc_id AS doc_id FROM eval_queries q JOIN citation_contexts c ON c.context_text = q.query_text WHERE c.cited_doc_id IS NOT NULL)",
    body="SELECT coalesce(l.query_id, d.query_id) AS query_id, coalesce(l.doc_id, d.doc_id) AS doc_id, coalesce(l.relevance, 1) AS relevance FROM der d FULL JOIN labels l ON l.query_id = d.query_id AND l.doc_id = d.doc_id")


@query
def normalised_records(spark, d):
    """Documents written as raw records, and read back in normal form."""
    docs = table(spark, d, "documents")
    raw = docs.select(F.to_json(F.struct(
        F.when(F.upper("source") == "MED", F.lit("")).otherwise(F.col("source")).alias("source"), F.concat(F.lit(" "), F.col("ext_id")).alias("id"),
        "pmid", "pmcid", "doi", "title", F.col("abstract").alias("abstractText"), F.concat(F.col("pub_year").cast("string"), F.when(F.col("cited_by") % 5 == 0, "?").otherwise("")).alias("pubYear"),
        F.col("cited_by").cast("string").alias("citedByCount"), F.when(F.col("is_open_access"), "Y").otherwise("N").alias("isOpenAccess"), F.col("journal").alias("journalTitle"))).alias("record"))
    return normalise_records(raw).select("source", "ext_id", "title", "abstract", "journal", "pub_year", "cited_by", "is_open_access")


_STRIP = f"regexp_replace(%s, '^{_WS}+|{_WS}+$', '', 'g')"
sql("normalised_records", body=f"""SELECT CASE WHEN coalesce(source, '') = '' OR upper(source) = 'MED' THEN 'MED' ELSE source END AS source, {_STRIP % "coalesce(ext_id, '')"} AS ext_id,
  {_STRIP % 'title'} AS title, nullif({_STRIP % 'abstract'}, '') AS abstract, journal, CASE WHEN cited_by % 5 = 0 THEN NULL ELSE pub_year END AS pub_year,
  coalesce(cited_by, 0) AS cited_by, coalesce(is_open_access, false) AS is_open_access FROM documents WHERE {_STRIP % "coalesce(title, '')"} <> '' AND {_STRIP % "coalesce(ext_id, '')"} <> '' AND {_STRIP % "coalesce(abstract, '')"} <> ''""")


@query
def point_lookups(spark, d):
    """Each labelled document looked up by its id; some ids have no document."""
    wanted = table(spark, d, "eval_qrels").select("doc_id").unionByName(table(spark, d, "eval_qrels").select((-F.col("doc_id")).alias("doc_id")))
    got = corpus.get_documents(wanted, table(spark, d, "documents"), table(spark, d, "passages"))
    return got.select("doc_id", "found", "title", F.coalesce(F.size("passages"), F.lit(0)).alias("n_passages"))


sql("point_lookups", P, "w AS (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM eval_qrels UNION ALL SELECT -doc_id FROM eval_qrels) WHERE doc_id IS NOT NULL)",
    body="""SELECT w.doc_id, d.doc_id IS NOT NULL AS found, any_value(d.title) AS title, count(p.passage_id)::INT AS n_passages
  FROM w LEFT JOIN documents d USING (doc_id) LEFT JOIN p ON p.doc_id = d.doc_id GROUP BY 1, 2""")


@query
def published_lexemes(spark, d):
    """The statistics put in place of the stored ones in one step, and read from there."""
    path = f"{shared_dir(spark)}/published-{uuid.uuid4().hex}"
    store.publish(table(spark, d, "lexeme_df").select("lexeme", F.col("ndoc").cast("long"), "df_frac"), path)
    return store.publish(lexeme_df(spark, d).select("lexeme", "ndoc", "df_frac"), path)


sql("published_lexemes", P, TOK, STATS, body="SELECT lexeme, ndoc, df_frac FROM stats")


@query
def upserted_queries(spark, d):
    """Stored queries after those derived from citations came in: splits set, new ones numbered."""
    return pipeline.build_eval_set(table(spark, d, "citation_contexts"), table(spark, d, "eval_queries"), evalset.labels_of(table(spark, d, "eval_qrels")))[0]


UPSERTED = """der AS (SELECT context_text AS query_text, CASE WHEN ('0x' || substr(sha256(max(citing_doc_id)::VARCHAR), 1, 8))::BIGINT % 100 < 20 THEN 'test' ELSE 'train' END AS split FROM kept GROUP BY 1),
uq AS (SELECT e.query_id, e.query_text, e.origin, coalesce(d.split, e.split) AS split FROM eval_queries e LEFT JOIN der d USING (query_text)
  UNION ALL SELECT (SELECT max(query_id) FROM eval_queries) + row_number() OVER (ORDER BY query_text), query_text, 'citation', split FROM der d
  WHERE NOT EXISTS (SELECT 1 FROM eval_queries e WHERE e.query_text = d.query_text))"""
sql("upserted_queries", BUILT, UPSERTED, body="SELECT query_id, query_text, origin, split FROM uq")


@query
def derived_labels(spark, d):
    """Labels after the derived ones came in by the ids of their queries: judged grades stay."""
    return pipeline.build_eval_set(table(spark, d, "citation_contexts"), table(spark, d, "eval_queries"), evalset.labels_of(table(spark, d, "eval_qrels")))[1]


sql("derived_labels", BUILT, UPSERTED, LABELS, """nl AS (SELECT DISTINCT u.query_id, c.cited_doc_id AS doc_id FROM citation_contexts c
  JOIN kept k ON c.citing_doc_id = k.citing_doc_id AND c.context_text = k.context_text JOIN uq u ON u.query_text = c.context_text WHERE c.cited_doc_id IS NOT NULL)""",
    body="SELECT query_id, doc_id, relevance FROM labels UNION ALL SELECT query_id, doc_id, 1 FROM nl ANTI JOIN labels l USING (query_id, doc_id)")


@query
def upserted_log(spark, d):
    """The ingest log after every other query was fetched again a day later, and a new one came."""
    log = table(spark, d, "ingest_log")
    again = log.where("n_docs % 2 = 0").select("query", (F.col("n_docs") + 1).alias("n_docs"), (F.col("fetched_at") + F.expr("interval 1 day")).alias("fetched_at"))
    new = log.select(F.concat(F.lit("new "), F.col("query")).alias("query"), "n_docs", "fetched_at")
    return store.upsert_log(log, again.unionByName(new)).select("query", "n_docs", F.unix_micros("fetched_at").alias("fetched_us"))


sql("upserted_log", """lg AS (SELECT * FROM ingest_log QUALIFY row_number() OVER (PARTITION BY query ORDER BY fetched_at DESC, n_docs DESC) = 1)""",
    """ag AS (SELECT query, n_docs + 1 AS n_docs, fetched_at + INTERVAL 1 DAY AS fetched_at FROM ingest_log WHERE n_docs % 2 = 0 UNION ALL SELECT 'new ' || query, n_docs, fetched_at FROM ingest_log)""",
    "la AS (SELECT * FROM ag QUALIFY row_number() OVER (PARTITION BY query ORDER BY fetched_at DESC, n_docs DESC) = 1)",
    body="SELECT coalesce(a.query, l.query) AS query, coalesce(a.n_docs, l.n_docs) AS n_docs, epoch_us(coalesce(a.fetched_at, l.fetched_at)) AS fetched_us FROM lg l FULL JOIN la a USING (query)")


def _raw_records(docs: DataFrame) -> DataFrame:
    """Documents as a service would return them for seven queries."""
    record = F.to_json(F.struct("source", F.col("ext_id").alias("id"), "pmid", "pmcid", "doi", "title", F.col("abstract").alias("abstractText"),
                                F.col("pub_year").cast("string").alias("pubYear"), F.col("cited_by").cast("string").alias("citedByCount"), F.col("journal").alias("journalTitle")))
    return docs.select(F.concat(F.lit("q"), F.col("doc_id") % 7).alias("query"), record.alias("record"))


@query
def ingest_totals(spark, d):
    """A whole round into the stored tables: two of seven queries are in the log and are skipped."""
    docs = table(spark, d, "documents")
    have = corpus.unique_passages(table(spark, d, "passages")).groupBy("doc_id", "ordinal").agg(F.min(F.struct("section", "text")).alias("r")).select("doc_id", "ordinal", "r.*")
    log = spark.createDataFrame([("q0", 1), ("q1", 2)], "query string, n_docs int").withColumn("fetched_at", F.lit(CUTOFF).cast("timestamp"))
    stored = _stored(docs).withColumn("canonical_doc_id", F.lit(None).cast("long"))
    return pipeline.ingest_round(_raw_records(docs), stored, have, log, F.lit("2025-01-01 00:00:00").cast("timestamp")).totals


sql("ingest_totals", f"""rec0 AS (SELECT coalesce(nullif(source, ''), 'MED') AS source, {_STRIP % "coalesce(ext_id, '')"} AS ext_id, {_STRIP % 'title'} AS title, {_STRIP % 'abstract'} AS abstract
  FROM documents WHERE doc_id % 7 > 1 AND {_STRIP % "coalesce(title, '')"} <> '' AND {_STRIP % "coalesce(ext_id, '')"} <> '' AND {_STRIP % "coalesce(abstract, '')"} <> '')""",
    """rec AS (SELECT row_number() OVER () AS doc_id, n, title, abstract FROM (SELECT *, count(*) OVER (PARTITION BY source, ext_id) AS n FROM rec0
  QUALIFY row_number() OVER (PARTITION BY source, ext_id ORDER BY title DESC, abstract DESC) = 1))""",
    sents_cte("abstract").replace("FROM documents)", "FROM rec)"), CHUNKS,
    body="SELECT (SELECT count(*) FROM rec0) AS documents, (SELECT sum(n) FROM chunks JOIN rec USING (doc_id))::BIGINT AS passages, 2 AS skipped")


@query
def harvest_totals(spark, d):
    docs = table(spark, d, "documents")
    return pipeline.harvest_totals(docs, written(evalset.resolve_references(_references(spark, d), docs), "refs"), docs)


sql("harvest_totals", RESOLVED, "per AS (SELECT doc_id, count(DISTINCT cited_doc_id) AS n FROM resolved JOIN documents USING (doc_id) GROUP BY 1)",
    body="""SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS documents, count(*) AS with_references, count(*) FILTER (WHERE n >= 3) AS with_enough,
  coalesce(sum(n) FILTER (WHERE n >= 3), 0)::BIGINT AS contexts FROM per""")


@query
def schema_violations(spark, d):
    """What in the stored tables breaks the declared keys, references and checks."""
    return schema.violations({name: table(spark, d, name) for name in schema.TABLES})


def _violation_sql() -> str:
    parts = []
    for name, t in schema.TABLES.items():
        row = lambda what, n, name=name: parts.append(f"SELECT '{name}' AS table_name, '{what}' AS constraint_name, {n} AS n_rows")
        for c in (*t.key, *t.required):
            row(f"required {c}", f"(SELECT count(*) FROM {name} WHERE {c} IS NULL)")
        for what, cond in t.checks:
            row(f"check {what}", f"(SELECT count(*) FROM {name} WHERE NOT ({cond.replace('size(', 'len(')}))")
        for key in (t.key, *t.unique):
            row(f"unique {', '.join(key)}", f"(SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM {name} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in key)} GROUP BY {', '.join(key)}))")
        for col, target, at in t.refers:
            row(f"refers {col}", f"(SELECT count(*) FROM {name} x WHERE {col} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {target} y WHERE y.{at} = x.{col}))")
    return " UNION ALL ".join(parts)


sql("schema_violations", body=_violation_sql())


@query
def streamed_documents(spark, d):
    """All documents through the ingest stream, in files that arrive one a trigger, to the table it keeps."""
    home = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents")
    docs.repartitionByRange(max(4, docs.rdd.getNumPartitions()), "ingested_at", "doc_id").write.parquet(f"{home}/arriving")
    in_order(spark, f"{home}/arriving")
    ingest_stream(spark, f"{home}/arriving", docs.schema, f"{home}/documents", f"{home}/checkpoint", files_per_trigger=1).awaitTermination()
    return documents_table(spark, f"{home}/documents").read().select("source", "ext_id", "title", "cited_by")


sql("streamed_documents", body="""SELECT source, ext_id, title, cited_by FROM documents QUALIFY row_number() OVER (PARTITION BY source, ext_id ORDER BY ingested_at DESC, pmid DESC, pmcid DESC, doi DESC, title DESC) = 1""")


@query
def event_windows(spark, d):
    return windowed_counts(table(spark, d, "events")).withColumn("mean_value", F.round("mean_value", 6))


sql("event_windows", body="SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
