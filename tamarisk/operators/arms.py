"""The four arms, over whole batches of queries: lexical, dense, fused, reranked.

A ranking is (query_id, passage_id, score, rank), ordered by score, then id, so
that equal inputs give equal output on any cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarisk.config import Settings
from tamarisk.functions.stem import analyser
from tamarisk.functions.text import tokens
from tamarisk.operators import tsquery
from tamarisk.operators.corpus import english
from tamarisk.operators.toplists import Buckets, lexical_candidates, near_candidates
from tamarisk.plans.materialise import written

ARMS = ("fts", "dense", "hybrid", "hybrid_rerank")
HIT = "query_id long, passage_id long, score double, rank int"


def top(scored: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best of each query; the plan cuts each partition before it shuffles."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "passage_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


GRAMMAR = r'"|(?<!\S)-\S'  # a phrase or a negation; anything else is a bag of words
OR = r"(?i)(?<!\S)or(?!\S)"


def query_terms(queries: DataFrame, stats: DataFrame, s: Settings = Settings(), query_col: str = "query_text") -> DataFrame:
    """(query_id, lexeme) to run for plain queries: distinct tokens, without those too common, but
    with the rarest of them where fewer than min_terms would be left. ``or`` is no word."""
    said = queries.select("query_id", F.posexplode(tokens(F.regexp_replace(query_col, OR, " "))).alias("pos", "lexeme"))
    if s.analyzer == "english":
        said = english(said, "query_id")
    words = said.groupBy("query_id", "lexeme").agg(F.min("pos").alias("pos"))
    if not s.prune_common:
        return words.select("query_id", "lexeme")
    known = words.join(stats.where(F.col("df_frac") > F.lit(float(s.max_df))).select("lexeme", "ndoc"), "lexeme", "left")
    q = Window.partitionBy("query_id")
    rare = F.count_if(F.col("ndoc").isNull()).over(q)
    place = F.row_number().over(Window.partitionBy("query_id", F.col("ndoc").isNull()).orderBy("ndoc", "pos"))
    return known.withColumn("_rare", rare).withColumn("_place", place).where(
        F.col("ndoc").isNull() | (F.col("_place") <= F.lit(s.min_terms) - F.col("_rare"))).select("query_id", "lexeme")


def query_plans(queries: DataFrame, stats: DataFrame, s: Settings = Settings(), query_col: str = "query_text") -> DataFrame:
    """(query_id, kind, tree, wanted, banned): queries parsed by the web grammar and rewritten (see
    ``tsquery``). Of the statistics a query sees its own too common words only."""
    prune = s.or_semantics and s.prune_common
    words = queries.select("query_id", F.explode(tokens(F.col(query_col))).alias("lexeme")).distinct()
    if s.analyzer == "english":
        words = english(words, "query_id").distinct()
    common = words.join(stats.where(F.col("df_frac") > F.lit(float(s.max_df))).select("lexeme", "ndoc"), "lexeme").groupBy("query_id").agg(
        F.map_from_entries(F.collect_list(F.struct("lexeme", "ndoc"))).alias("common"))  # as long as the query at most
    rows = queries.select("query_id", F.col(query_col).alias("text"))
    rows = rows.join(common, "query_id", "left") if prune else rows.withColumn("common", F.lit(None).cast("map<string,long>"))
    semantics, least, analyse = s.or_semantics, s.min_terms, analyser(s.analyzer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text, held in zip(b["query_id"], b["text"], b["common"], strict=True):
                p = tsquery.plan(tsquery.rewrite(tsquery.from_web(text, analyse), semantics, dict(held or {}), least))
                out.append((i, p.kind, p.text, list(p.wanted), list(p.banned)))
            yield pd.DataFrame(out, columns=["query_id", "kind", "tree", "wanted", "banned"])

    return rows.select("query_id", "text", "common").mapInPandas(run, "query_id long, kind string, tree string, wanted array<string>, banned array<string>")


def lexical(queries: DataFrame, passages: DataFrame, stats: DataFrame, k: int = 100, s: Settings = Settings(), query_col: str = "query_text") -> DataFrame:
    """The lexical arm: the web grammar, ranked by cover density r / (1 + r), to 6 places.

    By default a query matches a passage with any of its operands (words and "phrases") and
    none of its ``-`` ones; without ``or_semantics`` all operands must be there. Blank queries,
    those of unknown words and those of negations only have no hits; neither has a null.

    A bag of words is r = 0.1 per matching word, so it is a count over postings; phrases and
    conjunctions go by the places of words. Each chunk of passages is indexed once where it is
    read, and only a query's best rows leave it (see ``toplists``).
    """
    return top(lexical_scored(queries, passages, stats, k, s, query_col), k)


def lexical_scored(queries: DataFrame, passages: DataFrame, stats: DataFrame, k: int = 100, s: Settings = Settings(), query_col: str = "query_text") -> DataFrame:
    """(query_id, passage_id, score): what ``lexical`` ranks, which holds the k best of each query."""
    marked = F.coalesce(F.col(query_col).rlike(GRAMMAR), F.lit(False)) if s.or_semantics else F.lit(True)
    complex_ = queries.where(marked)
    plans = query_terms(queries.where(~marked), stats, s, query_col).groupBy("query_id").agg(F.collect_list("lexeme").alias("wanted")).select(
        "query_id", F.lit(None).cast("string").alias("tree"), "wanted", F.array().cast("array<string>").alias("banned"))
    if not complex_.isEmpty():
        parsed = query_plans(complex_, stats, s, query_col).where("kind <> 'none'")
        plans = plans.unionByName(parsed.select("query_id", F.when(F.col("kind") == "tree", F.col("tree")).alias("tree"), "wanted", "banned"))
    plans = written(plans, "plans")
    prefixes = not plans.where("tree is not null and size(wanted) = 0").isEmpty()
    found = lexical_candidates(plans, plans.count(), passages, k, s.analyzer, prefixes)
    return found.withColumn("score", F.round("score", 6)).where("score > 0")


def unit_vectors(rows: DataFrame, id_col: str, vector_col: str, dim: int = 64) -> DataFrame:
    """(id, vec) of usable vectors, each id once (the smallest, if they differ)."""
    v = F.col("vec")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vec")).where(
        (F.size("vec") == dim) & F.col("id").isNotNull()).where(fine).groupBy("id").agg(F.min("vec").alias("vec"))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows of up to ``size`` vectors in single precision, as they are stored: (ids binary, vecs binary)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, size):
                part = b.slice(k, size)
                x = part.column(1).flatten().to_numpy().astype(np.float32)
                ids = part.column(0).to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["ids", "vecs"])

    return rows.mapInArrow(run, "ids binary, vecs binary")


def _unpacked(ids: bytes, vecs: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of unit length, in double precision."""
    i = np.frombuffer(ids, np.int64)
    x = np.frombuffer(vecs, np.float32).reshape(len(i), -1).astype(np.float64)
    return i, x / np.linalg.norm(x, axis=1, keepdims=True)


def dense(queries: DataFrame, vectors: DataFrame, k: int = 100, block: int = 1024) -> DataFrame:
    """Exact nearest by cosine (double, to 6 places), for (id, vec) queries and vectors.

    Queries go in blocks, vectors in chunks, and parts of both meet (see ``toplists``): products in
    single precision leave out what can't be among a query's k best of the part so far, and the
    rest is scored exactly, so that only k rows a query and part are shuffled.
    """
    asked = written(_packed(queries, block), "dense")
    return top(near_candidates(asked, asked.count(), _packed(vectors, 1024), k, _unpacked), k)


def dense_ann(queries: DataFrame, vectors: DataFrame, k: int = 100, min_cosine: float = 0.8, tables: int = 12, width: float = 0.6, seed: int = 1) -> DataFrame:
    """Approximate nearest: random-projection buckets (Datar et al., SoCG 2004) propose, the exact
    cosine ranks. Buckets find neighbours at or over ``min_cosine``, with the defaults
    nine of ten of them; a query with fewer than k such hits is ranked exactly against all
    vectors (``dense``), so each has its k. With the defaults nine of ten unrelated pairs have a
    bucket in common too, so a join on buckets would score nearly all pairs one by one: the
    cosine goes first, by blocks as in ``dense``, and pairs over ``min_cosine`` are asked for a bucket.
    """
    first = vectors.select(F.size("vec").alias("n")).first()
    if first is None or queries.isEmpty():
        return queries.sparkSession.createDataFrame([], HIT)
    asked = written(_packed(queries, 1024), "ann")
    buckets = Buckets(min_cosine, first.n, tables, width, seed)
    found = written(top(near_candidates(asked, asked.count(), _packed(vectors, 1024), k, _unpacked, buckets), k), "ann")
    done = written(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query_id"), "ann")
    rest = dense(queries.join(done.withColumnRenamed("query_id", "id"), "id", "left_anti"), vectors, k)
    return found.join(done, "query_id", "left_semi").select(*rest.columns).unionByName(rest)


def fuse(runs: dict[str, DataFrame], k: int = 100, rrf_k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion: score is the sum of weight / (rrf_k + rank).

    An arm of weight 0 takes no part at all; an arm without a weight has 1. Adds
    ``components``, the arms' own scores by name.
    """
    weights = weights or {}
    rows = None
    for arm, run in sorted(runs.items()):
        w = float(weights.get(arm, 1.0))
        if w:
            part = run.select("query_id", "passage_id", F.lit(arm).alias("arm"), F.col("score").alias("own"), (F.lit(w) / (rrf_k + F.col("rank"))).alias("part"))
            rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError("every arm has weight 0")
    both = rows.groupBy("query_id", "passage_id").agg(
        F.round(F.sum("part"), 9).alias("score"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("arm", "own")))).alias("components"))
    return top(both, k)


def with_titles(ranked: DataFrame, passages: DataFrame, documents: DataFrame) -> DataFrame:
    """Join after limit: text and title come only to what is ranked already."""
    p = passages.select("passage_id", "doc_id", "text")
    return ranked.join(p, "passage_id").join(documents.select("doc_id", "title"), "doc_id")


def titled_first(scored: Callable[[DataFrame], DataFrame], passages: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """Join before limit: the same rows, the long way round. Every passage meets its document before
    ``scored`` searches the joined table, so a passage without one takes no place."""
    held = written(passages.select("passage_id", "doc_id", "text").join(documents.select("doc_id", "title"), "doc_id"), "titled")
    return top(scored(held).join(held, "passage_id"), k)


def rerank(ranked: DataFrame, scorer: Column | None, k: int) -> DataFrame:
    """The ranking by a scorer of pairs; without one (it could not be loaded) the order
    stays, and ``reranked`` says which happened. Adds the score to ``components``."""
    if scorer is None:
        return ranked.where(F.col("rank") <= k).withColumn("reranked", F.lit(False))
    own = ranked.withColumn("_s", scorer).withColumn(
        "components", F.map_concat("components", F.create_map(F.lit("rrf"), F.col("score"), F.lit("rerank"), F.col("_s"))))
    return top(own.withColumn("score", F.col("_s")).drop("_s", "rank"), k).withColumn("reranked", F.lit(True))


def check_arm(arm: str) -> str:
    if arm not in ARMS:
        raise ValueError(f"no such arm: {arm!r}; there are {', '.join(ARMS)}")
    return arm


def check_search(text: str, arm: str, k: int) -> None:
    """The limits of an interactive search: 1 to 1,000 characters, 1 to 100 hits, a known arm."""
    check_arm(arm)
    if not isinstance(text, str) or not 1 <= len(text) <= 1000:
        raise ValueError("a query has 1 to 1,000 characters")
    if isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= 100:
        raise ValueError("k is a whole number from 1 to 100")
