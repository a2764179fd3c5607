"""The public search API: a corpus, a batch of queries, an arm."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.config import Settings
from tamarisk.functions.text import plain_query
from tamarisk.operators import arms
from tamarisk.operators.corpus import (
    canonical_documents, canonical_map, counted_statistics, lead_passages, statistics_of, stemmed_postings, to_canonical, unique_passages,
)
from tamarisk.operators.evalset import clean_split, labels_of
from tamarisk.operators.metrics import collapse_labels, collapse_to_documents, query_metrics, summary
from tamarisk.operators.mining import own_papers, training_pairs
from tamarisk.operators.ml import Encoder, HashingEncoder, PairScorer, embedded, logit, pair_features, pair_score, train_reranker
from tamarisk.plans.materialise import written


@dataclass
class Corpus:
    """Documents and passages with what is derived from them once."""

    documents: DataFrame
    raw_passages: DataFrame
    settings: Settings = field(default_factory=Settings)
    encoder: Encoder | None = None
    model: PipelineModel | None = None
    pair_scorer: PairScorer | None = None  # of (query, text) pairs; goes before the model

    def __post_init__(self) -> None:
        self.encoder = self.encoder or HashingEncoder(self.settings.embed_dim, self.settings.embed_batch)

    @cached_property
    def passages(self) -> DataFrame:
        return written(unique_passages(self.raw_passages), "passages")

    @cached_property
    def statistics(self) -> DataFrame:
        if self.settings.analyzer == "english":
            return written(statistics_of(stemmed_postings(self.passages), self.passages.count()), "lexemes")
        return written(counted_statistics(self.passages), "lexemes")

    @cached_property
    def vectors(self) -> DataFrame:
        """(id, vec) of all passages by the encoder; texts without words have none."""
        made = self.passages.select("passage_id", embedded(F.col("text"), self.encoder).alias("vec"))
        return written(arms.unit_vectors(made, "passage_id", "vec", self.encoder.dim), "vectors")

    @cached_property
    def clusters(self) -> DataFrame:
        return written(canonical_map(canonical_documents(self.documents)), "clusters")

    def query_vectors(self, queries: DataFrame) -> DataFrame:
        made = queries.select("query_id", embedded(F.col("query_text"), self.encoder, self.settings.query_prefix).alias("vec"))
        return arms.unit_vectors(made, "query_id", "vec", self.encoder.dim)

    def lexical(self, queries: DataFrame, k: int) -> DataFrame:
        return arms.top(self.lexical_scored(queries, self.passages, k), k)

    def lexical_scored(self, queries: DataFrame, passages: DataFrame, k: int) -> DataFrame:
        """What the lexical arm ranks, over a table of passages with more columns, or fewer rows."""
        ask = "ask" if "ask" in queries.columns else "query_text"
        return arms.lexical_scored(queries, passages, self.statistics, k, self.settings, ask)

    def base_runs(self, queries: DataFrame, depth: int = 0) -> dict[str, DataFrame]:
        """Both retrieving arms, ranked once and stored: the other arms, and shorter lists, derive from these."""
        s = self.settings
        fts = self.lexical(queries, max(depth, s.fts_depth))
        near = arms.dense(self.query_vectors(queries), self.vectors, max(depth, s.dense_depth))
        return {"fts": written(fts, "runs"), "dense": written(near, "runs")}

    def rank(self, queries: DataFrame, arm: str, k: int, runs: dict[str, DataFrame] | None = None) -> DataFrame:
        """(query_id, passage_id, score, rank[, components]) of an arm for all queries at once."""
        arms.check_arm(arm)
        s = self.settings
        if arm in ("fts", "dense"):
            if runs is not None:
                return runs[arm].where(F.col("rank") <= k)
            if arm == "fts":
                return self.lexical(queries, k)
            return arms.dense(self.query_vectors(queries), self.vectors, k)
        runs = self.base_runs(queries) if runs is None else runs
        depth = {"fts": s.fts_depth, "dense": s.dense_depth}
        fused = arms.fuse({a: r.where(F.col("rank") <= depth[a]) for a, r in runs.items()}, k if arm == "hybrid" else s.rerank_depth, s.rrf_k, s.arm_weights())
        if arm == "hybrid":
            return fused
        fused = written(fused, "fused")
        if self.pair_scorer is not None:
            texts = fused.join(self.passages.select("passage_id", "text"), "passage_id").join(queries.select("query_id", "query_text"), "query_id")
            return arms.rerank(texts, pair_score(self.pair_scorer), k).select("query_id", "passage_id", "score", "rank", "components", "reranked")
        scorer: Column | None = None
        if self.model is not None:
            fused, scorer = pair_features(fused, queries, self.passages, self.statistics, self.passages.count()), logit(self.model)
        return arms.rerank(fused, scorer, k).select("query_id", "passage_id", "score", "rank", "components", "reranked")

    def search(self, queries: DataFrame, arm: str = "hybrid_rerank", k: int = 10) -> DataFrame:
        """The ranking with doc_id, text and title, joined after the cut; or before it, where
        the setting says so and the arm is lexical."""
        if arm == "fts" and not self.settings.join_after_limit:
            return arms.titled_first(lambda p: self.lexical_scored(queries, p, k), self.passages, self.documents, k)
        return arms.with_titles(self.rank(queries, arm, k), self.passages, self.documents)

    def search_one(self, text: str, arm: str = "hybrid_rerank", k: int = 10) -> dict:
        """One interactive query: {query, arm, latency_ms, hits}; at most k hits reach the driver.

        Raises ValueError for an unknown arm, a k outside 1 to 100, or a text that is empty or
        longer than 1,000 characters."""
        arms.check_search(text, arm, k)
        spark, began = self.documents.sparkSession, time.perf_counter()
        rows = self.search(spark.createDataFrame([(1, text)], "query_id long, query_text string"), arm, k).orderBy("rank").collect()
        parts = lambda r: {n: round(v, 6) for n, v in (r.components or {}).items()} if "components" in r else {arm: round(r.score, 6)}
        hits = [{"passage_id": r.passage_id, "doc_id": r.doc_id, "title": r.title, "text": r.text, "score": round(r.score, 6), "rank": r["rank"],
                 "components": parts(r)} for r in rows]
        reranked = bool(rows) and "reranked" in rows[0] and rows[0].reranked
        return {"query": text, "arm": arm, "reranked": reranked, "latency_ms": round((time.perf_counter() - began) * 1000, 2), "hits": hits}

    def candidates(self, queries: DataFrame, arm: str, k: int, runs: dict[str, DataFrame] | None = None) -> DataFrame:
        hit = self.rank(queries, arm, k, runs).join(self.passages.select("passage_id", "doc_id"), "passage_id")
        return to_canonical(hit.select("query_id", "passage_id", "doc_id", "rank"), self.clusters)

    def mine(self, queries: DataFrame, qrels: DataFrame, contexts: DataFrame, arm: str = "hybrid", k: int = 50, runs: dict[str, DataFrame] | None = None) -> DataFrame:
        s = self.settings
        labels = to_canonical(labels_of(qrels), self.clusters)
        blocked = to_canonical(own_papers(queries, contexts), self.clusters)
        return training_pairs(written(self.candidates(queries, arm, k, runs), "mining"), labels, blocked, lead_passages(self.raw_passages), s.max_negatives, s.max_positives)

    def train(self, queries: DataFrame, qrels: DataFrame, contexts: DataFrame) -> PipelineModel | None:
        """Mines pairs, fits the reranker and uses it from now on. Both arms are ranked once."""
        runs = self.base_runs(queries)
        pairs = written(self.mine(queries, qrels, contexts, runs=runs), "pairs")
        fused = self.rank(queries, "hybrid", self.settings.rerank_depth, runs).select("query_id", "passage_id", "components")
        rows = pairs.join(fused, ["query_id", "passage_id"], "left").withColumn("components", F.coalesce("components", F.create_map().cast("map<string,double>")))
        self.model = train_reranker(written(pair_features(rows, queries, self.passages, self.statistics, self.passages.count()), "features"), self.settings)
        return self.model

    def evaluate(self, queries: DataFrame, qrels: DataFrame, which: tuple[str, ...] = arms.ARMS, k: int = 50) -> DataFrame:
        """(run, query_id, recall, precision, rr, ndcg): all arms on one query set, cluster by
        cluster. The two retrieving arms are ranked once."""
        runs, base = None, self.base_runs(queries, k)
        for arm in which:
            one = self.candidates(queries, arm, k, base).select(F.lit(arm).alias("run"), "query_id", "cluster", "rank")
            runs = one if runs is None else runs.unionByName(one)
        labels = collapse_labels(to_canonical(labels_of(qrels), self.clusters)).join(queries.select("query_id"), "query_id", "left_semi")
        return query_metrics(collapse_to_documents(written(runs, "runs")), labels, list(which))

    def ablation(self, queries: DataFrame, qrels: DataFrame, which: tuple[str, ...] = arms.ARMS, k: int = 50) -> DataFrame:
        return summary(self.evaluate(queries, qrels, which, k))


def eval_queries(queries: DataFrame, split: str, origin: str | None = None, plain: bool = True) -> DataFrame:
    """Labelled queries of a split. Their texts are titles and sentences, not expressions, so by
    default the lexical arm asks with ``ask``, in which no mark is read as an operator."""
    q = clean_split(queries).where(F.col("split") == split)
    picked = q if origin is None else q.where(F.col("origin") == origin)
    return picked.select("query_id", "query_text", *([plain_query(F.col("query_text")).alias("ask")] if plain else []))
