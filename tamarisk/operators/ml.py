"""Encoders and pair scorers.

The published system's neural models are not available offline, so both sides
are interfaces with a plain default: an encoder that hashes words into a fixed
dimension (a stand-in, deterministic and untrained), and a logistic regression
over pair features, trained here with the same point-wise log loss.
"""

from __future__ import annotations

import json
import logging
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from tamarisk.config import Settings
from tamarisk.functions.text import tokens
from tamarisk.functions.words import word_list

log = logging.getLogger(__name__)
FEATURES = ("overlap", "covered", "weighted", "fts_part", "dense_part")


class Encoder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


@lru_cache(maxsize=500_000)
def _word_place(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


class HashingEncoder:
    """Signed feature hashing of words (Weinberger et al., ICML 2009), unit length; all
    zero for a text without words."""

    def __init__(self, dim: int = 64, batch: int = 256) -> None:
        self.dim, self.batch = dim, batch

    def encode(self, texts: list[str]) -> np.ndarray:
        said = [word_list(t) for t in texts]
        h = np.fromiter((_word_place(w) for ws in said for w in ws), dtype=np.uint64, count=sum(map(len, said)))
        row = np.repeat(np.arange(len(said)), [len(ws) for ws in said])
        at = row * self.dim + (h % np.uint64(self.dim)).astype(np.int64)
        sign = np.where(h >> np.uint64(63), 1.0, -1.0)
        out = np.bincount(at, sign, minlength=len(said) * self.dim).reshape(len(said), self.dim)
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n == 0, 1, n)).astype(np.float32)


def embedded(text: Column, encoder: Encoder | None = None, prefix: str = "") -> Column:
    """array<float>; null for a null text. Queries take the asymmetric prefix, passages none. The
    hashing stand-in would only mix the prefix's words into every query, so it has none."""
    enc = encoder or HashingEncoder()
    size = getattr(enc, "batch", 256)
    lead = "" if isinstance(enc, HashingEncoder) else prefix

    def run(texts: pd.Series) -> pd.Series:
        said = [t or "" for t in texts]
        return pd.Series([v for k in range(0, len(said), size) for v in enc.encode(said[k : k + size])], dtype="object")

    return F.when(text.isNotNull(), F.pandas_udf(run, ArrayType(FloatType()))(F.concat(F.lit(lead), text)))


class PairScorer(Protocol):
    """A scorer of (query, text) pairs, such as a cross-encoder: the higher, the more relevant."""

    def score(self, queries: list[str], texts: list[str]) -> np.ndarray: ...


def pair_score(scorer: PairScorer, query: str = "query_text", text: str = "text", batch: int = 64) -> Column:
    """The scorer over Arrow batches; a null text counts as an empty one."""
    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        q, t = [x or "" for x in queries], [x or "" for x in texts]
        got = [np.asarray(scorer.score(q[k : k + batch], t[k : k + batch]), dtype=np.float64) for k in range(0, len(q), batch)]
        return pd.Series(np.concatenate(got) if got else [], dtype="float64")

    return F.pandas_udf(run, DoubleType())(F.col(query), F.col(text))


def save_vectors(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The passage table with vectors (id, vec) filled in where it has none: a stored one stays."""
    v = new.select(F.col("id").alias("passage_id"), F.col("vec").alias("_vec"))
    return stored.join(v, "passage_id", "left").withColumn("embedding", F.coalesce("embedding", "_vec")).select(*stored.columns)


def embed_missing(passages: DataFrame, vectors: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """(id, vec) for passages (passage_id, text) without one in ``vectors``: what a resumed run adds."""
    todo = passages.join(vectors.select(F.col("id").alias("passage_id")), "passage_id", "left_anti")
    return todo.select(F.col("passage_id").alias("id"), embedded(F.col("text"), encoder).alias("vec")).where("vec is not null")


def pair_features(pairs: DataFrame, queries: DataFrame, passages: DataFrame, stats: DataFrame, n_passages: int | None = None) -> DataFrame:
    """(query_id, passage_id, FEATURES...): word overlap, the share of the query covered, overlap
    weighted by rarity, and the ranks' reciprocals in both arms (0 where absent)."""
    n = F.lit(float(max(1, passages.count() if n_passages is None else n_passages)))
    q = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query_text")))).alias("lexeme"))
    size = q.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_words"))
    p = passages.join(pairs.select("passage_id").distinct(), "passage_id", "left_semi").select(
        "passage_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("lexeme"))
    idf = stats.select("lexeme", F.log(n / F.col("ndoc")).alias("idf"))
    shared = pairs.select("query_id", "passage_id").distinct().join(q.join(idf, "lexeme", "left"), "query_id").join(p, ["passage_id", "lexeme"]).groupBy(
        "query_id", "passage_id").agg(F.count(F.lit(1)).alias("overlap"), F.sum(F.coalesce("idf", F.lit(0.0))).alias("weighted"))
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).cast("double").alias(name)
    arm = lambda name: zero(F.col("components").getItem(name), f"{name}_part") if "components" in pairs.columns else F.lit(0.0).alias(f"{name}_part")
    return pairs.join(shared, ["query_id", "passage_id"], "left").join(size, "query_id", "left").select(
        *[c for c in pairs.columns], zero(F.col("overlap"), "overlap"), zero(F.try_divide("overlap", "n_words"), "covered"),
        zero(F.col("weighted"), "weighted"), arm("fts"), arm("dense"))


def train_reranker(rows: DataFrame, s: Settings = Settings()) -> PipelineModel | None:
    """Logistic regression on (label, FEATURES); None if there is only one class."""
    if rows.select("label").distinct().count() < 2:
        return None
    from pyspark.ml import Pipeline

    stages = [VectorAssembler(inputCols=list(FEATURES), outputCol="features"),
              LogisticRegression(featuresCol="features", labelCol="label", maxIter=50, regParam=1e-3, standardization=True)]
    return Pipeline(stages=stages).fit(rows.select("label", *FEATURES))  # full-batch and convex: no order, batch or seed enters


def logit(model: PipelineModel) -> Column:
    """The model's score as an expression of the features: no Python in the hot path."""
    lr: LogisticRegressionModel = model.stages[-1]
    return sum((F.lit(float(c)) * F.col(f) for c, f in zip(lr.coefficients.toArray(), FEATURES, strict=True)), F.lit(float(lr.intercept)))


def save_model(model: PipelineModel, path: str, s: Settings, **facts) -> None:
    """The model, and its metadata with the settings' fingerprint, both by Spark, so on any file system."""
    model.write().overwrite().save(f"{path}/model")
    body = json.dumps({"retrieval": s.fingerprint(), "features": FEATURES, "seed": s.seed, **facts}, sort_keys=True)
    SparkSession.active().createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/training_meta")


def load_model(path: str, s: Settings, base: str | None = None) -> tuple[PipelineModel | None, bool]:
    """(model, stale): the model at ``path``, else the one at ``base`` with a warning, else none;
    stale if retrieval has changed since it was trained."""
    spark = SparkSession.active()
    mk = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for n, at in enumerate(p for p in (path, base) if p):
        where = mk(f"{at}/training_meta/_SUCCESS")
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            if n:
                log.warning("no model at %s: the base model at %s is used", path, at)
            meta = json.loads(spark.read.text(f"{at}/training_meta").first()[0])
            return PipelineModel.load(f"{at}/model"), meta["retrieval"] != s.fingerprint()
    log.warning("no model at %s: the fused order stays", path)
    return None, False


__all__ = ["HashingEncoder", "embed_missing", "embedded", "load_model", "logit", "pair_features", "save_model", "train_reranker"]
