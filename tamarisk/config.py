"""Every behaviour switch in one place, read from the environment on demand."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, fields

from pyspark.sql import SparkSession



@contextmanager
def scoped(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """Session settings for the length of a block; what stood before comes back, also after an error.
    Plans must be run inside the block, as they read settings when they run."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


ENV = "TAMARISK_"
RETRIEVAL = (  # what the arms read; the rest changes no ranking
    "embed_dim", "query_prefix", "fts_depth", "dense_depth", "rrf_k", "rerank_depth", "rrf_weighted", "rrf_weights", "analyzer", "or_semantics",
    "prune_common", "max_df", "min_terms", "window", "stride", "min_chars", "max_chars",
)


@dataclass(frozen=True)
class Settings:
    """Defaults are those the published measurements were made with."""

    embed_dim: int = 64
    embed_batch: int = 256
    query_prefix: str = "Represent this sentence for searching relevant passages: "
    fts_depth: int = 100
    dense_depth: int = 100
    rrf_k: int = 60
    rerank_depth: int = 100
    rrf_weighted: bool = True
    rrf_weights: dict[str, float] = field(default_factory=lambda: {"fts": 0.5, "dense": 1.0})
    analyzer: str = "plain"  # or "english": stop words left out, the rest stemmed
    or_semantics: bool = True
    prune_common: bool = True
    max_df: float = 0.05
    min_terms: int = 3
    join_after_limit: bool = True
    requests_per_second: float = 6.0
    concurrency: int = 6
    timeout_s: float = 30.0
    window: int = 3
    stride: int = 2
    min_chars: int = 80
    max_chars: int = 1200
    test_fraction: float = 0.2
    min_refs: int = 3
    min_positives: int = 2
    max_negatives: int = 8
    max_positives: int = 8
    seed: int = 0

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        """Settings with what TAMARISK_<NAME> variables override; values are JSON or plain text."""
        env = dict(os.environ) if env is None else env
        given = {}
        for f in fields(cls):
            raw = env.get(ENV + f.name.upper())
            if raw is None:
                continue
            try:
                given[f.name] = json.loads(raw)
            except ValueError:
                given[f.name] = raw
        return cls(**given)

    def arm_weights(self) -> dict[str, float]:
        """1.0 for an arm that isn't named, and for all of them if fusion is unweighted."""
        return dict(self.rrf_weights) if self.rrf_weighted else {}

    def fingerprint(self) -> str:
        """Changes whenever retrieval would, and only then: stored beside a model to detect a stale one."""
        mine = dataclasses.asdict(self)
        body = json.dumps({name: mine[name] for name in RETRIEVAL}, sort_keys=True)
        return hashlib.sha256(body.encode()).hexdigest()
