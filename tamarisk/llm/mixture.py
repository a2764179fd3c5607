"""Mixing sources to target weights.

Sizes are tokens. Each source gets its share of the total as a budget: first as
many complete epochs of all its documents as fit, then a part of one epoch,
drawn without replacement with probabilities by quality weight (Efraimidis and
Spirakis, IPL 2006): documents in the order of -ln(u) / weight, for a uniform u
that is a hash of the id, as long as their running sum fits the rest.

The running sum of a source is not one window: rows are range-partitioned by
source and key, each stretch is summed, and a stretch starts from the sums
before it. A source with most of the rows thus spans many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarisk.llm.tokens import BYTE_BPE, token_count
from tamarisk.plans.materialise import written


def quality_weight() -> Column:
    """1 + ln(1 + cited_by), halved without an abstract; never under a half."""
    cited = F.greatest(F.coalesce("cited_by", F.lit(0)), F.lit(0))
    has = F.coalesce(F.col("abstract").rlike(r"(?U)\S"), F.lit(False))
    return (1 + F.log1p(cited)) * F.when(has, 1.0).otherwise(0.5)


def _sized(documents: DataFrame, targets: DataFrame, seed: int, weight: Column, path: str) -> DataFrame:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + 0.5) / F.lit(float(2**53))
    return written(
        documents.withColumn("source", F.upper(F.trim("source"))).join(targets.select("source"), "source", "left_semi")
        .select("doc_id", "source", (-F.log(u) / weight).alias("key"), token_count(F.col("text"), path).alias("n_tokens")), "mixture")


def _targets(mix: DataFrame) -> DataFrame:
    """One row a source: its names' shares together, the largest repeat cap."""
    return mix.where("source is not null").groupBy(F.upper(F.trim("source")).alias("source")).agg(
        F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"),
        F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))


def _plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None) -> DataFrame:
    """A row a source: available tokens, budget, complete epochs and the rest.

    By default the total is the largest at which every source that has text and a
    share can give its share within its repeats, so the shares among them are met.
    A given total is a wish: a source short of tokens gives all it may.
    """
    have = targets.join(sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("available")), "source", "left")
    have = have.fillna(0, ["n_docs", "available"]).withColumn("cap", F.col("available") * F.col("max_repeats"))
    live = have.where("cap > 0 and target_share > 0").agg(
        F.sum("target_share").alias("live"), F.min(F.col("cap") / F.col("target_share")).alias("most")).first()
    share = (live["live"] or 1.0) if total_tokens is None else 1.0
    total = float(total_tokens) if total_tokens is not None else (live["most"] or 0.0) * share
    goal = F.floor(F.col("target_share") / F.lit(share) * F.lit(total) + F.lit(1e-6))
    have = have.withColumn("budget", F.when(F.col("cap") > 0, F.least(goal, "cap")).otherwise(0).cast("long"))
    epochs = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.greatest("available", F.lit(1)))).otherwise(0).cast("int")
    return have.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available"))


def mix_sources(documents: DataFrame, mix: DataFrame, total_tokens: int | None = None, seed: int = 17,
                weight: Column | None = None, path: str = BYTE_BPE) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).

    mixture: doc_id, source, n_tokens, copies (1 at least, max_repeats at most).
    report: source, target_share, max_repeats, n_docs, available, tokens, share, top_copies.

    Only sources of ``mix`` take part; a document without tokens, source or id does
    not. A source without documents gets 0 tokens, and the others' shares stay in
    proportion. Ties in key go by doc_id. Empty tables give empty mixtures.
    """
    targets = written(_targets(mix), "mixture")
    sized = _sized(documents.where("doc_id is not null"), targets, seed, quality_weight() if weight is None else weight, path).where("n_tokens > 0")
    plan = written(_plan(sized, targets, total_tokens), "mixture")
    ranged = written(sized.repartitionByRange("source", "key", "doc_id").withColumn("stretch", F.spark_partition_id()), "mixture")
    sums = ranged.groupBy("source", "stretch").agg(F.sum("n_tokens").alias("t"))  # sources plus partitions rows at most
    before = sums.select("source", "stretch", (F.sum("t").over(Window.partitionBy("source").orderBy("stretch")) - F.col("t")).alias("before"))
    w = Window.partitionBy("source", "stretch").orderBy("key", "doc_id")
    copies = F.col("epochs") + (F.col("upto") <= F.col("rest")).cast("int")
    mixture = written(
        ranged.join(before, ["source", "stretch"]).join(plan.select("source", "epochs", "rest"), "source")
        .withColumn("upto", F.col("before") + F.sum("n_tokens").over(w))
        .select("doc_id", "source", "n_tokens", copies.alias("copies")).where("copies > 0"), "mixture")
    got = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("top_copies"))
    all_tokens = F.sum("tokens").over(Window.partitionBy())  # over one row a source
    report = plan.join(got, "source", "left").fillna(0, ["tokens", "top_copies"]).select(
        "source", "target_share", "max_repeats", "n_docs", "available", "tokens",
        F.coalesce(F.try_divide("tokens", all_tokens), F.lit(0.0)).alias("share"), "top_copies")
    return mixture, report
