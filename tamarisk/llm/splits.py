"""Splits that keep related records together.

Components first: queries and the units they come from (a citing document, or
the duplicate group it belongs to) form a bipartite graph, joined on hashes of
the words. Components are then spread over many equal bins by the largest
differencing method (Karmarkar and Karp, 1982, in its many-way form), and whole
bins go to the splits by target proportion.

Differencing looks at weights only, and equal weights are interchangeable. So
the driver never sees components: it gets the number of components of each
weight. n records have fewer than sqrt(2 n) distinct weights, a proven bound (a
billion records: 45,000 rows). Full rounds of a weight over all bins cancel
out exactly; only the remainders, one vector a weight, are differenced.
The components of one weight are then numbered, in parallel, and take the
weight's places in turn.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarisk.functions.words import words_text
from tamarisk.llm.survivors import duplicate_groups
from tamarisk.operators.components import connected_components
from tamarisk.plans.materialise import written

PART = 100_000  # components numbered in one task, about
TARGETS = (("train", 0.76), ("dev", 0.08), ("test", 0.16))


def related_queries(queries: DataFrame, contexts: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, split, group_id) of every query with a split; group_id is the smallest
    query_id of its group, its own where nothing ties it to another.

    A query comes from each citing document with a context of the same words in the
    same order; queries are tied by a document, or by two of one duplicate group,
    over any number of steps. A null split takes part in nothing. A query without
    words comes from nowhere and stays alone, and so do null context texts.
    """
    q = written(queries.select(
        "query_id", F.lower(F.trim("split")).alias("split"), words_text(F.col("query_text")).alias("w"),
    ).where("split is not null").select("query_id", "split", F.when(F.col("w") != "", F.md5("w")).alias("key")), "splits")
    said = (
        contexts.where("context_text is not null and citing_doc_id is not null")
        .select("citing_doc_id", F.md5(words_text(F.col("context_text"))).alias("key"))
        .join(q.select("key").distinct(), "key", "left_semi").distinct()
    )
    groups = duplicate_groups(documents).withColumnRenamed("doc_id", "citing_doc_id")
    units = said.join(groups, "citing_doc_id", "left").select("key", F.coalesce("group_id", "citing_doc_id").alias("unit"))
    tied = units.select(F.concat(F.lit("q"), "key").alias("a"), F.concat(F.lit("d"), F.col("unit").cast("string")).alias("b")).distinct()
    comp = connected_components(tied, "a", "b").where(F.col("node").startswith("q")).select(
        F.substring("node", 2, 32).alias("key"), "component")
    placed = written(q.join(comp, "key", "left").withColumn(
        "component", F.coalesce("component", F.concat(F.lit("s"), F.col("query_id").cast("string")))), "splits")
    first = placed.groupBy("component").agg(F.min("query_id").alias("group_id"))
    return placed.join(first, "component").select("query_id", "split", "group_id")


def differencing(weights: dict[int, int], bins: int) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Per weight, how many of its components go to each bin; and the bins' sums.

    ``weights`` maps a weight to the number of components that have it. Equal weights are
    laid beside each other first (they differ most), so each weight enters as one vector
    with an entry for each of its components beyond full rounds. A merge keeps its two
    parts and an order of bins, not lists: memory and time are in proportion to the number
    of different weights.
    """
    places = {w: np.full(bins, n // bins, dtype=np.int64) for w, n in weights.items()}
    sums = np.full(bins, sum(w * (n // bins) for w, n in weights.items()), dtype=np.int64)
    heap: list[tuple[int, int, np.ndarray]] = []
    made: list[tuple] = []  # a leaf (weight, entries) or a merge (left, right, order)
    for w, n in sorted(weights.items(), reverse=True):
        if n % bins:
            v = np.zeros(bins, dtype=np.int64)
            v[-(n % bins) :] = w
            heap.append((-w, len(made), v))
            made.append((w, n % bins))
    heapq.heapify(heap)
    while len(heap) > 1:  # the two with the widest spread, laid against each other
        _, x, a = heapq.heappop(heap)
        _, y, b = heapq.heappop(heap)
        v = a + b[::-1]
        order = np.argsort(v, kind="stable").astype(np.int32)
        v = v[order]
        heapq.heappush(heap, (-int(v[-1] - v[0]), len(made), v))
        made.append((x, y, order))
    if heap:
        sums = sums + heap[0][2]
        todo = [(heap[0][1], np.arange(bins))]  # a part, and the bin of each of its places
        while todo:
            i, at = todo.pop()
            if len(made[i]) == 2:
                w, r = made[i]
                np.add.at(places[w], at[bins - r :], 1)
            else:
                x, y, order = made[i]
                left, right = np.empty(bins, dtype=np.int64), np.empty(bins, dtype=np.int64)
                left[order], right[bins - 1 - order] = at, at
                todo += [(x, left), (y, right)]
    return places, sums


def bins_to_splits(sums: np.ndarray, targets: tuple[tuple[str, float], ...]) -> list[str]:
    """Whole bins to splits: the heaviest first, each to the split furthest below its target."""
    total, got = float(sums.sum()), dict.fromkeys((t for t, _ in targets), 0.0)
    out = [""] * len(sums)
    for k in sorted(range(len(sums)), key=lambda k: (-sums[k], k)):
        s = max(targets, key=lambda t: t[1] * total - got[t[0]])[0]
        out[k], got[s] = s, got[s] + float(sums[k])
    return out


def assign_splits(related: DataFrame, targets: tuple[tuple[str, float], ...] = TARGETS, bins: int = 100) -> DataFrame:
    """(query_id, group_id, old_split, new_split): every group whole in one split.

    Shares are met as far as whole groups allow (a group with a third of all records
    can't be cut). The same input gives the same result. Empty in, empty out.
    """
    spark = related.sparkSession
    sizes = written(related.groupBy("group_id").agg(F.count(F.lit(1)).alias("w")), "splits")
    many = max(1, sizes.count() // PART)
    sizes = sizes.withColumn("part", F.pmod(F.xxhash64("group_id"), F.lit(many)))
    weights = {r.w: r.n for r in sizes.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not weights:
        return related.select("query_id", "group_id", F.col("split").alias("old_split"), F.col("split").alias("new_split"))
    places, sums = differencing(weights, bins)
    to = bins_to_splits(sums, targets)
    runs = []  # of a weight's components in order, which stretch goes to which split
    for w, per_bin in places.items():
        at = 0
        for name, _ in targets:
            n = int(sum(c for c, s in zip(per_bin, to, strict=True) if s == name))
            if n:
                runs.append((int(w), at, at + n, name))
            at += n
    stretch = spark.createDataFrame(runs, "w long, lo long, hi long, new_split string")
    # numbering without one sort of all: in parts, then offset by the parts before
    parts = sizes.groupBy("w", "part").agg(F.count(F.lit(1)).alias("n"))
    before = parts.withColumn("before", F.sum("n").over(Window.partitionBy("w").orderBy("part")) - F.col("n")).drop("n")
    placed = (
        sizes.withColumn("i", F.row_number().over(Window.partitionBy("w", "part").orderBy("group_id")) - 1)
        .join(before, ["w", "part"]).withColumn("i", F.col("i") + F.col("before")).join(stretch, "w")
        .where("i >= lo and i < hi").select("group_id", "new_split")
    )
    return related.join(placed, "group_id").select("query_id", "group_id", F.col("split").alias("old_split"), "new_split")


def straddling(assigned: DataFrame) -> DataFrame:
    """(group_id, query_id) of each group whose present splits differ."""
    torn = assigned.groupBy("group_id").agg(F.min("old_split").alias("a"), F.max("old_split").alias("b")).where("a <> b").select("group_id")
    return assigned.join(torn, "group_id", "left_semi").select("group_id", "query_id")
