"""Near-duplicate records with small edits.

A record is the set of its distinct runs of n successive words; two are alike
if shared / united count reaches a threshold, and likeness connects groups.

Every set gets minwise hashes, one bit of each making a 256-bit fingerprint
whose Hamming distance follows the sets' distance, and a row of the pivot
table: the fingerprint's distances to many reference fingerprints. A pair is
discarded if some coordinate of the pivot table differs by more than the
distance two alike records can have (triangle inequality), then by the
fingerprints' own distance; survivors are verified on the whole texts.

A pivot table discards pairs but doesn't find them, and comparing all rows of it
is a comparison of all pairs. So pairs are proposed by bands of the same
minwise hashes: records that agree in all hashes of a band meet in a bucket.

Copies are one class (a 64-bit hash of the set), so they are compared once.
Small buckets propose all their pairs. Of a large one each member is first
paired with the bucket's smallest and its own neighbour; what these connect
needs no further pair, and then only members outside the bucket's main
component are compared with the others: fingerprint by fingerprint, in blocks that are
salted over tasks, of which only pairs within reach come out. Nothing is capped, and a
group of nearly equal records costs pairs in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.functions.words import word_list
from tamarisk.llm.repetition import hashed, runs
from tamarisk.operators.components import connected_components
from tamarisk.plans.materialise import written

ROWS = 4  # hashes a band
SMALL = 32  # a bucket up to this size proposes all its pairs


def shingles(text: str | None, n: int, min_words: int) -> np.ndarray | None:
    """Sorted distinct 64-bit hashes of the runs of n words; None for too few words."""
    w = word_list(text)
    if len(w) < max(min_words, n):
        return None
    return np.unique(runs(hashed(w), n))


class Sketch:
    """Minwise hashes, bands and fingerprints of shingle sets, from a seed."""

    def __init__(self, bands: int = 64, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.bands, k = bands, bands * ROWS
        self.mask = rng.integers(0, 2**64, (k, 1), dtype=np.uint64)
        self.mult = rng.integers(0, 2**64, (k, 1), dtype=np.uint64) | np.uint64(1)
        self.weave = rng.integers(0, 2**64, ROWS, dtype=np.uint64) | np.uint64(1)

    def minima(self, s: np.ndarray) -> np.ndarray:
        out = None
        for k in range(0, len(s), 1024):  # bounds memory for very long texts
            m = ((s[None, k : k + 1024] ^ self.mask) * self.mult).min(axis=1)
            out = m if out is None else np.minimum(out, m)
        return out

    def keys(self, minima: np.ndarray) -> np.ndarray:
        m = minima.reshape(self.bands, ROWS)
        h = ((m ^ (m >> np.uint64(31))) * self.weave).sum(axis=1, dtype=np.uint64)
        h = (h ^ np.arange(self.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(32))).view(np.int64)

    @staticmethod
    def fingerprint(minima: np.ndarray) -> np.ndarray:
        return np.packbits((minima >> np.uint64(40)).astype(np.uint8) & 1)

    def reach(self, threshold: float) -> int:
        """The Hamming distance that alike fingerprints exceed by chance in 1 of 3 million: 5 deviations."""
        k, p = self.bands * ROWS, (1 - threshold) / 2
        return ceil(k * p + 5 * sqrt(k * p * (1 - p)))


def _popcount(rows: np.ndarray) -> np.ndarray:
    return np.bitwise_count(rows).sum(axis=-1, dtype=np.int64)


def _references(records: DataFrame, sketch: Sketch, n: int, min_words: int, count: int) -> np.ndarray:
    """Fingerprints of up to ``count`` records, chosen by a hash of the id: a bounded sample."""
    every = max(1, records.count() // (4 * count))
    some = records.where((F.pmod(F.xxhash64("id"), F.lit(every)) == 0) & F.col("content").isNotNull())
    rows = some.orderBy(F.xxhash64("id"), "id").limit(4 * count).select("content").collect()
    sets = [s for r in rows if (s := shingles(r[0], n, min_words)) is not None][:count]
    size = sketch.bands * ROWS // 8
    return np.stack([sketch.fingerprint(sketch.minima(s)) for s in sets]) if sets else np.zeros((1, size), np.uint8)


def _features(records: DataFrame, sketch: Sketch, refs: np.ndarray, n: int, min_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, cls, bands, fps, pivots = [], [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (s := shingles(text, n, min_words)) is None:
                    continue
                m = sketch.minima(s)
                fp = sketch.fingerprint(m)
                ids.append(i)
                cls.append(xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63)
                bands.append(sketch.keys(m))
                fps.append(fp.tobytes())
                pivots.append(np.minimum(_popcount(refs ^ fp), 255).astype(np.uint8).tobytes())
            flat = np.concatenate(bands) if bands else np.empty(0, np.int64)
            offsets = np.arange(len(ids) + 1, dtype=np.int32) * sketch.bands
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(cls, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                 pa.array(fps, pa.binary()), pa.array(pivots, pa.binary())], names=["id", "cls", "bands", "fp", "pivots"])

    return records.select("id", "content").mapInArrow(run, "id long, cls long, bands array<long>, fp binary, pivots binary")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, cls) sorted by both, to proposed pairs (a, b); of a large bucket also
    the rows themselves as (band, cls, large). Holds one batch and the open bucket's
    rows up to SMALL, and of a large bucket only its first and last member."""
    band = cls = np.empty(0, np.int64)
    first = last = key = None  # of the large bucket that is open

    def emit(a: list[np.ndarray], b: list[np.ndarray], large: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        big = sum(len(x) for x, _ in large)
        small = sum(map(len, a))
        none = np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([none, *a, *[x for x, _ in large]])), pa.array(np.concatenate([none, *b, *[y for _, y in large]])),
             pa.array(np.arange(small + big) >= small)], names=["a", "b", "large"])

    def work(band: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
        a, b, large = [], [], []
        edges = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1], [True]]))
        size = np.diff(edges)
        length = np.repeat(size, size)
        for k in range(1, SMALL):
            at = np.flatnonzero((band[k:] == band[:-k]) & (length[k:] <= SMALL)) if len(band) > k else []
            if not len(at):
                break
            a.append(cls[at])
            b.append(cls[at + k])
        for e in np.flatnonzero(size > SMALL):
            c = cls[edges[e] : edges[e + 1]]
            a += [np.full(len(c) - 1, c[0]), c[:-1]]
            b += [c[1:], c[1:]]
            large.append((band[edges[e] : edges[e + 1]], c))
        return emit(a, b, large)

    for batch in batches:
        nb, nc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(nb):
            continue
        if key is not None:  # the large bucket goes on
            n = int(np.searchsorted(nb, key, side="right")) if nb[0] == key else 0
            if n:
                c = nc[:n]
                yield emit([np.full(n, first), np.concatenate([[last], c[:-1]])], [c, c], [(nb[:n], c)])
                last, nb, nc = c[-1], nb[n:], nc[n:]
                if not len(nb):
                    continue
            key = None
        band, cls = np.concatenate([band, nb]), np.concatenate([cls, nc])
        open_at = int(np.searchsorted(band, band[-1], side="left"))
        if len(band) - open_at > SMALL:  # the last bucket is large already
            key, first, last = band[-1], cls[open_at], cls[-1]
            yield work(band, cls)
            band = cls = np.empty(0, np.int64)
        elif open_at:
            yield work(band[:open_at], cls[:open_at])
            band, cls = band[open_at:], cls[open_at:]
    if len(band):
        yield work(band, cls)


def _discard(pairs: DataFrame, feats: DataFrame, reach: int) -> DataFrame:
    """The pairs that neither the pivot table nor the fingerprints rule out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            get = lambda name: np.frombuffer(b"".join(b.column(name).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            keep = np.abs(get("pa").astype(np.int16) - get("pb").astype(np.int16)).max(axis=1) <= reach
            keep &= _popcount(get("fa") ^ get("fb")) <= reach
            yield b.select(["a", "b"]).filter(pa.array(keep))

    side = lambda x: feats.select(F.col("cls").alias(x), F.col("fp").alias(f"f{x}"), F.col("pivots").alias(f"p{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "pa", "pb", "fa", "fb").mapInArrow(run, "a long, b long")


def _within_reach(placed: DataFrame, marks: DataFrame, reach: int, block: int = 4096) -> DataFrame:
    """(a, b): of each bucket (band, cls, component, main) the pairs of a member outside the main
    component and one of another component that neither pivots nor fingerprints rule out.

    A bucket is a grid of blocks, by salts, so one of any size spreads over all tasks; the pairs
    of a block are looked at where they meet, and only those within reach leave it."""
    def compare(t: pa.Table) -> pa.Table:
        asks, others = t.filter(t.column("ask")), t.filter(pc.invert(t.column("ask")))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if asks.num_rows and others.num_rows:
            get = lambda x, name: np.frombuffer(b"".join(x.column(name).to_pylist()), np.uint8).reshape(x.num_rows, -1)
            fa, fb = (np.ascontiguousarray(get(x, "fp")).view(np.uint64) for x in (asks, others))
            pa_, pb = get(asks, "pivots").astype(np.int16), get(others, "pivots").astype(np.int16)
            (ca, ka), (cb, kb) = ((x.column("cls").to_numpy(), x.column("component").to_numpy()) for x in (asks, others))
            for k in range(len(ca)):
                at = np.flatnonzero(kb != ka[k])
                at = at[np.abs(pb[at] - pa_[k]).max(axis=1, initial=0) <= reach] if len(at) else at
                at = at[np.bitwise_count(fb[at] ^ fa[k]).sum(axis=1) <= reach]
                found.append((np.full(len(at), ca[k]), cb[at]))
        x, y = (np.concatenate([np.empty(0, np.int64), *side]) for side in (zip(*found) if found else ((), ())))
        return pa.Table.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    outside = F.col("component") != F.col("main")
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / block)).cast("int")
    sizes = placed.groupBy("band").agg(parts(F.count_if(outside)).alias("qs"), parts(F.count(F.lit(1))).alias("ms"), F.count_if(outside).alias("n")).where("n > 0").drop("n")
    rows = placed.join(sizes, "band").join(marks, "cls")
    salt = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "cls"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where(outside).select("band", salt(1, "qs").alias("qi"), every("ms").alias("mi"), F.lit(True).alias("ask"), "cls", "component", "fp", "pivots")
    right = rows.select("band", every("qs").alias("qi"), salt(2, "ms").alias("mi"), F.lit(False).alias("ask"), "cls", "component", "fp", "pivots")
    return left.unionByName(right).groupBy("band", "qi", "mi").applyInArrow(compare, "a long, b long").distinct()


def _verify(pairs: DataFrame, texts: DataFrame, n: int, min_words: int, threshold: float) -> DataFrame:
    """The pairs whose whole texts are alike."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True):
                s, t = shingles(x, n, min_words), shingles(y, n, min_words)
                shared = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(shared >= threshold * (len(s) + len(t) - shared) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: texts.select(F.col("cls").alias(x), F.col("content").alias(f"t{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def near_duplicate_groups(documents: DataFrame, id_col: str = "doc_id", content: Column | None = None, run: int = 5,
                          threshold: float = 0.8, min_words: int = 20, bands: int = 64, references: int = 64, seed: int = 11) -> DataFrame:
    """(id, class_id, group_id) of every record that is alike to another one.

    ``content`` is the text to compare; by default title, blank, abstract. Records of
    fewer than ``min_words`` words (null and empty texts among them) take part in
    nothing. Equal sets have one class_id, the smallest id of the class; group_id is the smallest
    id of the group. At a likeness s a pair is proposed with probability
    1 - (1 - s^4)^bands: 0.98 at 0.5, above 0.9999 from 0.65 on; a group is whole
    if any chain of proposed pairs connects it. An id must be unique. An empty
    table gives an empty result.
    """
    if content is None:
        content = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    sketch = Sketch(bands, seed)
    records = documents.select(F.col(id_col).alias("id"), content.alias("content"))
    feats = written(_features(records, sketch, _references(records, sketch, run, min_words, references), run, min_words), "near")
    one = feats.groupBy("cls").agg(F.min("id").alias("rep"))
    rows = feats.select(F.explode("bands").alias("band"), "cls").distinct()
    met = written(rows.repartition("band").sortWithinPartitions("band", "cls").mapInArrow(_meet, "a long, b long, large boolean"), "near")
    marks = feats.select("cls", "fp", "pivots").dropDuplicates(["cls"])
    reach = sketch.reach(threshold)

    def alike(pairs: DataFrame) -> DataFrame:
        left = written(_discard(pairs, marks, reach), "near")
        ends = left.select(F.col("a").alias("cls")).unionByName(left.select(F.col("b").alias("cls"))).distinct()
        texts = written(one.join(ends, "cls", "left_semi").join(records, F.col("rep") == F.col("id")).select("cls", "content"), "near")
        return written(_verify(left, texts, run, min_words, threshold), "near")

    edges = alike(met.where("not large").select("a", "b").distinct())
    comp = written(connected_components(edges, "a", "b").withColumnRenamed("node", "cls"), "near")
    large = met.where("large").select(F.col("a").alias("band"), F.col("b").alias("cls"))
    if not large.isEmpty():
        placed = written(large.join(comp, "cls", "left").withColumn("component", F.coalesce("component", "cls")), "near")
        main = placed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(
            F.max_by("component", F.struct("n", "component")).alias("main"))
        more = _within_reach(placed.join(main, "band"), marks, reach)
        edges = edges.unionByName(alike(more))
        comp = written(connected_components(edges, "a", "b").withColumnRenamed("node", "cls"), "near")
    grouped = feats.select("id", "cls").join(comp, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    firsts = grouped.groupBy("component").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return written(grouped.join(firsts, "component").join(one, "cls").select("id", F.col("rep").alias("class_id"), "group_id"), "near")


def group_pairs(groups: DataFrame) -> DataFrame:
    """(id_a, id_b), smaller first: all pairs of one group. The result is as large as that."""
    a = groups.select(F.col("id").alias("id_a"), "group_id")
    b = groups.select(F.col("id").alias("id_b"), "group_id")
    return a.join(b, "group_id").where("id_a < id_b").select("id_a", "id_b")
