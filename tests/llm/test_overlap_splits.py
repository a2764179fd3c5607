import random
import time
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tamarisk.functions.words import word_list
from tamarisk.llm.overlap import PAIRED, cross_split_pairs, overlap_classes, overlap_report
from tamarisk.llm.splits import TARGETS, assign_splits, bins_to_splits, differencing, related_queries, straddling
from tamarisk.plans.materialise import written

Q = "query_id long, query_text string, origin string, split string"


def test_overlap_against_all_pairs(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(220):
        base = rng.sample(vocab[: rng.choice([6, 12, 40])], rng.randint(1, 6))
        if rows and rng.random() < 0.5:
            base = (rows[rng.randrange(len(rows))][1] or "x").lower().split()
            if rng.random() < 0.6 and len(base) > 1:
                base[rng.randrange(len(base))] = rng.choice(vocab)
        text = " ".join(w.upper() if rng.random() < 0.2 else w for w in base)
        rows.append((i, rng.choice([text, text + "!", f"<b>{text}</b>"]), "manual", rng.choice(["train", " Train", "dev", "TEST ", None, "other"])))
    rows += [(900, None, "manual", "train"), (901, "", "manual", "dev"), (902, "?!", "manual", "test"), (903, "?!", "manual", "train")]
    df = spark.createDataFrame(rows, Q).withColumn("toks", F.lit(1)).withColumn("id", F.lit(2))
    recs = [(i, s.strip().lower(), frozenset(word_list(t))) for i, t, _, s in rows if s and word_list(t)]
    for limit in (0.7, 0.5, 1.0):
        want = {(min(a, b), max(a, b)) for a, s, x in recs if s == "train" for b, r, y in recs if r in ("dev", "test")
                if len(x & y) >= limit * len(x | y) - 1e-9}
        assert {tuple(r) for r in cross_split_pairs(df, threshold=limit).collect()} == want
    assert cross_split_pairs(df.where("false")).count() == 0
    rep = {r.split: r for r in overlap_report(df).collect()}
    assert set(rep) == {"dev", "test"} and all(r.n_exact <= r.n_near <= r.n_records for r in rep.values())


def test_long_records(spark):
    """Sets around and far over PAIRED words: exact, and hashes in proportion to their length."""
    rng = random.Random(8)
    rows = []
    for i in range(60):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([40, 60, 70, 90, 300, 3000]))]
        rows.append((len(rows), " ".join(base), "m", "train"))
        for keep in rng.sample([0.99, 0.86, 0.8, 0.72, 0.66], 2):
            rows.append((len(rows), " ".join(w for w in base if rng.random() < keep) + " x", "m", rng.choice(["dev", "test"])))
    df = spark.createDataFrame(rows, Q)
    recs = [(i, s, frozenset(word_list(t))) for i, t, _, s in rows]
    want = {(min(a, b), max(a, b)) for a, s, x in recs if s == "train" for b, r, y in recs if r != "train" and len(x & y) >= 0.7 * len(x | y) - 1e-9}
    assert {tuple(r) for r in cross_split_pairs(df).collect()} == want and any(len(x) > 4 * PAIRED for _, _, x in recs)


def test_classes(spark):
    rows = [(1, "a b c d", "m", "train"), (2, "A b c d!", "m", "train"), (3, "d c b a", "m", "dev"), (4, "a b c d e", "m", "test"), (5, "zz", "m", "test"), (6, "", "m", "dev"),
            (7, "a b c d", "m", "dev"), (7, "a b c d", "m", "dev")]
    got = {r.id: (r.split, r.class_id, r.n_exact, r.n_links) for r in overlap_classes(spark.createDataFrame(rows, Q)).collect()}
    assert got == {1: ("train", 1, 1, 3), 2: ("train", 1, 1, 3), 3: ("dev", 1, 0, 2), 4: ("test", 4, 0, 2), 5: ("test", 5, 0, 0), 7: ("dev", 1, 2, 2)}
    assert overlap_classes(spark.createDataFrame([], Q)).count() == 0


def test_hot_copies(spark):
    """A third of all rows are one text."""
    rows = [(i, "same words here", "m", "train" if i % 2 else "dev") for i in range(40)] + [(100 + i, f"other {i} text {i}", "m", "train") for i in range(80)]
    assert cross_split_pairs(spark.createDataFrame(rows, Q)).count() == 400


def test_related_queries(spark):
    q = spark.createDataFrame([(1, "A b", "c", "train"), (2, "a  B!", "c", "Dev "), (3, "c d", "c", "test"), (4, "e", "c", "train"), (5, "f", "c", None), (6, "", "c", "dev"), (7, None, "c", "dev")], Q)
    ctx = spark.createDataFrame([(1, 10, 1, "a b"), (2, 11, 1, "C D"), (3, 10, 2, "zz"), (4, 12, 1, "e"), (5, 11, 1, "f"), (6, 12, 1, "f"), (7, None, 1, "e"), (8, 13, 1, None)],
                                "ctx_id long, citing_doc_id long, cited_doc_id long, context_text string")
    docs = spark.createDataFrame([(10, None), (11, 10), (12, None), (13, 13)], "doc_id long, canonical_doc_id long")
    rel = written(related_queries(q, ctx, docs))
    assert {r.query_id: r.group_id for r in rel.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 6: 6, 7: 7}  # 5 has no split, so it ties nothing
    assert sorted(tuple(r) for r in straddling(assign_splits(rel)).collect()) == [(1, 1), (1, 2), (1, 3)]
    assert related_queries(q.where("false"), ctx, docs).count() == 0
    assert related_queries(q, ctx.where("false"), docs.where("false")).count() == 6


def test_differencing():
    rng = random.Random(1)
    weights = {w: rng.randint(1, 300) for w in range(1, 30)}
    places, sums = differencing(weights, 20)
    assert all(p.sum() == weights[w] for w, p in places.items())
    assert np.array_equal(sum(w * p for w, p in places.items()), sums)
    assert sums.max() - sums.min() <= 2
    to = bins_to_splits(sums, TARGETS)
    total = sums.sum()
    for name, share in TARGETS:
        assert abs(sums[[k for k, t in enumerate(to) if t == name]].sum() / total - share) < 0.06


def test_differencing_of_many_weights():
    """As many different weights as a hundred million records can have: seconds, and little memory."""
    weights = {w: 1 + w % 250 for w in range(1, 14_000)}
    tracemalloc.start()
    began = time.perf_counter()
    places, sums = differencing(weights, 100)
    took, (_, peak) = time.perf_counter() - began, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert took < 60 and peak < 200e6 and sums.max() - sums.min() <= 2
    assert all(p.sum() == weights[w] and p.min() >= 0 for w, p in places.items()) and np.array_equal(sum(w * p for w, p in places.items()), sums)


def test_assignment_keeps_groups_whole(spark):
    rng = random.Random(4)
    rows, i = [], 0
    for g in range(400):
        for _ in range(400 if g == 0 else rng.choice([1, 1, 2, 3, 7])):
            rows.append((i, rng.choice(["train", "dev", "test"]), g))
            i += 1
    df = spark.createDataFrame(rows, "query_id long, split string, group_id long")
    got = assign_splits(df).collect()
    assert len(got) == len(rows) and len({(r.group_id, r.new_split) for r in got}) == 400
    for name, share in TARGETS:
        assert abs(sum(r.new_split == name for r in got) / len(rows) - share) < 0.02
    assert [tuple(r) for r in assign_splits(df).orderBy("query_id").collect()] == [tuple(r) for r in assign_splits(df).orderBy("query_id").collect()]
    assert assign_splits(df.where("false")).count() == 0
