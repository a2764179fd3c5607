import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarisk.functions.words import word_list
from tamarisk.llm.near import SMALL, Sketch, _meet, _within_reach, group_pairs, near_duplicate_groups
from tamarisk.llm.vectors import LEVELS, Quantiser, _best, _pack, _unpack, most_similar, neighbour_pairs

import pyarrow as pa


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        i = rng.randrange(len(words))
        words[i : i + rng.choice([0, 1])] = [f"e{rng.randrange(10**6)}"]
    return words


def exact_groups(rows, n, limit, least=20):
    sets = {}
    for i, t, a in rows:
        w = word_list((t or "") + " " + (a or ""))
        if len(w) >= least:
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and shared >= limit * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    groups = {}
    for i in ids:
        groups.setdefault(find(i), []).append(i)
    return {g: m for g, m in groups.items() if len(m) > 1}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(9)
    rows = []
    for g in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(15, 120))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            w = edited(rng, base, rng.choice([0, 1, 2, 4]))
            rows.append((len(rows), " ".join(w[:5]).upper(), "<i>" + " ".join(w[5:]) + "</i>."))
    hot = [f"h{k}" for k in range(200)]
    for _ in range(3 * SMALL):  # one group of nearly equal records holds a third of all rows
        rows.append((len(rows), "hot", " ".join(edited(rng, hot, 3))))
    rows += [(len(rows) + k, "copy", " ".join(hot[:60])) for k in range(50)]
    rows += [(9000, None, None), (9001, "", ""), (9002, "few words", None), (9003, None, " ".join(hot[:60])), (9004, "long", " ".join(f"q{k}" for k in range(30000)))]
    df = spark.createDataFrame(rows, "doc_id long, title string, abstract string").withColumns({"id": F.lit(1), "cls": F.lit(1), "content": F.lit("x")})
    for n, limit in ((3, 0.5), (5, 0.8)):
        got: dict = {}
        for r in near_duplicate_groups(df, run=n, threshold=limit).collect():
            got.setdefault(r.group_id, []).append(r.id)
        assert {g: sorted(m) for g, m in got.items()} == exact_groups(rows, n, limit)
    assert near_duplicate_groups(df.where("false")).count() == 0
    g = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (5, 5), (4, 5)], "id long, group_id long")
    assert sorted(tuple(r) for r in group_pairs(g).collect()) == [(1, 2), (1, 3), (2, 3), (4, 5)]


@pytest.mark.parametrize("block", [5, 4096])
def test_large_buckets_in_blocks(spark, block):
    """Of a bucket's pairs those within reach come out, whichever blocks they fall into."""
    rng = np.random.default_rng(3)
    sizes, reach = {1: 40, 2: 13}, 3
    fps = rng.integers(0, 256, (60, 32), dtype=np.uint8)
    fps[1::3] = fps[::3]
    fps[1::3, 0] ^= 1
    refs = rng.integers(0, 256, (8, 32), dtype=np.uint8)
    pivots = np.stack([np.minimum(np.bitwise_count(refs ^ f).sum(axis=1), 255).astype(np.uint8) for f in fps])
    rows, want = [], set()
    for band, n in sizes.items():
        for c in range(n):
            rows.append((band, c, c if c % 4 else 0, 0))
        for a in range(n):
            for b in range(n):
                ka, kb = (a if a % 4 else 0), (b if b % 4 else 0)
                if ka != 0 and ka != kb and np.bitwise_count(fps[a] ^ fps[b]).sum() <= reach:
                    want.add((min(a, b), max(a, b)))
    placed = spark.createDataFrame(rows, "band long, cls long, component long, main long")
    marks = spark.createDataFrame([(i, bytes(f), bytes(p)) for i, (f, p) in enumerate(zip(fps, pivots))], "cls long, fp binary, pivots binary")
    assert {tuple(r) for r in _within_reach(placed, marks, reach, block).collect()} == want and want


@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_meeting_in_buckets(batch):
    rng = np.random.default_rng(0)
    sizes = [1, 2, SMALL, SMALL + 1, 5, 4 * SMALL, 1, 1, 3]
    band = np.repeat(np.arange(len(sizes)), sizes)
    cls = np.concatenate([np.sort(rng.choice(10**6, s, replace=False)) for s in sizes])
    rows = pa.RecordBatch.from_arrays([pa.array(band), pa.array(cls)], names=["band", "cls"])
    out = pa.Table.from_batches(list(_meet(iter([rows.slice(k, batch) for k in range(0, len(band), batch)])))).to_pandas()
    pairs, large = out[~out.large], out[out.large]
    for k, s in enumerate(sizes):
        c = cls[band == k]
        mine = {(a, b) for a, b in zip(pairs.a, pairs.b) if a in set(c) and b in set(c)}
        if s <= SMALL:
            assert mine == {(a, b) for i, a in enumerate(c) for b in c[i + 1 :]}
        else:
            assert mine == {(c[0], x) for x in c[1:]} | set(zip(c[:-1], c[1:]))
            assert sorted(large.b[large.a == k]) == list(c)


def test_sketch_follows_likeness():
    s, rng = Sketch(), np.random.default_rng(1)
    for want in (0.5, 0.8):
        n = 3000
        shared = round(2 * n * want / (1 + want))
        x = rng.integers(0, 2**63, 2 * n - shared, dtype=np.uint64)
        a, b = s.minima(x[:n]), s.minima(x[n - shared :])
        assert abs((a == b).mean() - want) < 0.12
        assert np.bitwise_count(s.fingerprint(a) ^ s.fingerprint(b)).sum() <= s.reach(want)


def cloud(rng, n, dim=64):
    x = rng.standard_normal((n, dim))
    near = x[: n // 4] + 0.25 * rng.standard_normal((n // 4, dim))
    return np.concatenate([x, near, near[:20] * 4, x[:10]]).astype(np.float32)


def exact_neighbours(ids, x, k, least):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s, out = np.round(u @ u.T, 12), set()
    np.fill_diagonal(s, -2)
    for i in range(len(ids)):
        for j in np.lexsort((ids, -s[i]))[:k]:
            if s[i, j] >= least:
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


@pytest.mark.parametrize("full_cell", [16_384, 40])
def test_recall(spark, full_cell):
    rng = np.random.default_rng(3)
    x = cloud(rng, 1200)
    ids = rng.permutation(len(x)) + 1
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)] + [(int(ids[0]), x[0].tolist()), (int(ids[1]), None)]
    rows += [(9001, None), (9002, [1.0] * 32), (9003, [0.0] * 64), (9004, [float("nan")] * 64), (9005, [1.0] * 63 + [None]), (9006, [float("inf")] * 64), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "pid long, e array<float>").withColumns({"id": F.lit(1), "vec": F.lit(2), "cls": F.lit(3)})
    found = most_similar(df, "pid", "e", min_cosine=0.9, full_cell=full_cell)
    got, want = {tuple(r) for r in neighbour_pairs(found).collect()}, exact_neighbours(ids, x, 5, 0.9)
    assert len(got & want) >= 0.95 * len(want)
    assert len(got - want) <= 0.02 * len(want)
    assert most_similar(df.where("false"), "pid", "e").count() == 0
    assert most_similar(df.where("pid > 9000"), "pid", "e").count() == 0


def test_copies(spark):
    """A third of all rows are one vector: ids decide, and nothing grows with its square."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 64)).astype(np.float32)
    rows = [(i, x[0].tolist()) for i in range(150)] + [(1000 + i, v.tolist()) for i, v in enumerate(x[1:])]
    got = {}
    for r in most_similar(spark.createDataFrame(rows, "i long, v array<float>"), "i", "v", min_cosine=0.9).collect():
        got.setdefault(r.id, []).append((r.place, r.other))
    assert set(got) == set(range(150))
    assert all([o for _, o in sorted(m)] == [j for j in range(6) if j != i][:5] for i, m in got.items())


def test_codes():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = Quantiser(x, 0.9, 6)
    codes, beam = q.encode(x)
    c, n = _unpack(*_pack(codes, np.linalg.norm(q.decode(codes), axis=1)))
    assert np.array_equal(c, codes) and np.allclose(n, np.linalg.norm(q.decode(codes), axis=1), atol=1e-4)
    assert np.linalg.norm(x - q.decode(codes), axis=1).mean() < 0.5 and beam.shape == (500, 6, 2)
    # every estimate is a sum of table entries, and equals the product of the decoded vectors
    places, want = q.places(codes[:50]), q.decode(codes[:7]) @ q.decode(codes[:50]).T
    table = q.table(q.decode(codes[:7]))
    row, member = np.repeat(np.arange(7), 50), np.tile(np.arange(50), 7)
    assert places.shape == (LEVELS, 50) and table.shape == (7, len(q.flat))
    assert np.allclose(q.pair_scores(table, row, places, member).reshape(7, 50), want, atol=1e-4)
    assert np.allclose(q.block_scores(table, places), want, atol=1e-4)
    tiny = Quantiser(x[:3], 0.9, 6)
    assert tiny.encode(x[:3])[0].max() < 3


def crowded(rng, n, noise):
    """A third of all rows lie around one vector; (ids, vectors)."""
    x = rng.standard_normal((3 * n, 64))
    x[:n] = x[0] / np.linalg.norm(x[0]) + noise * rng.standard_normal((n, 64))
    return rng.permutation(3 * n) + 1, x.astype(np.float32)


def recall(spark, ids, x, **kw):
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "pid long, e array<float>")
    got, want = {tuple(r) for r in neighbour_pairs(most_similar(df, "pid", "e", min_cosine=0.9, **kw)).collect()}, exact_neighbours(ids, x, 5, 0.9)
    return len(got & want) / len(want), len(got - want) / len(want)


@pytest.mark.parametrize("noise", [0.003, 0.03])
def test_crowd(spark, noise):
    """A crowd of nearly equal, but different, vectors: codes can't tell its members apart."""
    found, wrong = recall(spark, *crowded(np.random.default_rng(7), 1500, noise))
    print("recall", found, "wrong", wrong)
    assert found >= 0.9 and wrong <= 0.1


def test_every_vector_gets_its_k(spark):
    """No floor: k rows for every vector, near or not, by tables; a third of all rows nearly equal."""
    rng = np.random.default_rng(12)
    ids, x = crowded(rng, 1000, 0.02)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "pid long, e array<float>")
    rows = most_similar(df, "pid", "e", scan_block=700).collect()
    got, want = {(r.id, r.other) for r in rows}, set()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -2)
    for i in range(len(ids)):
        want |= {(int(ids[i]), int(ids[j])) for j in np.lexsort((ids, -s[i]))[:5]}
    assert len(rows) == 5 * len(ids) and len(got & want) >= 0.95 * len(want)
    few = most_similar(df, "pid", "e", queries=F.col("id") % 100 == 0)
    assert {(r.id, r.other) for r in few.collect()} <= got | want and few.select("id").distinct().count() == 30
    assert most_similar(df.limit(3), "pid", "e").count() == 6
    assert most_similar(df.where("false"), "pid", "e").count() == 0


def test_scan_against_all():
    """Tables leave most rows out, and lose next to none of the nearest."""
    rng = np.random.default_rng(6)
    u = rng.standard_normal((9000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    q = Quantiser(u[:4000], 0.9, 6)
    q.error = q.slack(u[:4000])
    codes = q.encode(u.astype(np.float32))[0]
    cls = np.arange(len(u))
    i, m = _best(u[:600], cls[:600], u, cls, 5, -2.0, q, codes, np.linalg.norm(q.decode(codes), axis=1))
    s = u[:600] @ u.T
    s[cls[:600], cls[:600]] = -2
    want = {(r, c) for r in range(600) for c in np.argsort(-s[r], kind="stable")[:5]}
    assert len({*zip(i, m)} & want) >= 0.97 * len(want) and len(i) == 3000


def test_hot_cells_are_split(spark):
    """A cell whose queries and members are too many for a task is spread by salts."""
    ids, x = crowded(np.random.default_rng(9), 700, 0.03)
    split, whole = (recall(spark, ids, x, task_pairs=n, short=3000) for n in (500, 2_000_000_000))
    assert split == whole and split[0] >= 0.9


def test_best_in_blocks():
    rng = np.random.default_rng(1)
    u = rng.standard_normal((9500, 8))
    u[3000:9300] = u[0] * 2  # ties, over a block's edge
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cls = np.arange(len(u))
    i, m = _best(u[:1100], cls[:1100], u, cls, 5, 0.5)
    s = np.round(u[:1100] @ u.T, 12)
    s[cls[:1100], cls[:1100]] = -2
    assert {*zip(i, m)} == {(r, c) for r in range(1100) for c in np.argsort(-s[r], kind="stable")[:5] if s[r, c] >= 0.5}


def test_full_cells(spark):
    """Cells of over full_cell members are compared whole, none of them is left out."""
    found, wrong = recall(spark, *crowded(np.random.default_rng(8), 1500, 0.03), full_cell=40, short=2000)
    print("recall", found, "wrong", wrong)
    assert found >= 0.9 and wrong <= 0.1


@pytest.mark.parametrize("depth", [3, 4])
def test_depth(spark, depth):
    """The deeper indexes of large tables find pairs that are right at the wanted cosine."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((2400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = rng.standard_normal((1200, 64))
    r -= (r * x[:1200]).sum(1, keepdims=True) * x[:1200]
    x[1200:] = 0.91 * x[:1200] + (1 - 0.91**2) ** 0.5 * r / np.linalg.norm(r, axis=1, keepdims=True)
    found, wrong = recall(spark, np.arange(2400), x.astype(np.float32), depth=depth)
    print("recall", found)
    assert found >= 0.9 and wrong == 0
