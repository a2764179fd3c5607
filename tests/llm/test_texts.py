import random
import re
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarisk.functions.words import word_list
from tamarisk.llm import repetition
from tamarisk.llm.mixture import mix_sources
from tamarisk.llm.pieces import cut_item, piece_spans, split_oversized
from tamarisk.llm.repetition import ACCURACY, NOISE, STATS, hashed, least_determinant, repeated_share, repetition_outliers
from tamarisk.llm.tokens import BYTE_BPE, byte_table, decode_ids, decoded, encode_ids, encode_table, offsets_table, token_count, token_offsets, tokenizer

TEXTS = ["", None, " ", "plain words here", "naïve café — 中文字符 🧬🧬 ​﻿", "<|endoftext|> is text", "a" * 5000, "x\r\n\r\n\ty  z", "퟿ é é", "ｆｕｌｌ　ｗｉｄｔｈ"]


def checked(text, limit, low=100, high=200):
    spans = piece_spans(text, limit)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(z - a <= limit for a, z in spans)
    for (_, z), (b, y) in zip(spans, spans[1:]):
        assert low <= z - b <= high and y > z
    return spans


def test_spans():
    rng = random.Random(0)
    for _ in range(150):
        n = rng.randint(601, 6000)
        text = "".join(rng.choice(["word ", "longerword ", "end. ", "new\n\n", "；;", "x" * rng.randint(1, 300), "中。"]) for _ in range(n // 6))[:n]
        if len(text) > 600:
            checked(text, 600)
    sentence = "This sentence has exactly some words in it. "
    text = sentence * 60
    spans = checked(text, 1200)
    assert all(text[:z].endswith(". ") for _, z in spans) and len(spans) == -(-(len(text) - 200) // 1000)
    assert piece_spans("short", 600) == [(0, 5)]
    assert checked("y" * 5000, 600)
    with pytest.raises(ValueError):
        piece_spans("y" * 700, 500)


def test_paragraphs_win():
    text = "a b. " * 123 + "\n\n" + "c d. " * 87
    (_, stop), _ = piece_spans(text, 700)[:2]
    assert text[:stop].endswith("\n\n")


def test_oversized(spark):
    rows = [(1, "w " * 400), (1, "w " * 400), (2, "z" * 700), (3, "short"), (4, None), (5, ""), (None, "w " * 400), (6, "z" * 600 + " " + "z" * 600), (7, "é" * 601)]
    df = spark.createDataFrame(rows, "pid long, body string").withColumns({"text": F.lit("clash"), "item_id": F.lit(9)})
    got = {r.item_id: r for r in split_oversized(df, "pid", "body", 600).collect()}
    assert {i: r.cut for i, r in got.items()} == {1: "natural", 2: "forced", 6: "natural", 7: "forced"}
    assert got[1].n_chars == 800 and all(p.text == ("w " * 400)[p.start : p.stop] for p in got[1].pieces)
    assert split_oversized(df.where("false"), "pid", "body", 600).count() == 0
    for text, limit, want in (("a" * 601, 600, "forced"), ("a" * 600 + "." + "a" * 600, 600, "natural"), ("a b " * 300 + "c" * 601, 600, "forced"), ("short", 600, "natural")):
        assert cut_item(text, limit)[1] == want == ("forced" if re.search(r"[^\s.!?;。]{%d}" % (limit + 1), text) else "natural")


def test_tokens(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    ids = {r.doc_id: r.ids for r in encode_table(df).collect()}
    assert ids[0] == [] and ids[1] == [] and 50256 not in ids[5]
    assert {r.doc_id: r.text for r in encode_table(df).select("doc_id", decoded(F.col("ids")).alias("text")).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.n for r in df.select("doc_id", token_count(F.col("text")).alias("n")).collect()} == {i: len(x) for i, x in ids.items()}
    assert encode_table(df.where("false")).count() == 0
    t = tokenizer(BYTE_BPE)
    for i, text in enumerate(TEXTS):
        e = t.encode(text or "", add_special_tokens=False)
        assert list(encode_ids([text], BYTE_BPE))[0] == e.ids == ids[i]
        assert token_offsets(text or "", e.ids, BYTE_BPE) == [tuple(o) for o in e.offsets]
    rows = {r.doc_id: r for r in offsets_table(df).collect()}
    assert all(len(r.ids) == len(r.starts) == len(r.stops) for r in rows.values())
    assert len(byte_table()) == 256 and sorted(byte_table().values()) == list(range(256))
    part = next(i for i in ids[4] if "�" in decode_ids([i], BYTE_BPE))  # a split character alone
    assert decode_ids([part], BYTE_BPE).count("�") >= 1


DOCS = "doc_id long, source string, cited_by int, abstract string, text string"


def test_mixture(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["A"] * 14 + [" b", "B ", "c"]), rng.choice([None, 0, 5, 100]), rng.choice([None, "", "x"]), " ".join(["tok"] * rng.randint(1, 60))) for i in range(600)]
    rows += [(900, "A", 1, "x", None), (901, "A", 1, "x", ""), (902, None, 1, "x", "t"), (903, "Z", 1, "x", "t"), (None, "A", 1, "x", "t")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"key": F.lit(1), "n_tokens": F.lit(1)})
    targets = spark.createDataFrame([("a", 0.5, 1), ("B", 0.3, 3), ("C", 0.15, 4), ("EMPTY", 0.05, 5), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mix, report = mix_sources(docs, targets)
    got, rep = mix.collect(), {r.source: r for r in report.collect()}
    assert set(rep) == {"A", "B", "C", "EMPTY"} and rep["EMPTY"].tokens == 0
    caps = {"A": 1, "B": 3, "C": 4}
    assert len({r.doc_id for r in got}) == len(got) and all(1 <= r.copies <= caps[r.source] for r in got)
    for s, share in (("A", 0.5), ("B", 0.3), ("C", 0.15)):
        tokens = sum(r.copies * r.n_tokens for r in got if r.source == s)
        assert tokens == rep[s].tokens and abs(rep[s].share - share / 0.95) < 0.03
        full = [r.copies for r in got if r.source == s]
        assert max(full) - min(full) <= 1  # complete epochs precede the part of one
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in mix_sources(docs, targets)[0].collect())
    some, short = mix_sources(docs, targets, total_tokens=1000)
    assert sum(r.copies * r.n_tokens for r in some.collect()) <= 1000
    assert mix_sources(docs.where("false"), targets)[0].count() == 0
    assert mix_sources(docs, targets.where("false"))[0].count() == 0


def test_weights_matter(spark):
    docs = spark.createDataFrame([(i, "A", 1000 if i % 2 else 0, "x", "tok " * 10) for i in range(400)] + [(1000, "B", 0, "x", "tok " * 400)], DOCS)
    targets = spark.createDataFrame([("A", 0.8, 1), ("B", 0.2, 1)], "source string, target_share double, max_repeats int")
    a = [r.doc_id for r in mix_sources(docs, targets)[0].collect() if r.source == "A"]
    assert 50 < len(a) < 400 and sum(i % 2 for i in a) > 0.6 * len(a)


def plain_share(words, n=8):
    seen, hit = set(), [0] * len(words)
    for k in range(len(words) - n + 1):
        g = tuple(words[k : k + n])
        if g in seen:
            hit[k : k + n] = [1] * n
        seen.add(g)
    return sum(hit) / len(words) if words else 0.0


def test_repetition(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        words = [f"v{rng.randrange(500)}" for _ in range(rng.randint(0, 120))]
        if i % 9 == 0 and len(words) > 20:
            words = words + words[:rng.randint(8, 20)] * rng.randint(1, 6)
        if i % 50 == 1:
            words = ["spam"] * 60
        rows.append((i, rng.choice(["en", "EN ", None, "de"]), rng.choice(["MED", "med ", None]), " ".join(words)))
    rows += [(900, "en", "MED", None), (901, "en", "MED", ""), (902, "en", "MED", "a b " * 9), (903, "en", "MED", "one two. " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").withColumns({"n_words": F.lit(0), "d": F.lit(1), "grp": F.lit("x")})
    got = {r.doc_id: r for r in repetition_outliers(df).collect()}
    for i, _, _, t in rows:
        w = word_list(t)
        assert (i in got) == (len(w) >= 20)
        if i in got and i != 903:
            assert got[i].share == pytest.approx(plain_share(w)) and got[i].over == (plain_share(w) >= 0.3)
    assert got[903].over and got[903].outlier
    assert sum(r.outlier for r in got.values()) < 0.3 * len(got)
    assert all(got[i].outlier for i, *_ in rows if i in got and got[i].share > 0.8)
    assert repetition_outliers(df.where("false")).count() == 0
    assert repeated_share(hashed(["a"] * 16), 8) == 15 / 16 and repeated_share(hashed(["a"] * 9), 8) == 8 / 9 and repeated_share(hashed(["a"] * 8), 8) == 0.0


def fast_mcd(x, h, tries=60):
    """The plain algorithm: many random starts, steps to the end, the least determinant (with the same floor)."""
    rng, best = np.random.default_rng(0), None
    d = x.shape[1]
    for _ in range(tries):
        c = x[rng.choice(len(x), d + 1, replace=False)]
        last = np.inf
        while True:
            m, s = c.mean(0), np.cov(c.T, bias=True) + np.eye(d) * NOISE**2
            det = np.linalg.det(s)
            if len(c) == h and det > last * (1 - 1e-9):
                break
            last = det if len(c) == h else last
            far = np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(s), x - m)
            c = x[np.argsort(far, kind="stable")[:h]]
        if best is None or last < best[0]:
            best = (last, m)
    return best


def test_least_determinant(spark):
    """Against many random starts; a third of the points of one group are planted far off."""
    rng = np.random.default_rng(4)
    d = len(STATS)
    groups = {"a": rng.normal(0.4, 0.08, (150, d)), "b": np.concatenate([rng.normal(0.2, 0.05, (100, d)), rng.normal(1.2, 0.02, (33, d))]), "c": np.zeros((40, d)), "d": rng.normal(0.3, 0.1, (1, d))}
    rows = [(g, *map(float, r)) for g, x in groups.items() for r in x]
    df = spark.createDataFrame(rows, "grp string, " + ", ".join(f"t_{c} double" for c in STATS))
    got = {r.grp: r for r in least_determinant(df).collect()}
    for g, x in groups.items():
        h = int(np.ceil(0.75 * len(x)))
        det, centre = fast_mcd(x, h) if len(x) > d + 1 else (NOISE ** (2 * d), x[0])
        assert got[g].det <= det * 1.05 and np.abs(np.array([got[g][f"c{i}"] for i in range(d)]) - centre).max() < 0.03, g
    assert ACCURACY >= 10_000 and len({r.grp for r in got.values()}) == 4


def test_scatter_is_that_of_all_rows(spark, monkeypatch):
    """Normal rows, most statistics 0: the estimate from the nearest rows gives distances of the scatter of all."""
    t = [0.8 + 0.2 * NormalDist().inv_cdf((k + 0.5) / 2000) for k in range(2000)]
    rows = [(k, "en", "MED", 50, float(np.sin(x) ** 2), 0.0, 0.0, 0.0, 0.0) for k, x in enumerate(t)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, " + ", ".join(f"{c} double" for c in STATS))
    monkeypatch.setattr(repetition, "repetition_stats", lambda documents: documents)
    got = repetition_outliers(df).agg(F.avg("distance")).first()[0]
    turned = np.arcsin(np.sqrt(np.sin(t) ** 2))
    assert got == pytest.approx(turned.var() / (turned.var() + NOISE**2), rel=0.06)
