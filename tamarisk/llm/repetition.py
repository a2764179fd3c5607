"""Repetition inside a single document.

Per document the operator measures how much of it repeats earlier parts, as a
vector: words inside repeated 8-word runs, words inside repeated 3-word runs,
characters of repeated sentences, of repeated lines and of repeated paragraphs. The
shares are transformed (arcsine of the root), and per language and source a robust
centre and scatter are estimated by the minimum covariance determinant (Rousseeuw and
Van Driessen, Technometrics 1999): from several deterministic starts (as in Hubert,
Rousseeuw and Verdonck, 2012) concentration steps run until no determinant falls by a
thousandth, the least is kept, and one reweighting step follows. The scatter of a part of the
rows is enlarged by the factor that makes it that of all (normal) rows, before a floor is added that
keeps the determinant above 0 where most documents repeat nothing (both as in Boudt et al., 2020).
Documents far from the centre in Mahalanobis distance, on the side of more
repetition, are outliers; they, and those over the share that is too much anywhere, are rejected.

All starts of all groups take their steps together; a step is two aggregates (a
quantile, then moments), so a group of any size spreads over all tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.functions.words import word_list
from tamarisk.plans.materialise import cut, written

STATS = ("run8", "run3", "sentences", "lines", "paragraphs")
_D = len(STATS)
NEAR, CHI2_NEAR, CHI2_CUT = 0.975, 12.833, 20.515  # fixed values: quantiles 0.975 and 0.999 of chi-square, 5 degrees of freedom
ACCURACY = 100_000  # of approximate quantiles: exact up to as many rows
NOISE = 0.05  # differences of a transformed share under this count for little
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s*")


@lru_cache(maxsize=500_000)
def _word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def hashed(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_word_hash, words), dtype=np.uint64, count=len(words))


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n successive words, given the words' hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m]
        out ^= out >> np.uint64(29)
    return out


def repeated_share(h: np.ndarray, n: int) -> float:
    """The share of positions inside a run of n that started at an earlier position too."""
    r = runs(h, n)
    if not len(r):
        return 0.0
    _, first = np.unique(r, return_index=True)
    if len(first) == len(r):
        return 0.0
    again = np.ones(len(r), dtype=bool)
    again[first] = False
    at = np.flatnonzero(again)
    edge = np.zeros(len(h) + 1, dtype=np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return float((np.cumsum(edge[:-1]) > 0).sum() / len(h))


def _said_before(parts: list[str]) -> float:
    seen: set[str] = set()
    total = again = 0
    for p in parts:
        if p := p.strip():
            total += len(p)
            again += len(p) if p in seen else 0
            seen.add(p)
    return again / total if total else 0.0


def repetition_stats(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, run8, run3, sentences, lines, paragraphs) of every row.

    A null or empty text has 0 words and repeats nothing. Whole texts are read.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                h = hashed(word_list(text))
                rows.append((len(h), repeated_share(h, 8), repeated_share(h, 3), _said_before(_SENTENCE.split(text or "")), _said_before((text or "").split("\n")), _said_before(_PARAGRAPH.split(text or ""))))
            out = pd.DataFrame(rows, columns=["n_words", *STATS])
            for k, c in enumerate(("doc_id", "lang", "source")):
                out.insert(k, c, b[c].to_numpy())
            yield out

    kept = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.lower(F.trim("lang")), F.lit("und")).alias("lang"),
        F.coalesce(F.upper(F.trim("source")), F.lit("")).alias("source"), "text")
    return kept.mapInPandas(run, "doc_id long, lang string, source string, n_words long, " + ", ".join(f"{c} double" for c in STATS))


_UPPER = [(i, j) for i in range(_D) for j in range(i, _D)]
_C, _U = [f"c{i}" for i in range(_D)], [f"u{i}" for i in range(len(_UPPER))]  # a centre, and the triangle that turns scatter into the unit
ESTIMATE = "grp string, start int, " + ", ".join(f"{c} double" for c in (*_C, *_U)) + ", det double, falls boolean"
GAIN = 1e-3  # share of a determinant by which a step must lower it for another to follow
INF = float("inf")
FEW = 20_000  # groups; estimates of so many (a few MB) may be broadcast


def _triangle(scatter: np.ndarray) -> np.ndarray:
    """The upper triangle U, row by row, with |U (x - centre)|^2 the squared distance."""
    return np.linalg.cholesky(np.linalg.inv(scatter)).T[tuple(zip(*_UPPER, strict=True))]


def _chi2(x: float, k: int) -> float:
    """The chi-square distribution at x, for an odd number of degrees of freedom."""
    out = math.erf(math.sqrt(x / 2))
    for j in range(1, k, 2):
        out -= (x / 2) ** (j / 2) * math.exp(-x / 2) / math.gamma(j / 2 + 1)
    return out


def consistency(keep: float) -> float:
    """How many times the scatter of all normal rows is that of the share ``keep`` of them nearest the centre."""
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(mid, _D) < keep else (low, mid)
    return keep / _chi2(high, _D + 2)


def _solve(batches: Iterator[pd.DataFrame], factor: float = 1.0) -> Iterator[pd.DataFrame]:
    """Moments of each group and start (one row) to centre, triangle and determinant; falls says
    whether that is under the last one (``was``). The floor isn't multiplied by ``factor``."""
    for b in batches:
        rows = []
        for r in b.itertuples(index=False):
            m, c = np.array([getattr(r, f"s{i}") for i in range(_D)]) / r.n, np.empty((_D, _D))
            for k, (i, j) in enumerate(_UPPER):
                c[i, j] = c[j, i] = getattr(r, f"p{k}") / r.n - m[i] * m[j]
            c = c * factor + np.eye(_D) * NOISE**2
            det = float(np.linalg.det(c))
            rows.append((r.grp, r.start, *m, *_triangle(c), det, det < r.was * (1 - GAIN)))
        yield pd.DataFrame(rows, columns=["grp", "start", *_C, *_U, "det", "falls"])


def _enlarged(batches: Iterator[pd.DataFrame], factor: float) -> Iterator[pd.DataFrame]:
    """Estimates with their scatter, but not its floor, multiplied."""
    for b in batches:
        rows = []
        for r in b.itertuples(index=False):
            u = np.zeros((_D, _D))
            u[tuple(zip(*_UPPER, strict=True))] = [getattr(r, c) for c in _U]
            floor = np.eye(_D) * NOISE**2
            rows.append((r.grp, *[getattr(r, c) for c in _C], *_triangle((np.linalg.inv(u.T @ u) - floor) * factor + floor)))
        yield pd.DataFrame(rows, columns=["grp", *_C, *_U])


def _distance() -> Column:
    x = [F.col(f"t_{c}") - F.col(_C[i]) for i, c in enumerate(STATS)]
    rows = [[F.col(_U[k]) * x[j] for k, (i, j) in enumerate(_UPPER) if i == row] for row in range(_D)]
    return sum((sum(r[1:], r[0]) * sum(r[1:], r[0]) for r in rows[1:]), sum(rows[0][1:], rows[0][0]) * sum(rows[0][1:], rows[0][0]))


def _moments(rows: DataFrame, *by: str) -> DataFrame:
    t = [F.col(f"t_{c}") for c in STATS]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(t)],
                                 *[F.sum(t[i] * t[j]).alias(f"p{k}") for k, (i, j) in enumerate(_UPPER)])


def _with(rows: DataFrame, small: DataFrame, by: list[str], few: bool) -> DataFrame:
    """Rows joined with a table of one row a group and start, beside the rows where there are few groups."""
    return rows.join(F.broadcast(small) if few else small, by)


def _starts(rows: DataFrame, few: bool) -> DataFrame:
    """Four deterministic estimates a group: medians with unit scatter; medians with the median
    absolute deviations; mean and covariance; and no repetition at all with the scatter of directions
    from the medians (spatial signs)."""
    t = [F.col(f"t_{c}") for c in STATS]
    mid = cut(rows.groupBy("grp").agg(*[F.percentile_approx(x, 0.5, ACCURACY).alias(_C[i]) for i, x in enumerate(t)]))
    off = _with(rows, mid, ["grp"], few)
    dev = off.groupBy("grp", *_C).agg(*[F.percentile_approx(F.abs(x - F.col(_C[i])), 0.5, ACCURACY).alias(f"m{i}") for i, x in enumerate(t)])
    size = F.sqrt(sum(((x - F.col(_C[i])) * (x - F.col(_C[i])) for i, x in enumerate(t)), F.lit(0.0)))
    signs = off.withColumn("size", size).where("size > 0").select("grp", *[((x - F.col(_C[i])) / F.col("size")).alias(f"t_{c}") for (i, x), c in zip(enumerate(t), STATS, strict=True)])
    flat = lambda entry: [(entry(i) if i == j else F.lit(0.0)).alias(_U[k]) for k, (i, j) in enumerate(_UPPER)]
    given = lambda start, df, centre, triangle: df.select("grp", F.lit(start).alias("start"), *centre, *triangle, F.lit(INF).alias("det"))
    plain = given(0, dev, _C, flat(lambda i: F.lit(1 / NOISE)))
    scaled = given(1, dev, _C, flat(lambda i: 1 / F.sqrt((F.col(f"m{i}") * 1.4826) * (F.col(f"m{i}") * 1.4826) + NOISE**2)))
    first = lambda df, start: _moments(df, "grp").withColumns({"start": F.lit(start), "was": F.lit(INF)})
    whole = given(2, first(rows, 2).mapInPandas(_solve, ESTIMATE), _C, _U)
    turned = given(3, first(signs, 3).mapInPandas(_solve, ESTIMATE), [F.lit(0.0).alias(c) for c in _C], _U)
    return plain.unionByName(scaled).unionByName(whole).unionByName(turned)


def least_determinant(rows: DataFrame, keep: float = 0.75, most_steps: int = 30) -> DataFrame:
    """(grp, start, centre, triangle, det): per group the estimate of least determinant, from rows with a
    grp and transformed statistics. Steps go on until none lowers the determinant of any
    start by a thousandth (they never raise it), ``most_steps`` at most."""
    few = rows.select("grp").distinct().count() <= FEW
    now = cut(_starts(rows, few))
    done = None
    for _ in range(most_steps):
        far = _with(rows, now.drop("det"), ["grp"], few).withColumn("d", _distance())
        edge = cut(far.groupBy("grp", "start").agg(F.percentile_approx("d", keep, ACCURACY).alias("edge")))
        held = _with(rows, now.drop("det").join(edge, ["grp", "start"]), ["grp"], few).where(_distance() <= F.col("edge"))
        was = now.select("grp", "start", F.col("det").alias("was"))
        new = cut(_moments(held, "grp", "start").join(was, ["grp", "start"]).mapInPandas(_solve, ESTIMATE))
        settled = new.where("not falls").drop("falls")
        done = settled if done is None else done.unionByName(settled)
        now = new.where("falls").drop("falls")
        if now.isEmpty():
            break
    else:
        done = done.unionByName(now)
    best = F.min_by(F.struct("start", *_C, *_U, "det"), F.struct("det", "start"))
    return cut(done.groupBy("grp").agg(best.alias("b")).select("grp", "b.*"))


def repetition_outliers(documents: DataFrame, min_words: int = 20, threshold: float = 0.3, keep: float = 0.75) -> DataFrame:
    """(doc_id, lang, source, n_words, share, distance, outlier, over, rejected) of documents with at
    least ``min_words`` words.

    share is that of words inside repeated 8-word runs; over: share >= threshold;
    distance: the squared robust distance within language and source; outlier: it is
    beyond the 0.999 quantile of chi-square, with more repetition than the centre; rejected: either.
    Every language and source has its own estimate, however few documents it has (one of
    a single document is its centre: no outlier). Null languages form one group ('und'), and
    so do null sources. Equal documents get equal values. An empty table gives an empty result.
    """
    stats = repetition_stats(documents).where(F.col("n_words") >= min_words)
    turned = stats.select("doc_id", "lang", "source", "n_words", "run8", *[F.asin(F.sqrt(c)).alias(f"t_{c}") for c in STATS], F.concat_ws("/", "lang", "source").alias("grp"))
    rows = written(turned, "repetition")
    few = rows.select("grp").distinct().count() <= FEW
    least = least_determinant(rows, keep).select("grp", *_C, *_U)
    raw = cut(least.mapInPandas(partial(_enlarged, factor=consistency(keep)), least.schema))
    near = _with(rows, raw, ["grp"], few).where(_distance() <= CHI2_NEAR)
    moments = _moments(near, "grp").withColumns({"start": F.lit(0), "was": F.lit(INF)})
    final = cut(moments.mapInPandas(partial(_solve, factor=consistency(NEAR)), ESTIMATE).select("grp", *_C, *_U))
    far = _with(rows, final, ["grp"], few).withColumn("distance", _distance())
    distance = F.col("distance")
    more = F.greatest(*[F.col(f"t_{c}") - F.col(_C[i]) for i, c in enumerate(STATS)]) > 0
    judged = far.select(
        "doc_id", "lang", "source", "n_words", F.col("run8").alias("share"), "distance",
        ((distance > CHI2_CUT) & more).alias("outlier"), (F.col("run8") >= threshold).alias("over"))
    return judged.withColumn("rejected", F.col("outlier") | F.col("over"))
