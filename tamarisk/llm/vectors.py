"""Most similar vectors for every vector.

Additive quantisation: a vector is the sum of one codeword from each of several
full-dimensional codebooks, fitted level by level to residuals on a bounded
sample; beam search encodes it, and the norm of its reconstruction is stored
with the code. Estimates are sums of lookup-table entries: a query's table holds
its inner product with every codeword, and a coded row's estimate is the sum of
its codewords' entries over its norm. What an estimate can't rule out is ranked
again by exact cosine. Two ways to search, chosen by what is asked:

* With a floor (``min_cosine``) the first levels' codes are the cells of an
  inverted index: a vector is listed in its nearest cell and looks into the cells
  of its beam, which is widened until, at that depth, 96 of 100 of the sample's
  pairs at the floor meet in a cell. Only codes travel (two longs a row); vectors
  are shuffled once, and only those of surviving pairs go on. A query with more
  than ``short`` others over the bound in one cell stands in a crowd its code can't
  tell apart: it is compared with every vector of its cells, and of those of a
  wider beam, by exact cosine. That is work in proportion to the crowd's square.
* Without a floor the nearest of a query may be no nearer than most vectors, and
  no cell can be left out: the tables scan the codes of all rows, a query's best
  estimates are ranked exactly, and every row whose estimate could still beat the
  k-th of them (within the error that 99 of 100 of the sample's true neighbours
  keep) is ranked exactly too. No list is cut at a number.

Both run in blocks of bounded memory, and what one cell needs beyond that is
split over tasks by salts. Equal vectors are one class (a 64-bit hash), so copies
cost nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarisk.plans.materialise import written

SIZES = (64, 64, 8, 8, 8, 8, *[64] * 10)  # words a level: the first six may be cells, so these grow in small steps
LEVELS, LATE_BEAM = len(SIZES), 3  # 84 bits a vector
HALF = LEVELS // 2
FIRST_LEVELS = 6  # 16 million cells at most
MEAN_CELL = 512
MEET = 0.96  # share of pairs at the wanted cosine whose cells must meet
LOSS = 0.01  # share of pairs at the wanted cosine that an estimate may miss
WIDE = 4  # times the beam, for queries in a crowd


class Quantiser:
    """Residual codebooks (levels, words, dim) and what scoring needs of them."""

    def __init__(self, sample: np.ndarray, min_cosine: float, beam: int, seed: int = 5, rounds: int = 8) -> None:
        rng = np.random.default_rng(seed)
        self.dim, self.beam, self.depth, self.error = sample.shape[1], beam, 2, 0.0
        left, books = sample.astype(np.float32), []
        for size in SIZES:
            words = min(size, len(sample))
            c = left[rng.choice(len(left), words, replace=False)].copy()
            for _ in range(rounds):
                at = (2 * left @ c.T - (c * c).sum(1)).argmax(1)
                n = np.bincount(at, minlength=words)
                sums = np.stack([np.bincount(at, left[:, j], words) for j in range(self.dim)], 1)
                c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c).astype(np.float32)
            books.append(c)
            left = left - c[(2 * left @ c.T - (c * c).sum(1)).argmax(1)]
        self.books = books
        self.flat = np.concatenate(books)
        self.at = np.cumsum([0, *map(len, books)])  # where a level's words begin in flat
        self.radix = np.cumprod([1, *SIZES[:FIRST_LEVELS]])  # of cell numbers
        self.bound = self._calibrate(sample, min_cosine, rng)

    @staticmethod
    def _pairs(sample: np.ndarray, cosine: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        x = sample[:3000].astype(np.float32)
        r = rng.standard_normal(x.shape).astype(np.float32)
        r -= (r * x).sum(1, keepdims=True) * x
        y = cosine * x + np.sqrt(max(0.0, 1 - cosine**2)) * r / np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-9)
        return x, y

    def _calibrate(self, sample: np.ndarray, cosine: float, rng: np.random.Generator) -> float:
        x, y = self._pairs(sample, cosine, rng)
        a, b = self.decode(self.encode(x)[0]), self.decode(self.encode(y)[0])
        est = (a * b).sum(1) / np.maximum(np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1), 1e-9)
        return float(np.quantile(est, LOSS))

    def slack(self, sample: np.ndarray, k: int = 10) -> float:
        """How far under its cosine the estimate of a neighbour may lie, the query's own vector being
        exact: 99 of 100 of the sample's nearest, and of its pairs at any cosine, keep it."""
        x = sample[:500].astype(np.float32)
        codes = self.encode(sample.astype(np.float32))[0]
        known = self.decode(codes)
        known /= np.maximum(np.linalg.norm(known, axis=1, keepdims=True), 1e-9)
        true = x @ sample.T.astype(np.float32)
        true[np.arange(len(x)), np.arange(len(x))] = -2
        near = np.argsort(-true, axis=1)[:, : min(k, len(sample) - 1)]
        worst = [np.take_along_axis(true - x @ known.T, near, 1).ravel()] if near.shape[1] else [np.zeros(1)]
        for c in (0.5, 0.7, 0.9, 0.99):
            a, b = self._pairs(sample, c, np.random.default_rng(13))
            seen = self.decode(self.encode(b)[0])
            worst.append((a * b).sum(1) - (a * seen).sum(1) / np.maximum(np.linalg.norm(seen, axis=1), 1e-9))
        return float(max(np.quantile(w, 1 - LOSS) for w in worst))

    def widen(self, sample: np.ndarray, cosine: float, most: int = 512) -> None:
        """The beam at this depth, at least as wide as it is, with which ``MEET`` of the sample's pairs
        at the wanted cosine share a cell: one's nearest is in the other's beam."""
        x, y = self._pairs(sample, cosine, np.random.default_rng(11))
        while self.beam < most:
            a, b = ((self.encode(v, self.depth)[1].astype(np.int64) * self.radix[: self.depth]).sum(2) for v in (x, y))
            if ((a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)).mean() >= MEET:
                break
            self.beam += max(1, self.beam // 4)

    def encode(self, x: np.ndarray, levels: int = LEVELS, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, levels), and the beam's codes of the first ``depth`` levels (n, beam, depth), best first."""
        n, beam = len(x), beam or self.beam
        codes = np.zeros((n, 1, 0), np.uint8)
        left, norm, cells = x[:, None, :], (x * x).sum(1)[:, None], None
        for m, c in enumerate(self.books[:levels]):
            k = len(c)
            cost = (norm[:, :, None] - 2 * (left.reshape(-1, self.dim) @ c.T).reshape(n, -1, k) + (c * c).sum(1)).reshape(n, -1)
            width = min(beam if m < self.depth else LATE_BEAM, cost.shape[1])
            top = np.argpartition(cost, width - 1, axis=1)[:, :width]
            found = np.take_along_axis(cost, top, 1)
            order = np.argsort(found, axis=1, kind="stable")
            top, norm = np.take_along_axis(top, order, 1), np.take_along_axis(found, order, 1)
            parent, word = top // k, top % k
            left = np.take_along_axis(left, parent[:, :, None], 1) - c[word]
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
            if m + 1 == self.depth:
                cells = codes
        return codes[:, 0], cells

    def decode(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), self.dim), np.float32)
        for m in range(codes.shape[1]):
            out += self.books[m][codes[:, m]]
        return out

    def table(self, q: np.ndarray) -> np.ndarray:
        """The lookup table of each query (n, words): its inner product with every codeword."""
        return q.astype(np.float32) @ self.flat.T

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Where a coded row's entries stand in a table (levels, n)."""
        return codes.T.astype(np.int64) + self.at[:LEVELS, None]

    def pair_scores(self, table: np.ndarray, row: np.ndarray, places: np.ndarray, member: np.ndarray) -> np.ndarray:
        """Estimated inner products of query ``row`` with coded row ``member``, pair by pair."""
        flat, base = table.ravel(), row * table.shape[1]
        out = np.zeros(len(row), np.float32)
        for level in places:
            out += flat.take(base + level.take(member))
        return out

    def block_scores(self, table: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Estimated inner products of all queries with all coded rows (queries, rows)."""
        turned = np.ascontiguousarray(table.T)
        out = np.empty((places.shape[1], len(table)), np.float32)
        for k in range(0, places.shape[1], 256):  # sums of whole table rows, in cache
            part = turned[places[0, k : k + 256]]
            for level in places[1:]:
                part += turned[level[k : k + 256]]
            out[k : k + 256] = part
        return out.T


def _pack(codes: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two longs: half the levels each, six bits a level; the second also has the norm in 16 bits."""
    shift = 6 * np.arange(HALF, dtype=np.int64)
    a, b = ((codes[:, k : k + HALF].astype(np.int64) << shift).sum(1) for k in (0, HALF))
    return a, b | (np.clip(np.rint(norms * 16384), 0, 65535).astype(np.int64) << 6 * HALF)


def _unpack(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shift = 6 * np.arange(HALF, dtype=np.int64)
    codes = np.concatenate([(a[:, None] >> shift) & 63, (b[:, None] >> shift) & 63], 1).astype(np.uint8)
    return codes, ((b >> 6 * HALF) & 65535).astype(np.float32) / 16384


def usable(vectors: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, vec, cls) of rows with an id and ``dim`` finite entries, not all zero."""
    v = F.col("vec")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vec")).where(
        (F.size("vec") == dim) & F.col("id").isNotNull()).where(fine).select("id", "vec", F.xxhash64("vec").alias("cls"))


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(rows: DataFrame, dim: int, min_cosine: float | None, beam: int, sample_rows: int, depth: int | None = None) -> Quantiser | None:
    """Codebooks from up to ``sample_rows`` vectors, chosen by a hash of the id, with the index
    that ``min_cosine`` asks for, or the slack of a scan."""
    n = rows.count()
    if not n:
        return None
    every = max(1, n // sample_rows)
    got = rows.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(every)) == 0).select("cls", "vec").limit(sample_rows).toArrow()
    got = got.combine_chunks()
    if not got.num_rows:
        got = rows.select("cls", "vec").limit(sample_rows).toArrow().combine_chunks()
    _, first = np.unique(got.column("cls").to_numpy(), return_index=True)
    sample = _unit(pa.concat_arrays(got.column("vec").chunks), dim)[first]
    q = Quantiser(sample, 0.9 if min_cosine is None else min_cosine, beam)
    if min_cosine is None:
        q.error = q.slack(sample)
        return q
    while q.depth < FIRST_LEVELS and (n / q.radix[q.depth] > MEAN_CELL if depth is None else q.depth < depth):
        q.depth += 1
    q.widen(sample, min_cosine)  # smaller cells: look into more of them
    return q


def _encoded(rows: DataFrame, q: Quantiser, dim: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = q.radix[None, None, : q.depth]
        for b in batches:
            for k in range(0, b.num_rows, 2048):
                part = b.slice(k, 2048)
                codes, beam = q.encode(_unit(part.column("vec"), dim).astype(np.float32))
                c1, c2 = _pack(codes, np.linalg.norm(q.decode(codes), axis=1))
                cells = (beam.astype(np.int64) * weigh).sum(2)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1]), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("cls"), pa.array(c1), pa.array(c2), lists], names=["id", "cls", "c1", "c2", "cells"])

    return rows.select("id", "vec", "cls").mapInArrow(run, "id long, cls long, c1 long, c2 long, cells array<long>")


def _cell_pairs(rows: DataFrame, q: Quantiser, short: int) -> DataFrame:
    """(q, x): members of a query's cells that score over the bound, by lookup tables. Of a cell
    with more than ``short`` of them only (q, null): codes can't tell a crowd apart, so
    ``_ranked`` takes the query.

    A cell's members come before its queries, so only the open cell's members are held (under
    ``full_cell``); queries are scored as they come, about a million pairs at a time: those
    of a cell with many together, by whole rows of the tables, the others entry by entry.
    """
    pairs_at_once, queries_at_once, many_queries = 1_000_000, 2048, 32

    def found(row: np.ndarray, member: np.ndarray, cls_q: np.ndarray, cls_m: np.ndarray) -> Iterator[pa.RecordBatch]:
        other = cls_q[row] != cls_m[member]
        row, member = row[other], member[other]
        crowd = np.bincount(row, minlength=len(cls_q)) > short
        fine, lost = ~crowd[row], cls_q[crowd]
        if fine.any() or len(lost):
            x = pa.chunked_array([pa.array(cls_m[member[fine]]), pa.nulls(len(lost), pa.int64())]).combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([cls_q[row[fine]], lost])), x], names=["q", "x"])

    def block(cls_q: np.ndarray, codes: np.ndarray, norm: np.ndarray, cls_m: np.ndarray, places: np.ndarray, norm_m: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Queries of one cell with all its members."""
        step = max(1, min(1024, 4 * pairs_at_once // len(cls_m)))
        for lo in range(0, len(cls_q), step):
            s = q.block_scores(q.table(q.decode(codes[lo : lo + step])), places).T
            s /= np.maximum(norm_m, 1e-9)[:, None]
            member, row = np.nonzero(s >= (q.bound * norm[lo : lo + step])[None])
            yield from found(row, member, cls_q[lo : lo + step], cls_m)

    def score(first: np.ndarray, size: np.ndarray, cls_q: np.ndarray, codes: np.ndarray, norm: np.ndarray,
              cls_m: np.ndarray, places: np.ndarray, norm_m: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Queries with their cell's members (first, size)."""
        upto = np.concatenate([[0], np.cumsum(size)])
        lo = 0
        while lo < len(size):
            hi = min(max(int(np.searchsorted(upto, upto[lo] + pairs_at_once, side="right")) - 1, lo + 1), lo + queries_at_once, len(size))
            n = size[lo:hi]
            row = np.repeat(np.arange(hi - lo), n)
            member = np.arange(len(row)) - np.repeat(upto[lo:hi] - upto[lo] - first[lo:hi], n)
            s = q.pair_scores(q.table(q.decode(codes[lo:hi])), row, places, member)
            over = s >= q.bound * np.maximum(norm[lo:hi][row] * norm_m[member], 1e-9)
            yield from found(row[over], member[over], cls_q[lo:hi], cls_m)
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        held, key = [none] * 3, None  # cls, c1, c2 of the open cell's members
        for b in batches:
            if not b.num_rows:
                continue
            cell, salt, ask, cls, c1, c2 = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            edges = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (salt[1:] != salt[:-1]), [True]]))
            lead = len(held[0])
            if key != (cell[0], salt[0]):
                held, lead = [none] * 3, 0
            m = np.flatnonzero(~ask)
            members = [np.concatenate([h, x[m]]) for h, x in zip(held, (cls, c1, c2), strict=True)]
            before = np.concatenate([[0], np.cumsum(~ask)]) + lead  # members up to a row
            starts = before[edges[:-1]]
            starts[0] = 0
            size = before[edges[1:]] - starts  # members of a segment: all stand before its queries
            o = np.flatnonzero(ask)
            seg = np.searchsorted(edges, o, side="right") - 1
            some = size[seg] > 0
            o, seg = o[some], seg[some]
            if len(o):
                (codes, norm), (mc, mn) = _unpack(c1[o], c2[o]), _unpack(members[1], members[2])
                places, asks = q.places(mc), np.bincount(seg, minlength=len(starts))
                for x in np.flatnonzero(asks >= many_queries):
                    at, of = slice(*np.searchsorted(seg, [x, x + 1])), slice(starts[x], starts[x] + size[x])
                    yield from block(cls[o[at]], codes[at], norm[at], members[0][of], places[:, of], mn[of])
                few = asks[seg] < many_queries
                yield from score(starts[seg[few]], size[seg[few]], cls[o[few]], codes[few], norm[few], members[0], places, mn)
            key, last = (cell[-1], salt[-1]), starts[-1]
            held = [x[last:] for x in members]

    return rows.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "ask").select("cell", "salt", "ask", "cls", "c1", "c2").mapInArrow(
        run, "q long, x long")


def _exact(pairs: DataFrame, rows: DataFrame, dim: int, min_cosine: float) -> DataFrame:
    """(a, b, cosine), in double, of the pairs at or over ``min_cosine``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = np.round((_unit(b.column("va"), dim) * _unit(b.column("vb"), dim)).sum(1), 12)  # equal up to rounding is equal
                keep = c >= min_cosine
                yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep)), pa.array(c[keep])], names=["a", "b", "cosine"])

    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    needed = written(rows.select("cls", "vec").join(ends, "cls", "left_semi").dropDuplicates(["cls"]), "vectors")
    side = lambda x: needed.select(F.col("cls").alias(x), F.col("vec").alias(f"v{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "va", "vb").mapInArrow(run, "a long, b long, cosine double")


def _best(v: np.ndarray, own: np.ndarray, u: np.ndarray, cls: np.ndarray, k: int, least: float,
          q: Quantiser | None = None, codes: np.ndarray | None = None, norms: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``v`` and of ``u`` that belong together: the k best of another class at or over
    ``least``; of equal ones those that stand first in ``u``. Memory is bounded.

    With a quantiser and the codes of ``u`` lookup tables say which rows need an exact cosine."""
    rows, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at_m, short_v, short_u = (None, v, u) if q is None else (q.places(codes), v.astype(np.float32), u.astype(np.float32))
    for lo in range(0, len(v), 1024):
        some, mine = v[lo : lo + 1024], own[lo : lo + 1024]
        table = None if q is None else q.table(some)
        row, at, c = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        edge = np.full(len(some), least - 1e-12)
        j = 0
        while j < len(u):
            w = 4096 if j or q is not None else 1024
            part = u[j : j + w]
            est = None
            if q is not None and len(part) > 8 * k:
                est = q.block_scores(table, at_m[:, j : j + w]) / np.maximum(norms[None, j : j + w], 1e-9)
            if est is None:
                s = some @ part.T
                if not j and s.shape[1] > k + 1:  # one more: a row may meet itself
                    edge = np.maximum(edge, np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1] - 1e-12)
                i, m = np.nonzero(s >= edge[:, None])
                exact = s[i, m]
            else:
                if not j:  # the best estimates, exactly: no row under the k-th of these can be wanted
                    n = min(8 * k, est.shape[1] - 1)
                    lead = np.argpartition(-est, n, axis=1)[:, :n]
                    s = np.sort(np.einsum("qd,qmd->qm", some, part[lead]), axis=1)
                    edge = np.maximum(edge, s[:, -k - 1] - 1e-12)
                i, m = np.nonzero(est >= (edge - q.error)[:, None])
                if len(i) * 8 > est.size:  # the codes tell little apart: multiply all
                    s = some @ part.T
                    i, m = np.nonzero(s >= edge[:, None])
                    exact = s[i, m]
                else:
                    cut = range(0, len(i), 16_384)
                    single = np.concatenate([np.empty(0), *[np.einsum("nd,nd->n", short_v[lo + i[x : x + 16_384]], short_u[j + m[x : x + 16_384]]) for x in cut]])
                    keep = single >= edge[i] - 1e-5
                    i, m = i[keep], m[keep]
                    exact = np.einsum("nd,nd->n", some[i], part[m])
                    keep = exact >= edge[i]
                    i, m, exact = i[keep], m[keep], exact[keep]
            other = mine[i] != cls[m + j]
            i, m, exact = i[other], m[other], exact[other]
            if len(i):
                row, at, c = np.concatenate([row, i]), np.concatenate([at, m + j]), np.concatenate([c, np.round(exact, 12)])
                order = np.lexsort((at, -c, row))
                row, at, c = row[order], at[order], c[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                last = place == k - 1
                edge[row[last]] = np.maximum(edge[row[last]], c[last] + 2.5e-13)  # later ones that are equal lose
                row, at, c = row[place < k], at[place < k], c[place < k]
            j += w
        rows.append(row + lo)
        places.append(at)
    return np.concatenate(rows), np.concatenate(places)


def _wider(vectors: DataFrame, q: Quantiser, dim: int) -> DataFrame:
    """(cls, cell): the cells of a beam ``WIDE`` times as wide, and those of the beam, of (cls, vec, cells)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = q.radix[None, None, : q.depth]
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                beam = q.encode(_unit(part.column("vec"), dim).astype(np.float32), q.depth, WIDE * q.beam)[1]
                cells = (beam.astype(np.int64) * weigh).sum(2)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1]), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("cls"), part.column("cells"), lists], names=["cls", "cells", "wide"])

    found = vectors.select("cls", "vec", "cells").mapInArrow(run, "cls long, cells array<long>, wide array<long>")
    return found.select("cls", F.explode(F.array_union("cells", "wide")).alias("cell"))


def _ranked(asked: DataFrame, home: DataFrame, all_: DataFrame, dim: int, k: int, min_cosine: float | None, q: Quantiser | None = None,
            block: int = 16_384, ask_block: int = 16_384) -> DataFrame:
    """(a, b, cosine), in double: the k most similar others of each class of ``asked`` (cls, cell) among
    all members (``home``: cls, cell) of its cells. ``all_`` has (cls, id, vec, c1, c2).

    Every member is looked at: by exact cosine, or with a quantiser first by lookup tables. A
    cell is a grid of member x query blocks of about ``block`` and ``ask_block`` rows, by salts,
    so a cell of any size spreads over all tasks and memory is bounded.
    """
    least = -2.0 if min_cosine is None else min_cosine

    def compare(t: pa.Table) -> pa.Table:
        asks = t.filter(pc.invert(t.column("member")))
        t = t.filter(t.column("member")).sort_by("id")
        out = [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())]
        if t.num_rows and asks.num_rows:
            v, u = (_unit(pa.concat_arrays(x.column("vec").chunks), dim) for x in (asks, t))
            own, cls = asks.column("cls").to_numpy(), t.column("cls").to_numpy()
            coded = (None, None, None) if q is None else (q, *_unpack(t.column("c1").to_numpy(), t.column("c2").to_numpy()))
            i, m = _best(v, own, u, cls, k, least, *coded)
            c = np.round((v[i] * u[m]).sum(1), 12)
            keep = c >= least
            out = [pa.array(x[keep]) for x in (own[i], cls[m], c)]
        return pa.Table.from_arrays(out, names=["a", "b", "cosine"])

    spark = all_.sparkSession
    n = lambda df, c: df.groupBy("cell").agg(F.count(F.lit(1)).alias(c))
    parts = lambda c, size: F.ceil(F.col(c) / size).cast("int")
    grid = written(n(asked, "nq").join(n(home, "nm"), "cell").select("cell", parts("nq", ask_block).alias("qs"), parts("nm", block).alias("ms"), (F.col("nq") * F.col("nm")).alias("work")), "vectors")
    salt = lambda seed, c: F.pmod(F.xxhash64(F.lit(seed), "cls"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = asked.join(grid, "cell").select("cell", salt(1, "qs").alias("qi"), every("ms").alias("mi"), F.lit(False).alias("member"), "cls")
    right = home.join(grid, "cell").select("cell", every("qs").alias("qi"), salt(2, "ms").alias("mi"), F.lit(True).alias("member"), "cls")
    work, blocks = grid.agg(F.sum("work"), F.sum(F.col("qs").cast("long") * F.col("ms"))).first()
    tasks = min(20_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), (work or 0) // 2_000_000_000, min(blocks or 0, 2000)))
    keys = ("cell", "qi", "mi")
    found = left.unionByName(right).join(all_, "cls").repartition(tasks, *keys).groupBy(*keys).applyInArrow(compare, "a long, b long, cosine double")
    w = Window.partitionBy("a").orderBy(F.desc("cosine"), "lead")
    lead = all_.select(F.col("cls").alias("b"), F.col("id").alias("lead"))
    return found.join(lead, "b").withColumn("i", F.row_number().over(w)).where(F.col("i") <= k).select("a", "b", "cosine")


def _near_by_cells(once: DataFrame, rows: DataFrame, all_: Callable[[], DataFrame], q: Quantiser, dim: int, k: int, min_cosine: float,
                   full_cell: int, short: int, task_pairs: int) -> DataFrame:
    """(a, b, cosine), both ways: the pairs at or over the floor that the inverted index finds."""
    places = F.array_append(F.transform("cells", lambda c: F.struct(c.alias("cell"), F.lit(True).alias("ask"))),
                            F.struct(F.col("cells")[0].alias("cell"), F.lit(False).alias("ask")))
    rest = once.select(F.explode(places).alias("p"), "cls", "c1", "c2").select("p.cell", "p.ask", "cls", "c1", "c2")
    sizes = rest.groupBy("cell").agg(F.count_if("ask").alias("nq"), F.count_if(~F.col("ask")).alias("nm"))
    salts = F.greatest(F.lit(1), F.ceil(F.col("nq") * F.col("nm") / task_pairs)).cast("int")
    large = sizes.select("cell", (F.col("nm") > full_cell).alias("full"), salts.alias("salts")).where("full or salts > 1")
    large = written(large, "vectors")  # cells that need more than one task, or an exact comparison
    spread = rest.withColumn("salt", F.lit(0))
    asks = None
    if not large.isEmpty():
        placed = rest.join(large, "cell", "left").withColumn("full", F.coalesce("full", F.lit(False)))
        own = F.array(F.pmod(F.xxhash64("cls"), F.coalesce("salts", F.lit(1))).cast("int"))
        each = F.when(F.col("ask"), own).otherwise(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
        spread = placed.where("not full").select("cell", "ask", "cls", "c1", "c2", F.explode(each).alias("salt"))
        asks = placed.where("full and ask").select(F.col("cls").alias("q"), F.lit(None).cast("long").alias("x"))
    scored = _cell_pairs(spread, q, short)
    scored = written(scored if asks is None else scored.unionByName(asks), "vectors")
    crowd = written(scored.where("x is null").select(F.col("q").alias("cls")).distinct(), "vectors")
    sure = scored.where("x is not null").join(crowd.withColumnRenamed("cls", "q"), "q", "left_anti")
    pairs = written(sure.select(F.least("q", "x").alias("a"), F.greatest("q", "x").alias("b")).distinct(), "vectors")
    near = _exact(pairs, rows, dim, min_cosine)
    if not crowd.isEmpty():
        held = all_()
        asked = written(_wider(held.join(crowd, "cls").join(once.select("cls", "cells"), "cls"), q, dim), "vectors")
        home = once.select("cls", F.col("cells")[0].alias("cell"))
        ranked = _ranked(asked, home, held, dim, k, min_cosine)
        near = near.unionByName(ranked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine")).dropDuplicates(["a", "b"])
    near = written(near, "vectors")
    return near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))


def most_similar(vectors: DataFrame, id_col: str, vector_col: str, k: int = 5, min_cosine: float | None = None, queries: Column | None = None,
                 dim: int = 64, beam: int = 6, sample_rows: int = 20_000, full_cell: int = 16_384, short: int = 48, depth: int | None = None,
                 task_pairs: int = 2_000_000_000, scan_block: int = 65_536) -> DataFrame:
    """(id, other, cosine, place): the k most similar others of every id, or of those for which
    ``queries`` (a condition on ``id``) holds; with ``min_cosine`` those at or over it only, so
    up to k. Equal cosines come in the order of the ids.

    Vectors that are null, of another length, all zero or hold a null or a non-finite
    entry are unusable; an id counts once (of differing usable vectors the one with
    the smallest hash). Copies have cosine 1. An empty table gives an empty result; where
    there are fewer than k others, all of them come out. Every usable vector is indexed;
    codebooks are fitted on ``sample_rows``, and the index has the ``depth`` their number
    asks for unless one is given.
    """
    rows = usable(vectors, id_col, vector_col, dim)
    none = rows.select("id", F.col("id").alias("other"), F.lit(0.0).alias("cosine"), F.lit(0).alias("place")).where("false")
    q = fit(rows, dim, min_cosine, beam, sample_rows, depth)
    if q is None:
        return none
    coded = written(_encoded(rows, q, dim), "vectors")
    members = coded.groupBy("id").agg(F.min("cls").alias("cls"))
    once = coded.select("cls", "c1", "c2", "cells").dropDuplicates(["cls"])

    def all_() -> DataFrame:
        leads = members.groupBy("cls").agg(F.min("id").alias("id"))
        return written(rows.select("cls", "vec").dropDuplicates(["cls"]).join(leads, "cls").join(once.select("cls", "c1", "c2"), "cls"), "vectors")

    asking = members if queries is None else members.where(queries)
    if min_cosine is not None:
        both = _near_by_cells(once, rows, all_, q, dim, k, min_cosine, full_cell, short, task_pairs)
    else:
        held = all_()
        everywhere = lambda df: df.select("cls", F.lit(0).cast("long").alias("cell"))
        asks = written(asking.select("cls").distinct(), "vectors")
        work, width = asks.count() * held.count(), int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        a_task = min(2 * task_pairs, max(200_000_000, work // (4 * width)))  # pairs: seconds to a minute
        both = written(_ranked(everywhere(asks), everywhere(held), held, dim, k, None, q, scan_block, max(1024, a_task // scan_block)), "vectors")
    lead = Window.partitionBy("cls").orderBy("id")
    firsts = written(members.withColumn("i", F.row_number().over(lead)).where(F.col("i") <= k + 1).select("cls", "id"), "vectors")
    own = firsts.select(F.col("cls").alias("a"), F.col("id").alias("other"), F.lit(1.0).alias("cosine"))
    others = both.join(firsts.withColumnsRenamed({"cls": "b", "id": "other"}), "b").select("a", "other", "cosine")
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "other")
    lists = others.unionByName(own).withColumn("i", F.row_number().over(best)).where(F.col("i") <= k + 1).select(
        F.col("a").alias("cls"), "other", "cosine")
    mine = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return asking.join(lists, "cls").where("id <> other").withColumn("place", F.row_number().over(mine)).where(
        F.col("place") <= k).select("id", "other", "cosine", "place")


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """(id_a, id_b), smaller first: pairs where one is among the most similar of the other."""
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
