"""Exact top lists, by blocks: what the lexical and the dense arm run in Python over Arrow batches.

Rows are dealt to parts, a block of queries by a salt of what is searched. A part's stream has its
queries first, then passages or vectors in chunks, and keeps for each query only rows that can still
be among its k best of the part, so memory and what is shuffled afterwards don't grow with the
number of matches. Nothing is sampled: every passage of a part meets every query of its block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.functions.stem import analyser
from tamarisk.functions.text import ascii_words
from tamarisk.operators.cover import WEIGHT, cover_density
from tamarisk.operators.tsquery import Group, Not, Term, parse

CHUNK = 2_000_000  # words of a chunk of passages, but for the last text
QUERIES = 32_768  # of a block
UNBOUNDED = 1 << 20  # from this k on, rows come out chunk by chunk
EDGE = 2e-6  # scores closer than this may be equal once they are rounded to 6 places


def dealt(asked: DataFrame, held: DataFrame, key: str, blocks: int) -> DataFrame:
    """Rows of both in parts (``part``), the queries of a part (``place`` 0) before its rows (1), in the
    order of ``key``. A row that is held goes to one salt of each block, a query to all salts of its block."""
    spark = asked.sparkSession
    cores = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    salts = max(1, -(-cores // blocks))
    at = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    spread = asked.withColumn("place", F.lit(0)).withColumn("part", F.explode(F.sequence(at(blocks) * salts, at(blocks) * salts + (salts - 1))))
    rows = held.withColumn("place", F.lit(1)).withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b * salts + at(salts))))
    return spread.unionByName(rows, allowMissingColumns=True).repartitionById(blocks * salts, "part").sortWithinPartitions("part", "place", key)


def _least(v: np.ndarray, k: int) -> float:
    """The k-th largest."""
    return np.partition(v, len(v) - k)[len(v) - k]


class _Words:
    """The ids of the words that the queries of a block ask for; -1 is any other."""

    def __init__(self, analyzer: str, every: bool) -> None:
        self.ids: dict[bytes, int] = {}
        self.every = every  # a prefix may be any word
        self.analyse = None if analyzer == "plain" else analyser(analyzer)
        self.known: dict[bytes, int] = {}

    def id(self, lexeme: str) -> int:
        return self.ids.setdefault(lexeme.encode(), len(self.ids))

    def _analysed(self, word: bytes) -> int:
        if word not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            lexeme = self.analyse(word.decode())
            self.known[word] = -1 if lexeme is None else self.id(lexeme) if self.every else self.ids.get(lexeme.encode(), -1)
        return self.known[word]

    def of(self, said: list[bytes]) -> np.ndarray:
        if self.analyse:
            return np.fromiter(map(self._analysed, said), np.int32, len(said))
        if self.every:
            return np.fromiter((self.ids.setdefault(w, len(self.ids)) for w in said), np.int32, len(said))
        return np.fromiter(map(self.ids.get, said, repeat(-1)), np.int32, len(said))


class _Chunk:
    """An inverted index of some passages, in the order of their ids."""

    def __init__(self, passage_ids: list[int], sizes: list[int], ids: np.ndarray, n_words: int, gap: int) -> None:
        self.passages, self.n, self.ids = np.array(passage_ids, np.int64), len(passage_ids), ids
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        known = np.flatnonzero(ids >= 0)
        key = np.sort((ids[known].astype(np.int64) << 32) | known)
        at = key & 0xFFFFFFFF
        self.doc = np.repeat(np.arange(self.n), sizes)[at]
        self.pos = at + self.doc * gap  # so that no phrase goes over the end of a passage
        self.lo = np.searchsorted(key >> 32, np.arange(n_words + 1)).tolist()

    def span(self, word: int) -> slice:
        return slice(self.lo[word], self.lo[word + 1])

    def has(self, docs: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n, bool)
        out[docs] = True
        return out

    def phrase(self, words: list[int], gaps: list[int]) -> np.ndarray:
        """The passage of each place where the words stand at these distances."""
        s = self.span(words[0])
        docs, pos, far = self.doc[s], self.pos[s], 0
        for w, g in zip(words[1:], gaps, strict=True):
            far += g
            other = self.pos[self.span(w)]
            if not len(pos) or not len(other):
                return docs[:0]
            if len(other) * 8 < len(pos):  # the shorter side is looked up
                j = np.searchsorted(pos, other - far)
                j = j[(j < len(pos)) & (pos[np.minimum(j, len(pos) - 1)] == other - far)]
                docs, pos = docs[j], pos[j]
            else:
                j = np.minimum(np.searchsorted(other, pos + far), len(other) - 1)
                ok = other[j] == pos + far
                docs, pos = docs[ok], pos[ok]
        return docs

    def covers(self, words: list[int], match: np.ndarray) -> np.ndarray:
        """r by passage of a conjunction of different words (see ``cover``), over the passages of ``match``:
        for each occurrence the last start of a stretch with all words, of those with one start the shortest."""
        spans = [self.span(w) for w in words]
        pos, docs = np.concatenate([self.pos[s] for s in spans]), np.concatenate([self.doc[s] for s in spans])
        which = np.repeat(np.arange(len(words)), [s.stop - s.start for s in spans])
        some = match[docs]
        pos, docs, which = pos[some], docs[some], which[some]
        o = np.argsort(pos)
        pos, docs, which, at = pos[o], docs[o], which[o], np.arange(len(o))
        a = at
        for w in range(len(words)):
            a = np.minimum(a, np.maximum.accumulate(np.where(which == w, at, -1)))
        z = np.flatnonzero((a >= 0) & (docs[a] == docs))
        a = a[z]
        first = np.ones(len(a), bool)
        first[1:] = a[1:] != a[:-1]
        a, z = a[first], z[first]
        return np.bincount(docs[z], WEIGHT / (1 + (pos[z] - pos[a] + 1) - (z - a + 1)), self.n)


class _Tree:
    """A query that needs more than a count: which passages match, and their r / (1 + r)."""

    def __init__(self, text: str, words: _Words) -> None:
        self.text, self.tree = text, parse(text)
        self.plain = {t.lexeme: words.id(t.lexeme) for t in _operands(self.tree) if t.lexeme is not None}
        self.gap = max([0, *(g for t in _operands(self.tree) for g in t.parts[1::2])])
        self.wanted = _positive(self.tree)
        node = self.wanted
        kids = node.of if isinstance(node, Group) else ()
        bare = all(isinstance(t, Term) and t.lexeme is not None for t in kids)
        self.any_of = self.all_of = self.phrase = None
        if node is not None and self.known(self.tree):
            if isinstance(node, Term):
                self.phrase = node
            elif node.kind == "or" and bare:
                self.any_of = [*{self.plain[t.lexeme] for t in kids}]
            elif node.kind == "and" and bare and len({t.lexeme for t in kids}) == len(kids):
                self.all_of = [self.plain[t.lexeme] for t in kids]

    def known(self, node) -> bool:
        """Whether ``match`` is exact: all operands are words, or phrases of words."""
        return all(t.lexeme is not None or t.parts and all(isinstance(p, Term) and p.lexeme is not None for p in t.parts[::2]) for t in _operands(node, False))

    def places(self, t: Term, c: _Chunk) -> np.ndarray | None:
        if t.lexeme is not None:
            return c.doc[c.span(self.plain[t.lexeme])]
        if t.parts and all(isinstance(p, Term) and p.lexeme is not None for p in t.parts[::2]):
            return c.phrase([self.plain[p.lexeme] for p in t.parts[::2]], list(t.parts[1::2]))
        return None

    def match(self, node, c: _Chunk) -> np.ndarray | None:
        """The passages that match; None where that isn't known, which any may."""
        if isinstance(node, Term):
            docs = self.places(node, c)
            return None if docs is None else c.has(docs)
        if isinstance(node, Not):
            inner = self.match(node.of, c)
            return None if inner is None else ~inner
        each = [self.match(x, c) for x in node.of]
        if node.kind == "or":
            return None if any(m is None for m in each) else np.logical_or.reduce(each)
        each = [m for m in each if m is not None]
        return np.logical_and.reduce(each) if each else None

    def scores(self, c: _Chunk, said: Callable[[int], list[str]]) -> np.ndarray:
        """By passage; 0 for what doesn't match."""
        if self.wanted is None:
            return np.zeros(c.n)
        if self.phrase is not None or self.any_of is not None:  # each place is a cover of its own
            docs = self.places(self.phrase, c) if self.phrase is not None else np.concatenate([c.doc[c.span(w)] for w in self.any_of])
            if not len(docs):
                return np.zeros(c.n)
            r = np.bincount(docs, minlength=c.n) * WEIGHT
            if self.tree is not self.phrase:
                r[~self.match(self.tree, c)] = 0
            return r / (1 + r)
        if self.all_of is not None and any(c.lo[w] == c.lo[w + 1] for w in self.all_of):
            return np.zeros(c.n)
        match = self.match(self.tree, c)
        if self.all_of is not None:
            if not match.any():
                return np.zeros(c.n)
            r = c.covers(self.all_of, match)
            return r / (1 + r)
        out = np.zeros(c.n)
        for i in range(c.n) if match is None else np.flatnonzero(match):
            out[i] = cover_density(self.text, said(i))
        return out


def _operands(node, apart: bool = True) -> list[Term]:
    """All operands, also negated ones; with ``apart`` the words of phrases beside them."""
    if isinstance(node, Term):
        return [node, *(x for p in node.parts[::2] for x in _operands(p))] if apart else [node]
    if isinstance(node, Not):
        return _operands(node.of, apart)
    return [t for c in node.of for t in _operands(c, apart)]


def _positive(node):
    """The tree without negations, and without groups of one; groups of a kind are put together."""
    if isinstance(node, (Not, Term)):
        return None if isinstance(node, Not) else node
    kids = []
    for c in map(_positive, node.of):
        if c is not None:
            kids += c.of if isinstance(c, Group) and c.kind == node.kind else [c]
    return (kids[0] if len(kids) == 1 else Group(node.kind, tuple(kids))) if kids else None


class _Best:
    """Of one query the rows that may be among its k best; they come in the order of their ids, so a
    later one must be better than the k-th so far. Values are counts (an int k-th) or scores."""

    def __init__(self, k: int, counted: bool) -> None:
        self.k, self.counted, self.floor, self.held, self.n = k, counted, 0, [], 0

    def score(self, v: np.ndarray) -> np.ndarray:
        r = v * WEIGHT
        return r / (1 + r) if self.counted else v

    def _kept(self, v: np.ndarray) -> np.ndarray:
        """Places, in their order; sets the floor."""
        t = _least(v, self.k)
        self.floor = max(self.floor, t)
        same = np.flatnonzero(v == t)[: self.k]
        near = v > t if self.counted and t <= 2000 else (v != t) & (self.score(v) >= self.score(t) - EDGE)
        return np.sort(np.concatenate([np.flatnonzero(near), same]))

    def offer(self, v: np.ndarray, c: _Chunk) -> None:
        at = np.flatnonzero(v > self.floor)
        if not len(at):
            return
        v = v[at]
        if len(at) > self.k:
            some = self._kept(v)
            at, v = at[some], v[some]
        self.held.append((v, c.passages[at]))
        self.n += len(at)
        if self.n > 3 * self.k:
            self._merge()

    def _merge(self) -> tuple[np.ndarray, np.ndarray]:
        v, ids = (np.concatenate(x) for x in zip(*self.held))
        if len(v) > self.k:
            some = self._kept(v)
            v, ids = v[some], ids[some]
        self.held, self.n = [(v, ids)], len(v)
        return v, ids

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        v, ids = self._merge()
        self.held, self.n = [], 0
        return self.score(v), ids


class _Lexical:
    """A part's queries and what they found so far."""

    def __init__(self, k: int, analyzer: str, prefixes: bool) -> None:
        self.k, self.words = k, _Words(analyzer, prefixes)
        self.queries: list[tuple[int, list[int] | _Tree, list[int], _Best]] = []
        self.texts: list[list] = [[], [], []]  # ids of passages, numbers of words, ids of words
        self.size = 0

    def ask(self, query_id: int, tree: str | None, wanted: list[str], banned: list[str]) -> None:
        what = _Tree(tree, self.words) if tree else [self.words.id(w) for w in wanted]
        self.queries.append((query_id, what, [self.words.id(w) for w in banned or ()], _Best(self.k, not tree)))

    def take(self, passage_ids: list[int], texts: list[bytes | None]) -> None:
        for begin in range(0, len(texts), 4096):
            said, sizes = [], []
            for t in texts[begin : begin + 4096]:
                ws = ascii_words(t)
                said += ws
                sizes.append(len(ws))
            self.texts[0] += passage_ids[begin : begin + 4096]
            self.texts[1] += sizes
            self.texts[2].append(self.words.of(said))
            self.size += len(said)
            if self.size >= CHUNK:
                yield from self.search()

    def search(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            trees = [q[1] for q in self.queries if isinstance(q[1], _Tree)]
            c = _Chunk(self.texts[0], self.texts[1], np.concatenate(self.texts[2]), len(self.words.ids), 1 + max([0, *(t.gap for t in trees)]))
            names = [w.decode() for w in self.words.ids] + [""] if trees else []
            said = lambda i: [names[w] for w in c.ids[c.starts[i] : c.starts[i + 1]]]
            doc, lo = c.doc, c.lo
            for _, what, banned, best in self.queries:
                if isinstance(what, _Tree):
                    best.offer(np.round(what.scores(c, said), 12), c)
                    continue
                spans = [doc[lo[w] : lo[w + 1]] for w in what if lo[w] < lo[w + 1]]
                if spans:
                    n = np.bincount(spans[0] if len(spans) == 1 else np.concatenate(spans), minlength=c.n)
                    for w in banned:
                        n[doc[lo[w] : lo[w + 1]]] = 0
                    best.offer(n, c)
        self.texts, self.size = [[], [], []], 0
        if self.k >= UNBOUNDED:
            yield from self.found()

    def found(self) -> Iterator[pa.RecordBatch]:
        yield from _packed_lists((i, *best.rows()[::-1]) for i, _, _, best in self.queries if best.held)


def _packed_lists(lists: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows (query_id, ids, scores): a list is one row, whatever its length."""
    rows, n = [], 0

    def batch() -> pa.RecordBatch:
        q, ids, scores = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(ids, pa.binary()), pa.array(scores, pa.binary())], names=["query_id", "ids", "scores"])

    for i, ids, scores in lists:
        rows.append((i, ids.tobytes(), scores.tobytes()))
        n += len(ids)
        if n > 200_000:
            yield batch()
            rows, n = [], 0
    if rows:
        yield batch()


LISTS = "query_id long, ids binary, scores binary"


def joined_lists(lists: DataFrame, k: int) -> DataFrame:
    """(query_id, passage_id, score) of the parts' lists: of each query the k best, and what may be equal to
    the last once scores are rounded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out, n = None, [], [], 0

        def kept() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ids, s = (np.concatenate(x) for x in zip(*held))
            if len(s) > k:
                t = _least(s, k)
                at = np.flatnonzero(s == t)
                some = np.concatenate([np.flatnonzero((s != t) & (s >= t - EDGE)), at[np.argsort(ids[at])[:k]]])
                ids, s = ids[some], s[some]
            return np.full(len(ids), now, np.int64), ids, s

        for b in batches:
            for q, ids, s in zip(*(b.column(c).to_pylist() for c in ("query_id", "ids", "scores")), strict=True):
                if q != now and held:
                    out.append(kept())
                    n += len(out[-1][0])
                    held = []
                    if n > 100_000:
                        yield _batch(*zip(*out))
                        out, n = [], 0
                now = q
                held.append((np.frombuffer(ids, np.int64), np.frombuffer(s, np.float64)))
        if held:
            out.append(kept())
        if out:
            yield _batch(*zip(*out))

    return lists.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(run, "query_id long, passage_id long, score double")


def _batch(ids: list[np.ndarray], found: list[np.ndarray], scores: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, found, scores)], names=["query_id", "passage_id", "score"])


def lexical_candidates(plans: DataFrame, n_plans: int, passages: DataFrame, k: int, analyzer: str = "plain", prefixes: bool = False) -> DataFrame:
    """(query_id, passage_id, score): of each plan (query_id, tree, wanted, banned) the k best by score
    rounded to 6 places, then id, and what may be equal to the last. A plan without a tree counts
    the words it wants. Scores aren't rounded."""
    asked = plans.select(F.col("query_id").alias("id"), "tree", "wanted", "banned")
    held = passages.select(F.col("passage_id").alias("id"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            part, place = b.column("part").to_numpy(), b.column("place").to_numpy()
            edges = [0, *(np.flatnonzero((part[1:] != part[:-1]) | (place[1:] != place[:-1])) + 1).tolist(), b.num_rows]
            for begin, end in zip(edges, edges[1:]):
                if begin == end:
                    continue
                if part[begin] != now:
                    if state:
                        yield from state.search()
                        yield from state.found()
                    now, state = part[begin], _Lexical(k, analyzer, prefixes)
                rows = b.slice(begin, end - begin)
                if place[begin] == 0:
                    for row in zip(*(rows.column(c).to_pylist() for c in ("id", "tree", "wanted", "banned")), strict=True):
                        state.ask(*row)
                elif state.queries:
                    yield from state.take(rows.column("id").to_pylist(), rows.column("text").to_pylist())
        if state:
            yield from state.search()
            yield from state.found()

    return joined_lists(dealt(asked, held, "id", max(1, -(-n_plans // QUERIES))).mapInArrow(run, LISTS), k)


class Buckets:
    """Random-projection buckets (Datar et al., SoCG 2004) of unit vectors: a pair is proposed if it has a
    bucket in common, and taken if its cosine is ``least`` at least."""

    def __init__(self, least: float, dim: int, tables: int, width: float, seed: int) -> None:
        lines = np.random.default_rng(seed).standard_normal((dim, tables))
        self.least, self.lines = least, lines / np.linalg.norm(lines, axis=0) / width

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.floor(x @ self.lines).astype(np.int32)


class _Near:
    """A block of query vectors, and for each its best rows so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, buckets: Buckets | None = None) -> None:
        self.ids, self.q, self.single, self.k = ids, q, q.astype(np.float32), k
        self.least, self.codes = (buckets.least, buckets.of(q)) if buckets else (-np.inf, None)
        self.floor, self.held, self.n = np.full(len(ids), self.least - 2e-5, np.float32), [], 0
        self.best = np.empty((len(ids), 0), np.float32)  # the k largest products so far, to set the floor
        self.open: list[tuple[np.ndarray, ...]] = []  # rows over the floor of their chunk, not scored yet
        self.chunks: list[tuple[np.ndarray, np.ndarray]] = []

    def offer(self, x_ids: np.ndarray, x: np.ndarray, single: np.ndarray, codes: np.ndarray | None = None) -> None:
        """Products in single precision, within 1e-5 of the exact ones, leave out what can't be among the
        k best; the rest is scored in double precision (in ``_settle``, when more is left out)."""
        s = self.single @ single.T
        over = s >= self.floor[:, None]
        if codes is not None:
            i, j = np.divmod(np.flatnonzero(over), s.shape[1])
            exact = np.einsum("ij,ij->i", self.q[i], x[j])
            met = (exact >= self.least - 1e-9) & (self.codes[i] == codes[j]).any(axis=1)
            self._add(i[met], exact[met], x_ids[j[met]])
            return
        if np.count_nonzero(over) > 4 * len(self.ids):
            both = np.concatenate([self.best, s], axis=1)
            if both.shape[1] > self.k:
                both = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
                self.floor = np.maximum(self.floor, both[:, 0] - np.float32(2e-5))
                over = s >= self.floor[:, None]
            self.best = both.copy()
        at = np.flatnonzero(over)
        i, j = np.divmod(at, s.shape[1])
        self.open.append((i.astype(np.int32), s.ravel()[at], np.full(len(at), len(self.chunks), np.int32), j.astype(np.int32)))
        self.chunks.append((x_ids, x))
        if len(self.chunks) >= 32:
            self._settle()

    def _settle(self) -> None:
        if not self.open:
            return
        i, s, c, j = (np.concatenate(v) for v in zip(*self.open))
        some = s >= self.floor[i]
        i, at = i[some], (np.cumsum([0, *(len(ids) for ids, _ in self.chunks)])[c] + j)[some]
        ids, x = (np.concatenate(v) for v in zip(*self.chunks))
        self.open, self.chunks = [], []
        for k in range(0, len(i), 100_000):
            part = slice(k, k + 100_000)
            self._add(i[part], np.einsum("ij,ij->i", self.q[i[part]], x[at[part]]), ids[at[part]])

    def _add(self, i: np.ndarray, exact: np.ndarray, ids: np.ndarray) -> None:
        if len(i):
            self.held.append((i.astype(np.int32), np.round(exact, 6) + 0.0, ids))
            self.n += len(i)
            if self.n > max(200_000, 3 * self.k * len(self.ids)):
                self._merge()

    def _merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, s, ids = (np.concatenate(x) for x in zip(*self.held))
        o = np.lexsort((ids, -s, i))
        i, s, ids = i[o], s[o], ids[o]
        begin = np.searchsorted(i, np.arange(len(self.ids)))
        place = np.arange(len(i)) - begin[i]
        last = place == self.k - 1
        self.floor[i[last]] = np.maximum(self.floor[i[last]], (s[last] - 1.2e-5).astype(np.float32))
        kept = place < self.k
        self.held, self.n = [(i[kept], s[kept], ids[kept])], int(kept.sum())
        return self.held[0]

    def found(self) -> Iterator[pa.RecordBatch]:
        self._settle()
        if self.held:
            i, s, ids = self._merge()
            ends = np.searchsorted(i, np.arange(len(self.ids) + 1))
            yield from _packed_lists((int(q), ids[a:z], s[a:z]) for q, a, z in zip(self.ids, ends[:-1], ends[1:], strict=True) if a < z)
        self.held, self.n = [], 0


def near_candidates(asked: DataFrame, n_asked: int, held: DataFrame, k: int, unpacked: Callable[[bytes, bytes], tuple[np.ndarray, np.ndarray]],
                    buckets: Buckets | None = None) -> DataFrame:
    """(query_id, passage_id, score): of each query the k best by cosine, to 6 places, then id;
    with ``buckets`` of pairs that these propose and take. Both sides are rows of packed vectors (ids,
    vecs), see ``arms.dense``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, []
        for b in batches:
            for part, place, ids, vecs in zip(*(b.column(c).to_pylist() for c in ("part", "place", "ids", "vecs")), strict=True):
                if part != now:
                    for q in blocks:
                        yield from q.found()
                    now, blocks = part, []
                ids, x = unpacked(ids, vecs)
                if place == 0:
                    blocks.append(_Near(ids, x, k, buckets))
                    continue
                single, codes = x.astype(np.float32), buckets.of(x) if buckets else None
                for q in blocks:
                    q.offer(ids, x, single, codes)
        for q in blocks:
            yield from q.found()

    return joined_lists(dealt(asked, held, "ids", max(1, -(-n_asked // 16))).mapInArrow(run, LISTS), k)
