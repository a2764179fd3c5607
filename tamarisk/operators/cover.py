"""Cover-density scores for queries that need more than a count.

After Clarke, Cormack and Tudhope (IP&M 2000): a cover is a shortest stretch of a
document that satisfies the query. Each adds its mean weight over one plus the
words in it that match nothing; the sum r is squashed to r / (1 + r). Where every
operand is a bare alternative, each match is its own cover and a plain count
gives the same score (``arms.lexical``); this is for conjunctions and phrases.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tamarisk.functions.stem import analyser
from tamarisk.operators.tsquery import Group, Not, Term, parse

WEIGHT = 0.1  # fixed value: of a word in an unlabelled field


@lru_cache(maxsize=10_000)
def _parsed(query: str):
    return parse(query)  # once a query, not once a row


def _places(term: Term, toks: list[str]) -> list[tuple[int, int]]:
    """Stretches (first, last) of the tokens that match an operand."""
    if term.parts:
        spans = _places(term.parts[0], toks)
        for gap, nxt in zip(term.parts[1::2], term.parts[2::2], strict=True):
            starts = {a: z for a, z in _places(nxt, toks)}
            spans = [(a, starts[z + gap]) for a, z in spans if z + gap in starts]
        return spans
    body = term.text[1 : term.text.rindex("'")].replace("''", "'")
    if term.lexeme is None and term.text.endswith("*"):
        return [(i, i) for i, t in enumerate(toks) if t and t.startswith(body)]
    return [(i, i) for i, t in enumerate(toks) if t == body]


def _covers(node, toks: list[str]) -> set[tuple[int, int]]:
    """Shortest stretches that satisfy the positive part of a query."""
    if isinstance(node, Term):
        found = set(_places(node, toks))
    elif node.kind == "or":
        found = set().union(*[_covers(c, toks) for c in node.of if not isinstance(c, Not)])
    else:
        found = None
        for c in node.of:
            if isinstance(c, Not):
                continue
            more = _covers(c, toks)
            found = more if found is None else _together(found, more)
    return _shortest(found or set())


def _together(left: set[tuple[int, int]], right: set[tuple[int, int]]) -> set[tuple[int, int]]:
    """Shortest stretches that hold one of either side; both are free of nesting, so for each end the
    latest starts up to it decide: one sweep over the ends."""
    sides = [sorted(left, key=lambda s: s[1]), sorted(right, key=lambda s: s[1])]
    at, out = [-1, -1], set()
    for end in sorted({z for side in sides for _, z in side}):
        for k, side in enumerate(sides):
            while at[k] + 1 < len(side) and side[at[k] + 1][1] <= end:
                at[k] += 1
        if min(at) >= 0:
            out.add((min(side[i][0] for side, i in zip(sides, at, strict=True)), end))
    return _shortest(out)


def _shortest(spans: set[tuple[int, int]]) -> set[tuple[int, int]]:
    """Without those that contain another."""
    out, least = set(), None
    for a, z in sorted(spans, key=lambda s: (-s[0], s[1])):
        if least is None or z < least:
            out.add((a, z))
            least = z
    return out


def _banned(node, toks: list[str]) -> bool:
    """Whether the tokens fail the query, negations included."""
    if isinstance(node, Term):
        return not _places(node, toks)
    if isinstance(node, Not):
        return not _banned(node.of, toks)
    return (any if node.kind == "and" else all)(_banned(c, toks) for c in node.of)


def _terms(node) -> list[Term]:
    if isinstance(node, Term):
        return [node]
    return [] if isinstance(node, Not) else [t for c in node.of for t in _terms(c)]


def cover_density(query: str, toks: list[str]) -> float:
    """0 for a document that doesn't match, or a query of negations only."""
    tree = _parsed(query)
    if tree is None or isinstance(tree, Not) or _banned(tree, toks):
        return 0.0
    covers = _covers(tree, toks)
    hits = sorted({i for t in _terms(tree) for a, z in _places(t, toks) for i in range(a, z + 1)})
    r = sum(WEIGHT / (1 + (z - a + 1) - (bisect_right(hits, z) - bisect_left(hits, a))) for a, z in covers)
    return r / (1 + r)


def cover_score(query: Column, toks: Column, analyzer: str = "plain") -> Column:
    analyse = analyser(analyzer)

    def run(queries: pd.Series, docs: pd.Series) -> pd.Series:
        read = (lambda d: list(d)) if analyzer == "plain" else (lambda d: [analyse(w) for w in d])  # a stop word keeps its place
        return pd.Series([0.0 if q is None or d is None else cover_density(q, read(d)) for q, d in zip(queries, docs, strict=True)], dtype="float64")

    return F.pandas_udf(run, DoubleType())(query, toks)


__all__ = ["Group", "cover_density", "cover_score"]
