"""Splitting oversized items at natural boundaries, with overlap.

Balanced targets: the least number of pieces is computed, their ends are set at
equal distances, and each end moves to the strongest boundary near it (blank
line, sentence end, line or clause end, white space; within a strength the
nearest, then the earlier). As long as a piece breaks a limit, or a cut finds no
boundary, there is one piece more, up to twice as many. Where none of these cuts at
pauses only, a long stretch without pauses lies across the targets, and the item is
cut at the last boundary that fits, piece by piece, if that cuts fewer stretches. Every
piece but the first repeats the last ``overlap`` characters of the one before.

One item is handled alone and in time linear in its length, so this is a plain
map over Arrow batches: no shuffle at all beside the one that keeps repeated
ids to one row each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PAUSES = (  # a cut may follow; the strongest last
    (1, re.compile(r"\s+|[.!?;。]+")),
    (2, re.compile(r"[;:]\s+|\s*\n\s*")),
    (3, re.compile(r"[.!?]+[\"')\]»”’]*\s+|[。！？]+\s*")),
    (4, re.compile(r"\s*\n[^\S\n]*\n\s*")),
)
OUT = "item_id long, n_chars int, cut string, pieces array<struct<start:int,stop:int,text:string>>"


def boundaries(text: str) -> np.ndarray:
    """Per position, the strength of cutting before it; 0 is inside a stretch."""
    strength = np.zeros(len(text) + 1, dtype=np.int8)
    for s, pattern in _PAUSES:
        ends = [m.end() for m in pattern.finditer(text)]
        strength[ends] = np.maximum(strength[ends], s)
    return strength


def _snap(strength: np.ndarray, target: int, lo: int, hi: int) -> int:
    near = strength[lo : hi + 1]
    top = near.max()
    if top == 0:
        return target
    at = np.flatnonzero(near == top) + lo
    return int(at[np.argmin(np.abs(at - target))])


def _cut(strength: np.ndarray, length: int, n: int, limit: int, overlap: tuple[int, int]) -> list[tuple[int, int]] | None:
    low, high = overlap
    step = (length - high) / n
    room = int(min(max(limit - step - high, 0) / 2, step / 3))
    spans, start = [], 0
    for i in range(1, n + 1):
        target = round(high + i * step)
        stop = length if i == n else _snap(strength, target, target - room, target + room)
        if stop - start > limit or stop <= start:
            return None
        spans.append((start, stop))
        if i < n:
            start = _snap(strength, stop - (low + high) // 2, stop - high, stop - low)
    return spans


def _reach(strength: np.ndarray, length: int, limit: int, overlap: tuple[int, int]) -> list[tuple[int, int]]:
    """Each piece to the last boundary that fits; where there is none, the whole limit."""
    low, high = overlap
    spans, start = [], 0
    while length - start > limit:
        at = np.flatnonzero(strength[start + high + 1 : start + limit + 1])
        stop = start + high + 1 + int(at[-1]) if len(at) else start + limit
        spans.append((start, stop))
        start = _snap(strength, stop - low, stop - high, stop - low)
    return [*spans, (start, length)]


def longest_stretch(strength: np.ndarray, text: str) -> int:
    """The most characters that follow each other without white space or . ! ? ; 。"""
    pauses = [(0, 0), *(m.span() for m in _PAUSES[0][1].finditer(text)), (len(text), len(text))]
    return max(b[0] - a[1] for a, b in zip(pauses, pauses[1:]))


def cut_item(text: str, limit: int, overlap: tuple[int, int] = (100, 200)) -> tuple[list[tuple[int, int]], str]:
    """(spans, cut): half-open spans, each at most ``limit`` long, the whole text if it fits; cut is
    'forced' where no set of pieces within the limit can end at pauses only, as a stretch
    between two pauses is longer than the limit, else 'natural'."""
    if limit < 3 * overlap[1]:
        raise ValueError("the limit must be three overlaps at least")
    length = len(text)
    strength = boundaries(text)
    cut = "forced" if longest_stretch(strength, text) > limit else "natural"
    if length <= limit:
        return [(0, length)], cut
    forced = lambda spans: sum(strength[z] == 0 for _, z in spans[:-1])
    least = math.ceil((length - overlap[1]) / (limit - overlap[1]))
    found: list[list[tuple[int, int]]] = []
    for n in range(least, 2 * least + 2):
        if (spans := _cut(strength, length, n, limit, overlap)) is not None:
            if not forced(spans):
                return spans, cut
            found.append(spans)
            if cut == "forced" and len(found) == 3:  # more pieces can't mend it
                break
    return min([*found, _reach(strength, length, limit, overlap)], key=lambda s: (forced(s), len(s))), cut


def piece_spans(text: str, limit: int, overlap: tuple[int, int] = (100, 200)) -> list[tuple[int, int]]:
    return cut_item(text, limit, overlap)[0]


def split_oversized(items: DataFrame, id_col: str, text_col: str, limit: int, overlap: tuple[int, int] = (100, 200)) -> DataFrame:
    """(item_id, n_chars, cut, pieces) of each item over its limit in code points.

    Both come from one cutting of the item (see ``cut_item``).
    Null, empty and short texts and null ids do not come out. A repeated id comes
    out once, with the smallest of its texts over the limit.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["item_id"], b["text"], strict=True):
                spans, cut = cut_item(t, limit, overlap)
                rows.append((i, len(t), cut, [{"start": a, "stop": z, "text": t[a:z]} for a, z in spans]))
            yield pd.DataFrame(rows, columns=["item_id", "n_chars", "cut", "pieces"])

    over = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where(
        (F.length("text") > limit) & F.col("item_id").isNotNull())
    return over.groupBy("item_id").agg(F.min("text").alias("text")).mapInPandas(run, OUT)
