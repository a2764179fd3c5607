"""Encoding of texts with a public byte-level BPE tokenizer, and back.

Texts go through the tokenizers library in Arrow batches; the ids come back as
Arrow lists, without Python objects per row on Spark's side. A null and an
empty text have no ids. Byte-level vocabularies write every byte as one
printable character; that table is a rule (printable Latin-1 bytes stand for
themselves, the others follow from 256 on), so decoding needs the vocabulary
only. A character may be split over tokens: its offsets then are the same for
each of them, and decoding joins bytes before it reads characters.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

import pandas as pd

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.json"
BATCH = 256  # texts a call: bounds the library's memory


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


@lru_cache(maxsize=1)
def byte_table() -> dict[str, int]:
    """The byte that each character of a token stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> dict[int, bytes]:
    table = byte_table()
    return {i: bytes(table[c] for c in t) if all(c in table for c in t) else t.encode() for t, i in tokenizer(path).get_vocab().items()}


def encode_ids(texts: list[str | None], path: str) -> Iterator[list[int]]:
    t = tokenizer(path)
    for k in range(0, len(texts), BATCH):
        for e in t.encode_batch_fast([x or "" for x in texts[k : k + BATCH]], add_special_tokens=False):
            yield e.ids


def decode_ids(ids: list[int], path: str) -> str:
    known = token_bytes(path)
    return b"".join(known[i] for i in ids).decode("utf-8", errors="replace")


def token_offsets(text: str, ids: list[int], path: str) -> list[tuple[int, int]]:
    """Per token, the half-open span of characters that any of its bytes belong to."""
    if not ids:
        return []
    raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    known = token_bytes(path)
    stops = np.cumsum([len(known[i]) for i in ids])
    starts = np.concatenate([[0], stops[:-1]])
    return list(zip(char[starts].tolist(), (char[stops - 1] + 1).tolist(), strict=True))


def _lists(values: list[list[int]]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.fromiter((i for v in values for i in v), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_table(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """(id, ids): a row per input row, in no order; ids is empty for a null or empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = list(encode_ids(b.column(1).to_pylist(), path))
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(ids)], names=[id_col, "ids"])

    kept = documents.select(id_col, F.col(text_col).cast("string").alias("text"))
    kind = kept.schema[id_col].dataType.simpleString()
    return kept.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_count(text: Column, path: str = BYTE_BPE) -> Column:
    """The number of tokens; 0 for a null or empty text."""
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([len(i) for i in encode_ids([None if t is None else t for t in texts], path)], dtype="int64")

    return F.pandas_udf(run, LongType())(text)


def decoded(ids: Column, path: str = BYTE_BPE) -> Column:
    """The text of token ids; null for null."""
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else decode_ids(list(r), path) for r in rows], dtype="object")

    return F.pandas_udf(run, StringType())(ids)


def offsets_table(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """(id, ids, starts, stops): each token with its characters, for every input row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = list(encode_ids(texts, path))
            spans = [token_offsets(t or "", i, path) for t, i in zip(texts, ids, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), _lists(ids), _lists([[a for a, _ in s] for s in spans]), _lists([[z for _, z in s] for s in spans])],
                names=[id_col, "ids", "starts", "stops"])

    kept = documents.select(id_col, F.col(text_col).cast("string").alias("text"))
    kind = kept.schema[id_col].dataType.simpleString()
    return kept.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, starts array<int>, stops array<int>")
