"""Words of a text: the canonical token sequence the corpus operators share.

Tags are dropped, HTML entities resolved, the text is decomposed by Unicode
NFKD, combining marks and invisible format characters are removed, the rest is
lower-cased, and the maximal runs of letters and digits are the words. A null
text has no words; neither has an empty or blank one.

Spark has no NFKD, so this runs in Python over Arrow batches. Texts that are
plain ASCII (the bulk of most corpora) skip the Unicode steps.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=1)
def _dropped() -> dict[int, None]:
    """Combining marks (M*) and invisible format characters (Cf)."""
    return {
        c: None
        for c in range(128, sys.maxunicode + 1)
        if (k := unicodedata.category(chr(c)))[0] == "M" or k == "Cf"
    }


def word_list(text: str | None) -> list[str]:
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    text = unicodedata.normalize("NFKD", text)
    return _WORD.findall(text.translate(_dropped()).lower())


def _joined(texts: pd.Series) -> pd.Series:
    return pd.Series([" ".join(word_list(t)) if t is not None else "" for t in texts])


def words_text(text: Column) -> Column:
    """The words joined by single spaces; '' for a text without words or a null."""
    return F.pandas_udf(_joined, StringType())(text)


def words(text: Column) -> Column:
    """The words as array<string>; empty for a text without words or a null."""
    joined = words_text(text)
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))
