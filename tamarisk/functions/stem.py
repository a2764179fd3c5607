"""English stemming after Porter (1980), run once per distinct token.

Words are described by rules on their measure: the number of vowel-consonant
sequences before a suffix. The tables are the published ones.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The suffix tables of steps 2, 3 and 4.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
)

# The usual English stop words.
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now".split())


def _shape(stem: str) -> str:
    """The stem as v and c; y is a vowel after a consonant."""
    out = ""
    for ch in stem:
        vowel = ch in "aeiou" or (ch == "y" and out[-1:] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif (end := _longest(word, ("ed", "ing"))) and "v" in _shape(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short_end(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        if (end := _longest(word, table)) and _measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + table[end]
    if (end := _longest(word, STEP4)) and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[: -3].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def stem(token: Column) -> Column:
    """Apply to a vocabulary (distinct tokens) and join back, not to every occurrence."""
    return F.pandas_udf(lambda s: pd.Series([None if t is None else porter(t) for t in s], dtype="object"), StringType())(token)


@lru_cache(maxsize=200_000)
def english_lexeme(word: str) -> str | None:
    return None if word in STOP_WORDS else porter(word)


def analyser(name: str) -> Callable[[str], str | None]:
    """A word's lexeme, None for a word that isn't indexed: 'plain' keeps words as they are."""
    if name not in ("plain", "english"):
        raise ValueError(f"no such analyzer: {name!r}")
    return english_lexeme if name == "english" else str
