"""Sentences, passages and keys of texts, in native expressions.

White space is Unicode white space throughout, spelt out so that every engine
and regular-expression dialect reads the same class.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"

# A full stop after these does not end a sentence.
ABBREVIATIONS = (
    "approx", "ca", "cf", "e.g", "et al", "etc", "fig", "figs", "i.e", "no",
    "p", "ref", "refs", "vs", "vol", "spp", "sp", "subsp", "str", "var",
    "dr", "prof", "mr", "mrs", "ms", "st", "jr", "sr", "inc", "ltd", "co",
)

# Fixed value: [12], [3,4], (Smith et al., 2020)
CITATION_MARK = r"\[\d+(?:\s*[,-]\s*\d+)*\]|\([A-Z][A-Za-z]+ et al\.?,? \d{4}\)"

# Fixed value: a sentence may end before a capital, a digit or an opening bracket.
SENTENCE_BOUNDARY = r"(?<=[.!?]) (?=[A-Z0-9(\[])"

_CUT = "\x01"  # stands between sentences while they are put together


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse_space(text: Column) -> Column:
    """Runs of white space become one blank; none is left at the ends. Null stays null."""
    return strip(F.regexp_replace(text, f"[{SPACE}]+", " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def tokens(text: Column) -> Column:
    """The unstemmed analyser: runs of ASCII letters and digits, lower-cased, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9]+)"), 1), F.lower)


_WORD_BYTES = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 32 for b in range(256))


def ascii_words(text: bytes | None) -> list[bytes]:
    """As ``tokens``, of a text in UTF-8."""
    return text.translate(_WORD_BYTES).split() if text else []


def plain_query(text: Column) -> Column:
    """Prose as a query: its words, so that no mark in it is read as an operator."""
    return F.array_join(tokens(text), " ")


def title_key(title: Column) -> Column:
    """Letters and digits only, lower-cased after anything else is removed."""
    return F.lower(F.regexp_replace(title, "[^A-Za-z0-9]", ""))


def identifier(value: Column) -> Column:
    return F.nullif(F.lower(strip(value.cast("string"))), F.lit(""))


def hash_split(key: Column, test_fraction: float = 0.2) -> Column:
    """'test' or 'train' from the key alone: the first 32 bits of its SHA-256, modulo 100."""
    bucket = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < int(test_fraction * 100), "test").otherwise("train")


def _unfinished(text: Column) -> Column:
    """Whether the text ends in an abbreviation or a single letter with a full stop. The last
    24 characters tell: a longer run of letters is neither."""
    tail = F.rtrim(F.lower(F.regexp_extract(F.right(text, F.lit(24)), r"([A-Za-z.]+)\.$", 1)), F.lit("."))
    return tail.isin(*ABBREVIATIONS) | (F.length(tail) == 1)


def sentences(text: Column) -> Column:
    """array<string>: cut after . ! ? before a capital, digit or bracket, unless the
    stop belongs to an abbreviation. Empty for a null or blank text."""
    parts = F.split(collapse_space(F.coalesce(text, F.lit(""))), SENTENCE_BOUNDARY)
    joined = F.aggregate(
        parts, F.lit(""), lambda acc, p: F.when(acc == "", p).otherwise(
            F.concat(acc, F.when(_unfinished(acc), F.lit(" ")).otherwise(F.lit(_CUT)), p)))
    return F.filter(F.transform(F.split(joined, _CUT), strip), lambda s: s != "")


def windows_of(sents: Column, window: int = 3, stride: int = 2, max_chars: int = 1200) -> Column:
    """array<string> of overlapping windows of sentences; a long one is cut at a blank."""
    n = F.size(sents)
    last = F.when(n <= window, 0).otherwise(F.ceil((n - window) / stride)).cast("int")
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(sents, i * stride + 1, F.lit(window)), " "))
    cut = F.transform(each, lambda t: F.when(
        F.length(t) > max_chars, F.regexp_replace(F.substring(t, 1, max_chars), " [^ ]*$", "")).otherwise(t))
    return F.when(n > 0, F.filter(cut, lambda t: t != "")).otherwise(F.array().cast("array<string>"))


def fold_tail(windows: Column, min_chars: int = 80, max_chars: int = 1200) -> Column:
    """A short last window is added to the one before: the overlap then stands twice."""
    folded = F.concat(
        F.slice(windows, F.lit(1), F.greatest(F.size(windows) - 2, F.lit(0))),
        F.array(F.substring(F.concat(F.try_element_at(windows, F.lit(-2)), F.lit(" "), F.try_element_at(windows, F.lit(-1))), 1, max_chars)))
    short = (F.size(windows) > 1) & (F.length(F.try_element_at(windows, F.lit(-1))) < min_chars)
    return F.when(short, folded).otherwise(windows)


def head_passage(title: Column, sents: Column, max_chars: int = 1200) -> Column:
    """The title with the first sentence."""
    lead = F.coalesce(F.try_element_at(sents, F.lit(1)), F.lit(""))
    return F.substring(strip(F.concat(strip(F.coalesce(title, F.lit(""))), F.lit(" "), lead)), 1, max_chars)


def citing_sentences(text: Column) -> Column:
    """array<string>: sentences with a citation mark, without it, of 60 to 400 characters."""
    marked = F.filter(sentences(text), lambda s: s.rlike(CITATION_MARK))
    clean = F.transform(marked, lambda s: F.regexp_replace(strip(F.regexp_replace(s, CITATION_MARK, "")), f"[{SPACE}]{{2,}}", " "))
    return F.filter(clean, lambda s: F.length(s).between(60, 400))
