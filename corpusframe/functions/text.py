"""Scalar text and projection functions.

Every function takes and returns a ``Column``: they compile to JVM expressions
inside whole-stage codegen (no Python per row) and work on batch and streaming
DataFrames alike. Regular expressions are written so that Java (Spark) and RE2
(the DuckDB oracle) read them the same way; Java's ``\\w`` and ``\\s`` are
ASCII-only, so the Unicode classes are spelled out.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusframe.functions.stopwords import ENGLISH_STOP_WORDS

# Unicode whitespace as Python's str.split()/str.strip() see it, as the inside of
# a character class valid in both Java regex and RE2.
WS_CLASS = (
    r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# The same set as literal characters, for trim functions.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Python's Unicode word character: letters, numbers, underscore.
WORD_CLASS = r"\p{L}\p{N}_"
# Anything that is not a word character, whitespace or '@' is punctuation.
PUNCTUATION_PATTERN = "[^" + WORD_CLASS + WS_CLASS + "@]"
WS_RUN = "[" + WS_CLASS + "]+"
NON_WS_RUN = "[^" + WS_CLASS + "]+"

# Keyword flags of the error analysis. ``has_link`` is
# case-sensitive, the other two ignore case.
FLAG_PATTERNS = {
    "has_link": "http[s]?",
    "has_login": "(?iu)login|log in|sign in|account",
    "has_urgent": "(?iu)urgent|immediately|verify|attention",
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lowercase(c) -> Column:
    """``str.lower``."""
    return F.lower(_col(c))


def remove_punctuation(c) -> Column:
    """Drop every character that is not a word character, whitespace or '@'."""
    return F.regexp_replace(_col(c), PUNCTUATION_PATTERN, "")


def split_words(c) -> Column:
    """``str.split()``: whitespace-separated words, no empty strings."""
    return F.filter(F.split(_col(c), WS_RUN), lambda w: w != "")


def remove_stop_words(c, stop_words: Iterable[str] = ENGLISH_STOP_WORDS) -> Column:
    """Split on whitespace, drop words whose lowercase form is a stop word,
    re-join with one space. The ``isin`` over a literal list becomes a hash set
    (``InSet``) in the optimised plan."""
    stop = list(stop_words)
    return F.array_join(
        F.filter(split_words(c), lambda w: ~F.lower(w).isin(stop)), " "
    )


def word_count(c) -> Column:
    """T5: ``len(str(x).split())`` -- maximal runs of non-whitespace."""
    return F.regexp_count(_col(c), F.lit(NON_WS_RUN)).cast("bigint")


def char_count(c) -> Column:
    """Number of code points."""
    return F.length(_col(c)).cast("bigint")


def substring_count(c, needle: str) -> Column:
    """Non-overlapping occurrences of a literal substring (``str.count``)."""
    import re

    return F.regexp_count(_col(c), F.lit(re.escape(needle))).cast("bigint")


def link_count(c) -> Column:
    """T7 first feature: occurrences of ``http`` (case-sensitive)."""
    return substring_count(c, "http")


def structured_features(c) -> list[Column]:
    """``[count("http"), len]`` as two named columns."""
    return [link_count(c).alias("link_count"), char_count(c).alias("email_length")]


def regex_flag(c, pattern: str) -> Column:
    """Regex search; a null text is a false match."""
    return F.coalesce(_col(c).rlike(pattern), F.lit(False))


def keyword_flags(c, patterns: dict[str, str] | None = None) -> list[Column]:
    """One boolean column per named pattern."""
    patterns = FLAG_PATTERNS if patterns is None else patterns
    return [regex_flag(c, p).alias(name) for name, p in patterns.items()]


def filter_short_words(c, min_len: int = 3) -> Column:
    """Keep whitespace-separated words of at least ``min_len`` code points."""
    return F.array_join(F.filter(split_words(c), lambda w: F.length(w) >= min_len), " ")


def strip_ws(c) -> Column:
    """``str.strip()`` with Python's whitespace set."""
    return F.btrim(_col(c), F.lit(WS_CHARS))


def is_blank(c) -> Column:
    """Null, empty or whitespace only."""
    return _col(c).isNull() | (strip_ws(c) == "")


def null_to_text(c, marker: str = "nan") -> Column:
    """``astype(str)``: the value as text, a missing value as ``marker``."""
    return F.coalesce(_col(c).cast("string"), F.lit(marker))


def concat_fields(cols: Iterable, marker: str = "nan") -> Column:
    """Concatenate columns with no separator after P1 on each."""
    return F.concat(*[null_to_text(c, marker) for c in cols])


def clip(c, lo, hi) -> Column:
    """Clip to [lo, hi]; a null stays null (``least``/``greatest`` skip nulls)."""
    c = _col(c)
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(hi)), F.lit(lo)))


def strict_label(c) -> Column:
    """Label as int; a value that is no whole number fails the job."""
    return _col(c).cast("string").cast("int")


def quarantine(df, label_col: str = "label"):
    """P7 with quarantine: (rows whose label is an int, rows whose label is
    not, unchanged). A null label is not an int."""
    parsed = F.col(label_col).cast("string").try_cast("int")
    return df.filter(parsed.isNotNull()).withColumn(label_col, parsed), df.filter(parsed.isNull())


def override_tail(vector_col: str, n: int, value: float) -> Column:
    """A vector column with its last ``n`` entries set to ``value``."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    a = vector_to_array(F.col(vector_col))  # no lambda: it would convert the vector once per entry
    kept = F.greatest(F.size(a) - n, F.lit(0))
    return array_to_vector(F.concat(F.slice(a, F.lit(1), kept), F.array_repeat(F.lit(float(value)), F.size(a) - kept)))


def normalise_name(c) -> Column:
    """P10: lowercase, spaces to underscores."""
    return F.regexp_replace(F.lower(_col(c)), " ", "_")


def term_tokens(c) -> Column:
    """G1: lowercase, then maximal runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("[" + WORD_CLASS + "]{2,}"), 0)
