"""Date-token test.

A token (or n-gram) is a date token when, stripped, it is entirely one of ten
forms: month; 4-digit year; d/m/y or d-m-y; y/m/d; month day; day month;
month year; year month; weekday; weekday day. Case is ignored. Digits are any
Unicode decimal digit and spaces any Unicode whitespace, as in Python's ``re``.
"""

from __future__ import annotations

from pyspark.sql import Column

from corpusframe.functions.text import WS_CLASS, _col, strip_ws

# Accepted month and weekday spellings.
MONTH_WORDS = (
    "jan", "january", "feb", "february", "mar", "march", "apr", "april", "may",
    "jun", "june", "jul", "july", "aug", "august", "sep", "sept", "september",
    "oct", "october", "nov", "november", "dec", "december",
)
WEEKDAY_WORDS = (
    "mon", "monday", "tue", "tuesday", "wed", "wednesday", "thu", "thursday",
    "fri", "friday", "sat", "saturday", "sun", "sunday",
)


def date_token_pattern(dialect: str = "java") -> str:
    """Anchored pattern; ``dialect`` is ``java`` (Spark) or ``re2`` (DuckDB)."""
    m = "(?:" + "|".join(MONTH_WORDS) + ")"
    w = "(?:" + "|".join(WEEKDAY_WORDS) + ")"
    d = r"\p{Nd}"
    sp = "[" + WS_CLASS + "]+"
    forms = [
        m,
        d + "{4}",
        d + "{1,2}[/-]" + d + "{1,2}[/-]" + d + "{2,4}",
        d + "{4}[/-]" + d + "{1,2}[/-]" + d + "{1,2}",
        m + sp + d + "{1,2}",
        d + "{1,2}" + sp + m,
        m + sp + d + "{4}",
        d + "{4}" + sp + m,
        w,
        w + sp + d + "{1,2}",
    ]
    flags = "(?iu)" if dialect == "java" else "(?i)"
    return flags + r"^(?:" + "|".join(forms) + r")\z"


def is_date_token(c) -> Column:
    return strip_ws(_col(c)).rlike(date_token_pattern("java"))
