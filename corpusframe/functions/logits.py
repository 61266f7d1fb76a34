"""Prediction-column functions over logit arrays.

All are higher-order array expressions evaluated in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusframe.functions.text import _col


def count_non_finite(c) -> Column:
    """Q5: number of NaN or infinite entries of a logit array."""
    return F.size(F.filter(_col(c), lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))


def sanitise(c, nan: float = 0.0, posinf: float = 10.0, neginf: float = -10.0) -> Column:
    """NaN -> 0, +Inf -> 10, -Inf -> -10."""
    return F.transform(
        _col(c),
        lambda x: F.when(F.isnan(x), F.lit(nan))
        .when(x == float("inf"), F.lit(posinf))
        .when(x == float("-inf"), F.lit(neginf))
        .otherwise(x),
    )


def argmax(c) -> Column:
    """Z3: 0-based index of the largest entry, first one on ties."""
    a = _col(c)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def softmax(c) -> Column:
    """Numerically stable softmax (shifted by the maximum)."""
    a = _col(c)
    m = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - m))
    total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / total)


def confidence(c) -> Column:
    """Probability of the predicted class."""
    return F.array_max(softmax(c))


def positive_probability(c, strict: bool = False) -> Column:
    """Probability of class 1; with ``strict`` a non-binary row fails the
    query, otherwise a one-logit row falls back to column 0."""
    p = softmax(c)
    if strict:
        return F.when(F.assert_true(F.size(_col(c)) == 2).isNull(), F.element_at(p, 2))
    return F.when(F.size(p) > 1, F.element_at(p, 2)).otherwise(F.element_at(p, 1))
