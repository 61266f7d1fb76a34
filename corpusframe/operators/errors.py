"""Error analysis.

Everything is computed per error class with grouped aggregations; no text is
joined into a driver-side string (T12 becomes explode + count)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.functions import text as T
from corpusframe.functions.dates import is_date_token
from corpusframe.functions.stopwords import ENGLISH_STOP_WORDS

FALSE_POSITIVE = "false_positive"
FALSE_NEGATIVE = "false_negative"


def misclassified(df: DataFrame, label_col="label", pred_col="predicted_label") -> DataFrame:
    """F3."""
    return df.filter(F.col(label_col) != F.col(pred_col))


def error_rows(df: DataFrame, label_col="label", pred_col="predicted_label") -> DataFrame:
    """false positives (0 -> 1) and false negatives (1 -> 0) with ``error_type``."""
    y, p = F.col(label_col), F.col(pred_col)
    et = F.when((y == 0) & (p == 1), F.lit(FALSE_POSITIVE)).when((y == 1) & (p == 0), F.lit(FALSE_NEGATIVE))
    return df.withColumn("error_type", et).filter(F.col("error_type").isNotNull())


def top_k_per_group(df: DataFrame, group_cols: Sequence[str], order: Sequence, k: int, buckets: int = 64, bucket_key=None) -> DataFrame:
    """Exact top ``k`` rows per group by ``order`` without sorting a whole
    group in one task: each (group, hash bucket) keeps its own top ``k``,
    then the at most ``buckets * k`` survivors per group are ranked."""
    group_cols = list(group_cols)
    key = bucket_key if bucket_key is not None else F.xxhash64(*[F.col(c) for c in df.columns if c not in group_cols])
    b = df.withColumn("_b", F.pmod(key, F.lit(buckets)))
    w1 = Window.partitionBy(*group_cols, "_b").orderBy(*order)
    cand = b.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k).drop("_r", "_b")
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return cand.withColumn("position", F.row_number().over(w2)).filter(F.col("position") <= k)


def term_frequency(
    df: DataFrame,
    text_col: str,
    group_col: str = "error_type",
    min_len: int = 3,
    stop_words=ENGLISH_STOP_WORDS,
) -> DataFrame:
    """A13 (+ F5, T9, T12): per group, counts of all whitespace-separated words
    of at least ``min_len`` characters that are not stop words. The most
    frequent ones are ``top_k_per_group`` of the result."""
    stop = list(stop_words)
    words = df.filter(F.col(text_col).isNotNull()).select(
        group_col, F.explode_outer(T.split_words(text_col)).alias("word")
    )
    words = words.filter(F.col("word").isNotNull() & (F.length("word") >= min_len) & ~F.lower("word").isin(stop))
    return words.groupBy(group_col, "word").agg(F.count(F.lit(1)).alias("n"))


def keep_term(term_col: str, min_len: int = 3) -> F.Column:
    """terms of at least ``min_len`` characters that are not date tokens."""
    return (F.length(term_col) >= min_len) & ~is_date_token(term_col)
