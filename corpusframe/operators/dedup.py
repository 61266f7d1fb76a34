"""Union and duplicate operators.

Texts are never shuffled, sorted or aggregated to find duplicates: rows are
grouped on a 256-bit digest plus the length of the text, and the aggregates hold
counts, labels and numeric ids only (hash aggregation with map-side combine, so
a text repeated in a third of all rows collapses to one row per map task). Only
the rows that go or stay are then looked up by their unique numeric id. The
frames given here are read more than once: pass a stored table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces into which the rows of one duplicated text are dealt for a join.
SALT = 16


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name, missing columns filled with null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def text_key(text_col: str) -> list[F.Column]:
    """Grouping key of a text: digest and length (null text -> null parts)."""
    return [F.sha2(F.col(text_col), 256).alias("_h"), F.length(text_col).alias("_n")]


def duplicate_members(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Every row whose text occurs more than once (all copies). A text's
    rows are dealt to ``SALT`` join tasks by their id."""
    keyed = df.select("*", *text_key(text_col))
    dup = keyed.groupBy("_h", "_n").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    dup = dup.select("_h", "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))).alias("_s"))
    salted = keyed.withColumn("_s", F.pmod(F.xxhash64(id_col), F.lit(SALT)))
    same = [salted["_h"].eqNullSafe(dup["_h"]), salted["_n"].eqNullSafe(dup["_n"]), salted["_s"] == dup["_s"]]
    return salted.join(dup, same, "left_semi").drop("_h", "_n", "_s")


def duplicate_count(df: DataFrame, text_col: str) -> DataFrame:
    """Rows beyond the first of each text (one row: ``duplicates``)."""
    per_text = df.groupBy(*text_key(text_col)).agg(F.count(F.lit(1)).alias("_c"))
    return per_text.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def distinct_keys(df: DataFrame, cols: Sequence[str], text_col: str, id_col: str) -> DataFrame:
    """One narrow row per distinct ``cols`` (the text compared by key): the
    other columns, and the smallest ``id_col`` as ``_first``."""
    others = [c for c in cols if c != text_col]
    return df.groupBy(*others, *text_key(text_col)).agg(F.min(id_col).alias("_first"))


def drop_duplicates(df: DataFrame, cols: Sequence[str], text_col: str, order_col: str) -> DataFrame:
    """U4: one row per distinct ``cols`` (the text column compared by key),
    keeping the row with the smallest ``order_col``, a unique numeric id."""
    first = distinct_keys(df, cols, text_col, order_col).select(F.col("_first").alias(order_col))
    return df.join(first, order_col, "left_semi")


def label_conflicts(df: DataFrame, text_col: str, label_col: str, id_col: str) -> DataFrame:
    """Texts carried with more than one label."""
    per_label = df.groupBy(*text_key(text_col), label_col).agg(F.count(F.lit(1)).alias("_c"), F.min(id_col).alias("_first"))
    g = per_label.groupBy("_h", "_n").agg(
        F.min("_first").alias(id_col), F.count(label_col).alias("n_labels"), F.sum("_c").cast("bigint").alias("n_rows")
    )
    return df.select(id_col, text_col).join(g.filter("n_labels > 1").drop("_h", "_n"), id_col).drop(id_col)
