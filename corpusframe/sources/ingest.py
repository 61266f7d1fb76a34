"""S3: map several labelled text sources to one schema and union them.

Each source is a ``select`` to ``(origin, row_id, text, label)``; ``row_id``
is unique over the union (source ordinal in the high bits, the source's own id
below ``1 << ID_BITS``; a larger or negative id fails the job), so later "keep
the first row" rules are deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusframe.functions import text as T
from corpusframe.functions.html import html_to_text
from corpusframe.operators.dedup import union_all

ID_BITS = 56
TURN_BITS = 20


def bounded_id(c: Column, bits: int) -> Column:
    """``c`` as a non-negative bigint below ``1 << bits``; fails otherwise."""
    c = c.cast("bigint")
    message = F.concat(F.lit(f"id outside 0 .. 2^{bits} - 1: "), c.cast("string"))
    return F.when((c < 0) | (c >= F.lit(1 << bits)), F.raise_error(message).cast("bigint")).otherwise(c)


def packed_id(high: Column, low: Column, low_bits: int = TURN_BITS, bits: int = ID_BITS) -> Column:
    """Two ids as one, in the order of (high, low)."""
    return bounded_id(high, bits - low_bits) * F.lit(1 << low_bits) + bounded_id(low, low_bits)


def as_source(
    df: DataFrame,
    ordinal: int,
    origin: str,
    id_col: str,
    text: Column,
    label: Column | int,
    lower: bool = True,
) -> DataFrame:
    """One source in the common schema (P3 constant label, P4 drop, P5 rename, T1)."""
    label_col = F.lit(label) if isinstance(label, int) else label
    t = T.lowercase(text) if lower else text
    return df.select(
        F.lit(origin).alias("origin"),
        (F.lit(ordinal).cast("bigint") * F.lit(1 << ID_BITS) + bounded_id(F.col(id_col), ID_BITS)).alias("row_id"),
        t.alias("text"),
        label_col.cast("int").alias("label"),
    )


def html_source(df: DataFrame, ordinal: int, origin: str, id_col: str, fields: Sequence[str], label: int = 1) -> DataFrame:
    """A raw-mail source: fields concatenated (P1, P2), HTML to text (T4), lowercased."""
    return as_source(df, ordinal, origin, id_col, html_to_text(T.concat_fields(fields)), label)


def fixture_sources(spark, sf_dir: str) -> list[DataFrame]:
    """The five frames of the cleaning flow, from the given tables:
    labelled documents split by label (F1), pages and conversations as raw
    mail sources, benchmark items as a single-class source."""
    from corpusframe.plans.corpus import labelled_documents, table

    docs = labelled_documents(spark, sf_dir)
    safe = as_source(docs.filter(F.col("label") == 0), 0, "labelled_safe", "id", F.col("text"), F.col("label"))
    unsafe = as_source(docs.filter(F.col("label") == 1), 1, "labelled_unsafe", "id", F.col("text"), F.col("label"))
    pages = html_source(table(spark, sf_dir, "pages"), 2, "pages", "page_id", ["url", "html"])
    conv = table(spark, sf_dir, "conversations").withColumn("_id", packed_id(F.col("conv_id"), F.col("turn")))
    conversations = html_source(conv, 3, "conversations", "_id", ["role", "text"])
    bench = as_source(table(spark, sf_dir, "benchmark"), 4, "benchmark", "item_id", F.col("text"), 1)
    return [safe, unsafe, pages, conversations, bench]


def merged_corpus(spark, sf_dir: str) -> DataFrame:
    """U1 over the five fixture sources."""
    return union_all(fixture_sources(spark, sf_dir))
