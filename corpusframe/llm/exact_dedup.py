"""Exact dedup by a heavy-hitter split, DataFrame functions only.

Texts are equal when they are identical (null counts as empty); the SHA-256 of
the UTF-8 text stands for the text. Of equal texts the row with the largest
``doc_id`` stays.

Method. One pass over the texts writes the narrow table (id, digest). A
Misra-Gries summary (``approx_top_k``, the frequent-items sketch, merged from
one bounded summary per task) names the digests that may be frequent. A second
pass over the narrow table verifies them: exact count and exact largest id of
each. These winners, at most ``HEAVY_DIGESTS`` rows whatever the input size,
are broadcast; every copy that is not its digest's winner is decided in the map
task and never shuffled. What remains (all other digests, and one row per
frequent one) is grouped by an ordinary shuffle on the digest. Of the digests
that are not named, none is among the ``HEAVY_DIGESTS`` most frequent but for the
summary's error of ``3.5 / SUMMARY_ITEMS`` of the rows: a shuffled group holds less
than ``1 / HEAVY_DIGESTS + 3.5 / SUMMARY_ITEMS``, a thousandth, of all rows.

Defined cases. Null text equals empty text. A null id is smaller than any id:
such a row stays only if no equal text has an id. Rows that repeat both id and
text are equal rows: exactly one of them stays. Very long texts are only hashed.
An empty table gives an empty result. Input columns keep their names; working
columns avoid them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusframe.llm.tables import fresh, stored, table, text_of

#: Counters of the Misra-Gries summary, per task and merged.
SUMMARY_ITEMS = 8192
#: Most digests that are broadcast (a digest, an id and a count each).
HEAVY_DIGESTS = 2048


def digest(text_col: str = "text") -> Column:
    return F.sha2(text_of(text_col), 256)


def heavy_digests(ids: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of the verified frequent digests of
    ``ids`` (doc_id, digest); at most ``HEAVY_DIGESTS`` rows."""
    summary = ids.agg(F.expr(f"approx_top_k(digest, {HEAVY_DIGESTS}, {SUMMARY_ITEMS})").alias("top"))
    named = summary.select(F.explode("top").alias("t")).where("t.count > 1").select(F.col("t.item").alias("digest"))
    counted = (
        ids.join(F.broadcast(named), "digest")
        .groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return counted.where("group_size > 1")


def groups(ids: DataFrame, heavy: DataFrame) -> DataFrame:
    """``ids`` (doc_id, digest) with keep_id, group_size and kept; ``heavy``:
    its ``heavy_digests``, stored."""
    marked = ids.join(F.broadcast(heavy), "digest", "left")
    loses = F.col("keep_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("keep_id"))
    dropped = marked.where(loses).select("doc_id", "digest", "keep_id", "group_size", F.lit(False).alias("kept"))
    same = Window.partitionBy("digest")
    rest = marked.where(~loses).select(
        "doc_id", "digest",
        F.coalesce("keep_id", F.max("doc_id").over(same)).alias("keep_id"),
        F.coalesce("group_size", F.count(F.lit(1)).over(same)).alias("group_size"),
        (F.row_number().over(same.orderBy(F.col("doc_id").desc_nulls_last())) == 1).alias("kept"),
    )
    return dropped.unionByName(rest)


def _ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return stored(docs.select(F.col(id_col).alias("doc_id"), digest(text_col).alias("digest")), "exact-ids")


def duplicate_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    ids = _ids(docs, id_col, text_col)
    return groups(ids, stored(heavy_digests(ids), "exact-heavy")).withColumnRenamed("digest", "text_sha256")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all columns of ``docs``.

    Copies of frequent texts go in the map task. The other rows are shuffled by
    (digest, id), a key that no two rows share unless they repeat each other,
    to meet their decision; of repeated rows one stays.
    """
    key, d, keep = fresh(docs, "key", "digest", "keep")
    ids = _ids(docs, id_col, text_col)
    heavy = stored(heavy_digests(ids), "exact-heavy")
    name = lambda digest_col, doc_col: F.concat_ws(":", digest_col, F.col(doc_col).cast("string"))  # noqa: E731  a null id adds nothing
    staying = groups(ids, heavy).where("kept").select(name(F.col("digest"), "doc_id").alias(key))
    winners = F.broadcast(heavy.select(F.col("digest").alias(d), F.col("keep_id").alias(keep)))
    rows = docs.withColumn(d, digest(text_col)).join(winners, d, "left")
    rows = rows.where(F.col(keep).isNull() | F.col(id_col).eqNullSafe(F.col(keep)))
    rows = rows.withColumn(key, name(F.col(d), id_col)).join(staying, key, "left_semi")
    return rows.dropDuplicates([key]).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_report(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
