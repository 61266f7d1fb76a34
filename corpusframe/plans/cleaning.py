"""The cleaning flow: merge sources, strip punctuation, find and drop
duplicates, count, and remove stop words (section 3.1 of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.functions import text as T
from corpusframe.operators import dedup
from corpusframe.session import scratch_path
from corpusframe.sources.files import materialize
from corpusframe.sources.ingest import merged_corpus


def cleaned_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(origin, row_id, label, cleaned_text, missing): P1 then T2 on the merged
    corpus. Cleaned once and stored, as the duplicate operators read it twice."""
    m = merged_corpus(spark, sf_dir)
    out = m.select(
        "origin", "row_id", "label", T.remove_punctuation(T.null_to_text("text")).alias("cleaned_text"), T.is_blank("text").alias("missing")
    )
    return materialize(out, scratch_path(spark, "cleaned-corpus"), force=True)


def deduplicated_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4 on (label, cleaned_text), first row kept."""
    c = cleaned_corpus(spark, sf_dir)
    return dedup.drop_duplicates(c, ["label", "cleaned_text"], "cleaned_text", "row_id").select(
        "row_id", "origin", "label", "cleaned_text"
    )


def no_stop_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second output variant: stop words removed."""
    d = deduplicated_corpus(spark, sf_dir)
    return d.select("row_id", "label", T.remove_stop_words("cleaned_text").alias("cleaned_text"))


def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-A3 as (metric, value): rows before and after de-duplication, rows
    per label after it, and missing texts before (null or blank) and after
    the text cast (always 0: the cast turns a missing value into text)."""
    c = cleaned_corpus(spark, sf_dir)
    before = c.agg(
        F.count(F.lit(1)).alias("rows_merged"),
        F.count_if("missing").alias("missing_text_before_cast"),
        F.count_if(F.col("cleaned_text").isNull()).alias("missing_text_after_cast"),
    )
    after = dedup.distinct_keys(c, ["label", "cleaned_text"], "cleaned_text", "row_id").agg(
        F.count(F.lit(1)).alias("rows_deduplicated"),
        F.count_if(F.col("label") == 0).alias("label_0"),
        F.count_if(F.col("label") == 1).alias("label_1"),
    )

    def long(df):
        return df.select(
            F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value")) for c in df.columns]))
        ).select("col.*")

    return long(before).unionByName(long(after))
