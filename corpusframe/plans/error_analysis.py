"""Error analysis of misclassified rows (section 3.4 of the survey): keyword
flags, lengths, word frequencies, and a joint bigram TF-IDF of false
positives and false negatives with per-class means and top terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusframe.functions.stopwords import ENGLISH_STOP_WORDS
from corpusframe.operators import errors as ER
from corpusframe.operators import features as G
from corpusframe.plans.corpus import scored
from corpusframe.session import scratch_path
from corpusframe.sources.files import materialize, read_csv, write_csv

BIGRAM_MAX_FEATURES = 100
TOP_TERMS = 10


def error_export(spark: SparkSession, sf_dir: str) -> str:
    """Write the misclassified rows with prediction and confidence as one
    CSV table; returns its path."""
    s = ER.misclassified(scored(spark, sf_dir))
    rows = s.select(
        "id", "cleaned_text", "label", "link_count", "email_length", "predicted_label", F.greatest(F.col("score"), 1 - F.col("score")).alias("confidence")
    )
    return write_csv(rows, scratch_path(spark, "misclassified"))


EXPORT_SCHEMA = "id bigint, cleaned_text string, label int, link_count bigint, email_length bigint, predicted_label int, confidence double"


def error_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, error_type, cleaned_text, email_length, ...) of the false positives
    and false negatives, read from the E9 export."""
    rows = read_csv(spark, error_export(spark, sf_dir), EXPORT_SCHEMA)
    return ER.error_rows(rows)


def bigram_fit(errors: DataFrame, stop_words=ENGLISH_STOP_WORDS, max_features: int = BIGRAM_MAX_FEATURES) -> tuple[DataFrame, DataFrame]:
    """Joint vocabulary and the error rows with their bigram terms (F5 drops
    rows without text)."""
    e = G.with_terms(errors.filter(F.col("cleaned_text").isNotNull()), "cleaned_text", "terms", (2, 2), stop_words)
    e = materialize(e.select("id", "error_type", "terms"), scratch_path(errors.sparkSession, "error-terms"), force=True)
    return G.fit_vocabulary(e, "terms", max_features), e


def mean_tfidf(spark: SparkSession, sf_dir: str, stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """Mean weight of every vocabulary term per class, over all rows of
    the class (rows without the term count as 0). ``stop_words``: the list of
    the bigram fit; the library list that the flow was written for is not
    available offline, so the default is this package's own list."""
    vocab, e = bigram_fit(error_corpus(spark, sf_dir), stop_words)
    w = G.tfidf_rows(e, ["id", "error_type"], "terms", vocab, BIGRAM_MAX_FEATURES)
    sums = w.groupBy("error_type", "term").agg(F.sum("weight").alias("s"))
    n = e.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))  # one row per class
    grid = vocab.select("term").crossJoin(F.broadcast(n))  # vocabulary x classes: bounded
    return grid.join(sums, ["error_type", "term"], "left").select(
        "error_type", "term", (F.coalesce(F.col("s"), F.lit(0.0)) / F.col("n")).alias("mean_tfidf")
    )


def top_terms(spark: SparkSession, sf_dir: str, k: int = TOP_TERMS) -> DataFrame:
    """O1: the ``k`` terms of highest mean weight per class (ties by term);
    at most max_features rows per class are ranked."""
    m = mean_tfidf(spark, sf_dir)
    w = Window.partitionBy("error_type").orderBy(F.col("mean_tfidf").desc(), F.col("term"))
    return m.withColumn("position", F.row_number().over(w).cast("bigint")).filter(F.col("position") <= k)


def filtered_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the per-class term scores without short terms and date tokens."""
    return mean_tfidf(spark, sf_dir).filter(ER.keep_term("term"))


def word_frequencies(spark: SparkSession, sf_dir: str, stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """Word counts per class."""
    return ER.term_frequency(error_corpus(spark, sf_dir), "cleaned_text", "error_type", 3, stop_words)
