"""Input tables of the flows, derived from the given parquet tables.

Mapping (see FIXTURES.md): the labelled corpus is ``documents`` joined with
``labels`` (``toxic`` is the positive class); ``pages`` are the HTML mail
sources, ``conversations`` the multi-field source, ``benchmark`` an extra
single-class source. Prediction scores are a fixed, hash-derived function of
the row id and label, so every evaluation operator has an exact SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.functions import text as T
from corpusframe.operators.splits import hex_to_long

# Clip bounds of the two structured features.
LINK_COUNT_MAX = 100
EMAIL_LENGTH_MAX = 20000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_documents(spark: SparkSession, sf_dir: str, target: str = "toxic") -> DataFrame:
    """(id, text, label, source, lang): every labelled document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col(target).cast("int").alias("label"))
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), "text", "label", "source", "lang"
    )


def finalized(spark: SparkSession, sf_dir: str, target: str = "toxic") -> DataFrame:
    """(id, cleaned_text, label, link_count, email_length): lowercased text
    without punctuation and its two clipped structured features."""
    df = labelled_documents(spark, sf_dir, target)
    cleaned = T.remove_punctuation(T.lowercase(T.null_to_text("text")))
    df = df.select("id", cleaned.alias("cleaned_text"), "label")
    return df.select(
        "id",
        "cleaned_text",
        "label",
        T.clip(T.link_count("cleaned_text"), 0, LINK_COUNT_MAX).alias("link_count"),
        T.clip(T.char_count("cleaned_text"), 0, EMAIL_LENGTH_MAX).alias("email_length"),
    )


def hash_unit(id_col: str, salt: str, modulus: int = 1000) -> F.Column:
    """Integer in [0, modulus) from ``md5('<salt>:<id>')``."""
    h = F.md5(F.concat(F.lit(f"{salt}:"), F.col(id_col).cast("string")))
    return F.pmod(hex_to_long(h, 8), F.lit(modulus))


def fixed_score(id_col: str = "id", label_col: str = "label", salt: str = "score", weight: int = 350) -> F.Column:
    """A deterministic score in [0, 1] that leans towards the true label;
    ``weight`` sets how much (0 = no signal). Scores repeat (ties)."""
    return (hash_unit(id_col, salt) + F.col(label_col) * F.lit(weight)) / F.lit(float(999 + weight))


def fixed_logits(id_col: str = "id", label_col: str = "label") -> F.Column:
    """Two-class logits from hashes, with NaN, +-Inf and equal logits mixed in."""
    a = (hash_unit(id_col, "logit0") - 500) / F.lit(100.0)
    b = (hash_unit(id_col, "logit1") - 500) / F.lit(100.0) + F.col(label_col) * F.lit(2.0)
    k = hash_unit(id_col, "special", 20)
    b = (
        F.when(k == 0, F.lit(float("nan")))
        .when(k == 1, F.lit(float("inf")))
        .when(k == 2, F.lit(float("-inf")))
        .when(k == 3, a)
        .when(k == 4, F.lit(1000.0))
        .otherwise(b)
    )
    return F.array(a.cast("double"), b.cast("double"))


def scored(spark: SparkSession, sf_dir: str, salt: str = "score", weight: int = 350) -> DataFrame:
    """Finalized rows with ``score`` and ``predicted_label`` (score >= 0.5)."""
    df = finalized(spark, sf_dir)
    s = fixed_score(salt=salt, weight=weight)
    return df.withColumn("score", s).withColumn("predicted_label", (s >= 0.5).cast("int"))
