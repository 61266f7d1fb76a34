"""The feature base of the learned flows: one split, one fitted feature
pipeline, one stored table.

The features are those of the classical comparison: TF-IDF over the
``VOCAB_SIZE`` most frequent training terms and two min-max scaled numbers. The
pipeline is fitted on the training rows and can be stored (``operators.pipeline``).
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.operators.pipeline import Scaler, Terms, TfIdf
from corpusframe.operators.splits import split_and_folds
from corpusframe.plans.corpus import finalized
from corpusframe.session import scratch_path
from corpusframe.sources.files import materialize

TEST_SIZE = 0.2
K_FOLDS = 5
SEED = 42
#: Most terms of the TF-IDF vocabulary (``max_features`` of the reference's classical models).
VOCAB_SIZE = 5000
NUMERIC = ("link_count", "email_length")


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, cleaned_text, link_count, email_length, is_test, fold), stored."""
    rows = split_and_folds(finalized(spark, sf_dir), "id", "label", TEST_SIZE, K_FOLDS, SEED)
    return materialize(rows, scratch_path(spark, "split-rows"), force=True)


def feature_pipeline() -> Pipeline:
    """cleaned_text and the two numbers -> ``features``, and ``nb_features``:
    the same without negative numbers, which unseen rows may have."""
    scaled = [f"{c}_scaled" for c in NUMERIC]
    floor = ", ".join(f"greatest({c}_scaled, 0D) AS {c}_nn" for c in NUMERIC)
    return Pipeline(stages=[
        Terms(inputCol="cleaned_text", outputCol="terms"),
        TfIdf(inputCol="terms", outputCol="tfidf", maxFeatures=VOCAB_SIZE),
        Scaler(inputCols=list(NUMERIC), kind="minmax"),
        SQLTransformer(statement=f"SELECT *, {floor} FROM __THIS__"),
        VectorAssembler(inputCols=["tfidf", *scaled], outputCol="features"),
        VectorAssembler(inputCols=["tfidf", *[f"{c}_nn" for c in NUMERIC]], outputCol="nb_features"),
    ])


def fit_features(rows: DataFrame) -> PipelineModel:
    """The pipeline fitted on the training rows of ``split_rows``."""
    return feature_pipeline().fit(rows.filter(~F.col("is_test")))


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, is_test, fold, features, nb_features) of the finalized corpus, stored."""
    rows = split_rows(spark, sf_dir)
    out = fit_features(rows).transform(rows).select("id", "label", "is_test", "fold", "features", "nb_features")
    return materialize(out, scratch_path(spark, "learned-features"), force=True)


def entries(vector_col: str) -> Column:
    """The stored entries of a vector column: ``array<struct<k: int, v: double>>``."""
    u = F.unwrap_udt(vector_col)
    sparse = F.zip_with(u["indices"], u["values"], lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    dense = F.transform(u["values"], lambda v, k: F.struct(k.alias("k"), v.alias("v")))
    return F.when(u["type"] == 0, sparse).otherwise(dense)
