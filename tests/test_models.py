"""Learned models have no exact oracle: check shapes and invariants on
sf0.01 (the smallest tables with enough rows of both classes)."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from corpusframe.operators import models as M
from corpusframe.plans import base as B
from corpusframe.plans import learned as LM
from corpusframe.session import scratch_path
from corpusframe.sources.files import materialize

MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def n_test(spark):
    return B.feature_table(spark, MID).filter(F.col("is_test")).count()


def test_learned_predictions(spark, n_test):
    df = E.queries()["learned_predictions"](spark, MID)
    rows = df.collect()
    assert {r.model for r in rows} == {"Naive Bayes", "Logistic Regression", "SVM", "Random Forest", "Gradient Boosting"}
    assert len(rows) == 5 * n_test
    assert all(r.predicted_label in (0, 1) and 0.0 <= r.score <= 1.0 for r in rows)


def test_learned_comparison(spark):
    rows = E.queries()["learned_comparison"](spark, MID).collect()
    assert len(rows) == 5
    for r in rows:
        for m in ("accuracy", "precision", "recall", "f1", "auc"):
            assert 0.0 <= getattr(r, m) <= 1.0
    assert [r.f1 for r in rows] == sorted((r.f1 for r in rows), reverse=True)
    assert max(r.auc for r in rows) > 0.6  # the target is learnable


def test_inference_times(spark):
    rows = E.queries()["inference_times"](spark, MID).collect()
    assert len(rows) == 5 and all(r.inference_seconds >= 0 for r in rows)


def test_grid_search(spark):
    rows = E.queries()["cv_grid_search"](spark, MID).collect()
    assert [r.config for r in rows] == list(range(len(LM.GRID)))
    assert sum(r.chosen for r in rows) == 1
    best = max(rows, key=lambda r: r.mean_auc)
    assert best.chosen


def test_kfold_resumes(spark):
    ft = B.feature_table(spark, MID)
    train = ft.filter(~F.col("is_test"))
    path = scratch_path(spark, "kfold-test")
    first = M.k_fold_runs(train, lambda tr: M.naive_bayes("nb_features"), 5, path, model_name="nb")
    assert sorted(r.fold for r in first.select("fold").distinct().collect()) == [1, 2, 3, 4, 5]
    assert first.count() == train.count()  # every training row validated once

    def refuse(_):
        raise AssertionError("completed folds must not be refitted")

    again = M.k_fold_runs(train, refuse, 5, path, model_name="nb")
    assert again.count() == train.count()


def test_kfold_runs_query(spark):
    rows = E.queries()["kfold_runs"](spark, MID).collect()
    assert sorted(r.fold for r in rows) == [1, 2, 3, 4, 5]


def test_fusion_head(spark):
    df = E.queries()["fusion_head"](spark, MID)
    n = spark.read.parquet(f"{MID}/embeddings.parquet").count()
    rows = df.collect()
    assert 0 < len(rows) < n
    assert all(r.predicted_label in (0, 1) for r in rows)


def test_every_model_is_fitted_on_every_training_row_once(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector

    ft = spark.range(60).select(
        "id", (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 5 == 0).alias("is_test"),
        array_to_vector(F.array((F.col("id") % 2).cast("double"), (F.col("id") % 7).cast("double"))).alias("features"),
    )
    ft = materialize(ft.withColumn("nb_features", F.col("features")), scratch_path(spark, "own-features"), force=True)
    plain, seen = M.naive_bayes("nb_features"), {}

    class Recorder:
        def __init__(self, name):
            self.name = name

        def fit(self, df):
            seen[self.name] = sorted(r.id for r in df.select("id").collect())
            return plain.fit(df)

    names = ("naive_bayes", "logistic_regression", "rbf_svm", "random_forest", "gradient_boosting")
    asked = {}
    for name in names:
        monkeypatch.setattr(M, name, lambda *a, name=name, **k: asked.setdefault(name, (a, k)) and Recorder(name))
    registry = LM.train_models(spark, ft)
    train = [i for i in range(60) if i % 5]
    assert seen == {name: train for name in names}
    assert asked["logistic_regression"] == ((len(train),), {}) and asked["rbf_svm"][1]["reg"] == 1 / len(train)
    runs = registry.runs().filter("metric = 'train_rows'").collect()
    assert sorted(r["value"] for r in runs) == [len(train)] * 5
