"""Fitted transforms: stored, loaded in another session, equal to SQL."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from corpusframe.operators.pipeline import Scaler, ScalerModel, Terms, TfIdf
from corpusframe.plans import base as B
from corpusframe.plans import catalog
from corpusframe.plans import runs as RU
from corpusframe.session import scratch_path
from tests.oracle_compare import duck

MID = "/root/testdata/sf0.01"


def test_stored_pipeline_in_a_new_session_equals_sql(spark):
    rows = B.split_rows(spark, MID)
    path = scratch_path(spark, "feature-pipeline")
    B.fit_features(rows).write().save(path)
    other = spark.newSession()
    loaded = PipelineModel.load(path)
    vocabulary = other.read.parquet(f"{path}/stages/*_TfIdfModel*/vocabulary").select("index", "term")
    terms = {r["index"]: r["term"] for r in vocabulary.collect()}
    names = terms | {len(terms): " link", len(terms) + 1: " length"}
    got = loaded.transform(rows.filter("is_test")).select("id", F.explode(B.entries("nb_features")).alias("e")).select("id", "e.*").collect()
    got = {(r["id"], names[r["k"]]): r["v"] for r in got}
    want = duck(MID).execute(f"WITH {catalog._BASE_SQL} SELECT id, x.k, v FROM x JOIN f USING (id) WHERE is_test AND v <> 0").fetchall()
    want = {(i, k): v for i, k, v in want}
    assert len(terms) == B.VOCAB_SIZE and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_scalers_keep_their_statistics(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    for kind, a in (("minmax", [0.0, 1 / 3, 1.0]), ("standard", list((np.array([1, 2, 4]) - 7 / 3) / np.std([1, 2, 4])))):
        model = Scaler(inputCols=["a", "b"], kind=kind).fit(df)
        path = scratch_path(spark, "scaler")
        model.write().save(path)
        again = ScalerModel.load(path)
        got = again.transform(df).orderBy("a").collect()
        assert np.allclose([r["a_scaled"] for r in got], a) and [r["b_scaled"] for r in got] == [0.0] * 3
        assert again.transform(df.select((F.col("a") * 100).alias("a"), "b")).count() == 3
    none = Scaler(inputCols=["a"]).fit(df.limit(0))
    assert none.transform(df).agg(F.sum("a_scaled")).first()[0] == 7.0
    with pytest.raises(ValueError):
        Scaler(inputCols=["a"], kind="other").fit(df)


def test_terms_and_unseen_words(spark):
    df = spark.createDataFrame([(1, "The red fox"), (2, "red red dog the"), (3, None)], "id int, t string")
    pipe = Pipeline(stages=[Terms(inputCol="t", outputCol="w", ngramHigh=2, stopWords=["the"]), TfIdf(inputCol="w", outputCol="x", maxFeatures=3)]).fit(df)
    path = scratch_path(spark, "terms")
    pipe.write().save(path)
    new = spark.createDataFrame([(9, "red cat the fox"), (10, ""), (11, None)], "id int, t string")
    a, b = pipe.transform(new).orderBy("id").collect(), PipelineModel.load(path).transform(new).orderBy("id").collect()
    assert a == b and a[0]["w"] == ["red", "cat", "fox", "red cat", "cat fox"]
    assert a[0]["x"].numNonzeros() >= 1 and a[1]["x"].numNonzeros() == a[2]["x"].numNonzeros() == 0


def test_rare_terms_count(spark, monkeypatch):
    """Scores change when the rarer terms of the vocabulary are dropped."""
    rows = B.split_rows(spark, MID)

    def margins(size):
        monkeypatch.setattr(B, "VOCAB_SIZE", size)
        x = RU.run_rows(B.fit_features(rows).transform(rows))
        return {r["id"]: r["m"] for r in RU.margins(x, RU.weights(x, size + 2)).collect()}

    full, cut = margins(5000), margins(500)
    assert full.keys() == cut.keys()
    assert sum(abs(full[i][4] - cut[i][4]) > 1e-3 for i in full) > 0.9 * len(full)
