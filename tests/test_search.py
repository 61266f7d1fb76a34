"""Stored models, resumable fits, the boosting log and the kernel features."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Observation
from pyspark.sql import functions as F

from corpusframe.operators import boosting as BO
from corpusframe.operators import evaluation as E
from corpusframe.operators import models as M
from corpusframe.operators.kernel import RandomFourierFeatures, RandomFourierFeaturesModel
from corpusframe.operators.search import missing, run_planned
from corpusframe.session import scratch_path
from corpusframe.sources.files import materialize
from corpusframe.sources.registry import ModelRegistry


def points(spark, n=600, seed=0):
    """Two rings around the origin, and a fold per row."""
    g = np.random.default_rng(seed)
    r = np.where(np.arange(n) % 2 == 0, 1.0, 3.0) + g.normal(0, 0.15, n)
    a = g.uniform(0, 2 * np.pi, n)
    rows = [(i, int(i % 2), int(i // 2 % 3 + 1), [float(r[i] * np.cos(a[i])), float(r[i] * np.sin(a[i]))]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, label int, fold int, v array<double>")
    return materialize(df.withColumn("features", array_to_vector("v")), scratch_path(spark, "rings"), force=True)


def accuracy(df):
    return df.agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]


def test_kernel_separates_rings_that_a_linear_svm_cannot(spark):
    df = points(spark)
    train, test = df.filter("fold < 3"), df.filter("fold = 3")
    linear = M.CalibratedSVM().fit(train)
    kernel = M.rbf_svm(width=128).fit(train)
    assert accuracy(linear.transform(test)) < 0.75
    scored = kernel.transform(test)
    assert accuracy(scored) > 0.97 and scored.filter("score < 0 OR score > 1").count() == 0
    path = scratch_path(spark, "svm")
    kernel.write().save(path)
    again = PipelineModel.load(path).transform(test)
    assert [tuple(r) for r in again.select("id", "score").orderBy("id").collect()] == [tuple(r) for r in scored.select("id", "score").orderBy("id").collect()]


def test_svm_fits_rows_that_come_twice_as_they_are(spark, monkeypatch):
    df = points(spark, 90, 12)
    seen = []

    class Counting(M.LinearSVC):
        def _fit(self, rows):
            seen.append(sorted(r["id"] for r in rows.select("id").collect()))
            return self.setMaxIter(5) and super()._fit(rows)

    monkeypatch.setattr(M, "LinearSVC", Counting)
    M.CalibratedSVM(reg=0.1).fit(df.unionByName(df))
    assert [len(x) for x in seen] == [120] * 3
    assert all(x[::2] == x[1::2] == sorted(set(x)) for x in seen)  # both copies, or neither
    assert sorted(x for ids in seen for x in ids) == sorted([*range(90)] * 4)


def test_fourier_features_approximate_the_kernel(spark):
    from pyspark.ml.linalg import SparseVector, VectorUDT  # noqa: F401

    g = np.random.default_rng(3)
    x = np.where(g.random((40, 30)) < 0.2, g.normal(size=(40, 30)), 0.0)
    rows = [(i, SparseVector(30, {k: v for k, v in enumerate(r) if v})) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ["id", "features"])
    model = RandomFourierFeatures(width=4096).fit(df)
    gamma = model.getOrDefault(model.gamma)
    assert abs(gamma - 1 / (30 * x.var())) < 1e-9
    z = np.array([r["fourier"].toArray() for r in model.transform(df.repartition(5)).orderBy("id").collect()])
    want = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - want).max() < 0.1
    dense = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    z2 = np.array([r["fourier"].toArray() for r in model.transform(dense.withColumn("features", array_to_vector("v"))).orderBy("id").collect()])
    assert np.allclose(z, z2)
    path = scratch_path(spark, "fourier")
    model.write().save(path)
    loaded = RandomFourierFeaturesModel.load(path)
    assert loaded.getOrDefault(loaded.gamma) == gamma


def test_run_that_is_cut_off_resumes(spark):
    path = scratch_path(spark, "planned")
    planned = spark.createDataFrame([(c, f) for c in "ab" for f in (1, 2, 3)], "config string, fold int")
    done = []

    def fit(row, fail=True):
        if fail and row == {"config": "b", "fold": 2}:
            raise RuntimeError("lost")
        done.append((row["config"], row["fold"]))
        return spark.range(4).select("id", F.lit(row["config"]).alias("config"), F.lit(row["fold"]).alias("fold"))

    with pytest.raises(RuntimeError, match="lost"):
        run_planned(planned, path, ["config", "fold"], fit, workers=3)
    assert len(done) == 5
    assert [tuple(r) for r in missing(planned, path, ["config", "fold"]).collect()] == [("b", 2)]
    out = run_planned(planned, path, ["config", "fold"], lambda row: fit(row, fail=False))
    assert len(done) == 6 and out.count() == 24
    assert out.groupBy("config", "fold").count().filter("count <> 4").count() == 0
    again = run_planned(planned, path, ["config", "fold"], lambda row: pytest.fail("refitted"))
    assert again.count() == 24
    with pytest.raises(ValueError):
        run_planned(planned, scratch_path(spark, "planned"), ["config", "fold"], lambda row: spark.range(1))


def test_grid_search_metrics_are_those_of_the_stored_predictions(spark):
    df = points(spark, 300, 2)
    df = df.withColumn("features", array_to_vector(F.array(F.col("v")[0] + F.col("label"), F.col("v")[1])))
    path = scratch_path(spark, "grid")
    grid = [{"regParam": 0.0}, {"regParam": 5.0}]
    base = M.logistic_regression(100)
    got = M.grid_search(df, lambda c: base.copy({base.getParam(k): v for k, v in c.items()}), grid, path, k=3).orderBy("config").collect()
    stored = spark.read.parquet(path)
    assert stored.count() == 2 * df.count()
    for r in got:
        aucs = [E.roc_auc(stored.filter((F.col("config") == r["config"]) & (F.col("cv_fold") == f))).first()["auc"] for f in (1, 2, 3)]
        assert abs(np.mean(aucs) - r["mean_auc"]) < 1e-12 and abs(np.std(aucs) - r["std_auc"]) < 1e-12


def test_registry_keeps_the_best_run(spark):
    df = points(spark, 200, 4)
    registry = ModelRegistry(spark, scratch_path(spark, "registry"))
    assert registry.runs().count() == 0
    with pytest.raises(LookupError):
        registry.load_best("f1", "rings")
    preds = M.k_fold_runs(df, lambda tr: M.random_forest(), 3, scratch_path(spark, "rings-predictions"), model_name="rings", registry=registry)
    f1 = {r["fold"]: r["f1"] for r in E.binary_metrics(preds, group_cols=["fold"]).collect()}
    stored = {r["fold"]: r["value"] for r in registry.runs().filter("metric = 'f1'").collect()}
    assert stored == f1
    best = registry.best("f1").collect()
    assert [(r["model"], r["fold"], r["value"]) for r in best] == [("rings", max(f1, key=lambda i: (f1[i], -i)), max(f1.values()))]
    # The loaded model predicts what was predicted when it was fitted.
    held = df.filter(F.col("fold") == best[0]["fold"])
    again = M.predictions(ModelRegistry(spark, registry.path).load_best("f1", "rings"), held)
    want = {r["id"]: r["score"] for r in preds.filter(F.col("fold") == best[0]["fold"]).collect()}
    assert {r["id"]: r["score"] for r in again.collect()} == want
    registry.register("rings", ModelRegistry(spark, registry.path).load_best("f1", "rings"), {"f1": 2.0}, fold=1)
    assert registry.runs().filter("fold = 1").count() == 1  # replaced, not added


def test_boosting_log_is_the_fit_round_by_round(spark):
    df = points(spark, 400, 6).withColumn("held", F.col("fold") == 3)
    noisy = df.withColumn("label", F.when(F.col("id") % 7 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    noisy = materialize(noisy, scratch_path(spark, "noisy"), force=True)
    estimator = M.gradient_boosting().setMaxIter(20)
    train, held = noisy.filter("NOT held"), noisy.filter("held")
    model = estimator.fit(train)
    log = {r["round"]: r for r in BO.round_log(model, held).collect()}
    assert sorted(log) == list(range(1, 21))
    # The last row is the whole model's.
    scored = model.transform(held)
    met = E.binary_metrics(scored.withColumn("predicted_label", F.col("prediction").cast("int"))).first()
    assert all(abs(log[20][k] - met[k]) < 1e-12 for k in ("accuracy", "precision", "recall", "f1"))
    # Every row's loss is Spark's own for that round.
    assert np.allclose([log[i]["loss"] for i in sorted(log)], model.evaluateEachIteration(held))
    # Stored trees, scored one by one.
    row = BO.staged_margins(model, held).first()
    want = np.cumsum([w * t.predict(row["features"]) for t, w in zip(model.trees, model.treeWeights)])
    assert np.allclose(row["margins"], want)
    # The fit that stops by itself stops where the log's replay does.
    best = BO.stops(BO.round_log(model, held.withColumn("run", F.lit(1)), ["run"]), ["run"]).first()
    assert BO.stopped(estimator, noisy, "held").getNumTrees == best["best_round"]


def test_logistic_regression_is_at_its_optimum(spark):
    df = points(spark, 300, 8)
    df = materialize(df.withColumn("features", array_to_vector(F.array(F.col("v")[0] + F.col("label"), F.col("v")[1]))), scratch_path(spark, "shifted"), force=True)
    model = M.logistic_regression(300, c=0.5, tol=1e-10).fit(df)
    x = np.array([r["features"].toArray() for r in df.orderBy("id").collect()])
    y = np.array([r["label"] for r in df.orderBy("id").collect()])
    p = 1 / (1 + np.exp(-(x @ model.coefficients.toArray() + model.intercept)))
    slope = x.T @ (p - y) / 300 + model.coefficients.toArray() / (0.5 * 300)
    assert np.abs(slope).max() < 1e-5 and abs((p - y).mean()) < 1e-5


def test_forest_is_the_mean_of_its_trees(spark):
    df = points(spark, 200, 9)
    model = M.random_forest().setNumTrees(7).fit(df)
    rows = df.limit(20).collect()
    got = {r["id"]: r["score"] for r in M.predictions(model, df).collect()}
    for r in rows:
        votes = np.array([t.predictProbability(r["features"]).toArray() for t in model.trees])
        assert abs(got[r["id"]] - votes.mean(axis=0)[1]) < 1e-12


def test_models_fit_and_score_in_a_session_that_has_observed(spark):
    df = points(spark, 60, 11).coalesce(1)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get == {"n": 60}
    for estimator in (M.logistic_regression(60), M.random_forest().setNumTrees(3), M.CalibratedSVM(k=2, reg=0.1)):
        assert M.predictions(estimator.fit(df), df).count() == 60
    runs = M.k_fold_runs(df, lambda tr: M.logistic_regression(tr.count()), 3, scratch_path(spark, "observed-folds"), model_name="lr")
    assert runs.count() == 60
