"""Classical comparison with learned Spark ML models (section 3.3), grid x
fold search (M7), k-fold runs (M8), fusion head (M6) and batch scoring (Z1).

The feature table (``base``) is built once per call and written under the shared
checkpoint folder, so every fit reads a short lineage that survives lost
executors.
The compared models are all fitted on the full training split; the reference
fits SVM, forest and boosting on 2,000 draws from it. Only the boosting log
still fits on such a sample.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusframe.functions import text as T
from corpusframe.operators import boosting as BO
from corpusframe.operators import evaluation as E
from corpusframe.operators import features as G
from corpusframe.operators import models as M
from corpusframe.operators import splits as SP
from corpusframe.operators.fusion import FusionHead
from corpusframe.operators.scoring import SharedModel, score_batches
from corpusframe.operators.search import run_planned
from corpusframe.plans import base as B
from corpusframe.plans import corpus as C
from corpusframe.session import scratch_path
from corpusframe.sources.files import materialize, overwrite_partitions
from corpusframe.sources.registry import ModelRegistry

SAMPLE_ROWS = 2000

# M7 grid: (regParam, maxIter) of logistic regression, one row per configuration.
GRID = (
    {"regParam": 0.001, "maxIter": 50},
    {"regParam": 0.01, "maxIter": 50},
    {"regParam": 0.1, "maxIter": 50},
    {"regParam": 0.001, "maxIter": 100},
    {"regParam": 0.01, "maxIter": 100},
)

def train_models(spark: SparkSession, ft: DataFrame) -> ModelRegistry:
    """The five classical models, each fitted on all training rows of a feature
    table, side by side, and stored."""
    train = ft.filter(~F.col("is_test"))
    n = train.count()
    estimators = {
        "Naive Bayes": M.naive_bayes("nb_features"),
        "Logistic Regression": M.logistic_regression(n),
        "SVM": M.rbf_svm(reg=1.0 / max(n, 1)),
        "Random Forest": M.random_forest(),
        "Gradient Boosting": M.gradient_boosting(),
    }
    registry = ModelRegistry(spark, scratch_path(spark, "learned-models"))

    def fit(row: dict) -> DataFrame:
        path = registry.register(row["model"], estimators[row["model"]].fit(train), {"train_rows": n})
        return spark.createDataFrame([(row["model"], path)], "model string, path string")

    planned = spark.createDataFrame([(name,) for name in estimators], "model string")
    run_planned(planned, scratch_path(spark, "learned-fits"), ["model"], fit, name="models")
    return registry


def stored_models(registry: ModelRegistry) -> dict:
    """{name: model}, loaded from the registry."""
    return {r["model"]: registry.load(r["path"]) for r in registry.best("train_rows").orderBy("model").collect()}


def test_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, id, label, predicted_label, score) on the test split, one
    stored table partitioned by model."""
    ft = B.feature_table(spark, sf_dir)
    test = ft.filter(F.col("is_test"))
    path = scratch_path(spark, "test-predictions")
    for name, m in stored_models(train_models(spark, ft)).items():
        overwrite_partitions(M.predictions(m, test).withColumn("model", F.lit(name)), path, ["model"])
    return spark.read.parquet(path).select("model", "id", "label", "predicted_label", "score")


def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per learned model with test accuracy, precision, recall,
    F1 and AUC, from one grouped evaluation of the stored predictions."""
    preds = test_predictions(spark, sf_dir)
    met = E.binary_metrics(preds, group_cols=["model"]).drop("support")
    return met.join(E.roc_auc(preds, group_cols=["model"]), "model").orderBy(F.col("f1").desc(), "model")


def inference_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds to score the test split with each stored model; a table of
    its own, as it differs from run to run. Loading and fitting are not timed."""
    ft = B.feature_table(spark, sf_dir)
    test = ft.filter(F.col("is_test"))
    rows = [(name, round(M.timed(M.predictions(m, test)), 3)) for name, m in stored_models(train_models(spark, ft)).items()]
    return spark.createDataFrame(rows, "model string, inference_seconds double")


def naive_bayes_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 + Z1: test-split predictions of naive Bayes alone."""
    ft = B.feature_table(spark, sf_dir)
    model = M.naive_bayes("nb_features").fit(ft.filter(~F.col("is_test")))
    return M.predictions(model, ft.filter(F.col("is_test")))


def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive Bayes scored on the test split with its numeric features
    overridden by a constant 0, beside the unchanged run: (features, id,
    predicted_label)."""
    ft = B.feature_table(spark, sf_dir)
    model = M.naive_bayes("nb_features").fit(ft.filter(~F.col("is_test")))
    test = ft.filter(F.col("is_test"))
    without = T.override_tail("nb_features", len(B.NUMERIC), 0.0)
    both = test.withColumn("features_used", F.lit("all")).unionByName(
        test.withColumn("nb_features", without).withColumn("features_used", F.lit("text only"))
    )
    return M.predictions(model, both, ("features_used", "id", "label")).drop("score")


def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: every configuration of ``GRID`` on the 5 training folds; mean and
    std of fold AUC, and the chosen configuration."""
    train = B.feature_table(spark, sf_dir).filter(~F.col("is_test"))
    base = M.logistic_regression(1)
    res = M.grid_search(train, lambda cfg: base.copy({base.getParam(k): v for k, v in cfg.items()}), GRID, scratch_path(spark, "grid-predictions"), "fold", B.K_FOLDS)
    grid = spark.createDataFrame([(i, float(c["regParam"]), int(c["maxIter"])) for i, c in enumerate(GRID)], "config int, reg_param double, max_iter int")
    order = Window.orderBy(F.col("mean_auc").desc(), "config")  # one row a configuration
    return grid.join(res, "config").withColumn("chosen", F.row_number().over(order) == 1).orderBy("config")


def k_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8 (+ S5, S6, A11): logistic regression over the 5 folds, validation
    predictions stored per (model, fold); per-fold metrics."""
    train = B.feature_table(spark, sf_dir).filter(~F.col("is_test"))
    path = scratch_path(spark, "kfold-predictions")
    preds = M.k_fold_runs(
        train, lambda tr: M.logistic_regression(tr.count()), B.K_FOLDS, path, model_name="logistic_regression"
    )
    met = E.binary_metrics(preds, group_cols=["fold"]).drop("support")
    auc = E.roc_auc(preds, group_cols=["fold"])
    return met.join(auc, "fold").select("fold", "accuracy", "precision", "recall", "f1", "auc")


FOLD_MODELS = {
    "logistic_regression": lambda train: M.logistic_regression(train.count()),
    "naive_bayes": lambda train: M.naive_bayes("nb_features"),
}


def stored_best_run(spark: SparkSession, sf_dir: str, name: str = "naive_bayes") -> DataFrame:
    """A model of ``FOLD_MODELS`` is fitted on every fold and stored with
    its validation metrics; the fold with the best F1 is loaded again, stored
    together with the feature pipeline (vocabulary, idf, scaler), and that whole
    is loaded and scores the test split from its texts: (model, best_fold,
    fold_f1, accuracy, precision, recall, f1, support)."""
    rows = B.split_rows(spark, sf_dir)
    features = B.fit_features(rows)
    table = features.transform(rows.filter("NOT is_test")).select("id", "label", "fold", "features", "nb_features")
    train = materialize(table, scratch_path(spark, "learned-features"), force=True)
    registry = ModelRegistry(spark, scratch_path(spark, "runs"))
    M.k_fold_runs(train, FOLD_MODELS[name], B.K_FOLDS, scratch_path(spark, "fold-predictions"), model_name=name, registry=registry)
    best = registry.best("f1", name).first()  # one row
    whole = PipelineModel([features, registry.load(best["path"])])
    path = registry.register(f"{name}_from_text", whole, {"f1": best["value"]}, best["fold"])
    test = M.predictions(registry.load(path), rows.filter("is_test"))
    met = E.binary_metrics(test)
    return met.select(F.lit(name).alias("model"), F.lit(best["fold"]).alias("best_fold"), F.lit(best["value"]).alias("fold_f1"), *met.columns)


def boosting_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E10 of an iterative learner: boosted trees fitted on every fold (from an
    exact bootstrap sample of its training rows, as in the comparison), and the
    metrics of every round on the validation rows: (fold, round, rows, loss,
    accuracy, precision, recall, f1)."""
    train = B.feature_table(spark, sf_dir).filter(~F.col("is_test"))

    def fit(row: dict) -> DataFrame:
        own = train.filter(F.col("fold") != row["fold"])
        sample = materialize(SP.bootstrap_sample(own, SAMPLE_ROWS, "id", B.SEED), scratch_path(spark, "boosting-sample"), force=True)
        model = M.gradient_boosting().fit(sample)
        return BO.round_log(model, train.filter(F.col("fold") == row["fold"])).withColumn("fold", F.lit(row["fold"]))

    planned = spark.range(1, B.K_FOLDS + 1).select(F.col("id").cast("int").alias("fold"))
    log = run_planned(planned, scratch_path(spark, "boosting-log"), ["fold"], fit, name="boosting")
    return log.select("fold", "round", "rows", "loss", "accuracy", "precision", "recall", "f1")


def boosting_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2 of an iterative learner: early stopping replayed on the boosting log."""
    return BO.stops(boosting_log(spark, sf_dir), ["fold"])


def fused_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, v, norm_scaled, mean_scaled): embedding with its two
    standard-scaled summary features (G10 inputs); target ``label % 2``."""
    e = C.table(spark, sf_dir, "embeddings").select(
        "vec_id", (F.col("label") % 2).cast("int").alias("label"),
        F.transform("embedding", lambda x: x.cast("double")).alias("v"),
    )
    e = e.select(
        "*",
        F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"),
        (F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")).alias("mean"),
    )
    stats = G.fit_standard_scaler(e, ["norm", "mean"])
    return G.apply_standard_scaler(e, stats, ["norm", "mean"])


def fusion_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: the jointly trained head over embedding and scaled numbers;
    test-split predictions."""
    e = fused_embeddings(spark, sf_dir)
    e = e.select("vec_id", "label", "v", F.array("norm_scaled", "mean_scaled").alias("f"))
    e = SP.stratified_split(e, "vec_id", "label", B.TEST_SIZE, B.SEED)
    e = materialize(e, scratch_path(spark, "fusion-features"), force=True)
    model = FusionHead(seed=B.SEED).fit(e.filter(~F.col("is_test")))
    return M.predictions(model, e.filter(F.col("is_test")), ("vec_id", "label"))


# Z1 fixed linear scorer: weight of embedding dimension i is ((7 * i) mod 11 - 5) / 10.
def scorer_weights(dim: int) -> list[float]:
    return [((7 * i) % 11 - 5) / 10.0 for i in range(dim)]


EMBEDDING_DIM = 64


def _linear_scorer(payload: bytes):
    import numpy as np

    w = np.frombuffer(payload, dtype="<f8")
    return lambda x: x @ w


def batch_scores(spark: SparkSession, sf_dir: str, batch_size: int = 64) -> DataFrame:
    """A caller's stored model, loaded once per Python worker, applied to
    Arrow batches of ``batch_size`` rows; logit, argmax label."""
    import numpy as np

    model = SharedModel(spark, np.array(scorer_weights(EMBEDDING_DIM), dtype="<f8").tobytes(), _linear_scorer)
    e = C.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")
    )
    s = score_batches(e, model, "v", EMBEDDING_DIM, batch_size).withColumnRenamed("score", "logit")
    return s.select("vec_id", F.round("logit", 6).alias("logit"), (F.col("logit") > 0).cast("int").alias("predicted_label"))
