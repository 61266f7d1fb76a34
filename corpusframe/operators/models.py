"""Model fitting on Spark ML (M1-M5, M7, M8; M6 is ``fusion``) and scoring.

Estimators carry the reference's settings mapped to Spark ML parameters.
Fitting and scoring are distributed (Spark ML aggregates gradients, split
statistics and class counts per partition); the driver only plans
folds and grid configurations (``search``), it never loops over rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LinearSVCModel,
    LogisticRegression,
    LogisticRegressionModel,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusframe.operators.kernel import RandomFourierFeatures
from corpusframe.operators.search import WORKERS, run_planned
from corpusframe.operators.splits import stratified_kfold
from corpusframe.session import scratch_path
from corpusframe.sources.files import materialize
from corpusframe.sources.registry import ModelRegistry

SEED = 42


def naive_bayes(features="features", label="label") -> Estimator:
    """M1: multinomial, smoothing 1 (features must be non-negative)."""
    return NaiveBayes(modelType="multinomial", smoothing=1.0, featuresCol=features, labelCol=label)


def logistic_regression(
    n_train: int, c: float = 1.0, max_iter: int = 1000, tol: float = 1e-4, features="features", label="label"
) -> Estimator:
    """M2: L2 with inverse strength ``c`` over ``n_train`` rows (sum-loss
    objective rescaled to Spark's mean-loss one), no standardisation; the
    library's default tolerance 1e-4."""
    return LogisticRegression(
        maxIter=max_iter, tol=tol, regParam=1.0 / (c * max(n_train, 1)), elasticNetParam=0.0,
        standardization=False, featuresCol=features, labelCol=label,
    )


def random_forest(features="features", label="label") -> Estimator:
    """M4: 50 trees of depth 10."""
    return RandomForestClassifier(numTrees=50, maxDepth=10, seed=SEED, featuresCol=features, labelCol=label)


def gradient_boosting(features="features", label="label") -> Estimator:
    """M5: 50 rounds of depth 4, row and column subsampling 0.8."""
    return GBTClassifier(
        maxIter=50, maxDepth=4, subsamplingRate=0.8, featureSubsetStrategy="0.8", stepSize=0.3,
        seed=SEED, featuresCol=features, labelCol=label,
    )


def positive_probability(prob_col: str = "probability") -> Column:
    return vector_to_array(F.col(prob_col))[1]


def without_summary(model: Model, df: DataFrame) -> Model:
    """The model as it is once stored and loaded. A model that was just fitted
    keeps a training summary, which holds the session; in a session that has ever
    used an ``Observation`` such a model cannot be sent to tasks."""
    if not getattr(model, "hasSummary", False):
        return model
    path = scratch_path(df.sparkSession, "fitted-model")
    model.write().save(path)
    return type(model).load(path)


class _SvmParams(HasFeaturesCol, HasLabelCol, HasSeed):
    k = Param(Params._dummy(), "k", "calibration folds", TypeConverters.toInt)
    reg = Param(Params._dummy(), "reg", "L2 strength of the SVM", TypeConverters.toFloat)
    idCol = Param(Params._dummy(), "idCol", "column that deals rows to folds", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(k=3, reg=0.0, idCol="id", seed=SEED, featuresCol="features", labelCol="label")


def _margin(svm: Model, df: DataFrame) -> DataFrame:
    scored = svm.transform(df).withColumn("_margin", vector_to_array("rawPrediction")[1])
    return scored.withColumn("_m", array_to_vector(F.array("_margin"))).drop("rawPrediction", "prediction")


class CalibratedSVM(Estimator, _SvmParams, DefaultParamsReadable, DefaultParamsWritable):
    """M3: SVM with sigmoid calibration on ``k`` folds: per fold an SVM fitted
    on the other folds and a one-feature logistic regression on its held-out
    margins; predictions average the fold probabilities. Linear in its features:
    ``rbf_svm`` puts the kernel before it."""

    @keyword_only
    def __init__(self, *, k=3, reg=0.0, featuresCol="features", labelCol="label", idCol="id"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> CalibratedSVMModel:
        """Folds are stratified (X2); the id column's rows are joined to their folds
        and stored, so that features are made once, not in every pass of every fit.
        Rows that share an id and a label are in one fold."""
        of, label, features = self.getOrDefault, self.getLabelCol(), self.getFeaturesCol()
        keys = [of(self.idCol), label]
        folds = stratified_kfold(df.select(*keys).distinct(), *keys, of(self.k), of(self.seed))
        d = materialize(df.select(*keys, features).join(folds, keys), scratch_path(df.sparkSession, "svm-folds"), force=True)
        pairs = []
        for i in range(1, of(self.k) + 1):
            svm = LinearSVC(regParam=of(self.reg), featuresCol=features, labelCol=label).fit(d.filter(F.col("fold") != i))
            svm = without_summary(svm, df)
            held = _margin(svm, d.filter(F.col("fold") == i))
            sigmoid = LogisticRegression(featuresCol="_m", labelCol=label, maxIter=100).fit(held)
            pairs.append((svm, without_summary(sigmoid, df)))
        return self._copyValues(CalibratedSVMModel(pairs))


class CalibratedSVMModel(Model, _SvmParams, MLReadable, MLWritable):
    def __init__(self, pairs: Sequence[tuple[Model, Model]] = ()):
        super().__init__()
        self.pairs = list(pairs)

    def _transform(self, df: DataFrame) -> DataFrame:
        """Adds ``score`` (mean calibrated probability) and ``prediction``."""
        probs = []
        out = df
        for i, (svm, cal) in enumerate(self.pairs):
            s = cal.transform(_margin(svm, out)).withColumn(f"_p{i}", positive_probability())
            out = s.drop("_margin", "_m", "rawPrediction", "probability", "prediction")
            probs.append(F.col(f"_p{i}"))
        score = sum(probs[1:], probs[0]) / F.lit(len(probs))
        out = out.withColumn("score", score).withColumn("prediction", (F.col("score") > 0.5).cast("double"))
        return out.drop(*[f"_p{i}" for i in range(len(probs))])

    def write(self) -> MLWriter:
        return _SvmWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _SvmReader(cls)


class _SvmWriter(MLWriter):
    def __init__(self, instance: CalibratedSVMModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        for i, (svm, cal) in enumerate(self.instance.pairs):
            svm.write().save(f"{path}/svm-{i}")
            cal.write().save(f"{path}/sigmoid-{i}")


class _SvmReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> CalibratedSVMModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        for i in range(model.getOrDefault(model.k)):
            model.pairs.append((LinearSVCModel.load(f"{path}/svm-{i}"), LogisticRegressionModel.load(f"{path}/sigmoid-{i}")))
        return model


def rbf_svm(width: int = 512, id_col: str = "id", features="features", label="label", reg: float = 0.0) -> Pipeline:
    """M3 with the reference's kernel: random Fourier features of an RBF kernel
    (gamma from the training variance), then the calibrated SVM."""
    kernel = RandomFourierFeatures(inputCol=features, outputCol="fourier", width=width, seed=SEED)
    return Pipeline(stages=[kernel, CalibratedSVM(featuresCol="fourier", labelCol=label, idCol=id_col, reg=reg)])


def predictions(model, df: DataFrame, keep: Sequence[str] = ("id", "label")) -> DataFrame:
    """``(keep..., predicted_label, score)`` from a fitted model."""
    out = without_summary(model, df).transform(df)
    score = F.col("score") if "score" in out.columns else positive_probability()
    return out.select(*keep, F.col("prediction").cast("int").alias("predicted_label"), score.alias("score"))


def timed(df: DataFrame) -> float:
    """Seconds to produce every row of ``df`` (``noop`` sink: nothing is
    collected)."""
    t0 = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def grid_search(
    train: DataFrame,
    make_estimator: Callable[[dict], Estimator],
    grid: Sequence[dict],
    path: str,
    fold_col: str = "fold",
    k: int = 5,
    workers: int = WORKERS,
    keep: Sequence[str] = ("id", "label"),
) -> DataFrame:
    """M7 (+ S5, S6): every configuration of ``grid`` on every fold (``fold_col``
    1..k), fitted on the other folds; validation predictions stored per (config,
    fold) at ``path``. Returns (config, mean_auc, std_auc)."""
    from corpusframe.operators.evaluation import roc_auc

    spark = train.sparkSession
    planned = spark.range(len(grid)).select(F.col("id").cast("int").alias("config")).crossJoin(
        spark.range(1, k + 1).select(F.col("id").cast("int").alias("cv_fold"))
    )

    def fit(row: dict) -> DataFrame:
        model = make_estimator(grid[row["config"]]).fit(train.filter(F.col(fold_col) != row["cv_fold"]))
        scored = predictions(model, train.filter(F.col(fold_col) == row["cv_fold"]), keep)
        return scored.withColumn("config", F.lit(row["config"])).withColumn("cv_fold", F.lit(row["cv_fold"]))

    found = run_planned(planned, path, ["config", "cv_fold"], fit, workers, "grid search")
    auc = roc_auc(found, group_cols=["config", "cv_fold"])
    return auc.groupBy("config").agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"))


def k_fold_runs(
    train: DataFrame,
    make_estimator: Callable[[DataFrame], Estimator],
    k: int,
    predictions_path: str,
    fold_col: str = "fold",
    keep: Sequence[str] = ("id", "label"),
    model_name: str = "model",
    registry: ModelRegistry | None = None,
    workers: int = WORKERS,
) -> DataFrame:
    """M8 (+ S5, S6): for each fold without stored predictions, fit on the
    other folds and write validation predictions to the table at
    ``predictions_path`` partitioned by (model, fold); returns that table. With a
    registry every fold's model is stored, with its validation metrics."""
    from corpusframe.operators.evaluation import binary_metrics

    spark = train.sparkSession
    planned = spark.range(1, k + 1).select(F.lit(model_name).alias("model"), F.col("id").cast("int").alias(fold_col))

    def fit(row: dict) -> DataFrame:
        i = row[fold_col]
        tr, va = train.filter(F.col(fold_col) != i), train.filter(F.col(fold_col) == i)
        model = make_estimator(tr).fit(tr)
        scored = predictions(model, va, keep).withColumn("model", F.lit(model_name)).withColumn(fold_col, F.lit(i))
        if registry is not None:
            registry.register(model_name, model, binary_metrics(scored).first().asDict(), fold=i)
        return scored

    return run_planned(planned, predictions_path, ["model", fold_col], fit, workers, "folds").filter(F.col("model") == model_name)
