"""E10 / W2 for an iterative learner: the log of a boosted fit.

A boosted model of ``n`` rounds holds the models of all earlier rounds: after
round ``i`` its margin is the weighted sum of the first ``i`` trees. So one fit and
one pass over the rows give the metrics of every round: each tree scores a row
once (a JVM expression), running sums give the row's margins, and an aggregate by
round gives the log. ``stopped`` fits with the validation rows marked, so that the
fit itself stops; its number of rounds is what replaying the log gives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusframe.operators.evaluation import _ratio, early_stopping


def staged_margins(model: GBTClassificationModel, df: DataFrame, out_col: str = "margins") -> DataFrame:
    """Add ``out_col``: the row's margin after each round."""
    out, trees = df, model.trees
    names = [f"_tree{i}" for i in range(len(trees))]
    for name, tree in zip(names, trees):
        out = tree.setFeaturesCol(model.getFeaturesCol()).setPredictionCol(name).transform(out)
    steps = out.withColumn("_steps", F.array(*[F.col(n) * F.lit(float(w)) for n, w in zip(names, model.treeWeights)])).drop(*names)
    none = F.array().cast("array<double>")
    sums = F.aggregate("_steps", none, lambda a, x: F.concat(a, F.array(x + F.coalesce(F.get(a, F.size(a) - 1), F.lit(0.0)))))
    return steps.withColumn(out_col, sums).drop("_steps")


def log_loss(label: Column, margin: Column) -> Column:
    """The loss that boosting reduces: ``2 ln(1 + exp(-2 y m))``, y in -1, 1."""
    z = -2.0 * (2.0 * label - 1.0) * margin
    return 2.0 * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))))


def round_log(model: GBTClassificationModel, df: DataFrame, group_cols: Sequence[str] = (), label_col: str = "label") -> DataFrame:
    """(groups..., round, rows, loss, accuracy, precision, recall, f1) of every
    round of ``model`` on ``df``."""
    each = staged_margins(model, df).select(*group_cols, F.col(label_col).cast("int").alias("y"), F.posexplode("margins").alias("at", "m"))
    p = (F.col("m") > 0).cast("int")
    of = lambda y, v: F.count_if((F.col("y") == y) & (p == v))
    per = each.groupBy(*group_cols, (F.col("at") + 1).alias("round")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(log_loss(F.col("y"), F.col("m"))).alias("loss"),
        of(1, 1).alias("tp"), of(0, 1).alias("fp"), of(1, 0).alias("fn"), of(0, 0).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return per.select(
        *group_cols, F.col("round").cast("int").alias("round"), "rows", "loss", _ratio(tp + tn, F.col("rows")).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def stopped(estimator: GBTClassifier, rows: DataFrame, held_col: str) -> GBTClassificationModel:
    """Fit on the rows where ``held_col`` is false; stop at the first round that
    is worse on the others than the best so far, and keep the best."""
    return estimator.copy({estimator.validationIndicatorCol: held_col, estimator.validationTol: 0.0}).fit(rows)


def stops(log: DataFrame, run_cols: Sequence[str]) -> DataFrame:
    """W2 on a ``round_log``: (runs..., rounds run, stop_round, best_round,
    best_loss), stopping at the first round whose loss is not a new least."""
    less = log.withColumn("gain", -F.col("loss"))
    st = early_stopping(less, run_cols, "round", "gain", patience=1)
    return st.select(*run_cols, F.col("epochs_run").alias("rounds_run"), F.col("stop_epoch").alias("stop_round"),
                     F.col("best_epoch").alias("best_round"), (-F.col("best_gain")).alias("best_loss"))
