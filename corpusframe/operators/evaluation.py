"""Evaluation operators (E1-E8, E12, E13) and metric-table operators
(A11, A12, W1, W2, E10, E11).

Binary metrics are conditional counts in one aggregate. ROC and AUC first
collapse the predictions to one row per distinct score (partial aggregation,
so a score shared by a third of the rows costs one row per map task), then
take exact running sums over the scores with ``prefix_sums`` -- no
single-task window over the predictions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.operators.ranking import prefix_sums
from corpusframe.session import scratch_path
from corpusframe.sources.files import materialize


def _ratio(num, den):
    """num / den, 0 when den is 0 (the zero-division convention)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def confusion_counts(df: DataFrame, label_col="label", pred_col="predicted_label", group_cols: Sequence[str] = ()) -> DataFrame:
    y, p = F.col(label_col), F.col(pred_col)
    return df.groupBy(*group_cols).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    )


def binary_metrics(df: DataFrame, label_col="label", pred_col="predicted_label", group_cols: Sequence[str] = ()) -> DataFrame:
    """E1 + E2: accuracy, and precision/recall/F1 of class 1 (0 on zero division)."""
    c = confusion_counts(df, label_col, pred_col, group_cols)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        *group_cols,
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        (tp + fn).alias("support"),
    )


def confusion_matrix(df: DataFrame, label_col="label", pred_col="predicted_label", classes=(0, 1)) -> DataFrame:
    """E6 + E7: zero-filled matrix in long form with the row-normalised rate."""
    counts = df.groupBy(F.col(label_col).alias("true_label"), F.col(pred_col).alias("predicted_label")).agg(
        F.count(F.lit(1)).alias("n")
    )
    spark = df.sparkSession
    grid = spark.createDataFrame([(int(a), int(b)) for a in classes for b in classes], "true_label int, predicted_label int")
    m = grid.join(counts, ["true_label", "predicted_label"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    row_total = F.sum("n").over(Window.partitionBy("true_label"))  # classes x classes rows
    return m.withColumn("rate", F.when(row_total == 0, F.lit(float("nan"))).otherwise(F.col("n") / row_total))


def classification_report(df: DataFrame, label_col="label", pred_col="predicted_label", digits: int = 4, group_cols: Sequence[str] = ()) -> DataFrame:
    """Per class precision/recall/F1/support, then accuracy, macro and
    weighted averages, rounded to ``digits``; for each group if given."""
    g = list(group_cols)
    # One pass: counts per (label, prediction), each of which counts once for the
    # support of its label and once for the predictions of its prediction.
    conf = df.groupBy(*g, F.col(label_col).alias("y"), F.col(pred_col).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    both = F.array(
        F.struct(F.col("y").alias("cls"), F.col("n").alias("support"), zero.alias("predicted"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(zero).alias("tp")),
        F.struct(F.col("p").alias("cls"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp")),
    )
    each = conf.select(*g, F.explode(both).alias("e")).select(*g, "e.*")
    per = each.groupBy(*g, "cls").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    per = per.select(
        *g,
        F.col("cls").cast("string").alias("row_name"),
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1_score"),
        F.col("support").cast("bigint").alias("support"),
        F.col("tp"),
    )
    per = materialize(per.coalesce(1), scratch_path(df.sparkSession, "class-report"), force=True)  # one row per class
    mean = lambda c: F.avg(c).alias(f"m_{c}")
    weighted = lambda c: F.sum(F.col(c) * F.col("support")).alias(f"w_{c}")
    columns = ("precision", "recall", "f1_score")
    total = per.groupBy(*g).agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"), *[mean(c) for c in columns], *[weighted(c) for c in columns])
    total = total.filter(F.col("n").isNotNull())
    n, none = F.col("n"), F.lit(None).cast("double")
    row = lambda name, p, r, f: F.struct(F.lit(name).alias("row_name"), p.alias("precision"), r.alias("recall"), f.alias("f1_score"))
    rows = F.array(
        row("accuracy", none, none, _ratio(F.col("tp"), n)),
        row("macro avg", *[F.col(f"m_{c}") for c in columns]),
        row("weighted avg", *[_ratio(F.col(f"w_{c}"), n) for c in columns]),
    )
    averages = total.select(*g, F.explode(rows).alias("e"), n.cast("bigint").alias("support")).select(*g, "e.*", "support")
    out = per.drop("tp").unionByName(averages)
    return out.select(
        *g,
        "row_name",
        F.round("precision", digits).alias("precision"),
        F.round("recall", digits).alias("recall"),
        F.round("f1_score", digits).alias("f1_score"),
        "support",
    )


def score_table(df: DataFrame, label_col="label", score_col="score", group_cols: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score (of a group): positives and negatives at
    that score. Written once under the shared checkpoint folder, as the running
    sums read it several times."""
    table = df.groupBy(*group_cols, F.col(score_col).alias("threshold")).agg(
        F.count_if(F.col(label_col) == 1).alias("pos"), F.count_if(F.col(label_col) != 1).alias("neg")
    )
    return materialize(table, scratch_path(df.sparkSession, "score-table"), force=True)


def _with_totals(rows: DataFrame, table: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    totals = table.groupBy(*group_cols).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return rows.join(totals, list(group_cols)) if group_cols else rows.crossJoin(F.broadcast(totals))  # one row


def roc_curve(df: DataFrame, label_col="label", score_col="score", group_cols: Sequence[str] = ()) -> DataFrame:
    """(groups..., threshold, fpr, tpr) at every distinct score, highest
    first, plus the starting point (+inf, 0, 0). NaN rates when a class is
    absent."""
    st = score_table(df, label_col, score_col, group_cols)
    cum = prefix_sums(st, "threshold", ["pos", "neg"], descending=True, group_cols=group_cols)
    pts = _with_totals(cum, st, group_cols)
    nan = F.lit(float("nan"))
    pts = pts.select(
        *group_cols,
        F.col("threshold").cast("double").alias("threshold"),
        F.when(F.col("N") == 0, nan).otherwise(F.col("neg_cum") / F.col("N")).alias("fpr"),
        F.when(F.col("P") == 0, nan).otherwise(F.col("pos_cum") / F.col("P")).alias("tpr"),
        F.when(F.col("N") == 0, nan).otherwise((F.col("neg_cum") - F.col("neg")) / F.col("N")).alias("fpr_prev"),
        F.when(F.col("P") == 0, nan).otherwise((F.col("pos_cum") - F.col("pos")) / F.col("P")).alias("tpr_prev"),
    )
    totals = st.groupBy(*group_cols).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    start = totals.select(
        *group_cols,
        F.lit(float("inf")).alias("threshold"),
        F.when(F.col("N") == 0, nan).otherwise(F.lit(0.0)).alias("fpr"),
        F.when(F.col("P") == 0, nan).otherwise(F.lit(0.0)).alias("tpr"),
        F.lit(None).cast("double").alias("fpr_prev"),
        F.lit(None).cast("double").alias("tpr_prev"),
    )
    return pts.unionByName(start)


def trapezoid_auc(points: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """E5: area under (fpr, tpr) points carrying their predecessor."""
    seg = (F.col("fpr") - F.col("fpr_prev")) * (F.col("tpr") + F.col("tpr_prev")) / 2
    return points.groupBy(*group_cols).agg(F.sum(seg).alias("auc"))


def roc_auc(df: DataFrame, label_col="label", score_col="score", group_cols: Sequence[str] = ()) -> DataFrame:
    """Exact ROC AUC (per group) by rank sum with ties counted half; NaN
    when only one class is present."""
    st = score_table(df, label_col, score_col, group_cols)
    cum = prefix_sums(st, "threshold", ["neg"], descending=False, group_cols=group_cols)
    below = F.col("neg_cum").cast("double") - 0.5 * F.col("neg")
    part = cum.groupBy(*group_cols).agg(
        F.sum(F.col("pos") * below).alias("s"),
        F.sum("pos").cast("double").alias("P"),
        F.sum("neg").cast("double").alias("N"),
    )
    return part.select(
        *group_cols,
        F.when((F.col("P") == 0) | (F.col("N") == 0) | F.col("P").isNull(), F.lit(float("nan")))
        .otherwise(F.col("s") / (F.col("P") * F.col("N")))
        .alias("auc"),
    )


# --------------------------------------------------------------------------
# Metric tables over runs (folds x epochs) -- small tables by nature
# --------------------------------------------------------------------------

def fold_summary(metrics: DataFrame, run_cols: Sequence[str], value_cols: Sequence[str]) -> DataFrame:
    """Mean and population std over folds."""
    aggs = []
    for v in value_cols:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_std")]
    return metrics.groupBy(*run_cols).agg(F.count(F.lit(1)).alias("folds"), *aggs)


def best_row(metrics: DataFrame, run_cols: Sequence[str], metric: str, order_cols: Sequence[str]) -> DataFrame:
    """Per run, the row with the highest ``metric``; on ties the first
    in ``order_cols`` order."""
    key = F.struct(F.col(metric), *[(-F.col(c)).alias(c) for c in order_cols])
    best = metrics.groupBy(*run_cols).agg(F.max_by(F.struct(*order_cols, metric), key).alias("_b"))
    return best.select(*run_cols, *[F.col(f"_b.{c}").alias(f"best_{c}") for c in order_cols], F.col(f"_b.{metric}").alias(f"best_{metric}"))


def running_best(metrics: DataFrame, run_cols: Sequence[str], order_col: str, metric: str, initial: float = 0.0) -> DataFrame:
    """Flag rows whose ``metric`` strictly beats ``initial`` and every
    earlier row of the run."""
    w = Window.partitionBy(*run_cols).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    prior = F.greatest(F.coalesce(F.max(metric).over(w), F.lit(initial)), F.lit(initial))
    return metrics.withColumn("best_before", prior).withColumn("is_new_best", F.col(metric) > F.col("best_before"))


def early_stopping(metrics: DataFrame, run_cols: Sequence[str], epoch_col: str, metric: str, patience: int = 2) -> DataFrame:
    """Per run, replay early stopping -- an epoch improves when its metric
    is strictly above every earlier one; training stops at the epoch where
    ``patience`` epochs in a row did not improve. Returns per run the epochs
    run, the stop epoch (null if never stopped) and the best epoch/metric."""
    w_prev = Window.partitionBy(*run_cols).orderBy(epoch_col).rowsBetween(Window.unboundedPreceding, -1)
    w_run = Window.partitionBy(*run_cols).orderBy(epoch_col).rowsBetween(Window.unboundedPreceding, 0)
    m = metrics.withColumn("_prev_best", F.max(metric).over(w_prev))
    m = m.withColumn("_improved", F.col("_prev_best").isNull() | (F.col(metric) > F.col("_prev_best")))
    m = m.withColumn("_streak_id", F.sum(F.col("_improved").cast("int")).over(w_run))
    w_streak = Window.partitionBy(*run_cols, "_streak_id").orderBy(epoch_col)
    m = m.withColumn("_misses", F.row_number().over(w_streak) - 1)
    stop = m.filter(F.col("_misses") >= patience).groupBy(*run_cols).agg(F.min(epoch_col).alias("stop_epoch"))
    ran = m.join(stop, list(run_cols), "left").filter(
        F.col("stop_epoch").isNull() | (F.col(epoch_col) <= F.col("stop_epoch"))
    )
    key = F.struct(F.col(metric), (-F.col(epoch_col)).alias("e"))
    return ran.groupBy(*run_cols).agg(
        F.count(F.lit(1)).alias("epochs_run"),
        F.max("stop_epoch").alias("stop_epoch"),
        F.max_by(F.col(epoch_col), key).alias("best_epoch"),
        F.max(metric).alias(f"best_{metric}"),
    )


def unpivot_metrics(df: DataFrame, id_cols: Sequence[str], value_cols: Sequence[str]) -> DataFrame:
    """Wide metrics to (id..., metric, score)."""
    return df.unpivot(list(id_cols), list(value_cols), "metric", "score")
