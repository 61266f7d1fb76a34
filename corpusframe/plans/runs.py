"""Split -> cross-validate -> evaluate (section 3.2/3.3), on fitted models.

The runs are multinomial naive Bayes models over the reference's features (the
``base`` pipeline: TF-IDF of ``base.VOCAB_SIZE`` terms and two min-max scaled
numbers), one per smoothing value, fitted for every fold and epoch: epoch ``e``
of fold ``f`` has learned the training rows of the other folds whose hash falls
into the first ``e`` of ``EPOCHS`` parts. Fitting is adding up, so the whole
flow -- exact split, folds, per-epoch log, early stopping, best run, fold
summaries, test evaluation of the chosen run, model comparison -- has a SQL
oracle. ``boosting`` has the log of an iterative learner.

Feature sums are taken once per (feature, label, fold, part), a table whose size
depends on the parameters only; every run's weights are sums of its rows. One
pass gives every text the margins of all runs as an array, where it is: no row
per text and run, or text and feature, is ever written or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from corpusframe.functions import text as T
from corpusframe.operators import evaluation as E
from corpusframe.operators.splits import split_and_folds
from corpusframe.plans import base as B
from corpusframe.plans.base import K_FOLDS, SEED, TEST_SIZE
from corpusframe.plans.corpus import finalized, hash_unit
from corpusframe.session import scratch_path
from corpusframe.sources.files import materialize

PATIENCE = 2
EPOCHS = 5

#: (display name, additive smoothing of the feature sums).
MODELS = (("Naive Bayes 1.0", 1.0), ("Naive Bayes 0.01", 0.01))
#: The feature that every text has once; its weight is the log ratio of the classes.
PRIOR = -1
#: Entries that meet the weights at once: what a task holds beside its rows is
#: twice this (or a text's own entries, if more) times the runs, whatever a batch has.
ENTRIES_AT_ONCE = 1 << 15


def fold_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, link_count, email_length, is_test, fold) over the finalized corpus."""
    df = finalized(spark, sf_dir).select("id", "label", "link_count", "email_length")
    return split_and_folds(df, "id", "label", TEST_SIZE, K_FOLDS, SEED)


def run_rows(features: DataFrame) -> DataFrame:
    """A feature table -> (id, label, is_test, fold, part, x): ``x`` holds the
    entries of the feature vector and the constant ``PRIOR``."""
    one = F.array(F.struct(F.lit(PRIOR).alias("k"), F.lit(1.0).alias("v")))
    part = (hash_unit("id", "part", EPOCHS) + 1).cast("int")
    return features.select("id", "label", "is_test", "fold", part.alias("part"), F.concat(B.entries("nb_features"), one).alias("x"))


def _specs() -> list[tuple[str, float, int, int]]:
    """(model, smoothing, fold, epoch) in the order of the weight arrays."""
    return [(m, a, f, e) for m, a in MODELS for f in range(1, K_FOLDS + 1) for e in range(1, EPOCHS + 1)]


def spec_columns(at: Column) -> list[Column]:
    """model, fold, epoch of a place in the arrays."""
    names = F.array(*[F.lit(m) for m, _ in MODELS])
    return [
        F.element_at(names, (F.floor(at / (K_FOLDS * EPOCHS)) + 1).cast("int")).alias("model"),
        (F.floor(at / EPOCHS) % K_FOLDS + 1).cast("int").alias("fold"),
        (at % EPOCHS + 1).cast("int").alias("epoch"),
    ]


def weights(rows: DataFrame, width: int) -> np.ndarray:
    """For each of the ``width`` features (and last, ``PRIOR``) the log ratio of
    its probability in the two classes under every run: an array of
    ``width + 1`` by the number of runs."""
    each = rows.filter(~F.col("is_test")).select("label", "fold", "part", F.explode_outer("x").alias("e"))
    cube = each.groupBy("label", "fold", "part", F.col("e.k").alias("k")).agg(F.sum("e.v").alias("v"))
    t = cube.toArrow()  # at most 2 * K_FOLDS * EPOCHS * (width + 1) rows
    sums = np.zeros((2, K_FOLDS, EPOCHS, width + 1))
    at = [t.column(c).to_numpy() for c in ("label", "fold", "part", "k")]
    sums[at[0], at[1] - 1, at[2] - 1, at[3]] = t.column("v").to_numpy()  # PRIOR is the last one
    sums = sums.cumsum(axis=2)
    learned = sums.sum(axis=1, keepdims=True) - sums  # of the other folds
    out = []
    for _, a in MODELS:
        c, prior = learned[..., :-1], learned[..., -1:]
        p = np.log(c + a) - np.log(c.sum(axis=-1, keepdims=True) + a * width)
        ratio = np.concatenate([p[1] - p[0], np.log(prior[1] + 1.0) - np.log(prior[0] + 1.0)], axis=-1)
        out.append(ratio.reshape(K_FOLDS * EPOCHS, width + 1))
    return np.concatenate(out).T.copy()


def _margins(batches: Iterator[pa.RecordBatch], w: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = b.column("x")
        entries, ends = x.flatten(), x.value_lengths().to_numpy().cumsum(dtype=np.int64)
        k, v = entries.field("k").to_numpy(), entries.field("v").to_numpy()
        m, row, at = np.empty((len(x), w.shape[1])), 0, 0
        while row < len(x):  # texts in slices of few entries
            stop = max(row + 1, int(np.searchsorted(ends, at + ENTRIES_AT_ONCE, "right")))
            parts = w[k[at : ends[stop - 1]]]
            parts *= v[at : ends[stop - 1], None]
            starts = np.append(at, ends[row : stop - 1]) - at
            m[row:stop] = np.add.reduceat(parts, starts, axis=0)  # no row is without an entry
            row, at = stop, ends[stop - 1]
        offsets = pa.array(np.arange(0, m.size + 1, w.shape[1]), pa.int32())
        columns = [b.column(i) for i in range(b.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(m.ravel()))], [*b.schema.names[:-1], "m"])


def margins(rows: DataFrame, w: np.ndarray) -> DataFrame:
    """(id, label, is_test, own_fold, part, m): ``m`` holds the text's log odds
    of class 1 under every run: its entries times the weights, in Arrow batches
    where the rows are; stored."""
    rows = rows.select("id", "label", "is_test", F.col("fold").alias("own_fold"), "part", "x")
    schema = StructType([*rows.schema.fields[:-1], StructField("m", ArrayType(DoubleType()))])
    return materialize(rows.mapInArrow(partial(_margins, w=w), schema), scratch_path(rows.sparkSession, "run-margins"), force=True)


def run_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``margins`` of every text of the feature base."""
    features = B.feature_table(spark, sf_dir)
    width = features.select(F.unwrap_udt("nb_features").alias("u")).agg(F.max(F.coalesce("u.size", F.size("u.values")))).first()[0] or 0
    rows = run_rows(features)
    return margins(rows, weights(rows, width))


def probability(margin: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-margin))


def _log(scores: DataFrame) -> DataFrame:
    """One row per run with its losses and counts: an aggregate over the arrays."""
    own = scores.filter(~F.col("is_test")).select("label", "own_fold", "part", F.posexplode("m").alias("at", "margin"))
    _, fold, epoch = spec_columns(F.col("at"))
    score = probability(F.col("margin"))
    s = F.least(F.greatest(score, F.lit(1e-7)), F.lit(1 - 1e-7))
    own = own.select(
        "at", "label", (-(F.col("label") * F.log(s) + (1 - F.col("label")) * F.log(1 - s))).alias("loss"), (score > 0.5).cast("int").alias("p"),
        (F.col("own_fold") == fold).alias("held"), ((F.col("own_fold") != fold) & (F.col("part") <= epoch)).alias("seen"),
    )
    of = lambda y, p: F.count_if(F.col("held") & (F.col("label") == y) & (F.col("p") == p))
    per = own.groupBy("at").agg(
        F.avg(F.when(F.col("held"), F.col("loss"))).alias("eval_loss"), F.avg(F.when(F.col("seen"), F.col("loss"))).alias("train_loss"),
        of(1, 1).alias("tp"), of(0, 1).alias("fp"), of(1, 0).alias("fn"), of(0, 0).alias("tn"),
    )
    per = per.select(*spec_columns(F.col("at")), "eval_loss", "train_loss", "tp", "fp", "fn", "tn")
    per = materialize(per.coalesce(1), scratch_path(scores.sparkSession, "run-log"), force=True)  # one row a run
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    eval_rows = per.select(
        "model", "fold", "epoch", F.lit("eval").alias("kind"), F.col("eval_loss").alias("loss"),
        E._ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        E._ratio(tp, tp + fp).alias("precision"),
        E._ratio(tp, tp + fn).alias("recall"),
        E._ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )
    null = F.lit(None).cast("double")
    train_rows = per.select(
        "model", "fold", "epoch", F.lit("train").alias("kind"), F.col("train_loss").alias("loss"),
        null.alias("accuracy"), null.alias("precision"), null.alias("recall"), null.alias("f1"),
    )
    return eval_rows.unionByName(train_rows)


def epoch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training log: per (model, fold, epoch) an ``eval`` row with the metrics
    on the fold's validation rows and a ``train`` row with the mean loss on
    the rows learned so far (metrics null)."""
    return _log(run_scores(spark, sf_dir))


def eval_log(spark: SparkSession, sf_dir: str, scores: DataFrame | None = None) -> DataFrame:
    """Log entries having both an F1 and an epoch (runs x folds x epochs
    rows)."""
    log = _log(run_scores(spark, sf_dir) if scores is None else scores)
    return log.filter(F.col("f1").isNotNull() & F.col("epoch").isNotNull()).select(
        "model", "fold", "epoch", "f1", "accuracy", "precision", "recall"
    )


def stopping(log: DataFrame) -> DataFrame:
    """W2 per (model, fold) of an ``eval_log``."""
    return E.early_stopping(log, ["model", "fold"], "epoch", "f1", PATIENCE)


def epochs_run(log: DataFrame) -> DataFrame:
    """The log as early stopping leaves it: no epoch after the stop."""
    st = stopping(log).select("model", "fold", "stop_epoch")
    return log.join(st, ["model", "fold"]).filter(F.col("stop_epoch").isNull() | (F.col("epoch") <= F.col("stop_epoch"))).drop("stop_epoch")


def fold_results(log: DataFrame) -> DataFrame:
    """Per (model, fold): the metrics of the best epoch among those run."""
    st = stopping(log).select("model", "fold", F.col("best_epoch").alias("epoch"))
    return log.join(st, ["model", "fold", "epoch"])


def best_run(log: DataFrame) -> DataFrame:
    """Per model, the (fold, epoch) with the highest F1 among the
    epochs run (first fold and epoch on ties)."""
    return E.best_row(epochs_run(log), ["model"], "f1", ["fold", "epoch"])


def best_run_test_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score the test split with each model's selected run."""
    scores = run_scores(spark, sf_dir)
    chosen = best_run(eval_log(spark, sf_dir, scores)).select("model", "best_fold", "best_epoch")
    test = scores.filter("is_test").select("label", F.posexplode("m").alias("at", "margin"))
    model, fold, epoch = spec_columns(F.col("at"))
    test = test.select("label", (probability(F.col("margin")) > 0.5).cast("int").alias("predicted_label"), model, fold.alias("best_fold"), epoch.alias("best_epoch"))
    rows = test.join(F.broadcast(chosen), ["model", "best_fold", "best_epoch"])  # one row per model
    return E.binary_metrics(rows, group_cols=["model", "best_fold", "best_epoch"])


def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E12 + O2: one row per model (normalised name), F1 rank."""
    m = best_run_test_metrics(spark, sf_dir)
    w = Window.orderBy(F.col("f1").desc(), F.col("model"))  # one row per model
    return m.select(T.normalise_name("model").alias("name"), "accuracy", "f1", F.row_number().over(w).cast("bigint").alias("position"))
