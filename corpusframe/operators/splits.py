"""Exact, deterministic stratified splits.

Membership is decided by an exact rank of ``md5('<seed>:<id>')`` inside each
class, so it is independent of partitioning and reproducible in SQL. Sizes
follow the stratified-split library convention: ``n_test = ceil(f * n)``; the
``n - n_test`` training rows are shared among classes by largest remainder
(ties: smaller label first) and each class's test quota is what is left.
k-fold numbers the sorted training rows round-robin, class after class, so
fold sizes differ by at most one overall and within each class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.operators.ranking import hash_rank


def hash_key(id_col: str, seed: int | str) -> F.Column:
    """Deterministic pseudo-random order key of a row."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def hex_to_long(c: F.Column, digits: int = 15) -> F.Column:
    """First ``digits`` hex digits of a hash as a non-negative bigint."""
    return F.conv(F.substring(c, 1, digits), 16, 10).cast("bigint")


def class_quotas(df: DataFrame, label_col: str, test_size: float) -> DataFrame:
    """One row per class: ``n_class, n_train, n_test, train_before`` where
    ``train_before`` counts training rows of the smaller labels."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_class"))
    everything = Window.partitionBy()  # one row per class: bounded
    q = counts.withColumn("n_all", F.sum("n_class").over(everything))
    q = q.withColumn("n_train_all", F.col("n_all") - F.ceil(F.lit(float(test_size)) * F.col("n_all")))
    cont = (F.col("n_class") / F.col("n_all")) * F.col("n_train_all")
    q = q.withColumn("_floor", F.floor(cont)).withColumn("_rem", cont - F.floor(cont))
    q = q.withColumn("_need", F.col("n_train_all") - F.sum("_floor").over(everything))
    order = Window.orderBy(F.col("_rem").desc(), F.col(label_col).asc())
    q = q.withColumn("n_train", (F.col("_floor") + (F.row_number().over(order) <= F.col("_need")).cast("long")).cast("long"))
    q = q.withColumn("n_test", F.col("n_class") - F.col("n_train"))
    prior = Window.orderBy(label_col).rowsBetween(Window.unboundedPreceding, -1)
    q = q.withColumn("train_before", F.coalesce(F.sum("n_train").over(prior), F.lit(0)).cast("long"))
    return q.select(label_col, "n_class", "n_train", "n_test", "train_before")


def split_and_folds(
    df: DataFrame,
    id_col: str = "id",
    label_col: str = "label",
    test_size: float = 0.2,
    k: int = 5,
    seed: int = 42,
) -> DataFrame:
    """X1 + X2 in one ranking pass: adds ``is_test`` (boolean) and ``fold``
    (1..k for training rows, null for test rows). Only (id, label) are ranked;
    other columns join back by id, which must be unique."""
    narrow = df.select(id_col, label_col)
    ranked = hash_rank(narrow.withColumn("_h", hash_key(id_col, seed)), [label_col], "_h", id_col, "_rank")
    quotas = class_quotas(narrow, label_col, test_size).select(label_col, "n_test", "train_before")
    out = ranked.join(F.broadcast(quotas), label_col)  # one row per class
    is_test = F.col("_rank") < F.col("n_test")
    train_pos = F.col("train_before") + F.col("_rank") - F.col("n_test")
    flags = out.select(
        id_col, label_col, is_test.alias("is_test"), F.when(~is_test, (F.pmod(train_pos, F.lit(k)) + 1).cast("int")).alias("fold")
    )
    if set(df.columns) == {id_col, label_col}:
        return flags
    return df.join(flags.drop(label_col), id_col)


def stratified_split(df: DataFrame, id_col="id", label_col="label", test_size=0.2, seed=42) -> DataFrame:
    """Adds ``is_test``."""
    return split_and_folds(df, id_col, label_col, test_size, 1, seed).drop("fold")


def stratified_kfold(df: DataFrame, id_col="id", label_col="label", k=5, seed=42) -> DataFrame:
    """Adds ``fold`` (1..k) over all rows of ``df``."""
    return split_and_folds(df, id_col, label_col, 0.0, k, seed).drop("is_test")


def fold_view(df: DataFrame, fold: int, role: str, fold_col: str = "fold") -> DataFrame:
    """Training rows (``fold != i``) or validation rows (``fold == i``); lazy."""
    if role == "train":
        return df.filter(F.col(fold_col) != fold)
    return df.filter(F.col(fold_col) == fold)


def fold_views(df: DataFrame, k: int, fold_col: str = "fold") -> DataFrame:
    """X4 as a table: every row once per fold, with ``view`` (1..k) and ``role``
    (``validation`` where the row's own fold is the view, else ``train``)."""
    views = df.withColumn("view", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return views.withColumn("role", F.when(F.col(fold_col) == F.col("view"), F.lit("validation")).otherwise(F.lit("train")))


def bootstrap_sample(df: DataFrame, n: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Exactly ``n`` draws with replacement. Draw ``i`` takes the row of
    global hash rank ``hash(seed, i) mod N``; adds ``draw``. Only ids are
    ranked; the drawn rows join back by id, which must be unique."""
    ids = df.select(id_col)
    ranked = hash_rank(ids.withColumn("_h", hash_key(id_col, seed)), [], "_h", id_col, "_rank").drop("_h")
    total = ids.agg(F.count(F.lit(1)).alias("_n"))  # one row
    draws = (
        df.sparkSession.range(n)
        .withColumnRenamed("id", "draw")
        .crossJoin(F.broadcast(total))
        .withColumn(
            "_rank",
            F.pmod(hex_to_long(F.md5(F.concat(F.lit(f"{seed}:draw:"), F.col("draw").cast("string")))), F.col("_n")),
        )
        .drop("_n")
    )
    return df.join(draws.join(ranked, "_rank").drop("_rank"), id_col)
