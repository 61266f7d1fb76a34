"""Profiling and data-quality operators.

Each is an aggregate with partial aggregation (quantiles take a few small ones
more); results are small DataFrames, nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from corpusframe.operators.ranking import bucket_of, value_bounds
from corpusframe.session import scratch_path
from corpusframe.sources.files import materialize

DESCRIBE_QUANTILES = (0.25, 0.5, 0.75)


def describe(df: DataFrame, value_cols: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """A4/A5: count, mean, sample std, min, 25/50/75 % (linear interpolation)
    and max of each value column, per group, in long form (``measure``).

    Rows are counted per distinct value once, and stored; ``df`` is read once. The
    values of a group are cut into buckets of like size (``ranking.value_bounds``);
    the buckets' totals show in which bucket a quantile lies, and only those
    buckets are sorted, so no task holds a group's values.
    """
    group_cols = list(group_cols)
    key = lambda c: F.struct(*group_cols, F.lit(c).alias("measure"))  # noqa: E731  a struct: null groups are equal
    stacked = df.select(
        F.explode(F.array(*[F.struct(key(c).alias("g"), F.col(c).cast("double").alias("v")) for c in value_cols])).alias("_m")
    ).select("_m.*")
    spark = df.sparkSession
    counts = materialize(stacked.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c")), scratch_path(spark, "describe-counts"), force=True)
    known = counts.filter(F.col("v").isNotNull())
    plain = counts.groupBy("g").agg(
        F.sum(F.when(F.col("v").isNotNull(), F.col("c")).otherwise(0)).alias("count"),
        F.sum(F.col("v") * F.col("c")).alias("sum"), F.min("v").alias("min"), F.max("v").alias("max"),
    )
    stats = plain.join(value_bounds(known, "v", ["g"]), "g", "left").withColumn("mean", F.when(F.col("count") > 0, F.col("sum") / F.col("count")))
    stats = materialize(stats, scratch_path(spark, "describe-stats"), force=True)  # one row per group
    placed = known.join(stats.select("g", "_bounds", "mean"), "g")
    placed = placed.select("g", "v", "c", bucket_of(F.col("v"), F.col("_bounds")).alias("b"), (F.col("c") * (F.col("v") - F.col("mean")) ** 2).alias("dev"))
    upto = Window.partitionBy("g").orderBy("b")
    totals = placed.groupBy("g", "b").agg(F.sum("c").alias("n"), F.sum("dev").alias("dev"))
    totals = totals.withColumn("before", F.sum("n").over(upto) - F.col("n"))  # VALUE_BUCKETS rows per group
    totals = materialize(totals, scratch_path(spark, "describe-totals"), force=True)
    place = [((F.col("count") - 1) * p) for p in DESCRIBE_QUANTILES]
    wanted = F.array(*[F.struct(F.lit(f"{side}{k}").alias("name"), of(x).cast("long").alias("i")) for k, x in enumerate(place) for side, of in (("lo", F.floor), ("hi", F.ceil))])
    wanted = stats.filter(F.col("count") > 0).select("g", F.explode(wanted).alias("w")).select("g", "w.*")
    met = totals.join(wanted, "g").filter((F.col("before") <= F.col("i")) & (F.col("i") < F.col("before") + F.col("n")))
    here = placed.join(met.select("g", "b").distinct(), ["g", "b"])
    here = here.withColumn("run", F.sum("c").over(Window.partitionBy("g", "b").orderBy("v")))
    found = here.join(met.select("g", "b", "name", (F.col("i") - F.col("before")).alias("i")), ["g", "b"])
    found = found.filter((F.col("run") > F.col("i")) & (F.col("run") - F.col("c") <= F.col("i")))
    names = [f"{side}{k}" for k in range(len(DESCRIBE_QUANTILES)) for side in ("lo", "hi")]
    quantiles = found.groupBy("g").agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in names])
    spread = totals.groupBy("g").agg(F.sum("dev").alias("dev"))
    out = stats.drop("_bounds").join(quantiles, "g", "left").join(spread, "g", "left")
    std = F.when(F.col("count") > 1, F.sqrt(F.col("dev") / (F.col("count") - 1)))
    at = [F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * (x - F.floor(x)) for k, x in enumerate(place)]
    return out.select("g.*", "count", "mean", std.alias("std"), "min", *[x.alias(n) for n, x in zip(("p25", "p50", "p75"), at)], "max")


def label_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """A1/A2: rows per label."""
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))


def missing_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A3: per column, nulls (and NaN for floating columns), in long form."""
    types = dict(df.dtypes)
    aggs = []
    for c in cols:
        missing = F.col(c).isNull()
        if types[c] in ("double", "float"):
            missing = missing | F.isnan(F.col(c))
        aggs.append(F.count_if(missing).alias(c))
    wide = df.agg(*aggs)
    return wide.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in cols])).alias("_r")
    ).select("_r.*")


def min_max_mean(df: DataFrame, col: str) -> DataFrame:
    """A6."""
    return df.agg(F.min(col).alias("min"), F.max(col).alias("max"), F.avg(col).alias("mean"))


def flag_value_counts(df: DataFrame, flag_cols: Sequence[str], value_col: str) -> DataFrame:
    """For each flag, counts of ``value_col`` per flag value, with the
    position of each count inside its (flag, value) group, largest first."""
    stacked = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("flag_value")) for f in flag_cols])
        ).alias("_f"),
        F.col(value_col),
    ).select("_f.flag", "_f.flag_value", value_col)
    counts = stacked.groupBy("flag", "flag_value", value_col).agg(F.count(F.lit(1)).alias("n"))
    # groups hold at most the number of distinct values: bounded
    w = Window.partitionBy("flag", "flag_value").orderBy(F.col("n").desc(), F.col(value_col))
    return counts.withColumn("position", F.row_number().over(w))


def histogram(df: DataFrame, value_col: str, group_col: str, bins: int = 10) -> DataFrame:
    """``bins`` equal-width bins over each group's own [min, max]; the last
    bin is closed; a constant group spans [v - 0.5, v + 0.5]. Empty bins are
    reported with count 0."""
    stats = df.groupBy(group_col).agg(F.min(value_col).alias("_lo0"), F.max(value_col).alias("_hi0"))
    stats = stats.select(
        group_col,
        F.when(F.col("_lo0") == F.col("_hi0"), F.col("_lo0") - 0.5).otherwise(F.col("_lo0")).cast("double").alias("_lo"),
        F.when(F.col("_lo0") == F.col("_hi0"), F.col("_hi0") + 0.5).otherwise(F.col("_hi0")).cast("double").alias("_hi"),
    )
    # stats has one row per group (few groups): broadcast is bounded
    binned = df.join(F.broadcast(stats), group_col).select(
        group_col,
        F.least(
            F.floor((F.col(value_col) - F.col("_lo")) * F.lit(float(bins)) / (F.col("_hi") - F.col("_lo"))),
            F.lit(bins - 1),
        ).cast("int").alias("bin"),
    )
    counts = binned.groupBy(group_col, "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = stats.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).select(
        group_col,
        "bin",
        (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))).alias("bin_lo"),
        F.when(F.col("bin") == bins - 1, F.col("_hi"))
        .otherwise(F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / F.lit(float(bins)))
        .alias("bin_hi"),
    )
    return grid.join(counts, [group_col, "bin"], "left").select(
        group_col, "bin", "bin_lo", "bin_hi", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")
    )


def check_expressions(
    feature_cols: Sequence[str] = (),
    label_col: str | None = "label",
    logits_col: str | None = None,
    features_array_col: str | None = None,
    arity: int = 2,
) -> list[Column]:
    """Q1-Q6 as aggregates, each named after its check and counting failures:
    Q1 non-finite features, Q2 null labels, Q3 labels outside {0, 1}, Q4 fewer
    than two classes (failures = 1), Q5 rows with non-finite logits, Q6 feature
    arrays of the wrong size. They hold no distinct aggregate, so that they can
    also be observed while the rows are written."""
    checks = []
    for c in feature_cols:
        x = F.col(c).cast("double")
        checks.append((f"finite_{c}", F.count_if(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))))
    if label_col:
        checks.append(("label_not_null", F.count_if(F.col(label_col).isNull())))
        checks.append(("label_in_0_1", F.count_if(~F.col(label_col).isin(0, 1))))
        checks.append(("two_classes", F.coalesce((F.min(label_col) == F.max(label_col)).cast("long"), F.lit(1))))
    if logits_col:
        from corpusframe.functions.logits import count_non_finite

        checks.append(("finite_logits", F.count_if(count_non_finite(logits_col) > 0)))
    if features_array_col:
        checks.append(("feature_arity", F.count_if(F.size(features_array_col) != arity)))
    return [e.cast("bigint").alias(name) for name, e in checks]


def quality_checks(df: DataFrame, *checks, strict: bool = False, **named_checks) -> DataFrame:
    """``check_expressions`` (its arguments follow ``df``) in one aggregate pass:
    rows ``(check, failures)``. ``strict`` makes a failure fail the job."""
    wide = df.agg(*check_expressions(*checks, **named_checks))
    out = wide.select(
        F.explode(F.array(*[F.struct(F.lit(name).alias("check"), F.col(name).alias("failures")) for name in wide.columns])).alias("_c")
    ).select("_c.*")
    if strict:
        out = out.withColumn("failures", F.when(F.assert_true(F.col("failures") == 0).isNull(), F.col("failures")))
    return out


def write_checked(df: DataFrame, path: str, strict: bool = False, partition_by: Sequence[str] = (), **checks) -> dict[str, int]:
    """Write ``df`` and count the failures of ``check_expressions`` on the way:
    the rows pass once. Returns failures by check. ``strict``: if there are any
    the table is left unfinished in the caller's eyes, by an error after the
    write; its rows can be looked at."""
    seen = Observation()
    df.observe(seen, *check_expressions(**checks)).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    failures = {k: int(v) for k, v in seen.get.items()}
    if strict and any(failures.values()):
        raise ValueError(f"failed checks in {path}: " + ", ".join(f"{k} {v}" for k, v in failures.items() if v))
    return failures
