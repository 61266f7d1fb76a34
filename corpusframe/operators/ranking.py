"""Exact ranks and prefix sums without a single-task window.

``Window.partitionBy(label).orderBy(...)`` puts every row of a class into one
task; with two classes that is two tasks for the whole table. Instead rows fall
into a fixed number of buckets by their order key: each (group, bucket) is
numbered or summed on its own, and a small table of bucket totals turns local
positions into global ones.

A row's bucket is a function of its key alone -- the leading digits of a hash,
or its place among literal bounds. It does not depend on the input's size, its
partitions or the columns that ride along, so the totals and the rows always
agree, and a recomputed task yields the same numbers. Bounds and bucket counts
change the speed only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of a hash that choose its bucket, and buckets by value.
HASH_DIGITS = 3
VALUE_BUCKETS = 256


def hash_rank(df: DataFrame, group_cols: Sequence[str], hash_col: str, id_col: str, rank_col: str = "rank") -> DataFrame:
    """Add ``rank_col``: 0-based position of the row within its group in
    (hash, id) order. ``hash_col``: lowercase hex digits. Pass narrow rows and
    join the ranks back; every column given here is sorted along."""
    group_cols = list(group_cols)
    b = df.withColumn("_bucket", F.conv(F.substring(hash_col, 1, HASH_DIGITS), 16, 10).cast("int"))
    totals = b.groupBy(*group_cols, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group_cols).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    here = Window.partitionBy(*group_cols, "_bucket").orderBy(hash_col, id_col)
    ranked = b.withColumn("_pos", F.row_number().over(here) - 1)
    # 16 ** HASH_DIGITS rows per group at most, for a few groups (classes)
    out = ranked.join(F.broadcast(offsets), [*group_cols, "_bucket"])
    return out.withColumn(rank_col, F.col("_before") + F.col("_pos")).drop("_bucket", "_pos", "_before")


def value_bounds(df: DataFrame, order_col: str, group_cols: Sequence[str] = (), buckets: int = VALUE_BUCKETS) -> DataFrame:
    """(groups..., _bounds): up to ``buckets - 1`` increasing bounds per group
    that cut its rows into parts of like size. They come from a quantile sketch
    (merged from the tasks' sketches) with an error of a fortieth of a bucket, so
    no bucket of distinct values holds much more than its share, wherever
    the values lie. Any bounds give the same sums."""
    probabilities = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    found = F.percentile_approx(F.col(order_col).cast("double"), probabilities, F.lit(40 * buckets))
    return df.groupBy(*group_cols).agg(F.array_sort(found).alias("_bounds"))


def bucket_of(value: Column, bounds: Column) -> Column:
    """Number of bounds at or below the value, by binary search. At most
    ``VALUE_BUCKETS - 1`` bounds, in order."""
    steps = F.array(*[F.lit(1 << k) for k in range(VALUE_BUCKETS.bit_length() - 2, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(bounds, at + s - 1) <= value, at + s).otherwise(at))


def prefix_sums(
    df: DataFrame,
    order_col: str,
    value_cols: Sequence[str],
    descending: bool = False,
    suffix: str = "_cum",
    group_cols: Sequence[str] = (),
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Add ``<v><suffix>``: running sum of each value column in the order of
    the numeric ``order_col`` (unique within a group), inclusive of the current
    row. ``df`` is read three times: pass a stored table."""
    value_cols, group_cols = list(value_cols), list(group_cols)
    key = F.col(order_col).desc() if descending else F.col(order_col).asc()
    if bounds is not None:
        b = df.withColumn("_bounds", F.lit(list(bounds)).cast("array<double>"))
    elif group_cols:
        b = df.join(value_bounds(df, order_col, group_cols), group_cols)
    else:
        b = df.crossJoin(F.broadcast(value_bounds(df, order_col)))  # one row
    b = b.withColumn("_bucket", bucket_of(F.col(order_col), F.col("_bounds"))).drop("_bounds")
    here = Window.partitionBy(*group_cols, "_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    local = b.select("*", *[F.sum(v).over(here).alias(f"_{v}_local") for v in value_cols])
    totals = b.groupBy(*group_cols, "_bucket").agg(*[F.sum(v).alias(f"_{v}_tot") for v in value_cols])
    place = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    before = Window.partitionBy(*group_cols).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group_cols, "_bucket", *[F.coalesce(F.sum(f"_{v}_tot").over(before), F.lit(0)).alias(f"_{v}_before") for v in value_cols]
    )
    # VALUE_BUCKETS rows per group; without groups that bound is certain
    out = local.join(offsets if group_cols else F.broadcast(offsets), [*group_cols, "_bucket"])
    for v in value_cols:
        out = out.withColumn(f"{v}{suffix}", F.col(f"_{v}_before") + F.col(f"_{v}_local"))
    return out.drop("_bucket", *[f"_{v}_local" for v in value_cols], *[f"_{v}_before" for v in value_cols])
