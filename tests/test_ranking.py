"""Exact ranks, splits, draws and running sums against plain windows, with a
wide payload, at several sizes and numbers of shuffle partitions."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusframe.operators import evaluation as E
from corpusframe.operators import profile as P
from corpusframe.operators import ranking as R
from corpusframe.operators import splits as SP
from corpusframe.session import scratch_path

CASES = [(4_000, 1), (4_000, 4), (4_000, 200), (400_000, 8)]


@pytest.fixture(params=CASES, ids=str)
def rows(request, spark):
    n, parts = request.param
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    d = spark.range(0, n, 1, 16).select(
        "id",
        (F.pmod(F.xxhash64("id"), F.lit(10)) == 0).cast("int").alias("label"),
        ((F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(n // 3)) - n // 9) / 1000.0).alias("score"),
        F.repeat(F.md5(F.col("id").cast("string")), 4).alias("payload"),
    )
    yield n, d
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ranks_equal_row_number(rows):
    n, d = rows
    d = d.withColumn("h", SP.hash_key("id", 42))
    ranked = R.hash_rank(d, ["label"], "h", "id")
    plain = F.row_number().over(Window.partitionBy("label").orderBy("h", "id")) - 1
    assert ranked.withColumn("want", plain).filter(F.col("rank") != F.col("want")).count() == 0
    assert ranked.count() == n


def test_split_sizes_and_payload(rows):
    n, d = rows
    out = SP.split_and_folds(d, "id", "label", 0.2, 5)
    assert set(out.columns) == {*d.columns, "is_test", "fold"}
    n1 = d.filter("label = 1").count()
    per = {(r["label"], r["is_test"]): r["count"] for r in out.groupBy("label", "is_test").count().collect()}
    assert per[0, True] + per[1, True] == -(-n // 5)
    assert abs(per[1, True] - n1 / 5) < 1 and per[1, True] + per[1, False] == n1
    folds = [r["count"] for r in out.filter("not is_test").groupBy("fold").count().collect()]
    assert len(folds) == 5 and max(folds) - min(folds) <= 1
    assert out.filter(F.col("payload") != F.repeat(F.md5(F.col("id").cast("string")), 4)).count() == 0


def test_bootstrap_draws(rows):
    _, d = rows
    got = SP.bootstrap_sample(d, 2000)
    r = got.agg(F.count(F.lit(1)), F.count_distinct("draw")).first()
    assert tuple(r) == (2000, 2000)


def test_auc_and_area_equal_the_window_form(rows):
    n, d = rows
    by = d.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q"))
    w = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("below", F.coalesce(F.sum("q").over(w), F.lit(0)))
    want = by.agg(F.sum(F.col("p") * (F.col("below") + 0.5 * F.col("q"))) / (F.sum("p") * F.sum("q"))).first()[0]
    assert E.roc_auc(d).first()[0] == pytest.approx(want, abs=1e-12)
    assert E.trapezoid_auc(E.roc_curve(d)).first()[0] == pytest.approx(want, abs=1e-9)
    g = d.withColumn("fold", (F.col("id") % 3).cast("int"))
    got = {r["fold"]: r["auc"] for r in E.roc_auc(g, group_cols=["fold"]).collect()}
    assert got[1] == pytest.approx(E.roc_auc(g.filter("fold = 1")).first()[0], abs=1e-12) and len(got) == 3


def test_any_bounds_give_the_same_sums(spark):
    d = spark.range(0, 500).select((F.col("id") * 1.5 - 100).alias("x"), (F.col("id") % 7).alias("v"))
    plain = F.sum("v").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    for bounds in ([], [0.0], [-200.0, -50.0, 3.0, 3.0, 10_000.0], None):
        for down in (False, True):
            order = F.col("x").desc() if down else F.col("x").asc()
            plain = F.sum("v").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
            got = R.prefix_sums(d, "x", ["v"], descending=down, bounds=bounds)
            assert got.withColumn("want", plain).filter(F.col("v_cum") != F.col("want")).count() == 0


def test_one_class_has_no_auc(spark):
    d = spark.createDataFrame([(1, 0.5), (1, 0.7)], "label int, score double")
    assert E.roc_auc(d).first()[0] != E.roc_auc(d).first()[0]  # NaN
    assert E.roc_auc(d.limit(0)).first()[0] != 0


def test_counts_beyond_a_bigint_product(spark, monkeypatch):
    big = 5_000_000_000
    table = spark.createDataFrame([(0.1, 0, big), (0.9, big, 0)], "threshold double, pos bigint, neg bigint")
    monkeypatch.setattr(E, "score_table", lambda *a: table)
    assert E.roc_auc(table).first()[0] == 1.0


def test_quantiles_of_continuous_values(spark):
    """Values that all lie between two powers of two: even buckets, exact quantiles."""
    n = 400_000
    d = spark.range(0, n, 1, 8).select((F.rand(3) + 1).alias("x"), F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("int")).alias("k"))
    d.write.parquet(path := scratch_path(spark, "continuous"))
    d = spark.read.parquet(path)
    b = d.crossJoin(R.value_bounds(d, "x")).groupBy(R.bucket_of(F.col("x"), F.col("_bounds")).alias("b")).count()
    most = b.agg(F.max("count"), F.count(F.lit(1))).first()
    assert most[1] == R.VALUE_BUCKETS and most[0] < 2 * n / R.VALUE_BUCKETS
    got = {r["k"]: r for r in P.describe(d, ["x"], ["k"]).collect()}
    want = d.groupBy("k").agg(F.count("x"), F.avg("x"), F.stddev_samp("x"), F.min("x"), F.percentile("x", F.lit([0.25, 0.5, 0.75])), F.max("x")).collect()
    assert len(got) == len(want) == 3 and None in got
    for r in want:
        g = got[r["k"]]
        assert (g["count"], g["min"], g["max"]) == (r[1], r[4], r[6])
        assert [g["p25"], g["p50"], g["p75"]] == pytest.approx(r[5], abs=1e-12)
        assert g["mean"] == pytest.approx(r[2]) and g["std"] == pytest.approx(r[3])


def test_describe_of_few_values_and_none(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 4.0), ("b", 2.0), ("c", None)], "k string, x double")
    got = {r["k"]: tuple(r)[2:] for r in P.describe(d, ["x"], ["k"]).collect()}
    assert got["a"][:2] == (3, 2.0) and got["a"][3:] == (1.0, 1.0, 1.0, 2.5, 4.0)
    assert got["b"] == (1, 2.0, None, 2.0, 2.0, 2.0, 2.0, 2.0)
    assert got["c"] == (0,) + (None,) * 7
    assert P.describe(d.limit(0), ["x"], ["k"]).count() == 0
