"""CSV with malformed records, checks inside the write, a model per worker."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusframe.operators import profile as P
from corpusframe.operators.scoring import SharedModel, score_batches
from corpusframe.session import scratch_path
from corpusframe.sources import files as IO

SCHEMA = "id int, text string, raw string"


def lines(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_malformed_records_are_kept_apart(spark, tmp_path):
    good = 'id,text,raw\n1,"two\nlines, ""quoted""",a\n2,,b\n'
    bad = "3,short\n4,long,c,d\nfive,no number,e\n"
    path = lines(tmp_path, "a.csv", good + bad)
    lines(tmp_path, "b.csv", 'id,text,raw\n6,fine,f\n7,"open quote,g\n8,swallowed,h\n')
    rows, apart = IO.convert_csv(spark, path, scratch_path(spark, "csv"), SCHEMA)
    assert rows.columns == ["id", "text", "raw"]
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 'two\nlines, "quoted"', "a"), (2, None, "b"), (6, "fine", "f")]
    kept = sorted((os.path.basename(r["file"]), r["raw"].strip()) for r in apart.collect())
    assert kept == [("a.csv", "3,short"), ("a.csv", "4,long,c,d"), ("a.csv", "five,no number,e"), ("b.csv", '7,"open quote,g\n8,swallowed,h')]


def test_line_by_line_an_open_quote_ends_with_its_line(spark, tmp_path):
    path = lines(tmp_path, "a.csv", 'id,text,raw\n1,"open,a\n2,fine,b\n')
    rows, apart = IO.convert_csv(spark, path, scratch_path(spark, "csv"), SCHEMA, multi_line=False)
    assert [tuple(r) for r in rows.collect()] == [(2, "fine", "b")]
    assert [r["raw"] for r in apart.collect()] == ['1,"open,a']


def test_checks_inside_the_write(spark):
    rows = [(1, 1.0, [0.5, 0.5]), (0, float("nan"), [0.1, float("inf")]), (None, 2.0, [1.0, 2.0]), (7, None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "label int, x double, logits array<double>")
    checks = dict(feature_cols=["x"], logits_col="logits", features_array_col="logits", arity=2)
    path = scratch_path(spark, "checked")
    got = P.write_checked(df, path, **checks)
    assert got == {r["check"]: r["failures"] for r in P.quality_checks(df, **checks).collect()}
    assert got == {"finite_x": 2, "label_not_null": 1, "label_in_0_1": 1, "two_classes": 0, "finite_logits": 1, "feature_arity": 0}
    assert spark.read.parquet(path).count() == 4
    with pytest.raises(ValueError, match="finite_x 2"):
        P.write_checked(df, path, strict=True, **checks)
    one = spark.createDataFrame([(1, 1.0)], "label int, x double")
    assert P.write_checked(one, path)["two_classes"] == 1 and P.write_checked(one.limit(0), path)["two_classes"] == 1


def test_rows_pass_once_with_their_checks(spark):
    df = spark.range(1000).select((F.col("id") % 2).cast("int").alias("label"))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    P.write_checked(df.mapInArrow(count, "label int"), scratch_path(spark, "once"))
    assert seen.value == 1000


def test_a_model_is_built_once_per_worker(spark, tmp_path):
    w = np.arange(3, dtype="<f8")
    folder = str(tmp_path)

    def build(payload):
        import tempfile

        with tempfile.NamedTemporaryFile(dir=folder, prefix=f"{os.getpid()}-", delete=False):
            pass
        return lambda x: x @ np.frombuffer(payload, dtype="<f8")

    model = SharedModel(spark, w.tobytes(), build)
    df = spark.range(0, 2000, 1, 40).select("id", F.array(*[(F.col("id") + k).cast("double") for k in range(3)]).alias("v"), F.lit("x").alias("score text"))
    for _ in range(2):
        got = score_batches(df, model, "v", 3, batch_size=7).collect()
        assert len(got) == 2000 and all(r["score"] == (r["id"] + 1) + 2 * (r["id"] + 2) and r["score text"] == "x" for r in got)
    loads = [n.split("-")[0] for n in os.listdir(folder)]
    assert loads and len(loads) == len(set(loads))  # 80 tasks, one load for each process
