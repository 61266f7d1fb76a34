"""Literal-row tests of the column functions (T, P, Z families)."""

import math

from pyspark.sql import functions as F

from corpusframe.functions import logits as Z
from corpusframe.functions import text as T
from corpusframe.functions.dates import is_date_token
from corpusframe.functions.html import html_to_text


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("o")).first()["o"]


def test_punctuation_keeps_unicode_letters_and_at(spark):
    assert one(spark, T.remove_punctuation("v"), "Héllo, wörld! a@b.c") == "Héllo wörld a@bc"


def test_stop_words_removed_case_insensitively(spark):
    assert one(spark, T.remove_stop_words("v"), "The cat IS on   the mat") == "cat mat"


def test_word_and_char_count(spark):
    assert one(spark, T.word_count("v"), "  a b\tc\n") == 3
    assert one(spark, T.word_count("v"), "") == 0
    assert one(spark, T.char_count("v"), "añb") == 3


def test_null_to_text_and_concat(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert df.select(T.concat_fields(["x", "y"]).alias("o")).first()["o"] == "anan"


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(150.0,), (-3.0,), (None,)], "v double")
    got = [r["o"] for r in df.select(T.clip(F.col("v"), 0, 100).alias("o")).collect()]
    assert got == [100.0, 0.0, None]


def test_link_count_and_flags(spark):
    assert one(spark, T.link_count("v"), "http://a https://b HTTP://c") == 2
    df = spark.createDataFrame([("Please LOGIN now, URGENT",), (None,)], "v string")
    rows = df.select(*T.keyword_flags("v")).collect()
    assert [tuple(r) for r in rows] == [(False, True, True), (False, False, False)]


def test_html_to_text(spark):
    html = "<html><head><style>p{}</style><script>x()</script></head><body><p> Hi &amp; bye </p><!-- c --><b>x</b></body></html>"
    assert one(spark, html_to_text(F.col("v")), html) == "Hi & bye x"
    assert one(spark, html_to_text(F.col("v")), "  plain text  ") == "plain text"
    assert one(spark, html_to_text(F.col("v")), None) == ""


def test_date_tokens(spark):
    df = spark.createDataFrame([(t,) for t in ["january", "2023", "12/05/2021", "mon 5", "hello", "20233"]], "v string")
    got = [r["o"] for r in df.select(is_date_token(F.col("v")).alias("o")).collect()]
    assert got == [True, True, True, True, False, False]


def test_logits(spark):
    df = spark.createDataFrame([([float("nan"), float("inf"), float("-inf"), 1.0],), ([2.0, 2.0],)], "v array<double>")
    rows = df.select(Z.sanitise("v").alias("s")).select(
        "s", Z.argmax("s").alias("a"), Z.softmax("s").alias("p"), Z.confidence("s").alias("c")
    ).collect()
    assert rows[0]["s"] == [0.0, 10.0, -10.0, 1.0]
    assert rows[0]["a"] == 1
    assert rows[1]["a"] == 0
    assert math.isclose(sum(rows[0]["p"]), 1.0)
    assert math.isclose(rows[1]["c"], 0.5)


def test_override_tail_of_wide_vectors(spark):
    from pyspark.ml.linalg import DenseVector, SparseVector

    rows = [(0, SparseVector(4, {0: 1.0, 3: 2.0})), (1, DenseVector([1.0, 2.0, 3.0, 4.0])), (2, DenseVector([5.0])), (3, SparseVector(0, {}))]
    df = spark.createDataFrame(rows, ["id", "v"]).select("id", T.override_tail("v", 2, 7.0).alias("v"))
    got = {r["id"]: r["v"].toArray().tolist() for r in df.collect()}
    assert got == {0: [1.0, 0.0, 7.0, 7.0], 1: [1.0, 2.0, 7.0, 7.0], 2: [7.0], 3: []}
    # a lambda over the entries converts the whole vector again for each of them
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
