"""Literal cases of operators that the fixture tables hardly reach."""

import pytest
from pyspark.sql import functions as F

from corpusframe import session
from corpusframe.functions import text as T
from corpusframe.functions.html import html_to_text
from corpusframe.operators import dedup, errors, models, profile
from corpusframe.operators import features as G
from corpusframe.operators import splits as SP
from corpusframe.sources import files as IO
from corpusframe.sources.ingest import packed_id


@pytest.fixture
def texts(spark):
    rows = [(1, 0, "a"), (2, 1, "a"), (3, 0, "a"), (4, 0, "b"), (5, None, "c"), (6, 1, None), (7, 0, None), (8, 1, "")]
    return spark.createDataFrame(rows, "row_id bigint, label int, t string")


def test_label_conflicts(texts):
    got = {tuple(r) for r in dedup.label_conflicts(texts, "t", "label", "row_id").select("t", "n_labels", "n_rows").collect()}
    assert got == {("a", 2, 3), (None, 2, 2)}


def test_duplicates(texts):
    assert {r[0] for r in dedup.duplicate_members(texts, "t", "row_id").select("row_id").collect()} == {1, 2, 3, 6, 7}
    assert dedup.duplicate_count(texts, "t").first()[0] == 3
    kept = dedup.drop_duplicates(texts, ["label", "t"], "t", "row_id")
    assert {r[0] for r in kept.select("row_id").collect()} == {1, 2, 4, 5, 6, 7, 8}


def test_no_text_is_sorted_or_aggregated(texts):
    for df in (dedup.drop_duplicates(texts, ["label", "t"], "t", "row_id"), dedup.label_conflicts(texts, "t", "label", "row_id")):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_describe_of_gaps_ties_and_signs(spark):
    rows = [("a", x) for x in (-5.0, -5.0, 0.0, 0.25, 3.0, 1e9, None)] + [("b", 7.0)]
    got = {r["g"]: r for r in profile.describe(spark.createDataFrame(rows, "g string, x double"), ["x"], ["g"]).collect()}
    a = got["a"]
    assert (a["count"], a["min"], a["p25"], a["p50"], a["p75"], a["max"]) == (6, -5.0, -3.75, 0.125, 2.3125, 1e9)
    assert (got["b"]["p25"], got["b"]["p75"], got["b"]["std"]) == (7.0, 7.0, None)


def test_packed_ids_fail_loudly(spark):
    d = spark.createDataFrame([(1, 2), (1, 3), (2, 0)], "a bigint, b bigint").select(packed_id(F.col("a"), F.col("b")).alias("k"))
    assert [r[0] for r in d.collect()] == sorted({r[0] for r in d.collect()})
    for a, b in ((1, 1 << 20), (1 << 36, 0), (-1, 0)):
        with pytest.raises(Exception, match="id outside"):
            spark.createDataFrame([(a, b)], "a bigint, b bigint").select(packed_id(F.col("a"), F.col("b"))).collect()


def test_vocabulary_without_bound(spark):
    d = spark.createDataFrame([(1, ["x", "y", "x"]), (2, ["y", "z"])], "id int, terms array<string>")
    v = G.fit_vocabulary(d, "terms", None).collect()
    assert {(r["term"], r["tf"], r["df"]) for r in v} == {("x", 2, 1), ("y", 2, 2), ("z", 1, 1)}
    assert sorted(r["rank"] for r in v) == [0, 1, 2]
    enc = G.encode_tokens(d, "id", "terms", G.fit_vocabulary(d, "terms", None), 4).orderBy("id").collect()
    assert [len(r["input_ids"]) for r in enc] == [4, 4] and enc[1]["attention_mask"] == [1, 1, 0, 0]
    with pytest.raises(ValueError):
        G.tfidf_vectorizer(G.fit_vocabulary(d, "terms", None), "terms", 2)


def test_word_frequencies_are_complete(spark):
    text = " ".join(f"word{i:03d}" for i in range(200))
    d = spark.createDataFrame([("fp", text), ("fp", None)], "error_type string, t string")
    counts = errors.term_frequency(d, "t")
    assert counts.count() == 200
    top = errors.top_k_per_group(counts, ["error_type"], [F.desc("n"), F.col("word")], 3)
    assert [r["word"] for r in top.orderBy("position").collect()] == ["word000", "word001", "word002"]


def test_quarantine(spark):
    d = spark.createDataFrame([("1",), ("x",), (None,), ("1.5",), ("-2",)], "label string")
    good, bad = T.quarantine(d)
    assert sorted(r[0] for r in good.collect()) == [-2, 1] and bad.count() == 3
    with pytest.raises(Exception):
        d.select(T.strict_label("label")).collect()


def test_override_tail(spark):
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors

    d = spark.createDataFrame([(Vectors.sparse(4, [0, 3], [1.0, 2.0]),)], ["v"])
    assert d.select(vector_to_array(T.override_tail("v", 2, 9.0)).alias("a")).first()[0] == [1.0, 0.0, 9.0, 9.0]


def test_fold_views_and_first_rows(spark):
    d = spark.createDataFrame([(i, i % 3 + 1) for i in range(9)], "id int, fold int")
    v = SP.fold_views(d, 3)
    assert v.count() == 27 and v.filter("role = 'validation'").count() == 9
    assert v.filter("role = 'train' and view = fold").count() == 0
    assert [r[0] for r in IO.first_rows(d, "id", 4).collect()] == [0, 1, 2, 3]


def test_a_second_fit_starts_anew(spark):
    from pyspark.ml.functions import array_to_vector

    d = spark.range(0, 120, 1, 1).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"))
    d = d.withColumn("features", array_to_vector(F.array((F.col("label") + F.col("id") % 5 / 3.0).cast("double"), F.lit(1.0))))
    est = models.CalibratedSVM(k=2)
    assert len(est.fit(d).pairs) == 2 and len(est.fit(d.withColumn("fold", F.lit(0))).pairs) == 2 and not hasattr(est, "pairs")


def test_scratch_folder_must_be_shared(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return self

        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_html_literal_cases(spark):
    cases = [
        (None, ""), ("  ", ""), (" plain ", "plain"), ("1 < 2", "1 < 2"), ("<p>a</p><p>b</p>", "a b"), ("<b>x</b>&amp;lt;", "x &lt;"),
        ("<script>no</script>yes<!-- c -->", "yes"), ("<style>p{}</style><i>t</i>", "t"), ("<p>&eacute;&#233;&#xe9;</p>", "ééé"),
        ("<p>&nbsp;a&nbsp;</p>", "a"), ("<!doctype html><br>z", "z"),
    ]
    d = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, h string")
    got = {r["i"]: r["t"] for r in d.select("i", html_to_text("h").alias("t")).collect()}
    assert [got[i] for i in range(len(cases))] == [t for _, t in cases]


def test_histogram_edges(spark):
    d = spark.createDataFrame([("same", 5.0)] * 4 + [("range", float(x)) for x in (0, 1, 5, 10, 10)], "g string, v double")
    got = {(r["g"], r["bin"]): r["n"] for r in profile.histogram(d, "v", "g", 10).collect()}
    assert got["same", 5] == 4 and got["range", 9] == 2 and got["range", 0] == 1 and got["range", 1] == 1 and len(got) == 20


def test_metrics_without_a_positive_prediction(spark):
    from corpusframe.operators import evaluation as E

    d = spark.createDataFrame([(1, 0), (0, 0), (0, 0)], "label int, predicted_label int")
    r = E.binary_metrics(d).first()
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"], r["support"]) == (pytest.approx(2 / 3), 0.0, 0.0, 0.0, 1)
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5), (0, 0.5)], "label int, score double")
    assert E.roc_auc(tied).first()[0] == 0.5


def test_early_stopping_replay(spark):
    from corpusframe.operators import evaluation as E

    logs = {
        "two misses": [0.5, 0.6, 0.6, 0.4, 0.9],  # a tie is a miss: stops at epoch 4
        "never improves": [0.3, 0.2, 0.1, 0.9],
        "always improves": [0.1, 0.2, 0.3],
        "recovers": [0.5, 0.4, 0.6, 0.5],
    }
    rows = [(m, e + 1, x) for m, xs in logs.items() for e, x in enumerate(xs)]
    got = {r["run"]: r for r in E.early_stopping(spark.createDataFrame(rows, "run string, epoch int, f1 double"), ["run"], "epoch", "f1", 2).collect()}
    want = {"two misses": (4, 4, 2, 0.6), "never improves": (3, 3, 1, 0.3), "always improves": (3, None, 3, 0.3), "recovers": (4, None, 3, 0.6)}
    assert {m: (r["epochs_run"], r["stop_epoch"], r["best_epoch"], r["best_f1"]) for m, r in got.items()} == want


def test_splits_of_tiny_classes(spark):
    d = spark.createDataFrame([(i, int(i == 0)) for i in range(11)], "id int, label int")
    out = SP.split_and_folds(d, "id", "label", 0.2, 5)
    assert out.filter("is_test").count() == 3 and out.filter("not is_test").select("fold").distinct().count() == 5
    few = SP.stratified_kfold(d.filter("id < 3"), "id", "label", 5)
    assert few.count() == 3 and few.select("fold").distinct().count() == 3


def test_features_of_unseen_and_constant_values(spark):
    train = spark.createDataFrame([(1, ["a", "b"], 2.0, 7.0), (2, ["a"], 4.0, 7.0)], "id int, terms array<string>, x double, c double")
    other = spark.createDataFrame([(3, ["z"], 6.0, 9.0), (4, ["a", "z"], 2.0, 7.0)], "id int, terms array<string>, x double, c double")
    w = {(r["id"], r["term"]): r["weight"] for r in G.tfidf_long(other, ["id"], "terms", G.fit_vocabulary(train, "terms", 10)).collect()}
    assert w == {(4, "a"): 1.0}
    std = {r["id"]: (r["x_scaled"], r["c_scaled"]) for r in G.apply_standard_scaler(other, G.fit_standard_scaler(train, ["x", "c"]), ["x", "c"]).collect()}
    assert std == {3: (3.0, 2.0), 4: (-1.0, 0.0)}
    mm = {r["id"]: (r["x_scaled"], r["c_scaled"]) for r in G.apply_minmax_scaler(other, G.fit_minmax_scaler(train, ["x", "c"]), ["x", "c"]).collect()}
    assert mm == {3: (2.0, 2.0), 4: (0.0, 0.0)}


def test_encoding_and_weights_in_place_equal_the_joined_form(spark, monkeypatch):
    rows = [(i, [f"t{(i * j) % 7}" for j in range(i % 9)] if i % 5 else None, i % 2) for i in range(60)]
    d = spark.createDataFrame(rows, "id int, terms array<string>, k int")
    vocab = G.fit_vocabulary(d.filter("id < 30"), "terms", 5)
    here = G.encode_tokens(d.repartition(3), "id", "terms", vocab, 6)
    weights = {(r["id"], r["k"], r["term"]): r["weight"] for r in G.tfidf_rows(d.repartition(3), ["id", "k"], "terms", vocab, 5).collect()}
    joined = {(r["id"], r["k"], r["term"]): r["weight"] for r in G.tfidf_long(d, ["id", "k"], "terms", vocab).collect()}
    assert weights.keys() == joined.keys() and all(abs(weights[x] - joined[x]) < 1e-12 for x in joined)
    plan = G.encode_tokens(d, "id", "terms", vocab, 6)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = {r["id"]: (r["input_ids"], r["attention_mask"]) for r in here.collect()}
    monkeypatch.setattr(G, "BROADCAST_TERMS", 2)
    assert got == {r["id"]: (r["input_ids"], r["attention_mask"]) for r in G.encode_tokens(d, "id", "terms", vocab, 6).collect()}
    assert len(got) == 60 and all(len(a) == len(b) == 6 for a, b in got.values())


def test_stored_steps_can_be_cleared(spark, monkeypatch):
    monkeypatch.setattr(session, "_HANDED_OUT", [])
    paths = [session.scratch_path(spark, f"step{i}") for i in range(3)]
    for p in paths[:2]:
        spark.range(5).write.parquet(p)
    assert session.clear_scratch(spark) == 2 and session.clear_scratch(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(paths[0])


def test_report_of_groups_and_of_nothing(spark):
    from corpusframe.operators import evaluation as E

    d = spark.createDataFrame([("a", 1, 1), ("a", 0, 1), ("a", 0, 0), ("b", 1, 0)], "k string, label int, predicted_label int")
    got = {(r["k"], r["row_name"]): tuple(r)[2:] for r in E.classification_report(d, group_cols=["k"]).collect()}
    assert got["a", "1"] == (0.5, 1.0, 0.6667, 1) and got["a", "0"] == (1.0, 0.5, 0.6667, 2) and got["a", "accuracy"] == (None, None, 0.6667, 3)
    assert got["b", "0"] == (0.0, 0.0, 0.0, 0) and got["b", "weighted avg"] == (0.0, 0.0, 0.0, 1) and len(got) == 10
    assert E.classification_report(d.limit(0)).count() == 0


def test_term_stats_and_ngrams_without_lambdas_over_counts(spark):
    rows = [(["b", "a", "b"],), (["a"],), ([],), (None,), (["ä", "a b", "a b"],)]
    df = spark.createDataFrame(rows, "t array<string>")
    stats = G.term_stats(df, "t")
    assert {tuple(r) for r in stats.collect()} == {("a", 2, 2), ("b", 2, 1), ("ä", 1, 1), ("a b", 2, 1), (None, 0, 5)}
    assert "lambda" not in stats._jdf.queryExecution().optimizedPlan().toString()
    grams = [r[0] for r in df.select(G.ngrams("t", 2)).collect()]
    assert grams == [["b a", "a b"], [], [], [], ["ä a b", "a b a b"]]
    assert [r[0] for r in df.select(G.ngrams("t", 3)).collect()] == [["b a b"], [], [], [], ["ä a b a b"]]
