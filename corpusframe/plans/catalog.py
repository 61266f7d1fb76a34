"""Registered queries: one per operator of the inventory, each with the
equivalent DuckDB SQL where one exists.

Every query reads the given tables at ``sf_dir`` (or what Spark derives from
them) in full. Floating outputs are rounded to 6 digits on both sides so the
comparison does not depend on summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.functions import text as T
from corpusframe.functions.dates import is_date_token
from corpusframe.functions.html import html_to_text
from corpusframe.operators import dedup, profile
from corpusframe.plans import corpus as C
from corpusframe.plans import sql_snippets as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

R = 6  # rounding digits of floating outputs


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def rnd(c, digits: int = R):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# --------------------------------------------------------------------------
# Text functions
# --------------------------------------------------------------------------

@register(
    "clean_text",
    f"SELECT doc_id, {S.punct_removed('lower(text)')} AS cleaned_text FROM documents",
)
def q_clean_text(spark, sf_dir):
    """T1 + T2 on every document."""
    d = C.table(spark, sf_dir, "documents")
    return d.select("doc_id", T.remove_punctuation(T.lowercase("text")).alias("cleaned_text"))


@register(
    "stop_word_removal",
    f"SELECT doc_id, {S.stop_removed(S.punct_removed('text'))} AS no_stop FROM documents",
)
def q_stop_word_removal(spark, sf_dir):
    """T3 after T2 (the cleaning order: punctuation first)."""
    d = C.table(spark, sf_dir, "documents")
    return d.select("doc_id", T.remove_stop_words(T.remove_punctuation("text")).alias("no_stop"))


@register(
    "word_char_counts",
    f"SELECT doc_id, {S.word_count('text')} AS word_count, CAST(length(text) AS BIGINT) AS char_count FROM documents",
)
def q_word_char_counts(spark, sf_dir):
    """T5, T6."""
    d = C.table(spark, sf_dir, "documents")
    return d.select("doc_id", T.word_count("text").alias("word_count"), T.char_count("text").alias("char_count"))


@register(
    "html_to_text",
    f"SELECT page_id, {S.html_to_text('html')} AS body_text FROM pages",
)
def q_html_to_text(spark, sf_dir):
    """T4 on every page."""
    p = C.table(spark, sf_dir, "pages")
    return p.select("page_id", html_to_text("html").alias("body_text"))


_PAGE_TEXT_SQL = "(url || ' ' || html)"


@register(
    "link_features",
    f"SELECT page_id, {S.http_count(_PAGE_TEXT_SQL)} AS link_count, "
    f"CAST(length({_PAGE_TEXT_SQL}) AS BIGINT) AS email_length FROM pages",
)
def q_link_features(spark, sf_dir):
    """T7 on url + html of every page (the only fixture text holding links)."""
    p = C.table(spark, sf_dir, "pages")
    t = F.concat_ws(" ", "url", "html")
    return p.select("page_id", *T.structured_features(t))


@register(
    "keyword_flags",
    "SELECT page_id, "
    + S.flags("url || ' ' || html") + " "
    "FROM pages",
)
def q_keyword_flags(spark, sf_dir):
    """T8 on url + html of every page."""
    p = C.table(spark, sf_dir, "pages")
    return p.select("page_id", *T.keyword_flags(F.concat_ws(" ", "url", "html")))


@register(
    "short_word_filter",
    f"SELECT doc_id, array_to_string(list_filter({S.words('text')}, lambda w: length(w) >= 3), ' ') AS long_words FROM documents",
)
def q_short_word_filter(spark, sf_dir):
    """T9."""
    d = C.table(spark, sf_dir, "documents")
    return d.select("doc_id", T.filter_short_words("text").alias("long_words"))


@register(
    "date_token_counts",
    "SELECT token, CAST(count(*) AS BIGINT) AS n FROM ("
    f"SELECT unnest(regexp_extract_all(lower(text), {S.q('[' + T.WORD_CLASS + ']+')})) AS token FROM documents) "
    f"WHERE {S.is_date_token('token')} GROUP BY token",
)
def q_date_token_counts(spark, sf_dir):
    """T10 over every word of every document."""
    d = C.table(spark, sf_dir, "documents")
    toks = d.select(F.explode_outer(F.regexp_extract_all(F.lower("text"), F.lit("[" + T.WORD_CLASS + "]+"), 0)).alias("token"))
    return toks.filter(F.col("token").isNotNull() & is_date_token("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@register(
    "concat_fields",
    "SELECT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), 'nan') || coalesce(CAST(turn AS VARCHAR), 'nan') "
    "|| coalesce(role, 'nan') || coalesce(text, 'nan') AS email_text, "
    f"{S.strip('text')} AS stripped FROM conversations",
)
def q_concat_fields(spark, sf_dir):
    """P1 + P2 (and T11 strip) on every conversation turn."""
    c = C.table(spark, sf_dir, "conversations")
    return c.select(
        "conv_id",
        "turn",
        T.concat_fields(["conv_id", "turn", "role", "text"]).alias("email_text"),
        T.strip_ws("text").alias("stripped"),
    )


@register(
    "clip_features",
    f"SELECT doc_id, {S.clip('n_chars', 0, 20000)} AS email_length, "
    f"{S.clip(S.http_count('text'), 0, 100)} AS link_count FROM documents",
)
def q_clip_features(spark, sf_dir):
    """P8 on the structured features of every document."""
    d = C.table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        T.clip("n_chars", 0, 20000).alias("email_length"),
        T.clip(T.link_count("text"), 0, 100).alias("link_count"),
    )


@register(
    "source_names",
    "SELECT source, regexp_replace(lower(source || ' ' || lang), ' ', '_', 'g') AS name, "
    "CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY ALL",
)
def q_source_names(spark, sf_dir):
    """P10 (name normalisation) on every (source, language) pair."""
    d = C.table(spark, sf_dir, "documents")
    return d.groupBy("source", T.normalise_name(F.concat_ws(" ", "source", "lang")).alias("name")).agg(
        F.count(F.lit(1)).alias("n")
    )


# --------------------------------------------------------------------------
# Cleaning flow: describe (flagship), dedup, counts
# --------------------------------------------------------------------------

_DEDUPED_NO_STOP_SQL = (
    f"SELECT label, {S.stop_removed('cleaned')} AS no_stop FROM ("
    f"SELECT DISTINCT label, {S.punct_removed('lower(text)')} AS cleaned FROM ({S.LABELLED}))"
)


def _describe_sql(src: str, group: str) -> str:
    cols = []
    for name, expr in (("word_count", S.word_count("no_stop")), ("char_count", "CAST(length(no_stop) AS BIGINT)")):
        cols.append(f"SELECT {group}, '{name}' AS measure, CAST({expr} AS DOUBLE) AS v FROM ({src})")
    stacked = " UNION ALL ".join(cols)
    return (
        f"SELECT {group}, measure, CAST(count(v) AS BIGINT) AS count, round(avg(v), {R}) AS mean, "
        f"round(stddev_samp(v), {R}) AS std, min(v) AS min, "
        f"round(quantile_cont(v, 0.25::DOUBLE), {R}) AS p25, round(quantile_cont(v, 0.5::DOUBLE), {R}) AS p50, "
        f"round(quantile_cont(v, 0.75::DOUBLE), {R}) AS p75, max(v) AS max FROM ({stacked}) GROUP BY ALL"
    )


def length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: labelled documents -> lower -> punctuation removed -> drop
    duplicate (label, text) -> stop words removed -> word and char counts ->
    describe per label."""
    df = C.labelled_documents(spark, sf_dir)
    df = df.select("id", "label", T.remove_punctuation(T.lowercase("text")).alias("cleaned"))
    df = dedup.drop_duplicates(df, ["label", "cleaned"], "cleaned", "id")
    df = df.select("label", T.remove_stop_words("cleaned").alias("no_stop"))
    df = df.select("label", T.word_count("no_stop").alias("word_count"), T.char_count("no_stop").alias("char_count"))
    out = profile.describe(df, ["word_count", "char_count"], ["label"])
    return out.select(
        "label", "measure", "count", rnd("mean").alias("mean"), rnd("std").alias("std"), "min",
        rnd("p25").alias("p25"), rnd("p50").alias("p50"), rnd("p75").alias("p75"), "max",
    )


register("length_profile", _describe_sql(_DEDUPED_NO_STOP_SQL, "label"))(length_profile)


# --------------------------------------------------------------------------
# Merged corpus and duplicates
# --------------------------------------------------------------------------

from corpusframe.plans import cleaning as CL  # noqa: E402
from corpusframe.sources.ingest import merged_corpus  # noqa: E402


@register("merged_corpus", f"SELECT origin, row_id, text, label FROM ({S.MERGED})")
def q_merged_corpus(spark, sf_dir):
    """S3 + U1: five sources (two label filters of the labelled corpus, pages
    and conversations through HTML-to-text, benchmark) in one schema."""
    return merged_corpus(spark, sf_dir)


@register(
    "duplicate_members",
    f"WITH c AS ({S.CLEANED}) SELECT origin, row_id, label, cleaned_text FROM c "
    "WHERE cleaned_text IN (SELECT cleaned_text FROM c GROUP BY cleaned_text HAVING count(*) > 1)",
)
def q_duplicate_members(spark, sf_dir):
    """Every copy of a duplicated cleaned text."""
    c = CL.cleaned_corpus(spark, sf_dir).drop("missing")
    return dedup.duplicate_members(c, "cleaned_text", "row_id")


@register(
    "duplicate_count",
    f"SELECT CAST(count(*) - count(DISTINCT cleaned_text) AS BIGINT) AS duplicates FROM ({S.CLEANED})",
)
def q_duplicate_count(spark, sf_dir):
    """Rows beyond the first per cleaned text."""
    return dedup.duplicate_count(CL.cleaned_corpus(spark, sf_dir), "cleaned_text")


@register("deduplicated_corpus", f"SELECT row_id, origin, label, cleaned_text FROM ({S.DEDUPED})")
def q_deduplicated_corpus(spark, sf_dir):
    """U4: distinct (label, cleaned_text), first row kept."""
    return CL.deduplicated_corpus(spark, sf_dir)


@register(
    "label_conflicts",
    "SELECT cleaned_text, CAST(count(DISTINCT label) AS BIGINT) AS n_labels, CAST(count(*) AS BIGINT) AS n_rows "
    f"FROM ({S.CLEANED}) GROUP BY cleaned_text HAVING count(DISTINCT label) > 1",
)
def q_label_conflicts(spark, sf_dir):
    """Cleaned texts carried with more than one label."""
    return dedup.label_conflicts(CL.cleaned_corpus(spark, sf_dir), "cleaned_text", "label", "row_id")


@register(
    "corpus_counts",
    f"WITH m AS ({S.MERGED}), d AS ({S.DEDUPED}) "
    "SELECT 'rows_merged' AS metric, CAST(count(*) AS BIGINT) AS value FROM m UNION ALL "
    f"SELECT 'missing_text_before_cast', CAST(count_if(text IS NULL OR {S.strip('text')} = '') AS BIGINT) FROM m UNION ALL "
    "SELECT 'missing_text_after_cast', CAST(0 AS BIGINT) UNION ALL "
    "SELECT 'rows_deduplicated', CAST(count(*) AS BIGINT) FROM d UNION ALL "
    "SELECT 'label_0', CAST(count_if(label = 0) AS BIGINT) FROM d UNION ALL "
    "SELECT 'label_1', CAST(count_if(label = 1) AS BIGINT) FROM d",
)
def q_corpus_counts(spark, sf_dir):
    """A1-A3 of the cleaning flow."""
    return CL.corpus_counts(spark, sf_dir)


@register(
    "category_filter",
    f"SELECT doc_id, lower(text) AS text, CAST(1 AS INTEGER) AS label FROM documents WHERE source = 'src3'",
)
def q_category_filter(spark, sf_dir):
    """F2 + P3 + P4: rows of one category, relabelled as a single class."""
    d = C.table(spark, sf_dir, "documents")
    return d.filter(F.col("source") == "src3").select(
        "doc_id", T.lowercase("text").alias("text"), F.lit(1).cast("int").alias("label")
    )


@register(
    "no_stop_profile",
    _describe_sql(
        f"SELECT label, {S.stop_removed('cleaned_text')} AS no_stop FROM ({S.DEDUPED})", "label"
    ),
)
def q_no_stop_profile(spark, sf_dir):
    """A4 over the merged, cleaned, de-duplicated corpus without stop words."""
    df = CL.no_stop_corpus(spark, sf_dir)
    df = df.select("label", T.word_count("cleaned_text").alias("word_count"), T.char_count("cleaned_text").alias("char_count"))
    out = profile.describe(df, ["word_count", "char_count"], ["label"])
    return out.select(
        "label", "measure", "count", rnd("mean").alias("mean"), rnd("std").alias("std"), "min",
        rnd("p25").alias("p25"), rnd("p50").alias("p50"), rnd("p75").alias("p75"), "max",
    )


# --------------------------------------------------------------------------
# Splits (X1-X4, A10)
# --------------------------------------------------------------------------

from corpusframe.operators import evaluation as EV  # noqa: E402
from corpusframe.operators import splits as SP  # noqa: E402
from corpusframe.plans import base as B  # noqa: E402
from corpusframe.plans import runs as RU  # noqa: E402

_FOLDS_SQL = S.split_sql(f"SELECT id, label, link_count, email_length FROM ({S.FINALIZED})", RU.TEST_SIZE, RU.K_FOLDS)


@register("stratified_holdout", f"SELECT id, label, is_test FROM ({_FOLDS_SQL})")
def q_stratified_holdout(spark, sf_dir):
    """Exact stratified 80/20 split of the labelled corpus."""
    return RU.fold_assignments(spark, sf_dir).select("id", "label", "is_test")


@register("stratified_folds", f"SELECT id, label, fold FROM ({_FOLDS_SQL}) WHERE NOT is_test")
def q_stratified_folds(spark, sf_dir):
    """X2 over the training split (folds never see test rows)."""
    return RU.fold_assignments(spark, sf_dir).filter(~F.col("is_test")).select("id", "label", "fold")


@register(
    "stratified_kfold",
    f"SELECT id, label, fold FROM ({S.split_sql(f'SELECT id, label FROM ({S.LABELLED})', 0.0, 5)})",
)
def q_stratified_kfold(spark, sf_dir):
    """X2 on its own: 5 folds over every labelled document."""
    df = C.labelled_documents(spark, sf_dir).select("id", "label")
    return SP.stratified_kfold(df, "id", "label", 5, 42)


@register(
    "fold_views",
    f"WITH f AS (SELECT * FROM ({_FOLDS_SQL}) WHERE NOT is_test), "
    "v AS (SELECT fold, label, count(*) AS n FROM f GROUP BY ALL), t AS (SELECT label, count(*) AS n FROM f GROUP BY label) "
    "SELECT v.fold, v.label, 'validation' AS role, CAST(v.n AS BIGINT) AS n FROM v UNION ALL "
    "SELECT v.fold, v.label, 'train', CAST(t.n - v.n AS BIGINT) FROM v JOIN t USING (label)",
)
def q_fold_views(spark, sf_dir):
    """Size per class of each fold's validation view (fold = i) and
    training view (fold != i)."""
    f = RU.fold_assignments(spark, sf_dir).filter(~F.col("is_test"))
    views = SP.fold_views(f, RU.K_FOLDS)
    return views.groupBy(F.col("view").alias("fold"), "label", "role").agg(F.count(F.lit(1)).alias("n"))


@register(
    "fold_class_counts",
    f"WITH f AS (SELECT * FROM ({_FOLDS_SQL}) WHERE NOT is_test) "
    "SELECT fold, CAST(count(DISTINCT label) AS BIGINT) AS n_classes, "
    "(SELECT CAST(count(DISTINCT fold) AS BIGINT) FROM f) AS n_folds FROM f GROUP BY fold",
)
def q_fold_class_counts(spark, sf_dir):
    """A10 + Q4: distinct classes per fold and distinct folds."""
    f = RU.fold_assignments(spark, sf_dir).filter(~F.col("is_test"))
    per = f.groupBy("fold").agg(F.count_distinct("label").alias("n_classes"))
    n = f.agg(F.count_distinct("fold").alias("n_folds"))  # one row
    return per.crossJoin(F.broadcast(n))


@register(
    "bootstrap_sample",
    f"WITH c AS (SELECT id, label FROM ({S.LABELLED})), "
    "r AS (SELECT id, label, row_number() OVER (ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) - 1 AS rk FROM c), "
    "n AS (SELECT count(*) AS n FROM c), "
    "d AS (SELECT range AS draw, ('0x' || substr(md5('42:draw:' || CAST(range AS VARCHAR)), 1, 15))::BIGINT % n AS rk "
    "FROM range(2000), n) SELECT d.draw, r.id, r.label FROM d JOIN r USING (rk)",
)
def q_bootstrap_sample(spark, sf_dir):
    """Exactly 2000 draws with replacement over the labelled corpus."""
    df = C.labelled_documents(spark, sf_dir).select("id", "label")
    return SP.bootstrap_sample(df, 2000, "id", 42)


# --------------------------------------------------------------------------
# Evaluation on fixed predictions
# --------------------------------------------------------------------------

_SCORED = S.scored()


def _rounded(df, cols):
    return df.select(*[rnd(c).alias(c) if c in cols else F.col(c) for c in df.columns])


@register(
    "binary_metrics",
    f"WITH s AS ({_SCORED}), c AS (SELECT count_if(label=1 AND predicted_label=1) AS tp, "
    "count_if(label=0 AND predicted_label=1) AS fp, count_if(label=1 AND predicted_label=0) AS fn, "
    "count_if(label=0 AND predicted_label=0) AS tn FROM s) "
    f"SELECT round((tp+tn)/(tp+tn+fp+fn), {R}) AS accuracy, "
    f"round(CASE WHEN tp+fp=0 THEN 0.0::DOUBLE ELSE tp/(tp+fp) END, {R}) AS precision, "
    f"round(CASE WHEN tp+fn=0 THEN 0.0::DOUBLE ELSE tp/(tp+fn) END, {R}) AS recall, "
    f"round(CASE WHEN 2*tp+fp+fn=0 THEN 0.0::DOUBLE ELSE 2*tp/(2*tp+fp+fn) END, {R}) AS f1, "
    "CAST(tp+fn AS BIGINT) AS support FROM c",
)
def q_binary_metrics(spark, sf_dir):
    """E1 + E2 over every labelled document."""
    return _rounded(EV.binary_metrics(C.scored(spark, sf_dir)), ["accuracy", "precision", "recall", "f1"])


@register(
    "confusion_matrix",
    f"WITH s AS ({_SCORED}), g AS (SELECT * FROM (VALUES (0,0),(0,1),(1,0),(1,1)) t(true_label, predicted_label)), "
    "c AS (SELECT label AS true_label, predicted_label, count(*) AS n FROM s GROUP BY ALL), "
    "m AS (SELECT g.true_label, g.predicted_label, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM g LEFT JOIN c USING (true_label, predicted_label)) "
    f"SELECT true_label, predicted_label, n, round(n / sum(n) OVER (PARTITION BY true_label), {R}) AS rate FROM m",
)
def q_confusion_matrix(spark, sf_dir):
    """E6 + E7."""
    return _rounded(EV.confusion_matrix(C.scored(spark, sf_dir)), ["rate"])


_REPORT_SQL = f"""
WITH s AS ({_SCORED}), conf AS (SELECT label AS y, predicted_label AS p, count(*) AS n FROM s GROUP BY ALL),
sup AS (SELECT y AS cls, sum(n) AS support FROM conf GROUP BY y),
pr AS (SELECT p AS cls, sum(n) AS predicted FROM conf GROUP BY p),
tp AS (SELECT y AS cls, n AS tp FROM conf WHERE y = p),
per0 AS (SELECT coalesce(sup.cls, pr.cls) AS cls, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted
         FROM sup FULL JOIN pr ON sup.cls = pr.cls),
per AS (SELECT per0.*, coalesce(tp.tp, 0) AS tp FROM per0 LEFT JOIN tp USING (cls)),
m AS (SELECT CAST(cls AS VARCHAR) AS row_name,
             CASE WHEN predicted = 0 THEN 0.0::DOUBLE ELSE tp / predicted END AS precision,
             CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE tp / support END AS recall,
             CASE WHEN predicted + support = 0 THEN 0.0::DOUBLE ELSE 2 * tp / (predicted + support) END AS f1_score,
             CAST(support AS BIGINT) AS support, tp FROM per),
tot AS (SELECT sum(support) AS n, sum(tp) AS tp, avg(precision) AS mp, avg(recall) AS mr, avg(f1_score) AS mf,
               sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1_score * support) AS wf FROM m)
SELECT row_name, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1_score, 4) AS f1_score, support FROM m
UNION ALL SELECT 'accuracy', NULL, NULL, round(tp / n, 4), CAST(n AS BIGINT) FROM tot
UNION ALL SELECT 'macro avg', round(mp, 4), round(mr, 4), round(mf, 4), CAST(n AS BIGINT) FROM tot
UNION ALL SELECT 'weighted avg', round(wp / n, 4), round(wr / n, 4), round(wf / n, 4), CAST(n AS BIGINT) FROM tot
"""


@register("classification_report", _REPORT_SQL)
def q_classification_report(spark, sf_dir):
    """E8."""
    return EV.classification_report(C.scored(spark, sf_dir))


_SCORE_TABLE = f"SELECT score AS threshold, count_if(label = 1) AS pos, count_if(label <> 1) AS neg FROM ({_SCORED}) GROUP BY score"

_ROC_SQL = f"""
WITH t AS ({_SCORE_TABLE}), tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM t),
c AS (SELECT *, sum(pos) OVER w AS pos_cum, sum(neg) OVER w AS neg_cum FROM t
      WINDOW w AS (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT CAST(threshold AS DOUBLE) AS threshold, neg_cum / N AS fpr, pos_cum / P AS tpr,
       (neg_cum - neg) / N AS fpr_prev, (pos_cum - pos) / P AS tpr_prev FROM c, tot
UNION ALL SELECT 'inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM tot
"""


@register(
    "roc_curve",
    f"SELECT threshold, round(fpr, {R}) AS fpr, round(tpr, {R}) AS tpr, round(fpr_prev, {R}) AS fpr_prev, "
    f"round(tpr_prev, {R}) AS tpr_prev FROM ({_ROC_SQL})",
)
def q_roc_curve(spark, sf_dir):
    """Every distinct threshold (ties kept together) plus the start point."""
    return _rounded(EV.roc_curve(C.scored(spark, sf_dir)), ["fpr", "tpr", "fpr_prev", "tpr_prev"])


@register("roc_trapezoid_auc", f"SELECT round(sum((fpr - fpr_prev) * (tpr + tpr_prev) / 2), {R}) AS auc FROM ({_ROC_SQL})")
def q_roc_trapezoid_auc(spark, sf_dir):
    """E5: trapezoid area under the E4 points."""
    return _rounded(EV.trapezoid_auc(EV.roc_curve(C.scored(spark, sf_dir))), ["auc"])


@register(
    "roc_auc",
    f"WITH t AS ({_SCORE_TABLE}), c AS (SELECT *, sum(neg) OVER (ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_cum FROM t) "
    f"SELECT round(CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN 'nan'::DOUBLE ELSE "
    f"sum(CAST(pos AS DOUBLE) * (neg_cum - neg + 0.5::DOUBLE * neg)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) END, {R}) AS auc FROM c",
)
def q_roc_auc(spark, sf_dir):
    """Rank-sum AUC with ties."""
    return _rounded(EV.roc_auc(C.scored(spark, sf_dir)), ["auc"])


@register(
    "misclassified_rows",
    f"SELECT id, cleaned_text, label, link_count, email_length, predicted_label, "
    f"round(greatest(score, 1 - score), {R}) AS confidence FROM ({_SCORED}) WHERE label <> predicted_label",
)
def q_misclassified_rows(spark, sf_dir):
    """Rows whose prediction is wrong, with the prediction's confidence."""
    s = C.scored(spark, sf_dir)
    return s.filter(F.col("label") != F.col("predicted_label")).select(
        "id", "cleaned_text", "label", "link_count", "email_length", "predicted_label",
        rnd(F.greatest(F.col("score"), 1 - F.col("score"))).alias("confidence"),
    )


@register(
    "error_types",
    f"SELECT id, label, predicted_label, CASE WHEN label = 0 THEN 'false_positive' ELSE 'false_negative' END AS error_type "
    f"FROM ({_SCORED}) WHERE (label = 0 AND predicted_label = 1) OR (label = 1 AND predicted_label = 0)",
)
def q_error_types(spark, sf_dir):
    """false positives and false negatives in one pass."""
    from corpusframe.operators.errors import error_rows

    return error_rows(C.scored(spark, sf_dir)).select("id", "label", "predicted_label", "error_type")


# --------------------------------------------------------------------------
# Run tables: epoch log, early stopping, best run, fold summary, comparison
# (E10-E13, W1, W2, A11, A12, O2, P10)
# --------------------------------------------------------------------------

_RUN_MODELS = ", ".join(f"('{m}', {a!r}::DOUBLE)" for m, a in RU.MODELS)
# The feature base: f (split rows), x (id, feature, value) of every row, n (number of features).
_BASE_SPLIT_SQL = S.split_sql(f"SELECT id, cleaned_text, label, link_count, email_length FROM ({S.FINALIZED})", B.TEST_SIZE, B.K_FOLDS)
_BASE_VOCAB_SQL = S.vocab_sql(f"SELECT * FROM ({_BASE_SPLIT_SQL}) WHERE NOT is_test", S.tokens("cleaned_text"), B.VOCAB_SIZE)
_BASE_SQL = f"""
f AS MATERIALIZED (SELECT * FROM ({_BASE_SPLIT_SQL})),
w0 AS ({S.tfidf_long_sql('SELECT * FROM f', 'id', S.tokens('cleaned_text'), _BASE_VOCAB_SQL)}),
mm AS (SELECT min(link_count)::DOUBLE AS ll, max(link_count)::DOUBLE AS hl, min(email_length)::DOUBLE AS le, max(email_length)::DOUBLE AS he FROM f WHERE NOT is_test),
x AS MATERIALIZED (SELECT id, term AS k, weight AS v FROM w0
      UNION ALL SELECT id, ' link', greatest((link_count - ll) / CASE WHEN hl = ll THEN 1.0::DOUBLE ELSE hl - ll END, 0.0::DOUBLE) FROM f, mm
      UNION ALL SELECT id, ' length', greatest((email_length - le) / CASE WHEN he = le THEN 1.0::DOUBLE ELSE he - le END, 0.0::DOUBLE) FROM f, mm),
n AS (SELECT count(*) + {len(B.NUMERIC)} AS k FROM ({_BASE_VOCAB_SQL}))
"""
_RUN_SCORES_SQL = f"""
WITH {_BASE_SQL},
d AS (SELECT id, label, is_test, fold, CAST({S.hash_unit('id', 'part', RU.EPOCHS)} + 1 AS INTEGER) AS part FROM f),
r AS (SELECT m.model, m.a, f.range AS fold, e.range AS epoch FROM (VALUES {_RUN_MODELS}) m(model, a), range(1, {RU.K_FOLDS + 1}) f, range(1, {RU.EPOCHS + 1}) e),
fe AS (SELECT DISTINCT fold, epoch FROM r),
c AS (SELECT fe.fold, fe.epoch, x.k, sum(CASE WHEN label = 1 THEN v ELSE 0 END) AS c1, sum(CASE WHEN label = 0 THEN v ELSE 0 END) AS c0
      FROM x JOIN d USING (id) JOIN fe ON d.fold <> fe.fold AND d.part <= fe.epoch WHERE NOT is_test GROUP BY ALL),
t AS (SELECT fold, epoch, sum(c1) AS n1, sum(c0) AS n0 FROM c GROUP BY ALL),
pr AS (SELECT fe.fold, fe.epoch, ln((count_if(d.label = 1) + 1.0::DOUBLE) / (count_if(d.label = 0) + 1.0::DOUBLE)) AS prior
       FROM fe LEFT JOIN d ON NOT d.is_test AND d.fold <> fe.fold AND d.part <= fe.epoch GROUP BY ALL),
w AS (SELECT r.model, r.fold, r.epoch, q.k,
             ln((coalesce(c1, 0) + a) / (coalesce(n1, 0) + a * n.k)) - ln((coalesce(c0, 0) + a) / (coalesce(n0, 0) + a * n.k)) AS w
      FROM r CROSS JOIN (SELECT DISTINCT k FROM x) q CROSS JOIN n LEFT JOIN c ON c.fold = r.fold AND c.epoch = r.epoch AND c.k = q.k
      LEFT JOIN t ON t.fold = r.fold AND t.epoch = r.epoch),
s AS (SELECT x.id, w.model, w.fold, w.epoch, sum(v * w) AS s FROM x JOIN w USING (k) GROUP BY ALL),
sc AS (SELECT d.id, d.label, d.is_test, d.fold AS own_fold, d.part, r.model, r.fold, r.epoch,
              1.0::DOUBLE / (1.0::DOUBLE + exp(-(prior + coalesce(s.s, 0)))) AS score
       FROM d CROSS JOIN r JOIN pr ON pr.fold = r.fold AND pr.epoch = r.epoch
       LEFT JOIN s ON s.id = d.id AND s.model = r.model AND s.fold = r.fold AND s.epoch = r.epoch)
SELECT id, label, is_test, own_fold, part, model, CAST(fold AS INTEGER) AS fold, CAST(epoch AS INTEGER) AS epoch, score,
       CAST(score > 0.5 AS INTEGER) AS pred FROM sc
"""

_EVAL_LOG_SQL = f"""
WITH s AS MATERIALIZED (SELECT *, own_fold = fold AS held, own_fold <> fold AND part <= epoch AS seen,
                  -(label * ln(least(greatest(score, 1e-7), 1 - 1e-7)) + (1 - label) * ln(1 - least(greatest(score, 1e-7), 1 - 1e-7))) AS loss
           FROM ({_RUN_SCORES_SQL}) WHERE NOT is_test),
per AS (SELECT model, fold, epoch, avg(loss) FILTER (WHERE held) AS eval_loss, avg(loss) FILTER (WHERE seen) AS train_loss,
        count_if(held) AS n, count_if(held AND label = 1 AND pred = 1) AS tp, count_if(held AND label = 0 AND pred = 1) AS fp,
        count_if(held AND label = 1 AND pred = 0) AS fn, count_if(held AND label = 0 AND pred = 0) AS tn FROM s GROUP BY ALL)
SELECT model, fold, epoch, eval_loss, train_loss, (tp + tn) / n AS accuracy,
       CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fp) END AS precision,
       CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fn) END AS recall,
       CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0::DOUBLE ELSE 2 * tp / (2 * tp + fp + fn) END AS f1
FROM per
"""


@register(
    "epoch_log",
    f"WITH l AS MATERIALIZED ({_EVAL_LOG_SQL}) SELECT model, fold, epoch, 'eval' AS kind, round(eval_loss, {R}) AS loss, round(accuracy, {R}) AS accuracy, "
    f"round(precision, {R}) AS precision, round(recall, {R}) AS recall, round(f1, {R}) AS f1 FROM l "
    f"UNION ALL SELECT model, fold, epoch, 'train', round(train_loss, {R}), NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM l",
)
def q_epoch_log(spark, sf_dir):
    """Training log of 2 models x 5 folds x 5 epochs, fitted on the fold rows."""
    return _rounded(RU.epoch_log(spark, sf_dir), ["loss", "accuracy", "precision", "recall", "f1"])


@register(
    "eval_log",
    f"SELECT model, fold, epoch, round(f1, {R}) AS f1, round(accuracy, {R}) AS accuracy, round(precision, {R}) AS precision, "
    f"round(recall, {R}) AS recall FROM ({_EVAL_LOG_SQL})",
)
def q_eval_log(spark, sf_dir):
    """The log entries that carry an F1 and an epoch."""
    return _rounded(RU.eval_log(spark, sf_dir), ["f1", "accuracy", "precision", "recall"])


def _stop_sql(log: str) -> str:
    """Early stopping replayed on ``log``: rows of the epochs run, and a
    summary per (model, fold), as CTEs ``ran`` and ``st``."""
    return f"""
l AS MATERIALIZED ({log}),
a AS (SELECT *, max(f1) OVER (PARTITION BY model, fold ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best FROM l),
b AS (SELECT *, prev_best IS NULL OR f1 > prev_best AS improved FROM a),
c AS (SELECT *, sum(CAST(improved AS INTEGER)) OVER (PARTITION BY model, fold ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS streak FROM b),
e AS (SELECT *, row_number() OVER (PARTITION BY model, fold, streak ORDER BY epoch) - 1 AS misses FROM c),
stop AS (SELECT model, fold, min(epoch) AS stop_epoch FROM e WHERE misses >= {RU.PATIENCE} GROUP BY ALL),
ran AS (SELECT e.*, stop.stop_epoch FROM e LEFT JOIN stop USING (model, fold) WHERE stop.stop_epoch IS NULL OR e.epoch <= stop.stop_epoch),
st AS (SELECT model, fold, CAST(count(*) AS BIGINT) AS epochs_run, max(stop_epoch) AS stop_epoch,
              arg_max(epoch, f1 - epoch * 1e-12) AS best_epoch, max(f1) AS best_f1 FROM ran GROUP BY ALL),
res AS (SELECT l.* FROM l JOIN st ON l.model = st.model AND l.fold = st.fold AND l.epoch = st.best_epoch),
best AS (SELECT model, fold AS best_fold, epoch AS best_epoch, f1 AS best_f1 FROM
         (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, fold, epoch) AS rn FROM ran) WHERE rn = 1)
"""


_STOP = "WITH " + _stop_sql(_EVAL_LOG_SQL)


@register("early_stopping", f"{_STOP} SELECT model, fold, epochs_run, stop_epoch, best_epoch, round(best_f1, {R}) AS best_f1 FROM st")
def q_early_stopping(spark, sf_dir):
    """Replay of early stopping (patience 2) per model and fold."""
    return _rounded(RU.stopping(RU.eval_log(spark, sf_dir)), ["best_f1"])


@register(
    "fold_summary",
    f"{_STOP} SELECT model, CAST(count(*) AS BIGINT) AS folds, round(avg(accuracy), {R}) AS accuracy_mean, "
    f"round(stddev_pop(accuracy), {R}) AS accuracy_std, round(avg(f1), {R}) AS f1_mean, round(stddev_pop(f1), {R}) AS f1_std "
    "FROM res GROUP BY model",
)
def q_fold_summary(spark, sf_dir):
    """A11 (M8 summary): mean and population std over folds of each model's
    best-epoch metrics."""
    out = EV.fold_summary(RU.fold_results(RU.eval_log(spark, sf_dir)), ["model"], ["accuracy", "f1"])
    return _rounded(out, ["accuracy_mean", "accuracy_std", "f1_mean", "f1_std"])


@register("best_fold_epoch", f"{_STOP} SELECT model, best_fold, best_epoch, round(best_f1, {R}) AS best_f1 FROM best")
def q_best_fold_epoch(spark, sf_dir):
    """Arg-max of F1 over the (fold, epoch) pairs run, first on ties."""
    return _rounded(RU.best_run(RU.eval_log(spark, sf_dir)), ["best_f1"])


@register(
    "running_best_fold",
    f"{_STOP} SELECT model, fold, round(f1, {R}) AS f1, round(best_before, {R}) AS best_before, f1 > best_before AS is_new_best FROM ("
    "SELECT *, greatest(coalesce(max(f1) OVER (PARTITION BY model ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE), 0.0::DOUBLE) AS best_before "
    "FROM res)",
)
def q_running_best_fold(spark, sf_dir):
    """A fold's model is kept only when its F1 strictly beats every earlier fold."""
    fr = RU.fold_results(RU.eval_log(spark, sf_dir)).select("model", "fold", "f1")
    out = EV.running_best(fr, ["model"], "fold", "f1", 0.0)
    return _rounded(out, ["f1", "best_before"])


_TEST_METRICS_SQL = f"""
WITH sc AS MATERIALIZED ({_RUN_SCORES_SQL}), {_stop_sql(_EVAL_LOG_SQL)},
cm AS (SELECT sc.model, best.best_fold, best.best_epoch, count_if(label=1 AND pred=1) AS tp, count_if(label=0 AND pred=1) AS fp,
       count_if(label=1 AND pred=0) AS fn, count_if(label=0 AND pred=0) AS tn
       FROM sc JOIN best ON sc.model = best.model AND sc.fold = best.best_fold AND sc.epoch = best.best_epoch WHERE is_test GROUP BY ALL)
SELECT model, best_fold, best_epoch, (tp+tn)/(tp+tn+fp+fn) AS accuracy,
       CASE WHEN tp+fp=0 THEN 0.0::DOUBLE ELSE tp/(tp+fp) END AS precision,
       CASE WHEN tp+fn=0 THEN 0.0::DOUBLE ELSE tp/(tp+fn) END AS recall,
       CASE WHEN 2*tp+fp+fn=0 THEN 0.0::DOUBLE ELSE 2*tp/(2*tp+fp+fn) END AS f1, CAST(tp+fn AS BIGINT) AS support FROM cm
"""


@register(
    "best_run_test_metrics",
    f"SELECT model, best_fold, best_epoch, round(accuracy, {R}) AS accuracy, round(precision, {R}) AS precision, "
    f"round(recall, {R}) AS recall, round(f1, {R}) AS f1, support FROM ({_TEST_METRICS_SQL})",
)
def q_best_run_test_metrics(spark, sf_dir):
    """The selected (fold, epoch) run of each model scored on the test split."""
    return _rounded(RU.best_run_test_metrics(spark, sf_dir), ["accuracy", "precision", "recall", "f1"])


_CMP_SQL = (
    f"SELECT {S.normalise_name('model')} AS name, round(accuracy, {R}) AS accuracy, round(f1, {R}) AS f1, "
    f"row_number() OVER (ORDER BY f1 DESC, model) AS position FROM ({_TEST_METRICS_SQL})"
)


@register("model_comparison", _CMP_SQL)
def q_model_comparison(spark, sf_dir):
    """E12 + O2 + P10: one row per model on the test split, ranked by F1."""
    return _rounded(RU.model_comparison(spark, sf_dir), ["accuracy", "f1"])


@register(
    "comparison_unpivot",
    f"SELECT name, metric, score FROM (UNPIVOT (SELECT name, accuracy, f1 FROM ({_CMP_SQL})) ON accuracy, f1 INTO NAME metric VALUE score)",
)
def q_comparison_unpivot(spark, sf_dir):
    """(name, metric, score) long form of the comparison table."""
    cmp = RU.model_comparison(spark, sf_dir).select("name", "accuracy", "f1")
    return _rounded(EV.unpivot_metrics(cmp, ["name"], ["accuracy", "f1"]), ["score"])


# --------------------------------------------------------------------------
# Prediction columns and data-quality checks
# --------------------------------------------------------------------------

from corpusframe.functions import logits as L  # noqa: E402


def _logits_sql() -> str:
    a = f"(({S.hash_unit('id', 'logit0')} - 500) / 100.0::DOUBLE)"
    b = f"(({S.hash_unit('id', 'logit1')} - 500) / 100.0::DOUBLE + label * 2.0::DOUBLE)"
    k = S.hash_unit("id", "special", 20)
    second = (
        f"CASE {k} WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE "
        f"WHEN 3 THEN {a} WHEN 4 THEN 1000.0::DOUBLE ELSE {b} END"
    )
    return f"SELECT id, label, [{a}, {second}] AS logits FROM ({S.LABELLED})"


_SANITISE = (
    "list_transform(logits, lambda x: CASE WHEN isnan(x) THEN 0.0::DOUBLE WHEN x = 'inf'::DOUBLE THEN 10.0::DOUBLE "
    "WHEN x = '-inf'::DOUBLE THEN -10.0::DOUBLE ELSE x END)"
)
_LOGITS_OUT_SQL = f"""
WITH l AS ({_logits_sql()}),
s AS (SELECT id, label, CAST(len(list_filter(logits, lambda x: isnan(x) OR isinf(x))) AS INTEGER) AS non_finite,
             {_SANITISE} AS clean FROM l),
e AS (SELECT *, list_max(clean) AS m FROM s),
x AS (SELECT *, list_transform(clean, lambda v: exp(v - m)) AS ex FROM e),
p AS (SELECT *, list_transform(ex, lambda v: v / list_sum(ex)) AS probs FROM x)
SELECT id, non_finite, list_transform(clean, lambda v: round(v, {R})) AS clean_logits,
       CAST(list_position(clean, list_max(clean)) - 1 AS INTEGER) AS predicted_label,
       list_transform(probs, lambda v: round(v, {R})) AS probabilities,
       round(list_max(probs), {R}) AS confidence, round(probs[2], {R}) AS positive_probability FROM p
"""


@register("logit_postprocess", _LOGITS_OUT_SQL)
def q_logit_postprocess(spark, sf_dir):
    """Q5 + Z2-Z6 on two-class logits of every labelled document (NaN, +-Inf,
    equal and very large logits included)."""
    df = C.labelled_documents(spark, sf_dir).select("id", "label", C.fixed_logits().alias("logits"))
    clean = L.sanitise("logits")
    df = df.select("id", L.count_non_finite("logits").alias("non_finite"), clean.alias("clean"))
    return df.select(
        "id",
        "non_finite",
        F.transform("clean", lambda v: F.round(v, R)).alias("clean_logits"),
        L.argmax("clean").alias("predicted_label"),
        F.transform(L.softmax("clean"), lambda v: F.round(v, R)).alias("probabilities"),
        rnd(L.confidence("clean")).alias("confidence"),
        rnd(L.positive_probability("clean", strict=True)).alias("positive_probability"),
    )


_CHECKS_SQL = (
    f"WITH f AS ({S.FINALIZED}), l AS ({_logits_sql()}) "
    "SELECT 'finite_link_count' AS check, CAST(count_if(link_count IS NULL OR isnan(link_count) OR isinf(link_count)) AS BIGINT) AS failures FROM f UNION ALL "
    "SELECT 'finite_email_length', CAST(count_if(email_length IS NULL OR isnan(email_length) OR isinf(email_length)) AS BIGINT) FROM f UNION ALL "
    "SELECT 'label_not_null', CAST(count_if(label IS NULL) AS BIGINT) FROM f UNION ALL "
    "SELECT 'label_in_0_1', CAST(count_if(label NOT IN (0, 1)) AS BIGINT) FROM f UNION ALL "
    "SELECT 'two_classes', CAST(count(DISTINCT label) < 2 AS BIGINT) FROM f UNION ALL "
    "SELECT 'feature_arity', CAST(count_if(len([link_count, email_length]) <> 2) AS BIGINT) FROM f UNION ALL "
    "SELECT 'finite_logits', CAST(count_if(len(list_filter(logits, lambda x: isnan(x) OR isinf(x))) > 0) AS BIGINT) FROM l"
)


def _checked_rows(spark, sf_dir):
    df = C.finalized(spark, sf_dir).withColumn("logits", C.fixed_logits())
    return df.withColumn("features", F.array(F.col("link_count").cast("double"), F.col("email_length").cast("double")))


_CHECKED = dict(feature_cols=["link_count", "email_length"], label_col="label", logits_col="logits", features_array_col="features")


@register("quality_checks", _CHECKS_SQL)
def q_quality_checks(spark, sf_dir):
    """Q1-Q6 in one pass over the finalized corpus (Q5 over its logits)."""
    return profile.quality_checks(_checked_rows(spark, sf_dir), **_CHECKED)


@register("checked_write", _CHECKS_SQL)
def q_checked_write(spark, sf_dir):
    """Q1-Q6 counted while the rows are written: no second pass."""
    failures = profile.write_checked(_checked_rows(spark, sf_dir), scratch_path(spark, "checked-rows"), **_CHECKED)
    return spark.createDataFrame(list(failures.items()), "check string, failures long")


# --------------------------------------------------------------------------
# Profiles (A3, A5-A8)
# --------------------------------------------------------------------------

@register(
    "missing_counts",
    f"SELECT 'cleaned_text' AS column, CAST(count_if(cleaned_text IS NULL) AS BIGINT) AS missing FROM ({S.FINALIZED}) UNION ALL "
    f"SELECT 'label', CAST(count_if(label IS NULL) AS BIGINT) FROM ({S.FINALIZED}) UNION ALL "
    f"SELECT 'link_count', CAST(count_if(link_count IS NULL) AS BIGINT) FROM ({S.FINALIZED}) UNION ALL "
    f"SELECT 'email_length', CAST(count_if(email_length IS NULL) AS BIGINT) FROM ({S.FINALIZED})",
)
def q_missing_counts(spark, sf_dir):
    """A3 per column of the finalized corpus."""
    f = C.finalized(spark, sf_dir)
    return profile.missing_counts(f, ["cleaned_text", "label", "link_count", "email_length"])


def _describe_cols_sql(src: str, cols) -> str:
    parts = [f"SELECT '{c}' AS measure, CAST({c} AS DOUBLE) AS v FROM ({src})" for c in cols]
    return (
        f"SELECT measure, CAST(count(v) AS BIGINT) AS count, round(avg(v), {R}) AS mean, round(stddev_samp(v), {R}) AS std, "
        f"min(v) AS min, round(quantile_cont(v, 0.25::DOUBLE), {R}) AS p25, round(quantile_cont(v, 0.5::DOUBLE), {R}) AS p50, "
        f"round(quantile_cont(v, 0.75::DOUBLE), {R}) AS p75, max(v) AS max FROM ({' UNION ALL '.join(parts)}) GROUP BY measure"
    )


@register("feature_describe", _describe_cols_sql(S.FINALIZED, ["link_count", "email_length"]))
def q_feature_describe(spark, sf_dir):
    """A5: describe of the two structured features."""
    out = profile.describe(C.finalized(spark, sf_dir), ["link_count", "email_length"])
    return _rounded(out, ["mean", "std", "p25", "p50", "p75"])


_MISCLASSIFIED_SQL = f"SELECT * FROM ({_SCORED}) WHERE label <> predicted_label"


@register(
    "misclassified_length_stats",
    f"SELECT CAST(min(email_length) AS BIGINT) AS min, CAST(max(email_length) AS BIGINT) AS max, "
    f"round(avg(email_length), {R}) AS mean FROM ({_MISCLASSIFIED_SQL})",
)
def q_misclassified_length_stats(spark, sf_dir):
    """A6 over the misclassified rows."""
    m = C.scored(spark, sf_dir).filter(F.col("label") != F.col("predicted_label"))
    return _rounded(profile.min_max_mean(m, "email_length"), ["mean"])


@register(
    "flag_prediction_counts",
    f"WITH m AS (SELECT predicted_label, {S.flags('cleaned_text')} FROM ({_MISCLASSIFIED_SQL})), "
    "s AS (SELECT 'has_link' AS flag, has_link AS flag_value, predicted_label FROM m UNION ALL "
    "SELECT 'has_login', has_login, predicted_label FROM m UNION ALL SELECT 'has_urgent', has_urgent, predicted_label FROM m), "
    "c AS (SELECT flag, flag_value, predicted_label, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY ALL) "
    "SELECT *, row_number() OVER (PARTITION BY flag, flag_value ORDER BY n DESC, predicted_label) AS position FROM c",
)
def q_flag_prediction_counts(spark, sf_dir):
    """T8 + A7: keyword flags of misclassified rows against the prediction."""
    m = C.scored(spark, sf_dir).filter(F.col("label") != F.col("predicted_label"))
    m = m.select("predicted_label", *T.keyword_flags("cleaned_text"))
    out = profile.flag_value_counts(m, list(T.FLAG_PATTERNS), "predicted_label")
    return out.withColumn("position", F.col("position").cast("bigint"))


@register(
    "error_length_histogram",
    f"WITH e AS (SELECT CASE WHEN label = 0 THEN 'false_positive' ELSE 'false_negative' END AS error_type, email_length "
    f"FROM ({_MISCLASSIFIED_SQL})), "
    "st0 AS (SELECT error_type, min(email_length) AS lo0, max(email_length) AS hi0 FROM e GROUP BY error_type), "
    "st AS (SELECT error_type, CAST(CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS DOUBLE) AS lo, "
    "CAST(CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS DOUBLE) AS hi FROM st0), "
    "b AS (SELECT e.error_type, CAST(least(floor((email_length - lo) * 10.0::DOUBLE / (hi - lo)), 9) AS INTEGER) AS bin FROM e JOIN st USING (error_type)), "
    "c AS (SELECT error_type, bin, count(*) AS n FROM b GROUP BY ALL), "
    "g AS (SELECT st.*, CAST(r.range AS INTEGER) AS bin FROM st CROSS JOIN range(10) r) "
    f"SELECT g.error_type, g.bin, round(lo + bin * (hi - lo) / 10.0::DOUBLE, {R}) AS bin_lo, "
    f"round(CASE WHEN bin = 9 THEN hi ELSE lo + (bin + 1) * (hi - lo) / 10.0::DOUBLE END, {R}) AS bin_hi, "
    "CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM g LEFT JOIN c USING (error_type, bin)",
)
def q_error_length_histogram(spark, sf_dir):
    """10-bin length histograms of false positives and false negatives."""
    from corpusframe.operators.errors import error_rows

    e = error_rows(C.scored(spark, sf_dir))
    return _rounded(profile.histogram(e, "email_length", "error_type", 10), ["bin_lo", "bin_hi"])


# --------------------------------------------------------------------------
# Features (G1-G10)
# --------------------------------------------------------------------------

from corpusframe.operators import features as G  # noqa: E402
from corpusframe.plans import error_analysis as EA  # noqa: E402

VOCAB_SIZE = B.VOCAB_SIZE
ENCODING_LENGTH = 320  # the shorter of the two training lengths

_TEXT_FOLDS_SQL = S.split_sql(f"SELECT id, cleaned_text, label FROM ({S.FINALIZED})", RU.TEST_SIZE, RU.K_FOLDS)
_TRAIN_VOCAB_SQL = S.vocab_sql(f"SELECT * FROM ({_TEXT_FOLDS_SQL}) WHERE NOT is_test", S.tokens("cleaned_text"), VOCAB_SIZE)


def _terms(spark, sf_dir):
    """(id, is_test, terms) of every labelled text, stored: one pass over the
    corpus for the fit and for what it is applied to."""
    rows = G.with_terms(B.split_rows(spark, sf_dir), "cleaned_text").select("id", "is_test", "terms")
    return IO.materialize(rows, scratch_path(spark, "split-terms"), force=True)


def _train_vocab(terms):
    return G.fit_vocabulary(terms.filter(~F.col("is_test")).select("terms"), "terms", VOCAB_SIZE)


@register(
    "tfidf_vocabulary",
    f"SELECT term, tf, df, round(idf, {R}) AS idf, index, rank FROM ({_TRAIN_VOCAB_SQL})",
)
def q_tfidf_vocabulary(spark, sf_dir):
    """G1 + G3 + G4: the 5000 most frequent terms of the training split and their idf."""
    return _rounded(_train_vocab(_terms(spark, sf_dir)), ["idf"])


@register(
    "tfidf_weights",
    f"SELECT id, term, round(weight, {R}) AS weight FROM ("
    f"{S.tfidf_long_sql(f'SELECT * FROM ({_TEXT_FOLDS_SQL}) WHERE is_test', 'id', S.tokens('cleaned_text'), _TRAIN_VOCAB_SQL)})",
)
def q_tfidf_weights(spark, sf_dir):
    """The test split transformed with the training vocabulary."""
    rows = _terms(spark, sf_dir)
    return _rounded(G.tfidf_rows(rows.filter("is_test"), ["id"], "terms", _train_vocab(rows), VOCAB_SIZE), ["weight"])


@register(
    "bigram_vocabulary",
    "SELECT term, tf, df, round(idf, 6) AS idf FROM ("
    + S.term_stats_sql(f"SELECT {S.no_stop_tokens('text')} AS toks FROM documents", S.bigrams("toks"))
    + ")",
)
def q_bigram_vocabulary(spark, sf_dir):
    """G2 + G3 + G4: every bigram (after stop words) of all documents."""
    d = G.with_terms(C.table(spark, sf_dir, "documents"), "text", "terms", (2, 2), S.STOP_WORDS).select("terms")
    return _rounded(G.fit_vocabulary(d, "terms", None).select("term", "tf", "df", "idf"), ["idf"])


_SCALE_SRC = f"SELECT * FROM ({_FOLDS_SQL})"


@register(
    "standard_scaled_features",
    f"WITH f AS ({_SCALE_SRC}), s AS (SELECT avg(link_count) AS ml, stddev_pop(link_count) AS sl, "
    "avg(email_length) AS me, stddev_pop(email_length) AS se FROM f WHERE NOT is_test) "
    f"SELECT id, is_test, round((link_count - ml) / CASE WHEN sl = 0 THEN 1.0::DOUBLE ELSE sl END, {R}) AS link_count_scaled, "
    f"round((email_length - me) / CASE WHEN se = 0 THEN 1.0::DOUBLE ELSE se END, {R}) AS email_length_scaled FROM f, s",
)
def q_standard_scaled_features(spark, sf_dir):
    """Standard scaler fitted on the training split, applied to all rows."""
    f = RU.fold_assignments(spark, sf_dir)
    cols = ["link_count", "email_length"]
    stats = G.fit_standard_scaler(f.filter(~F.col("is_test")), cols)
    out = G.apply_standard_scaler(f, stats, cols).select("id", "is_test", "link_count_scaled", "email_length_scaled")
    return _rounded(out, ["link_count_scaled", "email_length_scaled"])


@register(
    "minmax_scaled_features",
    f"WITH f AS ({_SCALE_SRC}), s AS (SELECT min(link_count)::DOUBLE AS lo_l, max(link_count)::DOUBLE AS hi_l, "
    "min(email_length)::DOUBLE AS lo_e, max(email_length)::DOUBLE AS hi_e FROM f WHERE NOT is_test) "
    f"SELECT id, is_test, round((link_count - lo_l) / CASE WHEN hi_l = lo_l THEN 1.0::DOUBLE ELSE hi_l - lo_l END, {R}) AS link_count_scaled, "
    f"round((email_length - lo_e) / CASE WHEN hi_e = lo_e THEN 1.0::DOUBLE ELSE hi_e - lo_e END, {R}) AS email_length_scaled FROM f, s",
)
def q_minmax_scaled_features(spark, sf_dir):
    """Min-max scaler fitted on the training split, no clamping of test rows."""
    f = RU.fold_assignments(spark, sf_dir)
    cols = ["link_count", "email_length"]
    stats = G.fit_minmax_scaler(f.filter(~F.col("is_test")), cols)
    out = G.apply_minmax_scaler(f, stats, cols).select("id", "is_test", "link_count_scaled", "email_length_scaled")
    return _rounded(out, ["link_count_scaled", "email_length_scaled"])


@register(
    "token_encoding",
    f"WITH v AS ({_TRAIN_VOCAB_SQL}), d AS (SELECT id, {S.tokens('cleaned_text')} AS toks FROM ({S.FINALIZED})), "
    "u AS (SELECT id, unnest(generate_series(1, len(toks))) AS pos, unnest(toks) AS term FROM d), "
    f"e AS (SELECT u.id, list(CAST(coalesce(v.rank + 2, 1) AS INTEGER) ORDER BY u.pos) AS ids FROM u LEFT JOIN v USING (term) "
    f"WHERE u.pos <= {ENCODING_LENGTH} GROUP BY u.id) "
    f"SELECT d.id, list_resize(coalesce(e.ids, []::INTEGER[]), {ENCODING_LENGTH}, 0) AS input_ids, "
    f"list_resize(list_transform(coalesce(e.ids, []::INTEGER[]), lambda x: 1), {ENCODING_LENGTH}, 0) AS attention_mask "
    "FROM d LEFT JOIN e USING (id)",
)
def q_token_encoding(spark, sf_dir):
    """Fixed-length (320) token ids and attention mask of every labelled
    document over the training vocabulary."""
    rows = _terms(spark, sf_dir)
    return G.encode_tokens(rows, "id", "terms", _train_vocab(rows), ENCODING_LENGTH)


@register(
    "dense_fusion",
    "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), "
    "f AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm, list_avg(v) AS mean FROM e), "
    "s AS (SELECT avg(norm) AS mn, stddev_pop(norm) AS sn, avg(mean) AS mm, stddev_pop(mean) AS sm FROM f) "
    f"SELECT vec_id, list_transform(list_concat(v, [greatest(least((norm - mn) / CASE WHEN sn = 0 THEN 1.0::DOUBLE ELSE sn END, 10.0::DOUBLE), -10.0::DOUBLE), "
    f"greatest(least((mean - mm) / CASE WHEN sm = 0 THEN 1.0::DOUBLE ELSE sm END, 10.0::DOUBLE), -10.0::DOUBLE)]), lambda x: round(x, {R})) AS fused FROM f, s",
)
def q_dense_fusion(spark, sf_dir):
    """Each embedding followed by its two scaled, clamped summary features."""
    e = C.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    e = e.select(
        "vec_id", "v",
        F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"),
        (F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")).alias("mean"),
    )
    stats = G.fit_standard_scaler(e, ["norm", "mean"])
    e = G.apply_standard_scaler(e, stats, ["norm", "mean"])
    fused = G.fuse_dense(F.col("v"), [F.col("norm_scaled"), F.col("mean_scaled")])
    return e.select("vec_id", F.transform(fused, lambda x: F.round(x, R)).alias("fused"))


# --------------------------------------------------------------------------
# Error analysis
# --------------------------------------------------------------------------

_ERRORS_SQL = (
    f"SELECT id, CASE WHEN label = 0 THEN 'false_positive' ELSE 'false_negative' END AS error_type, nullif(cleaned_text, '') AS cleaned_text "
    f"FROM ({_SCORED}) WHERE label <> predicted_label"
)
_ERR_TERMS = S.bigrams("toks")
_ERR_TOKS = f"SELECT id, error_type, {S.no_stop_tokens('cleaned_text')} AS toks FROM ({_ERRORS_SQL}) WHERE cleaned_text IS NOT NULL"
_ERR_VOCAB = S.vocab_sql(_ERR_TOKS, _ERR_TERMS, EA.BIGRAM_MAX_FEATURES)
_ERR_MEANS_SQL = f"""
WITH w AS ({S.tfidf_long_sql(_ERR_TOKS, "id, error_type", _ERR_TERMS, _ERR_VOCAB)}),
s AS (SELECT error_type, term, sum(weight) AS s FROM w GROUP BY ALL),
n AS (SELECT error_type, count(*) AS n FROM ({_ERRORS_SQL}) WHERE cleaned_text IS NOT NULL GROUP BY error_type),
g AS (SELECT v.term, n.error_type, n.n FROM ({_ERR_VOCAB}) v CROSS JOIN n)
SELECT g.error_type, g.term, coalesce(s.s, 0.0::DOUBLE) / g.n AS mean_tfidf FROM g LEFT JOIN s USING (error_type, term)
"""


@register("error_tfidf_means", f"SELECT error_type, term, round(mean_tfidf, {R}) AS mean_tfidf FROM ({_ERR_MEANS_SQL})")
def q_error_tfidf_means(spark, sf_dir):
    """A9 (+ G2-G5): mean bigram TF-IDF per class with a vocabulary fitted on
    false positives and false negatives together."""
    return _rounded(EA.mean_tfidf(spark, sf_dir), ["mean_tfidf"])


@register(
    "error_top_terms",
    f"SELECT error_type, term, round(mean_tfidf, {R}) AS mean_tfidf, position FROM ("
    f"SELECT *, row_number() OVER (PARTITION BY error_type ORDER BY mean_tfidf DESC, term) AS position FROM ({_ERR_MEANS_SQL})) "
    f"WHERE position <= {EA.TOP_TERMS}",
)
def q_error_top_terms(spark, sf_dir):
    """O1: the 10 terms of highest mean TF-IDF per class."""
    return _rounded(EA.top_terms(spark, sf_dir), ["mean_tfidf"])


@register(
    "error_terms_filtered",
    f"SELECT error_type, term, round(mean_tfidf, {R}) AS mean_tfidf FROM ({_ERR_MEANS_SQL}) "
    f"WHERE length(term) >= 3 AND NOT {S.is_date_token('term')}",
)
def q_error_terms_filtered(spark, sf_dir):
    """F6 (+ T10): term scores without short terms and date tokens."""
    return _rounded(EA.filtered_terms(spark, sf_dir), ["mean_tfidf"])


@register(
    "error_word_frequency",
    f"WITH w AS (SELECT error_type, unnest({S.words('cleaned_text')}) AS word FROM ({_ERRORS_SQL}) WHERE cleaned_text IS NOT NULL), "
    f"c AS (SELECT error_type, word, CAST(count(*) AS BIGINT) AS n FROM w WHERE length(word) >= 3 AND NOT list_contains({S.STOP}, lower(word)) GROUP BY ALL) "
    "SELECT error_type, word, n FROM c",
)
def q_error_word_frequency(spark, sf_dir):
    """A13 (+ F5, T9, T12): word counts per error class."""
    return EA.word_frequencies(spark, sf_dir)


# --------------------------------------------------------------------------
# Learned models (M1-M8, Z1, Z7, G8): fitted on the data, checked by rows
# and invariants (tests/test_models.py); the fixed batch scorer has SQL.
# --------------------------------------------------------------------------

from corpusframe.plans import learned as LM  # noqa: E402


@register("learned_predictions")
def q_learned_predictions(spark, sf_dir):
    """M1-M5 + G8 + Z1: test-split predictions of naive Bayes, logistic
    regression, calibrated RBF SVM, random forest and boosted trees."""
    return LM.test_predictions(spark, sf_dir)


@register("learned_comparison")
def q_learned_comparison(spark, sf_dir):
    """E12 over the learned models."""
    return LM.comparison(spark, sf_dir)


@register("inference_times")
def q_inference_times(spark, sf_dir):
    """Z7 over the learned models."""
    return LM.inference_times(spark, sf_dir)


@register("cv_grid_search")
def q_cv_grid_search(spark, sf_dir):
    """M7: logistic-regression grid over the 5 exact folds."""
    return LM.grid_search(spark, sf_dir)


@register("kfold_runs")
def q_kfold_runs(spark, sf_dir):
    """M8 + S5 + S6: per-fold validation metrics of k-fold training."""
    return LM.k_fold(spark, sf_dir)


_STORED_SQL = f"""
WITH sc AS MATERIALIZED (SELECT *, own_fold = fold AS held FROM ({_RUN_SCORES_SQL}) WHERE model = '{RU.MODELS[0][0]}' AND epoch = {RU.EPOCHS} AND (is_test OR own_fold = fold)),
m AS (SELECT fold, is_test, count_if(label=1 AND pred=1) AS tp, count_if(label=0 AND pred=1) AS fp, count_if(label=1 AND pred=0) AS fn,
      count_if(label=0 AND pred=0) AS tn FROM sc GROUP BY ALL),
e AS (SELECT *, (tp+tn)/(tp+tn+fp+fn) AS accuracy, CASE WHEN tp+fp=0 THEN 0.0::DOUBLE ELSE tp/(tp+fp) END AS precision,
      CASE WHEN tp+fn=0 THEN 0.0::DOUBLE ELSE tp/(tp+fn) END AS recall, CASE WHEN 2*tp+fp+fn=0 THEN 0.0::DOUBLE ELSE 2*tp/(2*tp+fp+fn) END AS f1 FROM m),
b AS (SELECT fold, f1 FROM e WHERE NOT is_test ORDER BY f1 DESC, fold LIMIT 1)
SELECT 'naive_bayes' AS model, b.fold AS best_fold, round(b.f1, {R}) AS fold_f1, round(accuracy, {R}) AS accuracy, round(precision, {R}) AS precision,
       round(recall, {R}) AS recall, round(e.f1, {R}) AS f1, CAST(tp+fn AS BIGINT) AS support FROM e JOIN b USING (fold) WHERE is_test
"""


@register("stored_best_run", _STORED_SQL)
def q_stored_best_run(spark, sf_dir):
    """Naive Bayes of every fold stored; the best one loaded with the stored
    feature pipeline and scored on the test split."""
    return _rounded(LM.stored_best_run(spark, sf_dir), ["fold_f1", "accuracy", "precision", "recall", "f1"])


@register("stored_best_logistic")
def q_stored_best_logistic(spark, sf_dir):
    """E11 for logistic regression."""
    return LM.stored_best_run(spark, sf_dir, "logistic_regression")


@register("boosting_log")
def q_boosting_log(spark, sf_dir):
    """Metrics after every round of boosted trees, per fold."""
    return LM.boosting_log(spark, sf_dir)


@register("boosting_stops")
def q_boosting_stops(spark, sf_dir):
    """Where the boosted fits of the folds would stop."""
    return LM.boosting_stops(spark, sf_dir)


@register("fusion_head")
def q_fusion_head(spark, sf_dir):
    """M6: joint head over embedding and projected summary features."""
    return LM.fusion_head(spark, sf_dir)


_W = ", ".join(f"{w}::DOUBLE" for w in LM.scorer_weights(LM.EMBEDDING_DIM))


@register(
    "batch_scoring",
    f"WITH s AS (SELECT vec_id, list_dot_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), [{_W}]) AS logit "
    "FROM embeddings) SELECT vec_id, round(logit, 6) AS logit, CAST(logit > 0 AS INTEGER) AS predicted_label FROM s",
)
def q_batch_scoring(spark, sf_dir):
    """A batch function over Arrow batches of 64 embeddings."""
    return LM.batch_scores(spark, sf_dir)


# --------------------------------------------------------------------------
# Sources and sinks (S1, S2, S4, S7, S8): write under the shared checkpoint
# folder, read back.
# --------------------------------------------------------------------------

from corpusframe.session import scratch_path  # noqa: E402
from corpusframe.sources import files as IO  # noqa: E402


@register(
    "csv_roundtrip",
    f"SELECT row_id, origin, label, nullif(cleaned_text, '') AS cleaned_text FROM ({S.DEDUPED})",
)
def q_csv_roundtrip(spark, sf_dir):
    """S2 then S1: the de-duplicated corpus through headered, quoted,
    multi-line CSV (empty text reads back as null, as in pandas)."""
    df = CL.deduplicated_corpus(spark, sf_dir).select("row_id", "origin", "label", "cleaned_text")
    path = IO.write_csv(df, scratch_path(spark, "csv-roundtrip"))
    return IO.read_csv(spark, path, "row_id bigint, origin string, label int, cleaned_text string")


@register(
    "csv_quarantine",
    "SELECT CASE WHEN lang = 'en' THEN doc_id END AS doc_id, CASE WHEN lang = 'en' THEN source END AS source, "
    "CASE lang WHEN 'en' THEN NULL WHEN 'fr' THEN doc_id || ',' || lang WHEN 'de' THEN doc_id || ',' || lang || ',' || source || ',' || n_chars "
    """WHEN 'es' THEN '"' || doc_id || ',' || lang || ',' || source ELSE 'x' || doc_id || ',' || lang || ',' || source END AS raw FROM documents""",
)
def q_csv_quarantine(spark, sf_dir):
    """Malformed records are kept apart in the one conversion to parquet. The
    lines stand for a CSV source: French ones lack a field, German ones have one
    too many, Spanish ones an open quote, others (not English) no number."""
    line = F.concat_ws(",", "doc_id", "lang", "source")
    line = F.when(F.col("lang") == "fr", F.concat_ws(",", "doc_id", "lang")).when(F.col("lang") == "de", F.concat_ws(",", line, "n_chars")).when(
        F.col("lang") == "es", F.concat(F.lit('"'), line)).when(F.col("lang") != "en", F.concat(F.lit("x"), line)).otherwise(line)
    path = scratch_path(spark, "csv-lines")
    C.table(spark, sf_dir, "documents").select(line.alias("value")).write.text(path)
    schema = "doc_id bigint, lang string, source string"
    rows, apart = IO.convert_csv(spark, path, scratch_path(spark, "csv-converted"), schema, multi_line=False, header=False)
    return rows.select("doc_id", "source", F.lit(None).cast("string").alias("raw")).unionByName(apart.select("raw"), allowMissingColumns=True)


@register("materialized_corpus", f"SELECT * FROM ({S.FINALIZED})")
def q_materialized_corpus(spark, sf_dir):
    """Compute once, then load from the stored table."""
    path = scratch_path(spark, "finalized")
    IO.materialize(C.finalized(spark, sf_dir), path)
    return IO.materialize(C.finalized(spark, sf_dir), path)  # second call loads


@register("fold_tables", f"SELECT id, label, fold FROM ({_FOLDS_SQL}) WHERE NOT is_test")
def q_fold_tables(spark, sf_dir):
    """The training rows of every fold as one table partitioned by fold."""
    folds = RU.fold_assignments(spark, sf_dir).filter(~F.col("is_test")).select("id", "label", "fold")
    path = IO.write_partitioned(folds, scratch_path(spark, "fold-tables"), ["fold"])
    return spark.read.parquet(path).select("id", "label", F.col("fold").cast("int").alias("fold"))


@register(
    "metrics_sink",
    f"UNPIVOT (SELECT 'fixed_scorer' AS run, CAST(accuracy AS DOUBLE) AS accuracy, CAST(precision AS DOUBLE) AS precision, "
    f"CAST(recall AS DOUBLE) AS recall, CAST(f1 AS DOUBLE) AS f1, CAST(support AS DOUBLE) AS support "
    f"FROM ({ORACLE['binary_metrics']})) ON accuracy, precision, recall, f1, support INTO NAME metric VALUE value",
)
def q_metrics_sink(spark, sf_dir):
    """A long (run, metric, value) table written as JSON lines and read back."""
    m = q_binary_metrics(spark, sf_dir).select(F.lit("fixed_scorer").alias("run"), "*")
    long = IO.long_metrics(m, ["run"], ["accuracy", "precision", "recall", "f1", "support"])
    path = IO.write_metrics(long, scratch_path(spark, "metrics"))
    return spark.read.schema("run string, metric string, value double").json(path)


# --------------------------------------------------------------------------
# Export, report, resume, ablation, first rows, quarantine
# --------------------------------------------------------------------------

@register(
    "misclassified_export",
    f"SELECT id, nullif(cleaned_text, '') AS cleaned_text, label, link_count, email_length, predicted_label, "
    f"round(greatest(score, 1 - score), {R}) AS confidence FROM ({_MISCLASSIFIED_SQL})",
)
def q_misclassified_export(spark, sf_dir):
    """The misclassified rows as the exported CSV table holds them."""
    rows = IO.read_csv(spark, EA.error_export(spark, sf_dir), EA.EXPORT_SCHEMA)
    return _rounded(rows, ["confidence"])


_FOLD_SCORED_SQL = f"SELECT s.*, f.fold FROM ({_SCORED}) s JOIN ({_FOLDS_SQL}) f USING (id) WHERE NOT f.is_test"


@register(
    "fold_report_sink",
    f"""
WITH s AS ({_FOLD_SCORED_SQL}), cls AS (SELECT DISTINCT fold, unnest([0, 1]) AS c FROM s),
p0 AS (SELECT cls.fold, cls.c, count_if(label = c) AS support, count_if(predicted_label = c) AS predicted,
       count_if(label = c AND predicted_label = c) AS tp FROM cls JOIN s ON s.fold = cls.fold GROUP BY ALL),
p AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0::DOUBLE ELSE tp / predicted END AS precision, CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE tp / support END AS recall,
      CASE WHEN predicted + support = 0 THEN 0.0::DOUBLE ELSE 2 * tp / (predicted + support) END AS f1_score FROM p0 WHERE predicted + support > 0),
o AS (SELECT fold, CAST(c AS VARCHAR) AS row_name, precision, recall, f1_score, CAST(support AS BIGINT) AS support FROM p
      UNION ALL SELECT fold, 'accuracy', NULL, NULL, sum(tp) / sum(support), CAST(sum(support) AS BIGINT) FROM p GROUP BY fold
      UNION ALL SELECT fold, 'macro avg', avg(precision), avg(recall), avg(f1_score), CAST(sum(support) AS BIGINT) FROM p GROUP BY fold
      UNION ALL SELECT fold, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                       sum(f1_score * support) / sum(support), CAST(sum(support) AS BIGINT) FROM p GROUP BY fold)
SELECT fold, row_name, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1_score, 4) AS f1_score, support,
       '{RU.SEED}' AS seed, '{RU.TEST_SIZE}' AS test_size, '2026-01-01 00:00:00' AS written_at FROM o
""",
)
def q_fold_report_sink(spark, sf_dir):
    """Every fold's classification report with the run's parameters and a
    time, written as JSON lines and read back."""
    folds = RU.fold_assignments(spark, sf_dir).filter(~F.col("is_test")).select("id", "fold")
    report = EV.classification_report(C.scored(spark, sf_dir).join(folds, "id"), group_cols=["fold"])
    table = IO.run_report(report, {"seed": RU.SEED, "test_size": RU.TEST_SIZE}, ["fold"], "2026-01-01 00:00:00")
    path = IO.write_metrics(table, scratch_path(spark, "fold-report"))
    schema = "fold int, row_name string, precision double, recall double, f1_score double, support bigint, parameters map<string,string>, written_at timestamp"
    back = spark.read.schema(schema).json(path)
    return back.select(
        "fold", "row_name", "precision", "recall", "f1_score", "support", F.col("parameters")["seed"].alias("seed"),
        F.col("parameters")["test_size"].alias("test_size"), F.date_format("written_at", "yyyy-MM-dd HH:mm:ss").alias("written_at"),
    )


@register(
    "pending_folds",
    f"SELECT fold, label, CAST(count(*) AS BIGINT) AS n FROM ({_FOLDS_SQL}) WHERE NOT is_test AND fold NOT IN (1, 3) GROUP BY ALL",
)
def q_pending_folds(spark, sf_dir):
    """Fold results are stored for two folds; what is planned and not yet
    stored remains."""
    planned = RU.fold_assignments(spark, sf_dir).filter(~F.col("is_test")).groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))
    path = IO.write_partitioned(planned.filter(F.col("fold").isin(1, 3)), scratch_path(spark, "done-folds"), ["fold"])
    return IO.pending(planned, path, ["fold"])


@register("first_documents", "SELECT doc_id, source, n_chars FROM documents ORDER BY doc_id LIMIT 1000")
def q_first_documents(spark, sf_dir):
    """O3: the first 1000 documents in id order (the feature is the limit)."""
    return IO.first_rows(C.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id", 1000)


@register(
    "label_quarantine",
    "WITH t AS (SELECT doc_id, source, replace(source, 'src', '') AS a, CASE WHEN lang = 'en' THEN replace(source, 'src', '') ELSE source END AS raw FROM documents) "
    "SELECT doc_id, raw, TRY_CAST(raw AS INTEGER) AS label, TRY_CAST(raw AS INTEGER) IS NULL AS quarantined FROM t",
)
def q_label_quarantine(spark, sf_dir):
    """Labels that are no ints are set aside, not lost (the source number
    stands for a label; it is only an int in English rows)."""
    d = C.table(spark, sf_dir, "documents")
    number = F.replace("source", F.lit("src"), F.lit(""))
    raw = d.select("doc_id", F.when(F.col("lang") == "en", number).otherwise(F.col("source")).alias("raw"))
    good, bad = T.quarantine(raw.withColumn("label", F.col("raw")), "label")
    return good.withColumn("quarantined", F.lit(False)).unionByName(
        bad.withColumn("label", F.lit(None).cast("int")).withColumn("quarantined", F.lit(True))
    )


_NB_SQL = f"""
WITH {_BASE_SQL},
c AS (SELECT k, sum(CASE WHEN label = 1 THEN v ELSE 0 END) AS c1, sum(CASE WHEN label = 0 THEN v ELSE 0 END) AS c0 FROM x JOIN f USING (id) WHERE NOT is_test GROUP BY k),
t AS (SELECT sum(c1) AS n1, sum(c0) AS n0 FROM c),
th AS (SELECT c.k, ln((c1 + 1) / (n1 + n.k)) - ln((c0 + 1) / (n0 + n.k)) AS d FROM c, t, n),
pr AS (SELECT ln((count_if(label = 1) + 1.0::DOUBLE) / (count_if(label = 0) + 1.0::DOUBLE)) AS p FROM f WHERE NOT is_test),
s AS (SELECT x.id, p + sum(v * d) AS m FROM x JOIN th USING (k), pr GROUP BY x.id, p),
s0 AS (SELECT x.id, p + sum(CASE WHEN k IN (' link', ' length') THEN 0 ELSE v * d END) AS m FROM x JOIN th USING (k), pr GROUP BY x.id, p)
"""


@register(
    "naive_bayes_predictions",
    f"{_NB_SQL} SELECT f.id, f.label, CAST(m > 0 AS INTEGER) AS predicted_label, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-m)), {R}) AS score "
    "FROM f JOIN s USING (id) WHERE is_test",
)
def q_naive_bayes_predictions(spark, sf_dir):
    """M1 + Z1: multinomial naive Bayes over TF-IDF and the scaled numeric
    features, on the test split."""
    return _rounded(LM.naive_bayes_predictions(spark, sf_dir), ["score"])


@register(
    "feature_ablation",
    f"{_NB_SQL} SELECT 'all' AS features_used, f.id, f.label, CAST(m > 0 AS INTEGER) AS predicted_label FROM f JOIN s USING (id) WHERE is_test "
    "UNION ALL SELECT 'text only', f.id, f.label, CAST(m > 0 AS INTEGER) FROM f JOIN s0 USING (id) WHERE is_test",
)
def q_feature_ablation(spark, sf_dir):
    """Naive Bayes with and without its numeric features."""
    return LM.ablation(spark, sf_dir)
