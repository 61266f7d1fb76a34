"""Feature engineering.

TF-IDF follows the usual library conventions: terms are lowercase runs of at
least two word characters (G1), optionally stop-word filtered and joined into
n-grams (G2); the vocabulary keeps the ``max_features`` terms of highest
corpus frequency, ties by term (G3); ``idf = ln((1 + n) / (1 + df)) + 1`` over
the fitting documents (G4); weights are ``tf * idf`` scaled to unit L2 norm
per document, unseen terms dropped (G5).

Plan shape:
* fitting is one aggregation over the rows' own term counts (one explode, one
  shuffle, hot terms collapse before it) and a bounded top-k;
* with a vocabulary of at most ``max_features`` terms, documents are weighed in
  place (``CountVectorizerModel`` over the fitted vocabulary, idf product,
  normaliser), and encoded in place; without a bound, term counts taken inside
  each row meet the vocabulary in a join, and one shuffle gives the L2 norm.

Scalers fit one aggregate row and apply it as a one-row broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from corpusframe.functions import text as T
from corpusframe.operators.ranking import hash_rank
from corpusframe.session import scratch_path
from corpusframe.sources.files import materialize

# ---------------------------------------------------------------- terms


def ngrams(tokens_col: str, n: int) -> Column:
    """Space-joined n-grams of a token-array column (empty when shorter than
    n). Pass a column, not an expression: the lambda reads it per element."""
    tokens = F.col(tokens_col)
    starts = F.slice(tokens, F.lit(1), F.size(tokens) - n + 1)
    grams = F.transform(starts, lambda t, i: F.concat_ws(" ", t, *[F.get(tokens, i + k) for k in range(1, n)]))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def with_terms(
    df: DataFrame,
    text_col: str,
    out_col: str = "terms",
    ngram_range: tuple[int, int] = (1, 1),
    stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """G1 + G2: add ``out_col``, the terms of a text in order: lowercase
    tokens of two or more word characters, stop words removed, joined into
    n-grams of the requested range."""
    toks = T.term_tokens(text_col)
    if stop_words:
        stop = list(stop_words)
        toks = F.filter(toks, lambda t: ~t.isin(stop))
    d = df.withColumn("_toks", toks)
    lo, hi = ngram_range
    grams = [F.col("_toks") if n == 1 else ngrams("_toks", n) for n in range(lo, hi + 1)]
    return d.withColumn(out_col, grams[0] if len(grams) == 1 else F.concat(*grams)).drop("_toks")


def with_term_counts(df: DataFrame, terms_col: str, out_col: str = "term_counts") -> DataFrame:
    """Add ``out_col``: the distinct terms of ``terms_col`` with their counts,
    ``array<struct<term, tf>>``, by sorting and measuring runs inside the
    row (O(n log n)). Intermediate arrays are separate projections: inside a
    lambda a referenced expression would be re-evaluated per element."""
    d = df.withColumn("_s", F.sort_array(F.coalesce(F.col(terms_col), F.array().cast("array<string>"))))
    s = F.col("_s")
    n = F.size(s)
    d = d.withColumn(
        "_starts",
        F.filter(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
            lambda i: (n > 0) & ((i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1))))),
        ),
    )
    st = F.col("_starts")
    m = F.size(st)
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(m, F.lit(1))),
        lambda k: F.struct(
            F.element_at(s, F.element_at(st, k)).alias("term"),
            (F.when(k < m, F.element_at(st, F.least(k + 1, m))).otherwise(n + 1) - F.element_at(st, k))
            .cast("long")
            .alias("tf"),
        ),
    )
    empty = F.array().cast("array<struct<term:string,tf:bigint>>")
    return d.withColumn(out_col, F.when(n > 0, runs).otherwise(empty)).drop("_s", "_starts")


# ---------------------------------------------------------------- fitting


# Computed arrays are exploded with ``explode_outer`` and the generated column
# filtered: for a plain ``explode`` the optimizer infers ``size(arr) > 0`` and
# pushes it below the projections, inlining the array's whole expression (and
# re-evaluating it per element inside lambdas).


def term_stats(df: DataFrame, terms_col: str) -> DataFrame:
    """(term, tf, df): corpus frequency and document frequency, one explode
    and one shuffle. The row with a null term counts the documents (``df``)."""
    d = df.select(F.sort_array(F.coalesce(F.col(terms_col), F.array().cast("array<string>"))).alias("_s"))
    # a null after the sorted terms ends the row; sorted terms lie side by side,
    # so the first of each is known without counting inside the row
    each = d.withColumn("_all", F.concat("_s", F.array(F.lit(None).cast("string")))).select("_s", F.posexplode_outer("_all").alias("_at", "term"))
    last, first = F.col("term").isNull(), (F.col("_at") == 0) | (F.get("_s", F.col("_at") - 1) != F.col("term"))
    each = each.select("term", F.when(last, 0).otherwise(1).alias("tf"), (last | first).cast("long").alias("df"))
    return each.groupBy("term").agg(F.sum("tf").cast("bigint").alias("tf"), F.sum("df").cast("bigint").alias("df"))


def fit_vocabulary(df: DataFrame, terms_col: str, max_features: int | None) -> DataFrame:
    """G3 + G4: (term, tf, df, idf, index, rank), stored. ``index`` is the
    alphabetical position (the column order of the document-term matrix);
    ``rank`` the frequency position. Without ``max_features`` both are the
    term's position in hash order: unique and gapless, but found without
    sorting an unbounded vocabulary in one task."""
    from pyspark.sql import Window

    spark = df.sparkSession
    every = materialize(term_stats(df, terms_col), scratch_path(spark, "term-stats"), force=True)
    n_docs = every.filter(F.col("term").isNull()).select(F.col("df").alias("_n"))  # one row
    stats = every.filter(F.col("term").isNotNull())
    if max_features is not None:
        stats = stats.orderBy(F.col("tf").desc(), F.col("term")).limit(int(max_features))
    vocab = stats.crossJoin(F.broadcast(n_docs)).withColumn(
        "idf", F.log((F.lit(1.0) + F.col("_n")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    )
    if max_features is not None:
        # at most max_features rows: a single ordered task is bounded
        vocab = vocab.withColumn("index", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))
        vocab = vocab.withColumn(
            "rank", (F.row_number().over(Window.orderBy(F.col("tf").desc(), F.col("term"))) - 1).cast("int")
        )
    else:
        vocab = hash_rank(vocab.withColumn("_h", F.md5("term")), [], "_h", "term", "index").drop("_h").withColumn("rank", F.col("index"))
    return materialize(vocab.drop("_n"), scratch_path(spark, "vocabulary"), force=True)


#: Terms a vocabulary may have to be broadcast.
BROADCAST_TERMS = 1 << 20


def _vocab_side(vocab: DataFrame) -> DataFrame:
    """The vocabulary as the build side of a join: broadcast if its rows are
    counted to be few, otherwise joined by a shuffle."""
    return F.broadcast(vocab) if vocab.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else vocab


def tfidf_long(
    df: DataFrame, id_cols: Sequence[str], terms_col: str, vocab: DataFrame, norm: bool = True
) -> DataFrame:
    """G5 in long form: (id..., term, weight). Term counts are taken inside
    each row, idf comes from a hash join with the vocabulary (unseen terms
    drop out), and the L2 norm is a window per document."""
    from pyspark.sql import Window

    id_cols = list(id_cols)
    c = with_term_counts(df.select(*id_cols, terms_col), terms_col, "_tc")
    c = c.select(*id_cols, F.explode_outer("_tc").alias("_e")).select(*id_cols, "_e.term", "_e.tf")
    c = c.filter(F.col("term").isNotNull())
    w = c.join(_vocab_side(vocab.select("term", "idf")), "term").select(
        *id_cols, "term", (F.col("tf") * F.col("idf")).alias("w")
    )
    if not norm:
        return w.withColumnRenamed("w", "weight")
    l2 = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*id_cols)))
    return w.select(*id_cols, "term", (F.col("w") / l2).alias("weight"))


def tfidf_vectorizer(vocab: DataFrame, terms_col: str, max_features: int, out_col: str = "features"):
    """G5 as Spark ML stages producing a sparse vector: counts over the fitted
    vocabulary (alphabetical index), times idf, L2-normalised. A model's width
    is a parameter: ``vocab`` was fitted with ``max_features``, and as many
    terms are brought to the driver to build the stages."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import DenseVector

    rows = vocab.select("term", "idf").orderBy("term").limit(max_features + 1).collect()
    if len(rows) > max_features:
        raise ValueError("the vocabulary was not fitted with this max_features")
    cv = CountVectorizerModel.from_vocabulary([r.term for r in rows], inputCol=terms_col, outputCol="_tf")
    ep = ElementwiseProduct(scalingVec=DenseVector([r.idf for r in rows]), inputCol="_tf", outputCol="_tfidf")
    nm = Normalizer(p=2.0, inputCol="_tfidf", outputCol=out_col)
    return PipelineModel(stages=[cv, ep, nm])


def tfidf_vector(df: DataFrame, terms_col: str, vocab: DataFrame, max_features: int, out_col: str = "features") -> DataFrame:
    """G5 as an ML sparse vector column (for Spark ML estimators)."""
    return tfidf_vectorizer(vocab, terms_col, max_features, out_col).transform(df).drop("_tf", "_tfidf")


def tfidf_rows(df: DataFrame, id_cols: Sequence[str], terms_col: str, vocab: DataFrame, max_features: int) -> DataFrame:
    """G5 in long form for a bounded vocabulary: (id..., term, weight) from the
    vectors, so that rows are weighed where they are, without a join or shuffle."""
    model = tfidf_vectorizer(vocab, terms_col, max_features, "_tfidf_unit")
    u = F.unwrap_udt("_tfidf_unit")
    at = F.when(u["type"] == 0, u["indices"]).otherwise(F.sequence(F.lit(0), F.size(u["values"]) - 1))
    entries = F.arrays_zip(at.alias("k"), u["values"].alias("v"))
    texts = df.select(*id_cols, F.coalesce(terms_col, F.array().cast("array<string>")).alias(terms_col))
    each = model.transform(texts).select(*id_cols, F.explode_outer(entries).alias("_entry"))
    terms = F.lit(model.stages[0].vocabulary)
    return each.filter(F.col("_entry.v") > 0).select(*id_cols, F.get(terms, F.col("_entry.k")).alias("term"), F.col("_entry.v").alias("weight"))


# ---------------------------------------------------------------- scalers


def fit_standard_scaler(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """G6 fit: one row of mean and population std per column."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    return df.agg(*aggs)


def apply_standard_scaler(df: DataFrame, stats: DataFrame, cols: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """G6 apply: (x - mean) / std, a zero std divides by 1."""
    d = df.crossJoin(F.broadcast(stats))
    for c in cols:
        sd = F.col(f"{c}__std")
        d = d.withColumn(f"{c}{suffix}", (F.col(c) - F.col(f"{c}__mean")) / F.when(sd == 0, F.lit(1.0)).otherwise(sd))
    return d.drop(*[f"{c}__{s}" for c in cols for s in ("mean", "std")])


def fit_minmax_scaler(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """G7 fit: one row of min and max per column."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).cast("double").alias(f"{c}__min"), F.max(c).cast("double").alias(f"{c}__max")]
    return df.agg(*aggs)


def apply_minmax_scaler(df: DataFrame, stats: DataFrame, cols: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """G7 apply: (x - min) / (max - min), no clamping; a constant column
    divides by 1 (so training rows become 0)."""
    d = df.crossJoin(F.broadcast(stats))
    for c in cols:
        rng = F.col(f"{c}__max") - F.col(f"{c}__min")
        d = d.withColumn(f"{c}{suffix}", (F.col(c) - F.col(f"{c}__min")) / F.when(rng == 0, F.lit(1.0)).otherwise(rng))
    return d.drop(*[f"{c}__{s}" for c in cols for s in ("min", "max")])


# ---------------------------------------------------------------- encodings


PAD_ID = 0
UNKNOWN_ID = 1


def _lookup(batches: Iterator[pa.RecordBatch], terms: pa.Array, ids: pa.Array, length: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tokens = b.column(1)
        found = pc.fill_null(pc.take(ids, pc.index_in(tokens.flatten(), value_set=terms)), UNKNOWN_ID).to_numpy()
        sizes = tokens.value_lengths().to_numpy()
        known = np.arange(length) < sizes[:, None]
        padded = np.full(known.shape, PAD_ID, dtype=np.int32)
        padded[known] = found
        offsets = pa.array(np.arange(0, known.size + 1, length), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel(), pa.int32())) for x in (padded, known.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([b.column(0), *lists], [b.schema.names[0], "input_ids", "attention_mask"])


def encode_tokens(df: DataFrame, id_col: str, tokens_col: str, vocab: DataFrame, max_length: int) -> DataFrame:
    """(id, input_ids, attention_mask): the first ``max_length`` tokens
    as ids (known term ``2 + rank``, unknown 1), padded with 0, and the mask.

    A vocabulary of at most ``BROADCAST_TERMS`` terms travels to the rows, which
    are encoded where they are, in Arrow batches; a larger one is joined."""
    none = F.array().cast("array<string>")
    rows = df.select(id_col, F.coalesce(F.slice(F.col(tokens_col), 1, max_length), none).alias("_tokens"))
    if vocab.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        table = vocab.select("term", (F.col("rank") + 2).cast("int").alias("id")).toArrow()
        terms, ids = (table.column(c).combine_chunks() for c in ("term", "id"))
        array = ArrayType(IntegerType())
        schema = StructType([df.schema[id_col], StructField("input_ids", array), StructField("attention_mask", array)])
        return rows.mapInArrow(partial(_lookup, terms=terms, ids=ids, length=max_length), schema)
    toks = rows.select(id_col, F.posexplode_outer("_tokens").alias("pos", "term"))
    ids = toks.join(vocab.select("term", "rank"), "term", "left").select(
        id_col, "pos", F.when(F.col("term").isNotNull(), F.coalesce(F.col("rank") + 2, F.lit(UNKNOWN_ID))).cast("int").alias("tid")
    )
    seq = ids.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.when(F.col("tid").isNotNull(), F.struct("pos", "tid")))).alias("_p")
    )
    arr = F.transform("_p", lambda e: e["tid"])
    seq = seq.withColumn("_ids", arr)
    pad = F.array_repeat(F.lit(PAD_ID), F.lit(max_length) - F.size("_ids"))
    return seq.select(
        id_col,
        F.concat("_ids", pad).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("_ids")), pad).alias("attention_mask"),
    )


def fuse_dense(vector: Column, features: Sequence[Column], bound: float = 10.0) -> Column:
    """Text vector followed by the scaled numeric features, each clamped
    to [-bound, bound]."""
    clamped = [T.clip(f.cast("double"), -bound, bound) for f in features]
    return F.concat(F.transform(vector, lambda x: x.cast("double")), F.array(*clamped))
