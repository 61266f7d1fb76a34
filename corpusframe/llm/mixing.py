"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources, in code point order with null last, weigh 5, 2, 1, repeating. They
share ``SHARE`` times all words; a target stops at ``MOST`` times its source's
size and the excess is reshared by weight until no target is above. A source
takes as many complete epochs as fit its target, then documents in the order of
their exponential keys ``-ln(u) / weight`` until the words taken are nearest to
what is left. ``u`` is a hash of the id, so reruns agree; the quality weight is
one half plus the share of letters among the text's non-white characters.

Scale. Keys fall into ``BUCKETS`` fixed ranges. Words are summed per source and
range (combined map-side); their prefix sums show in which single range a
source's budget ends, and only that range's rows are sorted and prefix-summed.
Every row is then decided where it is by comparing it with its source's cut:
no source's rows are gathered, however large its share. The table of cuts has
one row per source and is broadcast if counted to be small, else joined.

Defined cases. Null text has size 0; a null source is a source; a null id is
hashed as an empty string. Rows that agree in id, size and key share one
decision. Empty sources take nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusframe.llm.tables import WORD, fresh, small, stored, table, text_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BUCKETS = 4096
#: Weights from here up spread over the ranges with at most weight / LEAST_WEIGHT
#: times an even share in one; other weights only make ranges less even.
LEAST_WEIGHT = 0.5
SEED = "mix"


def size_of(text_col: str = "text") -> Column:
    return F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")


def quality_weight(text_col: str = "text") -> Column:
    text = text_of(text_col)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    solid = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]", ""))
    return F.lit(0.5) + F.when(solid > 0, letters / solid).otherwise(F.lit(0.0))


def sampling_key(id_col: str, weight: Column, seed: str = SEED) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def _source_key(source_col: str) -> Column:
    """A key that is never null."""
    c = F.col(source_col).cast("string")
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), c))


def rows_of(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight: Column | None = None) -> list[Column]:
    """The columns that decide a row: source key, id, size, key and its range."""
    key = sampling_key(id_col, quality_weight(text_col) if weight is None else weight)
    at = F.least(F.floor(F.lit(BUCKETS) * (1 - F.exp(-key * LEAST_WEIGHT))), F.lit(BUCKETS - 1)).cast("int")
    return [_source_key(source_col).alias("src"), F.col(id_col).alias("id"), size_of(text_col).alias("size"), key.alias("key"), at.alias("range")]


def targets(sources: DataFrame) -> DataFrame:
    """(src, source_size) -> with target. One row per source; the windows over
    all sources hold nothing else."""
    at = F.row_number().over(Window.orderBy((F.col("src") == "").asc(), "src")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (at % len(WEIGHTS) + 1).cast("int")).cast("double")
    s = sources.withColumn("w", weight).withColumn("most", (MOST * F.col("source_size")).cast("double"))
    by = Window.orderBy(F.col("most") / F.col("w"), "src")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    budget = F.lit(SHARE) * F.sum("source_size").over(every)
    left = budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weights = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    s = s.withColumn("level", left / weights)
    s = s.withColumn("free", F.col("level") * F.col("w") <= F.col("most"))
    # The first free source, in order of the level at which it is full, sets the level of all that follow.
    level = F.min(F.when(F.col("free"), F.struct(F.col("most") / F.col("w"), "src", "level"))).over(every)["level"]
    s = s.withColumn("target", F.coalesce(F.least(level * F.col("w"), F.col("most")), F.col("most")))
    return s.select("src", "source_size", "target")


def cuts(rows: DataFrame) -> DataFrame:
    """Stored ``rows`` (src, id, size, key, range) -> (src, source_size, target,
    epochs, cut_range, cut): a row is selected once more if its range is below
    the cut's, or equal and (key, id, size) is not above ``cut``."""
    per = stored(rows.groupBy("src", "range").agg(F.sum("size").alias("words")), "mix-ranges")
    goal = targets(per.groupBy("src").agg(F.sum("words").alias("source_size")))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = stored(goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")
    upto = Window.partitionBy("src").orderBy("range")
    ends = per.withColumn("upto", F.sum("words").over(upto)).join(small(goal), "src")
    ends = ends.where((F.col("rest") > 0) & (F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
    ends = stored(ends.select("src", "range", (F.col("upto") - F.col("words")).alias("before"), "rest"), "mix-ends")
    last = rows.join(small(ends), ["src", "range"])
    sums = F.col("before") + F.sum("size").over(Window.partitionBy("src").orderBy("key", "id", "size"))
    last = last.select("src", F.struct("key", "id", "size").alias("cut"), sums.alias("words"), "rest")
    none = ends.select("src", F.lit(None).cast(last.schema["cut"].dataType).alias("cut"), F.col("before").alias("words"), "rest")
    near = last.unionByName(none).groupBy("src").agg(
        F.min_by("words", F.struct(F.abs(F.col("words") - F.col("rest")), "words")).alias("words")
    )
    best = last.join(near, ["src", "words"]).groupBy("src").agg(F.max("cut").alias("cut"))
    out = goal.join(ends.select("src", F.col("range").alias("cut_range")), "src", "left").join(best, "src", "left")
    return stored(out.select("src", "source_size", "target", "epochs", "cut_range", "cut"), "mix-cuts")


def _taken() -> Column:
    """Times a row is taken."""
    row = F.struct("key", "id", "size")
    more = (F.col("range") < F.col("cut_range")) | ((F.col("range") == F.col("cut_range")) & F.col("cut").isNotNull() & (row <= F.col("cut")))
    return (F.col("epochs") + F.coalesce(more.cast("long"), F.lit(0))).cast("int")


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken words and
    times taken."""
    rows = stored(docs.select(rows_of(docs, id_col, text_col, source_col, weight)), "mix-rows")
    met = rows.join(small(cuts(rows)), "src").withColumn("times", _taken())
    return met.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken"), "times")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the
    columns of ``docs``. Rows are decided in place; texts are not shuffled."""
    (x,) = fresh(docs, "mix")
    rows = stored(docs.select(rows_of(docs, id_col, text_col, source_col, weight)), "mix-rows")
    found = docs.withColumn(x, F.struct(*rows_of(docs, id_col, text_col, source_col, weight)))
    work = found.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), f"{x}.*").join(small(cuts(rows)), "src")
    times = F.when(_taken() > 0, F.sequence(F.lit(1), _taken()))
    return work.select("doc", F.explode(times)).select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         length(regexp_replace(coalesce(text, ''), '[^\p{{L}}]', '', 'g')) AS letters,
         length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS solid,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
),
k AS (
  SELECT doc_id, source, size,
         -ln((('0x' || h[1:13])::BIGINT::DOUBLE + 0.5) / {float(1 << 52)!r})
           / (0.5 + CASE WHEN solid > 0 THEN letters / solid ELSE 0 END) AS key
  FROM d
),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [{', '.join(f'{w}.0::DOUBLE' for w in WEIGHTS)}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS w
  FROM k GROUP BY source
),
c AS (
  SELECT *, {MOST}.0::DOUBLE * source_size AS most,
         (({SHARE}::DOUBLE * sum(source_size) OVER ()) - coalesce(sum({MOST}.0::DOUBLE * source_size) OVER (ORDER BY {MOST}.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY {MOST}.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM s
),
l AS (SELECT arg_min(level, most / w) AS level FROM c WHERE level * w <= most),
t AS (
  SELECT source, source_size, least(l.level * w, most)::DOUBLE AS target,
         CASE WHEN source_size > 0 THEN floor(least(l.level * w, most) / source_size) ELSE 0 END::BIGINT AS epochs
  FROM c, l
),
p AS (
  SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest,
         sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST, size) AS upto
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
),
best AS (
  SELECT source, arg_min(words, gap) AS words FROM (
    SELECT source, upto AS words, abs(upto - rest) + upto * 1e-12 AS gap FROM p WHERE rest > 0
    UNION ALL SELECT source, 0, target - epochs * source_size FROM t WHERE target - epochs * source_size > 0
  ) GROUP BY source
)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN best.words IS NOT NULL AND upto <= best.words THEN 1 ELSE 0 END))::BIGINT AS taken,
       (epochs + CASE WHEN best.words IS NOT NULL AND upto <= best.words AND best.words > 0 THEN 1 ELSE 0 END)::INTEGER AS times
FROM p LEFT JOIN best ON p.source IS NOT DISTINCT FROM best.source
"""
