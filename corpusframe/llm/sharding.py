"""Sharding by a consistent-hash ring with virtual nodes and bounded loads,
DataFrame functions only.

Every shard has ``NODES`` virtual nodes on a ring of ``CELLS`` cells, placed by
hashing (shard, node); every document has a cell by hashing its id. The arc that
ends at a node belongs to that node's shard. Three laws:

* ``rows``: a shard takes ``n div shards`` documents, the first ``n mod shards``
  shards one more, so counts are at most one apart;
* ``bytes``: the same for bytes. A document goes to the shard that its first
  byte falls to, so a shard's bytes differ from the even share by less than the
  documents that lie over a boundary (one for each part of an arc);
* ``key``: no bounds, the id and the number of shards decide; with one more
  shard, documents move into that shard only.

Bounded loads. The arcs are filled in ring order. An arc's documents go to the
arc's shard while it has room; what is over continues clockwise to the next other
shard with room, and so on. As the bounds add up to the whole, every document
finds room. What an arc holds is numbered in the order of the ids' hashes, and
each part of an arc is a range of these numbers (or bytes). Few documents move
when a shard is added, as only what overflows leaves the place that the ring
gives it.

Scale. One pass over the texts writes (arc, hash, id, size, crc, copies); texts
are not shuffled. The ring is filled by one fold over one sum per arc: a row of
``shards * NODES`` entries, whatever the input's size. Documents are numbered per
arc, thousands of groups of like size, and meet their arc's parts, at most
``shards`` for each arc, by a broadcast join.

Defined cases. Null text has size 8 and checksum 0, as an empty one; a null id
is hashed as an empty string. Rows that repeat id, size and checksum are one row
with a count until their places are known, so a hot repeated row is never a
group; the copies of very frequent rows are dealt out anew before they are
written. Very long texts are only measured. Ties in the hash are in the order
of (id, size, checksum), a null id first. An empty table gives an empty result.
Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusframe.llm.tables import stored, table, text_of

SHARDS = 24
NODES = 128
CELLS = 1 << 16
#: Bytes that a document has besides its text.
OVERHEAD = 8
#: Copies of one repeated row that one task writes.
COPIES = 10_000
LAW = "rows"


def _hash(c: Column) -> Column:
    """60 bits of a hash as a non-negative bigint."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


def nodes(spark: SparkSession, shards: int) -> DataFrame:
    """(arc, cell, shard): the nodes in ring order, numbered from 1."""
    n = spark.range(shards * NODES).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("node"))
    n = n.withColumn("cell", _hash(F.format_string("ring:%d:%d", "shard", "node")) % CELLS)
    order = Window.orderBy("cell", "shard", "node")  # shards * NODES rows
    return n.select(F.row_number().over(order).alias("arc"), "cell", "shard")


def cells(ring: DataFrame) -> DataFrame:
    """(cell, arc) for every cell: the first node at or after it, around the ring."""
    here = ring.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    every = ring.sparkSession.range(CELLS).withColumnRenamed("id", "cell").join(F.broadcast(here), "cell", "left")
    below = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # CELLS rows
    before = F.coalesce(F.sum("n").over(below), F.lit(0))
    total = F.sum("n").over(Window.partitionBy())
    return every.select("cell", (before % total + 1).cast("int").alias("arc"))


def preferences(ring: DataFrame) -> DataFrame:
    """(arc, prefer): the distinct shards clockwise of an arc, nearest first."""
    order = F.transform(F.array_sort(F.collect_list(F.struct("arc", "shard"))), lambda x: x["shard"])
    round_ = ring.agg(order.alias("shards"))  # one row of shards * NODES entries
    met = ring.crossJoin(F.broadcast(round_))
    clockwise = F.expr("concat(slice(shards, arc, size(shards)), slice(shards, 1, arc - 1))")
    return met.select("arc", F.array_distinct(clockwise).alias("prefer"))


def bounded_parts(loads: DataFrame, ring: DataFrame, shards: int) -> DataFrame:
    """``loads`` (arc, load: whole units) -> (arc, start, take, shard): the units
    ``start`` to ``start + take - 1`` of the arc go to the shard. Bounded loads:
    the shards' sums are at most one apart."""
    each = preferences(ring).join(F.broadcast(loads), "arc", "left").select("arc", F.coalesce("load", F.lit(0)).alias("load"), "prefer")
    one = each.agg(F.array_sort(F.collect_list(F.struct("arc", "load", "prefer"))).alias("arcs"), F.sum("load").alias("n"))  # one row
    one = one.withColumn("bounds", F.expr(f"transform(sequence(0, {shards - 1}), s -> n div {shards} + IF(s < n % {shards}, 1L, 0L))"))
    gets = "least(b.left, b.free[s])"
    part = f"named_struct('arc', a.arc, 'start', a.load - b.left, 'take', {gets}, 'shard', s)"
    ask = f"""(b, s) -> IF({gets} > 0, named_struct(
        'left', b.left - {gets}, 'free', transform(b.free, (x, i) -> IF(i = s, x - {gets}, x)), 'parts', concat(b.parts, array({part}))), b)"""
    filled = f"""aggregate(arcs,
        named_struct('left', 0L, 'free', bounds, 'parts', CAST(array() AS array<struct<arc:int, start:bigint, take:bigint, shard:int>>)),
        (f, a) -> aggregate(a.prefer, named_struct('left', a.load, 'free', f.free, 'parts', f.parts), {ask}))"""
    return stored(one.select(F.explode(F.expr(f"{filled}.parts")).alias("p")).select("p.*"), "shard-parts")


def keys_of(docs: DataFrame, ring: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(arc, h, id, size, crc, copies), stored: the distinct keys with their counts."""
    h = _hash(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    text = text_of(text_col)
    rows = docs.select(
        h.alias("h"), F.col(id_col).alias("id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc")
    )
    rows = rows.withColumn("cell", F.col("h") % CELLS).join(F.broadcast(cells(ring)), "cell")  # CELLS rows
    return stored(rows.groupBy("arc", "h", "id", "size", "crc").agg(F.count(F.lit(1)).alias("copies")), "shard-keys")


def _copies(keys: DataFrame) -> DataFrame:
    """One row per document: column ``copy`` counts the copies of a key. Keys of
    more than ``COPIES`` are dealt out first, so that no task writes them all."""
    few = keys.where(F.col("copies") <= COPIES).withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    many = keys.where(F.col("copies") > COPIES).withColumn("lot", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")))
    many = many.repartition("h", "id", "lot")
    upto = F.least(F.col("copies"), (F.col("lot") + 1) * COPIES) - 1
    many = many.withColumn("copy", F.explode(F.sequence(F.col("lot") * COPIES, upto))).drop("lot")
    return few.unionByName(many)


def shard_report(docs: DataFrame, shards: int = SHARDS, law: str = LAW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot (gapless
    from 0 in each shard), grown_shard (``key``: with one shard more)."""
    if law not in ("rows", "bytes", "key"):
        raise ValueError("law is rows, bytes or key")
    spark = docs.sparkSession
    ring = stored(nodes(spark, shards).coalesce(1), "shard-ring")
    keys = keys_of(docs, ring, id_col, text_col)
    unit = F.col("size") if law == "bytes" else F.lit(1).cast("long")
    loads = stored(keys.groupBy("arc").agg(F.sum(F.col("copies") * unit).alias("load")).coalesce(1), "shard-loads")
    if law == "key":
        parts = loads.join(F.broadcast(ring), "arc").select("arc", F.lit(0).cast("long").alias("start"), F.col("load").alias("take"), "shard")
    else:
        parts = bounded_parts(loads, ring, shards)
    # Places are numbered per key; a key's copies follow each other.
    before = Window.partitionBy("arc").orderBy("h", "id", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    placed = keys.withColumn("place", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    placed = placed.withColumn("at", F.coalesce(F.sum(F.col("copies") * unit).over(before), F.lit(0)))
    rows = _copies(placed).withColumn("place", F.col("place") + F.col("copy")).withColumn("at", F.col("at") + F.col("copy") * unit)
    within = F.col("at").between(F.col("start"), F.col("start") + F.col("take") - 1)
    if law == "bytes":  # how many documents a part holds shows only when they are dealt
        rows = stored(rows.drop("copies", "copy"), "shard-rows")
        met = rows.join(F.broadcast(parts.withColumnRenamed("arc", "arc_")), (F.col("arc") == F.col("arc_")) & within)
        counts = met.groupBy("arc", "start", "take", "shard").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    else:
        counts = parts.withColumn("first", F.col("start")).withColumn("n", F.col("take"))
    ahead = Window.partitionBy("shard").orderBy("arc", "start").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first"))
    counts = stored(counts.select(F.col("arc").alias("arc_"), "start", "take", "shard", "base").coalesce(1), "shard-plan")
    # at most one row for each arc and shard
    out = rows.join(F.broadcast(counts), (F.col("arc") == F.col("arc_")) & within)
    grown = F.lit(None).cast("int")
    if law == "key":
        more = stored(nodes(spark, shards + 1).coalesce(1), "shard-ring")
        owner = cells(more).join(F.broadcast(more.select("arc", F.col("shard").alias("grown"))), "arc").select("cell", "grown")
        out = out.withColumn("cell", F.col("h") % CELLS).join(F.broadcast(owner), "cell")
        grown = F.col("grown")
    return out.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit(law).alias("law"), "shard",
        (F.col("base") + F.col("place")).alias("slot"), grown.alias("grown_shard"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    """The law ``rows`` in DuckDB SQL."""
    point = lambda c: f"('0x' || substr(md5({c}), 1, 15))::BIGINT"
    text = "coalesce(text, '')"
    step = "xor(crc >> 1, CASE WHEN crc & 1 = 1 THEN 3988292384 ELSE 0 END)"
    sql = rf"""
WITH RECURSIVE bits AS (
  SELECT b, b::BIGINT AS crc, 0 AS k FROM range(256) t(b) UNION ALL SELECT b, {step}, k + 1 FROM bits WHERE k < 8
),
crcs AS MATERIALIZED (SELECT list(crc ORDER BY b) AS t FROM bits WHERE k = 8),
chars AS MATERIALIZED (
  SELECT DISTINCT {text} AS x FROM documents
),
sums AS MATERIALIZED (
  SELECT x, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(h, 2 * i - 1, 2))::BIGINT FOR i IN range(1, strlen(x) + 1)]),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM (SELECT x, hex(encode(x)) AS h FROM chars), crcs
),
ring AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY cell, shard, node) AS arc, cell, shard
  FROM (SELECT s::INTEGER AS shard, v AS node, {point("'ring:' || s || ':' || v")} % {CELLS} AS cell FROM range({SHARDS}) a(s), range({NODES}) b(v))
),
prefer AS MATERIALIZED (
  SELECT arc, list(shard ORDER BY away) AS shards
  FROM (SELECT a.arc, b.shard, min((b.arc - a.arc + {SHARDS * NODES}) % {SHARDS * NODES}) AS away FROM ring a, ring b GROUP BY ALL) GROUP BY arc
),
d AS (
  SELECT doc_id, strlen({text}) + {OVERHEAD} AS size, sums.crc, {point("coalesce(doc_id::VARCHAR, '')")} AS h
  FROM documents JOIN sums ON {text} = x
),
k AS MATERIALIZED (
  SELECT d.*, coalesce((SELECT min(arc) FROM ring WHERE ring.cell >= d.h % {CELLS}), 1) AS arc FROM d
),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY arc ORDER BY h, doc_id NULLS FIRST, size, crc) - 1 AS place FROM k),
loads AS MATERIALIZED (SELECT arc, shards, (SELECT count(*) FROM p WHERE p.arc = prefer.arc) AS load FROM prefer),
steps AS (
  SELECT 0::BIGINT AS arc, 0::BIGINT AS r, 0::BIGINT AS left_, 0::BIGINT AS start, 0::BIGINT AS take, NULL::INTEGER AS shard,
         [n // {SHARDS} + CASE WHEN s < n % {SHARDS} THEN 1 ELSE 0 END FOR s IN range({SHARDS})] AS free FROM (SELECT count(*) AS n FROM p)
  UNION ALL
  SELECT arc, r, left_ - gets, load - left_, gets, shard, [CASE WHEN i = shard + 1 THEN free[i] - gets ELSE free[i] END FOR i IN range(1, {SHARDS + 1})]
  FROM (
    SELECT l.arc, b.r, b.left_, l.load, l.shards[b.r] AS shard, b.free, least(b.left_, b.free[l.shards[b.r] + 1]) AS gets
    FROM (SELECT CASE WHEN left_ > 0 THEN steps.arc ELSE steps.arc + 1 END AS arc, CASE WHEN left_ > 0 THEN r + 1 ELSE 1 END AS r,
                 CASE WHEN left_ > 0 THEN left_ ELSE n.load END AS left_, free
          FROM steps LEFT JOIN loads n ON n.arc = steps.arc + 1) b JOIN loads l ON l.arc = b.arc
  )
)"""
    return sql + f""",
plan AS (
  SELECT *, coalesce(sum(take) OVER (PARTITION BY shard ORDER BY arc, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - start AS base FROM steps WHERE take > 0
)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, '{LAW}' AS law, shard, (base + place)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM p JOIN plan ON p.arc = plan.arc AND place BETWEEN start AND start + take - 1
"""
