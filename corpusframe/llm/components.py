"""Connected components by alternating large and small stars.

Every step is a minimum per vertex (combined map-side) joined back to the
edges, so no vertex's neighbours are ever gathered in one place, and a vertex
with very many edges is an ordinary skewed join. Each round is written to the
shared folder; the number of rounds grows with the logarithm of the size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusframe.llm.tables import stored


def _sum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (u, v) with u != v, of one type -> (node, root): every linked
    node, with the smallest node of its component. No links: no rows."""
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stored(edges, "links")
    seen = _sum(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        met = edges.join(low, "u")
        edges = met.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stored(edges.select("e.u", "e.v").where("u <> v").distinct(), "links")
        now = _sum(edges)
        if now == seen:
            break
        seen = now
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())
