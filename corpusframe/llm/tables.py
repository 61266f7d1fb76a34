"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.session import scratch_path

#: Rows a table may have to be broadcast; wider tables join by shuffling.
BROADCAST_ROWS = 100_000

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder under the shared checkpoint folder and
    read it back: computed once, lineage cut, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored table for broadcast if it is counted to have at most
    ``rows`` rows; otherwise return it as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_of(col: str = "text"):
    """The text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working names for new columns that no column of ``df`` has, in any case."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        n = f"__{n}"
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out
