"""From raw documents to training tokens: rules, exact dedup, near dedup, mix,
tokens.

Each stage takes ``(spark, docs, sf_dir)``, works on every row its predecessor
kept, and returns the columns of ``docs`` (the last: the tokens). ``run``
writes each stage as Parquet under the shared checkpoint folder and reads it
again, so a stage is computed once and a lost executor costs one stage at most.

Defined cases. The rules reject null, empty and blank texts, so no later stage
meets them. Null ids and rows that repeat (id, text) pass the rules; of repeated
rows and equal texts exactly one stays, one with an id if there is one. Ties are
decided by the ids, as each stage says. Very long texts are handled whole in every
stage. Other columns, whatever their names, pass through to the mix; the
last stage returns its own. An empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusframe.llm import exact_dedup, mixing, piece_bpe, quality_rules, simhash
from corpusframe.llm.tables import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the rules reject go."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of equal texts the one with the largest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of linked fingerprints the smallest doc_id stays."""
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: each document as often as the mix takes it."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: ids of every document of the mix, and their digests."""
    return piece_bpe.token_report(docs, with_ids=True)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixing", mixed), ("piece_bpe", tokens)]

#: Fingerprint links are not expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
