"""Small tables of awkward rows, shared by the operators' tests."""

from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Extra columns whose names the operators might use themselves.
EXTRA = ["key", "digest", "keep", "src", "size", "range", "fp", "u", "v", "count", "words", "h"]
SCHEMA = StructType(
    [StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
     StructField("source", StringType()), StructField("n_chars", LongType())]
    + [StructField(x, StringType()) for x in EXTRA]
)


def docs_of(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) + tuple("x" for _ in EXTRA) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward():
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    base = "the quick brown fox jumps over the lazy dog and runs to the river of the old town"
    return [
        (1, base, "a"), (2, base, "a"), (3, base + " again", "b"), (4, "", None), (5, None, None), (6, " \t\n", "b"),
        (7, long, "c"), (8, long, "c"), (9, long + " tail", None), (10, base, "a"), (10, base, "a"), (None, base, "a"),
        (None, "only without id", "b"), (None, "only without id", "b"), (11, "one two three", "a"), (12, "Ünï cödé ▁ 中文 \U0001F600", "d"),
        (13, "a " * 500, "b"), (14, "line\nline\nline\nline\n\nother", "a"),
    ]
