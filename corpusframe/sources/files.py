"""File sources and sinks.

Every path a job writes by default lies under the session's shared
checkpoint folder (``spark.checkpoint.dir``); see ``session.checkpoint_dir``.
Writes are whole-directory commits (``_SUCCESS`` marker), so a job that loses
executors re-runs the failed tasks and a half-written folder is never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

CSV_OPTIONS = {
    "header": "true", "multiLine": "true", "escape": '"', "quote": '"',
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Headered CSV with quoted multi-line text. Pass ``schema`` for
    typed columns (no inference pass over the data)."""
    r = spark.read.options(**CSV_OPTIONS)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", "false")
    return r.csv(path)


def convert_csv(spark: SparkSession, path: str, out: str, schema: StructType | str, multi_line: bool = True, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """S1 for files that may be malformed: one pass over the CSV writes parquet
    under ``out``, and every later read is splittable. Returns (rows, quarantine):
    records with too few or too many fields, a value that is no value of its
    column's type, or a quote that is never closed are kept apart, each with its
    raw text and file; every record is in exactly one of the two tables.

    ``multi_line=False`` reads the files in splits too, where no field holds a
    line break; an unclosed quote then ends with its line. Otherwise a file is one
    task, and an unclosed quote takes the rest of its file into one record."""
    typed = spark.createDataFrame([], schema).schema
    raw, bad, file = (_unused(typed.names, n) for n in ("raw", "malformed", "file"))
    reader = spark.read.options(**CSV_OPTIONS | {"multiLine": str(multi_line).lower(), "header": str(header).lower(), "mode": "PERMISSIVE"})
    read = reader.option("columnNameOfCorruptRecord", raw).schema(StructType([*typed.fields, StructField(raw, StringType())])).csv(path)
    marked = read.withColumn(bad, F.col(raw).isNotNull()).withColumn(file, F.col("_metadata.file_path"))
    marked.write.mode("overwrite").partitionBy(bad).parquet(out)
    table = spark.read.schema(StructType([*typed.fields, StructField(raw, StringType()), StructField(file, StringType()), StructField(bad, BooleanType())])).parquet(out)
    return table.filter(~F.col(bad)).select(*typed.names), table.filter(bad).select(F.col(file).alias("file"), F.col(raw).alias("raw"))


def _unused(names: Sequence[str], name: str) -> str:
    while name.lower() in {n.lower() for n in names}:
        name += "_"
    return name


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Headered CSV, one file per partition (no single-file coalesce:
    that would funnel the table through one task)."""
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)
    return path


def _complete(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    return fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))


def materialize(df: DataFrame, path: str, force: bool = False, partition_by: Sequence[str] = ()) -> DataFrame:
    """Load the parquet table at ``path`` if it was completely written,
    else compute ``df``, write it and load it (which also cuts the lineage)."""
    spark = df.sparkSession
    if force or not _complete(spark, path):
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
    return spark.read.parquet(path)


def pending(planned: DataFrame, done_path: str, keys: Sequence[str]) -> DataFrame:
    """Planned work rows whose keys have no result at ``done_path`` yet."""
    spark = planned.sparkSession
    if not _complete(spark, done_path):
        return planned
    done = spark.read.parquet(done_path).select(*keys).distinct()
    return planned.join(done, list(keys), "left_anti")


def partitions_written(spark: SparkSession, path: str) -> bool:
    """Whether a partitioned table at ``path`` has a committed partition (its
    writers work in hidden folders until they commit)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and any(s.isDirectory() and "=" in s.getPath().getName() for s in fs.listStatus(p))


def overwrite_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace the partitions that ``df`` has rows of, and no others; writers of
    different partitions may work at the same time."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "overwrite") -> str:
    """One table partitioned by e.g. ``(model, fold)`` or ``fold``;
    rows are clustered on the partition columns first so each task writes
    few files."""
    df.repartition(*by).write.mode(mode).partitionBy(*by).parquet(path)
    return path


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """A long metrics/report table as JSON lines."""
    df.write.mode(mode).json(path)
    return path


def run_report(report: DataFrame, parameters: dict, id_cols: Sequence[str] = (), written_at=None) -> DataFrame:
    """S7 report: one row per line of a classification report (with its id
    columns, e.g. the fold), the run's parameters as a map, and the time of
    writing (now unless given)."""
    pairs = [x for k, v in sorted(parameters.items()) for x in (F.lit(str(k)), F.lit(str(v)))]
    return report.select(
        *id_cols, *[c for c in report.columns if c not in id_cols],
        F.create_map(*pairs).alias("parameters"),
        (F.current_timestamp() if written_at is None else F.lit(written_at).cast("timestamp")).alias("written_at"),
    )


def first_rows(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """O3: the ``n`` rows of smallest id, in id order (a distributed top-n)."""
    return df.orderBy(id_col).limit(n)


def long_metrics(df: DataFrame, id_cols: Sequence[str], metric_cols: Sequence[str]) -> DataFrame:
    """S7 layout: ``(id..., metric, value)``."""
    return df.select(*id_cols, *[F.col(c).cast("double").alias(c) for c in metric_cols]).unpivot(
        list(id_cols), list(metric_cols), "metric", "value"
    )
