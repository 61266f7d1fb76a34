"""M7 / M8: planned fits that run side by side and resume.

A plan is a table of keys, e.g. (config, fold). Every key without a result is
fitted by a call of its own, a few at a time from a thread pool (Spark runs their
jobs side by side, each in a job group of its own), and its result is committed
alone, as the partition of its keys. A run that is cut off, or a fit that fails,
leaves the results that were committed; the next run fits what is missing, found
by an anti-join, and never doubles a row, as a partition is replaced as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from corpusframe.sources.files import overwrite_partitions, partitions_written

WORKERS = 4


def missing(planned: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """The planned rows whose keys have no committed result at ``path``."""
    if not partitions_written(planned.sparkSession, path):
        return planned
    return planned.join(planned.sparkSession.read.parquet(path).select(*keys).distinct(), list(keys), "left_anti")


def run_planned(
    planned: DataFrame, path: str, keys: Sequence[str], fit: Callable[[dict], DataFrame], workers: int = WORKERS, name: str = "fit"
) -> DataFrame:
    """Call ``fit`` with every planned row (as a dict) that has no result yet,
    ``workers`` at a time, and commit the table that it returns; returns the table
    of all results. ``planned`` has a row for every fit: few. After an error the
    other fits still run, then the first error is raised."""
    spark = planned.sparkSession
    todo = sorted((r.asDict() for r in missing(planned, path, keys).collect()), key=lambda r: [str(r[k]) for k in keys])

    def one(row: dict) -> None:
        label = ", ".join(f"{k}={row[k]}" for k in keys)
        spark.sparkContext.setJobGroup(f"{name}: {label}", f"{name}: {label}")
        rows = fit(row)
        for k in keys:
            if k not in rows.columns:
                raise ValueError(f"the result lacks the key {k}")
        overwrite_partitions(rows, path, keys)

    with ThreadPoolExecutor(max(1, workers)) as pool:
        runs = [pool.submit(inheritable_thread_target(spark)(one), row) for row in todo]
    for r in runs:
        r.result()
    return spark.read.parquet(path)
