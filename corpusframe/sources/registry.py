"""Stored models and the table of their runs.

A registry is a folder of the shared file system: models under ``models/``, and
``runs``, a table (model, fold, round, path, metric, value) partitioned by (model,
fold). A run is registered in two steps, the model first and its rows last, each
a commit of its own: a run that is in the table has a complete model, and one
that was cut off is not in the table. Registering a (model, fold) again replaces
its rows. Any fitted Spark ML model with persistence can be stored, pipelines and
this package's own models among them; ``load`` finds the class in the stored
metadata.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.sources.files import overwrite_partitions, partitions_written

RUNS_SCHEMA = "model string, fold int, round int, path string, metric string, value double"


class ModelRegistry:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def register(self, name: str, model: Model, metrics: Mapping[str, float], fold: int = 0, round: int = 0) -> str:
        """Store ``model`` and its metrics; returns the model's path."""
        at = f"{self.path}/models/{uuid.uuid4().hex}"
        model.write().save(at)
        rows = [(name, fold, round, at, k, float(v)) for k, v in sorted(metrics.items())]
        overwrite_partitions(self.spark.createDataFrame(rows, RUNS_SCHEMA).coalesce(1), f"{self.path}/runs", ["model", "fold"])
        return at

    def runs(self) -> DataFrame:
        """(model, fold, round, path, metric, value) of every registered run."""
        if not partitions_written(self.spark, f"{self.path}/runs"):
            return self.spark.createDataFrame([], RUNS_SCHEMA)
        table = self.spark.read.schema(RUNS_SCHEMA).parquet(f"{self.path}/runs")
        return table.select("model", "fold", "round", "path", "metric", "value")

    def best(self, metric: str, name: str | None = None) -> DataFrame:
        """Per model the run with the highest ``metric``, the first (fold,
        round) on ties."""
        runs = self.runs().filter(F.col("metric") == metric)
        runs = runs if name is None else runs.filter(F.col("model") == name)
        key = F.struct("value", (-F.col("fold")).alias("f"), (-F.col("round")).alias("r"))
        return runs.groupBy("model").agg(F.max_by(F.struct("fold", "round", "path", "value"), key).alias("b")).select("model", "b.*")

    def load(self, path: str) -> Model:
        return DefaultParamsReader.loadParamsInstance(path, self.spark)

    def load_best(self, metric: str, name: str) -> Model:
        rows = self.best(metric, name).collect()  # one row
        if not rows:
            raise LookupError(f"no run of {name} with a {metric}")
        return self.load(rows[0]["path"])
