"""A caller's model over Arrow batches, loaded once per worker.

The stored model (bytes: weights, a serialised network, ...) travels as one
broadcast, which Spark hands to each executor once. A Python worker builds the
scoring function from it when it first needs it and keeps it for all its tasks;
batches of rows then pass through as NumPy arrays.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Scoring functions of this worker, by model.
_LOADED: dict[str, Callable[[np.ndarray], np.ndarray]] = {}


class SharedModel:
    """``build(payload)`` returns a function from a matrix (one row per input)
    to one number per row. ``build`` runs on the workers."""

    def __init__(self, spark: SparkSession, payload: bytes, build: Callable[[bytes], Callable[[np.ndarray], np.ndarray]]):
        self.key, self.build = uuid.uuid4().hex, build
        self.payload = spark.sparkContext.broadcast(payload)

    def scorer(self) -> Callable[[np.ndarray], np.ndarray]:
        from corpusframe.operators import scoring  # this worker's module, also if the object came by value

        if self.key not in scoring._LOADED:
            scoring._LOADED.clear()  # one model at a time
            scoring._LOADED[self.key] = self.build(self.payload.value)
        return scoring._LOADED[self.key]


def _scored(batches: Iterator[pa.RecordBatch], model: SharedModel, width: int, batch_size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, batch_size):
            part = b.slice(at, batch_size)
            x = part.column(part.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            y = pa.array(np.asarray(model.scorer()(x), dtype=np.float64))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], y], [*b.schema.names[:-1], "score"])


def score_batches(df: DataFrame, model: SharedModel, vector_col: str, width: int, batch_size: int = 64) -> DataFrame:
    """``df`` with ``vector_col`` (an array of ``width`` doubles) replaced by
    ``score``; the model sees at most ``batch_size`` rows at a time. Other columns
    are kept as they are."""
    keep = [c for c in df.columns if c != vector_col]
    rows = df.select(*keep, vector_col)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(partial(_scored, model=model, width=width, batch_size=batch_size), ", ".join([*kept, "score double"]))
