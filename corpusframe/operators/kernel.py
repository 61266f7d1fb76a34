"""M3's kernel: random Fourier features, a Spark ML transformer.

The inner product of ``z(x) = sqrt(2 / D) * cos(x W + b)`` approximates the RBF
kernel ``exp(-gamma * |x - y|^2)``, so a linear SVM on ``z`` separates what an RBF
SVM does, with a fit that is a sum over rows instead of a kernel matrix.
``gamma='scale'`` is the library default ``1 / (features * variance)``, the
variance taken over all entries of the training matrix.

W and b are drawn from a seed, row by row: row ``i`` of W has its own generator,
so the model's state is four numbers, a sparse vector draws only the rows that it
has entries in (a worker keeps those it has drawn), and every executor
draws the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of W that a worker keeps.
KEPT_ROWS = 20_000
#: Rows that a worker hands back at once, however many a batch has.
ROWS_AT_ONCE = 256


class _Draws(dict):
    """Rows of W by number; ``-1``: the phases b."""

    def __init__(self, width: int, gamma: float, seed: int):
        super().__init__()
        self.width, self.gamma, self.seed = width, gamma, seed

    def __missing__(self, i: int) -> np.ndarray:
        if len(self) > KEPT_ROWS:
            self.clear()
        g = np.random.Generator(np.random.PCG64([self.seed, i + 1]))
        row = g.uniform(0, 2 * np.pi, self.width) if i < 0 else g.normal(0, (2 * self.gamma) ** 0.5, self.width)
        self[i] = row
        return row


def _features(width: int, gamma: float, seed: int):
    """A batch function of (indices, values)."""

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        draws = _Draws(width, gamma, seed)
        for indices, values in batches:
            out = []
            for n, (at, v) in enumerate(zip(indices, values), 1):
                z = draws[-1].copy()
                for i, x in zip(range(len(v)) if at is None else at, v):
                    z += x * draws[int(i)]
                out.append(np.sqrt(2 / width) * np.cos(z))
                if len(out) == ROWS_AT_ONCE or n == len(values):
                    yield pd.Series(out)
                    out = []

    return features


class _FourierParams(HasInputCol, HasOutputCol, HasSeed):
    width = Param(Params._dummy(), "width", "number of random features", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel coefficient; 0: from the training variance", TypeConverters.toFloat)


class RandomFourierFeatures(Estimator, _FourierParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="fourier", width=512, gamma=0.0, seed=42):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="fourier", width=512, gamma=0.0, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> RandomFourierFeaturesModel:
        gamma = self.getOrDefault(self.gamma)
        if gamma == 0:
            u = df.select(F.unwrap_udt(self.getInputCol()).alias("u")).select(F.coalesce("u.size", F.size("u.values")).alias("d"), "u.values")
            add = lambda f: F.sum(F.aggregate("values", F.lit(0.0), lambda a, x: a + f(x)))
            s = u.agg(F.sum("d").alias("n"), F.max("d").alias("d"), add(lambda x: x).alias("s"), add(lambda x: x * x).alias("q")).first()  # one row
            variance = s["q"] / s["n"] - (s["s"] / s["n"]) ** 2 if s["n"] else 0.0
            gamma = 1.0 / (s["d"] * variance) if variance > 0 else 1.0
        model = RandomFourierFeaturesModel()
        self._copyValues(model)
        return model._set(gamma=gamma)


class RandomFourierFeaturesModel(Model, _FourierParams, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="fourier", width=512, gamma=0.0, seed=42)

    def _transform(self, df: DataFrame) -> DataFrame:
        of = self.getOrDefault
        u = F.unwrap_udt(self.getInputCol())
        z = _features(of(self.width), of(self.gamma), of(self.seed))(u["indices"], u["values"])
        return df.withColumn(self.getOutputCol(), array_to_vector(z))
