"""M6: the fusion head, trained jointly.

A text vector and a few numbers meet in one network: the numbers pass a learned
projection, which is clamped to ``CLAMP``; vector and projection are concatenated and
pass a ReLU layer and an output layer with one logit per class; the loss is the
mean cross-entropy plus an L2 term on the weights.

Training is full-batch L-BFGS. The parameters are one vector of fixed size (some
thousand numbers, whatever the input's size) on the driver; every step ships
them with the job, each task adds up loss and gradient over its rows in Arrow
batches, and Spark adds up the tasks' vectors, entry by entry. No row leaves its
task, the result does not depend on how rows are dealt to tasks (but for
rounding), and a lost executor costs the tasks it ran.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasMaxIter, HasSeed, HasTol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES = 2
CLAMP = 10.0

# ------------------------------------------------------------- the network


def shapes(vector: int, numbers: int, projected: int, hidden: int) -> list[tuple[int, int]]:
    """Weights with their bias as the last row: projection, ReLU layer, output."""
    return [(numbers + 1, projected), (vector + projected + 1, hidden), (hidden + 1, CLASSES)]


def unpacked(theta: np.ndarray, of: list[tuple[int, int]]) -> list[np.ndarray]:
    cuts = np.cumsum([a * b for a, b in of])[:-1]
    return [p.reshape(s) for p, s in zip(np.split(theta, cuts), of)]


def start(of: list[tuple[int, int]], seed: int) -> np.ndarray:
    """Uniform within 1 / sqrt(inputs) of zero."""
    g = np.random.Generator(np.random.PCG64(seed))
    return np.concatenate([g.uniform(-1, 1, a * b) / (a - 1) ** 0.5 for a, b in of])


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def logits(theta: np.ndarray, of: list[tuple[int, int]], v: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, tuple]:
    p, h, o = unpacked(theta, of)
    f1 = _with_one(f)
    q = f1 @ p
    x1 = _with_one(np.hstack([v, np.clip(q, -CLAMP, CLAMP)]))
    z = x1 @ h
    a1 = _with_one(np.maximum(z, 0.0))
    return a1 @ o, (f1, q, x1, z, a1)


def loss_and_gradient(theta: np.ndarray, of: list[tuple[int, int]], v: np.ndarray, f: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed cross-entropy of the rows and its gradient."""
    _, h, o = unpacked(theta, of)
    out, (f1, q, x1, z, a1) = logits(theta, of, v, f)
    out = out - out.max(axis=1, keepdims=True)
    logs = out - np.log(np.exp(out).sum(axis=1, keepdims=True))
    rows = np.arange(len(y))
    d_out = np.exp(logs)
    d_out[rows, y] -= 1.0
    d_z = (d_out @ o[:-1].T) * (z > 0)
    d_x = d_z @ h[:-1].T
    d_p = d_x[:, v.shape[1] :] * (np.abs(q) < CLAMP)
    gradient = [f1.T @ d_p, x1.T @ d_z, a1.T @ d_out]
    return float(-logs[rows, y].sum()), np.concatenate([g.ravel() for g in gradient])


def minimise(value: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int, tol: float, memory: int = 10) -> tuple[np.ndarray, list[float]]:
    """L-BFGS with step halving; returns the minimum found and the values on
    the way, which fall."""
    f, g = value(x)
    path, steps, changes = [f], [], []
    for _ in range(max_iter):
        d, back = -g, []
        for s, c in zip(reversed(steps), reversed(changes)):
            a = (s @ d) / (s @ c)
            back.append(a)
            d = d - a * c
        if steps:
            d = d * (steps[-1] @ changes[-1]) / (changes[-1] @ changes[-1])
        for s, c, a in zip(steps, changes, reversed(back)):
            d = d + (a - (c @ d) / (s @ c)) * s
        slope = g @ d
        t = 1.0 if steps else min(1.0, 1.0 / max(np.abs(g).sum(), 1e-12))
        for _ in range(20):
            new_f, new_g = value(x + t * d)
            if new_f <= f + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        if (t * d) @ (new_g - g) > 1e-12:
            steps, changes = [*steps, t * d][-memory:], [*changes, new_g - g][-memory:]
        done = f - new_f <= tol * max(1.0, abs(f))
        x, f, g = x + t * d, new_f, new_g
        path.append(f)
        if done:
            break
    return x, path


# ------------------------------------------------------------- on Spark


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _task_sums(batches: Iterator[pa.RecordBatch], theta: np.ndarray, of: list[tuple[int, int]], vector: int) -> Iterator[pa.RecordBatch]:
    """(v, f, y) -> one row per task: summed gradient, then loss and rows."""
    total = np.zeros(len(theta) + 2)
    for b in batches:
        y = b.column(2).to_numpy().astype(np.int64)
        loss, gradient = loss_and_gradient(theta, of, _rows(b.column(0), vector), _rows(b.column(1), of[0][0] - 1), y)
        total += np.append(gradient, [loss, len(y)])
    if total[-1]:
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total], pa.list_(pa.float64()))})


def gradient(rows: DataFrame, theta: np.ndarray, of: list[tuple[int, int]], vector: int) -> tuple[float, np.ndarray, int]:
    """(summed loss, its gradient, rows) over a table (v, f, y)."""
    sums = rows.mapInArrow(partial(_task_sums, theta=theta, of=of, vector=vector), "sums array<double>")
    sums = sums.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).toArrow()  # one number per parameter
    out = np.zeros(len(theta) + 2)
    out[sums.column("at").to_numpy()] = sums.column("x").to_numpy()
    return float(out[-2]), out[:-2], int(out[-1])


class _HeadParams(HasLabelCol, HasMaxIter, HasTol, HasSeed):
    vectorCol = Param(Params._dummy(), "vectorCol", "text vector, an array of doubles", TypeConverters.toString)
    numberCol = Param(Params._dummy(), "numberCol", "the other features, an array of doubles", TypeConverters.toString)
    projected = Param(Params._dummy(), "projected", "width of the projection of the numbers", TypeConverters.toInt)
    hidden = Param(Params._dummy(), "hidden", "width of the ReLU layer", TypeConverters.toInt)
    reg = Param(Params._dummy(), "reg", "L2 strength", TypeConverters.toFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(vectorCol="v", numberCol="f", labelCol="label", projected=32, hidden=128, maxIter=50, tol=1e-5, seed=42, reg=1e-4)


class FusionHead(Estimator, _HeadParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, vectorCol="v", numberCol="f", labelCol="label", projected=32, hidden=128, maxIter=50, tol=1e-5, seed=42, reg=1e-4):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> FusionHeadModel:
        """``df`` is read once per step: pass a stored table."""
        get = self.getOrDefault
        rows = df.select(get(self.vectorCol), get(self.numberCol), F.col(self.getLabelCol()).cast("int"))
        widths = rows.select(F.size(rows.columns[0]), F.size(rows.columns[1])).first()
        if widths is None:
            raise ValueError("no rows to fit")
        of = shapes(*widths, get(self.projected), get(self.hidden))

        def value(theta: np.ndarray) -> tuple[float, np.ndarray]:
            loss, g, n = gradient(rows, theta, of, widths[0])
            return loss / n + get(self.reg) / 2 * float(theta @ theta), g / n + get(self.reg) * theta

        theta, losses = minimise(value, start(of, self.getSeed()), self.getMaxIter(), self.getTol())
        model = FusionHeadModel()
        self._copyValues(model)
        return model._set(parameters=theta.tolist(), losses=losses, widths=list(widths))


def _probability(theta: np.ndarray, of: list[tuple[int, int]], vector: int):
    @F.pandas_udf("double")
    def probability(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for v, f in batches:
            out, _ = logits(theta, of, np.vstack(v.to_numpy()).reshape(-1, vector), np.vstack(f.to_numpy())) if len(v) else (np.zeros((0, 2)), None)
            yield pd.Series(1.0 / (1.0 + np.exp(np.clip(out[:, 0] - out[:, 1], -700, 700))))

    return probability


class FusionHeadModel(Model, _HeadParams, DefaultParamsReadable, DefaultParamsWritable):
    parameters = Param(Params._dummy(), "parameters", "all weights, in order", TypeConverters.toListFloat)
    losses = Param(Params._dummy(), "losses", "loss after each step", TypeConverters.toListFloat)
    widths = Param(Params._dummy(), "widths", "lengths of the vector and of the numbers", TypeConverters.toListInt)

    def _transform(self, df: DataFrame) -> DataFrame:
        """Adds ``score`` (probability of class 1) and ``prediction``."""
        get = self.getOrDefault
        widths = get(self.widths)
        of = shapes(*widths, get(self.projected), get(self.hidden))
        score = _probability(np.array(get(self.parameters)), of, widths[0])(F.col(get(self.vectorCol)), F.col(get(self.numberCol)))
        return df.withColumn("score", score).withColumn("prediction", (F.col("score") > 0.5).cast("double"))
