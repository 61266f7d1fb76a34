"""Whitening of embeddings by spectrum slicing.

Each entry ``c`` becomes the whole number ``floor(64 * c) + 1000000``. The fit
list is every distinct vector of whole numbers once. Its covariance (divisor
``n``, centred before multiplying) is a small matrix; its leading eigenpairs are
found by slicing the spectrum:

* the inertia of ``V - s I``, read off the pivots of an LDL^T factorisation with
  symmetric (Bunch-Kaufman) pivoting, counts the eigenvalues above ``s``;
* bisection on these counts isolates the k-th eigenvalue in an interval that
  holds no other one (or shows that several agree to the last digits);
* Rayleigh quotient iteration, started from the interval's middle, converges
  cubically; a quotient that leaves the interval is thrown away and the
  interval halved once more;
* counts just below and just above the result certify that it is number k.

Scale. Vectors are converted once and written (id, whole numbers); the distinct
ones are found by an ordinary shuffle (equal vectors meet map-side first) and
written. Sums, products and the check of the whitened covariance are partial
sums, one matrix per task, added by Spark: the driver sees one number for every
pair of dimensions, never a vector of the table. Rows are whitened where they
are, in Arrow batches.

Defined cases. Rows whose vector is null, empty, or holds a null or non-finite
entry are left out, and so are entries beyond ``LIMIT`` (their whole number
would pass 62 bits). All vectors have one length, the most frequent one (the
longer of equally frequent ones); rows of another length are left out. Repeated
rows are each returned. Components whose eigenvalue is zero to rounding
do not exist: fewer distinct vectors than components give fewer components, one
distinct vector gives none, an empty table gives an empty result. Equal
eigenvalues are numbered in the order found; their vectors are orthogonal. The
sign makes the largest entry (the first of them) positive. ``deviation`` is null
where it passes 64 bits. Other columns may have any name; ids may be null or
repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from corpusframe.llm.tables import stored, table

COMPONENTS = 16
STEPS = 64
SHIFT = 1_000_000
#: Entries of this size or more count as not finite.
LIMIT = 2.0**55
EPS = float(np.finfo(float).eps)

# ------------------------------------------------------------- eigenpairs


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix above ``shift``: the positive pivots of
    an LDL^T factorisation of ``matrix - shift * I``."""
    a = matrix - shift * np.eye(len(matrix))
    n, k, above = len(a), 0, 0
    alpha = (1 + 17**0.5) / 8
    while k < n:
        pivot, two = k, False
        if k + 1 < n:
            column = np.abs(a[k + 1 :, k])
            r = k + 1 + int(column.argmax())
            largest = column[r - k - 1]
            if abs(a[k, k]) < alpha * largest:
                row = np.abs(a[r, k:])
                row[r - k] = 0
                widest = row.max()
                if abs(a[k, k]) * widest < alpha * largest * largest:
                    two = abs(a[r, r]) < alpha * widest
                    pivot = r
        at = k + 1 if two else k
        if pivot != at:
            a[[at, pivot]] = a[[pivot, at]]
            a[:, [at, pivot]] = a[:, [pivot, at]]
        if two:  # always one positive and one negative eigenvalue
            above += 1
            c = a[k + 2 :, k : k + 2]
            if len(c):
                a[k + 2 :, k + 2 :] -= c @ np.linalg.solve(a[k : k + 2, k : k + 2], c.T)
            k += 2
        else:
            d = a[k, k]
            above += d > 0
            c = a[k + 1 :, k]
            if d != 0:
                a[k + 1 :, k + 1 :] -= np.outer(c, c / d)
            k += 1
    return int(above)


def _solve(matrix: np.ndarray, shift: float, v: np.ndarray, scale: float) -> np.ndarray:
    for k in range(4):  # a shift that is an eigenvalue to the last bit
        try:
            y = np.linalg.solve(matrix - (shift + k * EPS * scale) * np.eye(len(matrix)), v)
            if np.isfinite(y).all() and y.any():
                return y / np.linalg.norm(y)
        except np.linalg.LinAlgError:
            pass
    return v


def leading_eigenpairs(matrix: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the ``components`` largest eigenvalues of
    a positive semidefinite matrix that are not zero to rounding, by falling value."""
    d = len(matrix)
    scale = float(np.linalg.norm(matrix)) if d else 0.0
    if scale == 0:
        return np.zeros(0), np.zeros((d, 0))
    near = 4 * d * EPS * scale
    counts = {-near: d, scale * (1 + 1e-9) + near: 0}

    def above(s: float) -> int:
        if s not in counts:
            counts[s] = count_above(matrix, s)
        return counts[s]

    def halve(lo: float, hi: float, k: int) -> tuple[float, float]:
        mid = (lo + hi) / 2
        return (mid, hi) if above(mid) >= k else (lo, mid)

    values: list[float] = []
    vectors = np.zeros((d, 0))
    most = min(components, above(near))
    while len(values) < most:
        k = len(values) + 1
        lo = max(s for s, c in counts.items() if c >= k)
        hi = min(s for s, c in counts.items() if c < k and s > lo)
        while (above(lo) != k or above(hi) != k - 1) and hi - lo > near:
            lo, hi = halve(lo, hi, k)
        alone = above(lo) == k and above(hi) == k - 1
        while True:
            shift, v = (lo + hi) / 2, np.cos(np.arange(1, d + 1) * (k + 0.5))
            good = False
            for step in range(12):
                v = _solve(matrix, shift, v, scale)
                for _ in range(2):
                    v = v - vectors @ (vectors.T @ v)
                    v /= np.linalg.norm(v)
                value = float(v @ matrix @ v)
                good = np.linalg.norm(matrix @ v - value * v) <= near
                if good and step > 1:
                    break
                if alone and step and lo < value < hi:
                    shift = value
            inside = lo - near <= value <= hi + near
            if (good and inside and above(value - 2 * near) >= k > above(value + 2 * near)) or hi - lo <= near / 4:
                break
            lo, hi = halve(lo, hi, k)
        values.append(value)
        vectors = np.column_stack([vectors, v * np.sign(v[np.abs(v).argmax()])])
    order = np.argsort(-np.array(values), kind="stable")  # equal to rounding: may be out of order by that much
    return np.array(values)[order], vectors[:, order]


# ------------------------------------------------------------- the fit


@dataclass(frozen=True)
class Whitening:
    """n vectors of the fit list, their sums per dimension, and the components."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - sums / n``, without losing digits to the size of ``x``."""
        return _centred(x, self.n, self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) @ self.vectors) / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of ``(n * x - sums) ** 2``, exact."""
        whole, rest = _parts(self.n, self.sums)
        c = x - whole
        bound = (int(np.abs(c).max(initial=0)) + 1) * self.n
        kind = np.int64 if bound * bound * max(1, len(self.sums)) < 1 << 63 else object
        t = c.astype(kind) * self.n - rest.astype(kind)
        return [v if v < 1 << 63 else None for v in (t * t).sum(axis=1).tolist()]


def _parts(n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([s // n for s in sums], dtype=np.int64), np.array([s % n for s in sums], dtype=np.int64)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    whole, rest = _parts(n, sums)
    return (x - whole).astype(np.float64) - rest / n


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def whole_numbers(vector: Column) -> Column:
    """The vector as whole numbers; null if an entry is missing, not finite or too large."""
    v = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LIMIT))
    x = F.transform(v, lambda c: F.floor(c * STEPS).cast("long") + SHIFT)
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad, x)


def _sums(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    total, n = [0] * d, 0
    for b in batches:
        x = _matrix(b.column(0), d)
        n += len(x)
        big = int(np.abs(x).max(initial=0)) * len(x) >= 1 << 63
        total = [t + int(s) for t, s in zip(total, x.sum(axis=0, dtype=object if big else np.int64))]
    if n:
        yield pa.RecordBatch.from_pydict({"i": list(range(-1, d)), "total": [str(t) for t in [n, *total]]}, pa.schema([("i", pa.int64()), ("total", pa.string())]))


def _products(batches: Iterator[pa.RecordBatch], d: int, rows_of) -> Iterator[pa.RecordBatch]:
    """Sums of the products of every two columns of ``rows_of(x)``."""
    total = None
    for b in batches:
        z = rows_of(_matrix(b.column(0), d))
        total = z.T @ z if total is None else total + z.T @ z
    if total is not None:
        i, j = np.triu_indices(len(total))
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int64), "j": j.astype(np.int64), "total": total[i, j]})


def _covariance(fit: DataFrame, n: int, d: int, rows_of, width: int) -> np.ndarray:
    sums = fit.mapInArrow(partial(_products, d=d, rows_of=rows_of), "i long, j long, total double")
    sums = sums.groupBy("i", "j").agg(F.sum("total").alias("total"))
    out = np.zeros((width, width))
    for r in sums.collect():  # a number for every pair of dimensions
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["total"] / n
    return out


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, float]:
    """``rows`` (x: whole numbers, of one length) -> the fit, and the largest
    absolute entry of the whitened fit list's covariance minus the identity. No
    rows: no fit."""
    first = rows.select(F.size("x").alias("d")).first()
    if first is None:
        return None, 0.0
    d = first["d"]
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    sums = fit.mapInArrow(partial(_sums, d=d), "i long, total string")
    sums = sums.groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    total = {r["i"]: int(r["total"]) for r in sums.collect()}  # a number for every dimension
    n, sums = total[-1], tuple(total[i] for i in range(d))
    v = _covariance(fit, n, d, partial(_centred, n=n, sums=sums), d)
    values, vectors = leading_eigenpairs(v, components)
    model = Whitening(n, sums, values, vectors, float(np.trace(v)))
    k = len(values)
    error = float(np.abs(_covariance(fit, n, d, model.whitened, k) - np.eye(k)).max()) if k else 0.0
    return model, error


# ------------------------------------------------------------- the rows


def usable_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x), stored: the rows that count, of one length."""
    rows = stored(vectors.select(F.col(id_col).alias("vec_id"), whole_numbers(F.col(vector_col)).alias("x")).where("x IS NOT NULL"), "whitening-rows")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(2).collect()
    return rows.where(F.size("x") == lengths[0]["d"]) if len(lengths) > 1 else rows


def _apply(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    d, k = len(model.sums), len(model.values)
    for b in batches:
        x = _matrix(b.column("x"), d)
        z = model.whitened(x)
        offsets = pa.array(np.arange(0, len(x) * k + 1, k), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(model.deviations(x), pa.int64()), lists], ["vec_id", "deviation", "whitened"])


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, x) -> (vec_id, deviation, whitened: one entry per component)."""
    schema = StructType([rows.schema["vec_id"], StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))])
    return rows.mapInArrow(partial(_apply, model=model), schema)


def whitening_report(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: vec_id, component (from 1), n,
    deviation, whitened, explained, identity_error."""
    rows = usable_rows(vectors, id_col, vector_col)
    model, error = fit_whitening(rows, components)
    if model is None or not len(model.values):
        one = F.array(F.lit(0.0))
        return rows.limit(0).select(
            "vec_id", F.lit(1).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
            one[0].alias("whitened"), one[0].alias("explained"), one[0].alias("identity_error"),
        )
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    each = whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_report(table(spark, sf_dir, "embeddings"))
