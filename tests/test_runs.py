"""Memory and sums of the run margins, and of the kernel's batches."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from corpusframe.operators import kernel as K
from corpusframe.plans import runs as RU


@pytest.mark.parametrize("biggest", [300, 50_000])
def test_margins_of_a_large_batch_take_little_memory(biggest):
    g = np.random.default_rng(biggest)
    sizes = np.append(g.integers(1, 300, 2000), biggest)
    k, v = g.integers(-1, 999, sizes.sum()).astype(np.int32), g.random(sizes.sum())
    x = pa.ListArray.from_arrays(pa.array(np.append(0, sizes.cumsum()), pa.int32()), pa.StructArray.from_arrays([pa.array(k), pa.array(v)], ["k", "v"]))
    batch, w = pa.RecordBatch.from_arrays([pa.array(np.arange(len(sizes))), x], ["id", "x"]), g.normal(size=(1000, 50))
    tracemalloc.start()
    out = list(RU._margins(iter([batch]), w))[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6  # all entries at once: 120 MB a copy
    got = out.column("m").flatten().to_numpy().reshape(len(sizes), 50)
    row = np.repeat(np.arange(len(sizes)), sizes)
    want = np.stack([np.bincount(row, w[k, j] * v) for j in range(50)], axis=1)
    assert out.column("id").to_pylist() == list(range(len(sizes))) and np.allclose(got, want)


def test_margins_of_an_empty_batch():
    x = pa.array([], pa.list_(pa.struct([("k", pa.int32()), ("v", pa.float64())])))
    batch = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), x], ["id", "x"])
    assert [b.num_rows for b in RU._margins(iter([batch]), np.zeros((3, 4)))] == [0]


def test_fourier_features_leave_a_worker_in_small_parts(spark):
    n = 2 * K.ROWS_AT_ONCE + 3
    values = pd.Series([np.array([1.0 + i % 5]) for i in range(n)])
    indices = pd.Series([np.array([i % 7]) for i in range(n)])
    parts = list(K._features(8, 0.5, 42).func(iter([(indices, values), (indices[:0], values[:0]), (indices[:2], values[:2])])))
    assert [len(p) for p in parts] == [K.ROWS_AT_ONCE, K.ROWS_AT_ONCE, 3, 2]
    draws = K._Draws(8, 0.5, 42)
    want = [np.sqrt(2 / 8) * np.cos(draws[-1] + v[0] * draws[int(i[0])]) for i, v in zip(indices, values)]
    assert np.array_equal(np.stack([r for p in parts for r in p]), np.stack(want + want[:2]))
