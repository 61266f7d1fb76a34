"""The joint fusion head: gradient, training, partitions, persistence."""

import numpy as np
import pytest

from corpusframe.operators import fusion as FU
from corpusframe.operators import models as M
from corpusframe.session import scratch_path
from corpusframe.sources.files import materialize


def rows(n=300, d=6, seed=0):
    """Classes that neither the vector nor the numbers show alone."""
    g = np.random.default_rng(seed)
    v, f = g.normal(size=(n, d)), g.normal(size=(n, 2)) * 3
    return v, f, ((v[:, 0] > 0) ^ (f[:, 1] > 0)).astype(int)


def table(spark, v, f, y):
    data = [(i, a.tolist(), b.tolist(), int(c)) for i, (a, b, c) in enumerate(zip(v, f, y))]
    return materialize(spark.createDataFrame(data, "id long, v array<double>, f array<double>, label int"), scratch_path(spark, "fusion-test"), force=True)


def test_gradient_equals_numeric_differences():
    v, f, y = rows(20, 4)
    f[0] = [50.0, -50.0]  # beyond the clamp
    of = FU.shapes(4, 2, 3, 5)
    theta = FU.start(of, 1)
    _, g = FU.loss_and_gradient(theta, of, v, f, y)
    for i in range(len(theta)):
        e = np.zeros(len(theta))
        e[i] = 1e-6
        up, down = FU.loss_and_gradient(theta + e, of, v, f, y)[0], FU.loss_and_gradient(theta - e, of, v, f, y)[0]
        assert abs((up - down) / 2e-6 - g[i]) < 1e-4


def test_distributed_gradient_is_the_plain_one_however_rows_are_dealt(spark):
    v, f, y = rows(100)
    of = FU.shapes(6, 2, 4, 8)
    theta = FU.start(of, 3)
    loss, g = FU.loss_and_gradient(theta, of, v, f, y)
    df = table(spark, v, f, y).select("v", "f", "label")
    for parts in (1, 8):
        got = FU.gradient(df.repartition(parts), theta, of, 6)
        assert abs(got[0] - loss) < 1e-9 and np.allclose(got[1], g, atol=1e-9) and got[2] == 100


def test_training_learns_and_is_stored(spark):
    v, f, y = rows()
    df = table(spark, v, f, y)
    head = FU.FusionHead(projected=4, hidden=16, maxIter=60)
    model = head.fit(df.repartition(4))
    losses = model.getOrDefault(model.losses)
    assert all(a >= b for a, b in zip(losses, losses[1:])) and losses[-1] < losses[0] / 2
    preds = M.predictions(model, df).collect()
    assert np.mean([r["predicted_label"] == r["label"] for r in preds]) > 0.9
    path = scratch_path(spark, "head")
    model.write().save(path)
    again = M.predictions(FU.FusionHeadModel.load(path), df.repartition(3)).collect()
    a, b = ({r["id"]: r["score"] for r in p} for p in (preds, again))
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-12 for i in a)
    with pytest.raises(ValueError):
        head.fit(df.limit(0))


def test_minimise_finds_the_minimum_of_a_quadratic():
    g = np.random.default_rng(2)
    a = g.normal(size=(8, 8))
    a = a @ a.T + np.eye(8)
    b = g.normal(size=8)
    x, path = FU.minimise(lambda x: (float(x @ a @ x / 2 - b @ x), a @ x - b), np.zeros(8), 200, 1e-15)
    assert np.allclose(x, np.linalg.solve(a, b), atol=1e-4) and path[-1] <= path[0]
