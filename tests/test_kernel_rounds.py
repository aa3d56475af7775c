import numpy as np

from lathe.operators import kernel, models
from tests.test_models_training import table


def test_many_rows_take_few_rounds(spark, monkeypatch):
    """A kernel of many directions, and most weights at their bounds, where the start has to leave them."""
    monkeypatch.setattr(kernel, "START_ROWS", 1000)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 10))
    y = 30 * rng.uniform(-1, 1, size=2000) + np.sin(x[:, 0])
    fitted = models.KernelSVR(working_set=64, max_rounds=12).fit(table(spark, x, y).repartition(2))
    assert fitted.gap <= 1e-3 and fitted.rounds < 12
    known = {tuple(z): w for z, w in zip(fitted.x.tolist(), fitted.weights.tolist())}
    b = np.array([known.get(tuple(z), 0.0) for z in x.tolist()])
    assert abs(b.sum()) < 1e-6 and (np.abs(b) == 1).mean() > 0.9
    up, down = kernel.slopes(b, kernel.gaussian(x, x, fitted.gamma) @ b - y, 1.0, 0.1)
    assert down.max() - up.min() <= 1.1e-3


def test_newtons_steps_settle_a_small_dual():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 2))
    y = 5 * np.sin(2 * x[:, 0]) + rng.normal(size=300)
    k, before = kernel.gaussian(x, x, 0.3), np.zeros(300)
    b = kernel.settle(k, -y, before, 1.0, 0.1, 1e-4)
    exact = kernel.pairwise(k, -y, before, 1.0, 0.1, 1e-6)
    value = lambda b: b @ k @ b / 2 - y @ b + 0.1 * np.abs(b).sum()
    up, down = kernel.slopes(b, k @ b - y, 1.0, 0.1)
    assert abs(b.sum()) < 1e-8 and down.max() - up.min() < 1e-3 and abs(value(b) - value(exact)) < 1e-3
    assert value(kernel.settle(k, k @ exact - y, exact, 1.0, 0.1, 1e-4)) <= value(exact)


def test_pivots_leave_little_of_the_kernel():
    x = np.random.default_rng(7).normal(size=(500, 2))
    z, inverse = kernel.pivots(x, 0.2, 200, block=16)
    p = kernel.gaussian(x, z, 0.2) @ inverse.T
    assert len(z) <= 200 and np.abs(p @ p.T - kernel.gaussian(x, x, 0.2)).max() < 1e-7
    w = np.random.default_rng(8).normal(size=500)
    assert np.allclose(kernel.weighted(x, x, w, 0.2), kernel.gaussian(x, x, 0.2) @ w)
