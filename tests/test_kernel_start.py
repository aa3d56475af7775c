import numpy as np

from lathe.operators import kernel


def test_a_start_adds_up_to_nothing_and_is_nearly_right(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(400, 2))
    y = 20 * np.sin(x[:, 0]) + 5 * x[:, 1] + rnd.normal(size=400)
    rows = [(i, a.tolist(), float(b), 0.0, 0.0) for i, (a, b) in enumerate(zip(x, y))]
    state = spark.createDataFrame(rows, kernel._STATE).coalesce(2).persist()
    monkeypatch.setattr(kernel, "PIVOTS", 64)
    svr = kernel.KernelSVR()
    got = svr._start(state, 0.5, 400).orderBy("id").toPandas()
    b, f = got["b"].to_numpy(), got["f"].to_numpy()
    assert abs(b.sum()) < 1e-6 and np.abs(b).max() <= svr.C
    assert np.allclose(f, kernel.gaussian(x, x, 0.5) @ b)
    up, down = kernel.slopes(b, f - y, svr.C, svr.epsilon)
    assert down.max() - up.min() < 0.1 * (y.max() - y.min())
