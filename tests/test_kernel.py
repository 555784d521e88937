"""Kernel machines of many cells against one plain descent per cell."""

import numpy as np
import pytest

from disclosure_spark.operators import kernel as K


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 3)) * [1, 4, 0] + [0, 2, 5]
    y = (np.abs(x[:, 0]) > 0.7).astype(int)
    sides = np.stack([np.where(np.arange(90) % 3 == 0, 0, 1), np.where(np.arange(90) < 40, 1, -1), np.full(90, -1)], axis=1)
    return x, y, sides


def scalers_of(x, sides):
    return [(x[sides[:, c] == 1].mean(0), x[sides[:, c] == 1].std(0)) for c in (0, 1)] + [(np.zeros(3), np.ones(3))]


def frame(spark, data):
    rows = [([float(v) for v in a], int(b), [int(v) for v in c]) for a, b, c in zip(*data)]
    return spark.createDataFrame(rows, "features array<double>, y int, sides array<int>").repartition(5)


def plain_descent(z, signs, C, steps):
    """The same objective, written for one machine over one matrix."""
    n, before, now = len(z), np.zeros(z.shape[1]), np.zeros(z.shape[1])
    lam = np.append(np.full(z.shape[1] - 1, 1 / (C * n)), 0)
    for t in range(steps):
        u = now + t / (t + 3) * (now - before)
        grad = sum(-2 * s * max(0.0, 1 - s * float(r @ u)) * r for r, s in zip(z, signs)) / n + lam * u
        before, now = now, u - grad / (6 + 1 / (C * n))
    return now


def test_cells_equal_one_descent_each(spark, data):
    x, y, sides = data
    scalers = scalers_of(x, sides)
    cells = [K.Cell(0, 0.5, 60), K.Cell(1, 2.0, 40), K.Cell(2, 1.0, 0)]
    rows = frame(spark, data)
    got = K.fit_cells(rows, cells, scalers, C=3.0, width=12, n_inputs=3, max_iter=9)
    weights = K.fourier_weights(3, 12)
    right = {}
    for at in (0, 1):
        mean, std = scalers[at]
        z = K.lift((x - mean) / np.where(std == 0, 1, std), cells[at].gamma, *weights)
        z = np.hstack([z, np.ones((90, 1))])
        train = sides[:, at] == 1
        expected = plain_descent(z[train], np.where(y[train] == 1, 1, -1), 3.0, 9)
        assert np.allclose(got[at], expected, atol=1e-10)
        hit = (z @ expected > 0) == (y == 1)
        for side, name in ((1, "train"), (0, "valid")):
            if (sides[:, at] == side).any():
                right[at, name] = (int(hit[sides[:, at] == side].sum()), int((sides[:, at] == side).sum()))
    assert not got[2].any()  # no training rows
    counts = K.count_right(rows, cells, scalers, got, n_inputs=3).collect()
    assert {(r["cell"], r["side"]): (r["correct"], r["n"]) for r in counts} == right


def test_a_step_is_one_pass_for_all_cells(spark, data, monkeypatch):
    passes = []
    real = K.merged_vectors
    monkeypatch.setattr(K, "merged_vectors", lambda *a, **o: passes.append(1) or real(*a, **o))
    cells = [K.Cell(2, g, 10) for g in (0.1, 1.0, 10.0)]
    K.fit_cells(frame(spark, data), cells, scalers_of(data[0], data[2]), width=4, n_inputs=3, max_iter=3)
    assert len(passes) == 3


def test_inner_products_approach_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6, 2))
    z = K.lift(x, 0.3, *K.fourier_weights(2, 4000))
    exact = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - exact).max() < 0.06


def test_no_rows_give_zero_weights(spark):
    empty = spark.createDataFrame([], "features array<double>, y int, sides array<int>")
    got = K.fit_cells(empty, [K.Cell(0, 1.0, 0)], [(np.zeros(2), np.ones(2))], width=4, n_inputs=2, max_iter=2)
    assert not got.any() and got.shape == (1, 5)


def test_half_versines_are_exact_for_any_turn():
    turns = np.concatenate([np.linspace(-3, 3, 1001), [0.0, 0.5, -0.5, 1e6 + 0.25]])
    assert np.abs(1 - 2 * K.half_versine(turns.copy()) - np.cos(2 * np.pi * turns)).max() < 1e-14 + 1e-9 * (np.abs(turns).max() > 1e5)


def test_only_rows_that_train_a_cell_are_lifted(data):
    import pandas as pd

    x, y, sides = data
    pdf = pd.DataFrame({"features": list(x), "y": y, "sides": list(sides)})
    seen = {}
    for least in (0, 1):
        K._visit_cells(
            [pdf], [K.Cell(0, 0.5, 60), K.Cell(1, 2.0, 40), K.Cell(2, 1.0, 0)], scalers_of(x, sides), K.fourier_weights(3, 4), "features", least,
            lambda at, versines, signs, side, least=least: seen.update({(least, at): len(versines)}),
        )
    assert seen == {(0, 0): 90, (0, 1): 40, (1, 0): 60, (1, 1): 40}
