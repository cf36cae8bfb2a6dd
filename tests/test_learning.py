import math

import numpy as np
import pytest

from netresil.operators import learning as L

COLS = ["D", "S"]


def slopes(rows, model, c):
    """Slopes of the summed loss plus |w|^2 / (2 C) where the fit ended; all zero at its minimum."""
    x = np.array([[a, b, 1.0] for a, b, _ in rows])
    y = np.array([t for *_, t in rows])
    w = np.array([*model.weights, model.intercept])
    return x.T @ (1 / (1 + np.exp(-x @ w)) - y) + np.array([w[0] / c, w[1] / c, 0.0])


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(400, 2))
    y = (rnd.random(400) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(int)
    return [(float(a), float(b), int(t)) for (a, b), t in zip(x, y)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "D double, S double, label int")


@pytest.mark.parametrize("c", [1.0, 0.01])
def test_fit_ends_at_the_minimum(spark, rows, c):
    model = L.logistic_fit(frame(spark, rows).repartition(3), COLS, c=c)
    assert np.abs(slopes(rows, model, c)).max() < 1e-6


def test_halved_steps_on_separable_far_apart_labels(spark):
    rows = [(1000.0 * i, float(i % 3), int(i > 0)) for i in range(-20, 21) if i]
    model = L.logistic_fit(frame(spark, rows), COLS, steps=60)
    assert np.abs(slopes(rows, model, 1.0) / [1e4, 20, 20]).max() < 1e-4
    scored = L.logistic_score(model, frame(spark, rows)).collect()
    assert all((r.score > 0.5) == (r.label == 1) for r in scored)


def test_nulls_empty_tables_and_single_labels(spark, rows):
    dirty = [*rows, (None, 1.0, 1), (float("nan"), 1.0, 0), (1.0, 2.0, None)]
    clean, same = L.logistic_fit(frame(spark, rows), COLS), L.logistic_fit(frame(spark, dirty), COLS)
    assert np.allclose(clean.weights, same.weights)
    assert L.logistic_score(clean, frame(spark, dirty[-3:])).collect()[0].score is None
    assert L.logistic_fit(frame(spark, []), COLS) == L.Logistic(tuple(COLS), (0.0, 0.0), 0.0)
    one = L.logistic_fit(frame(spark, [(a, b, 1) for a, b, _ in rows]), COLS)
    assert one.intercept > 3 and all(map(math.isfinite, one.weights))


def test_clashing_names_and_saved_model(spark, rows, tmp_path):
    df = frame(spark, rows).withColumnsRenamed({"D": "y", "S": "p"}).withColumnRenamed("label", "z")
    model = L.logistic_fit(df, ["y", "p"], "z")
    want = L.logistic_fit(frame(spark, rows), COLS)
    assert np.allclose(model.weights, want.weights) and L.logistic_score(model, df).columns == ["y", "p", "z", "score"]
    L.save_model(spark, want, 0.4, str(tmp_path))
    assert L.load_model(spark, str(tmp_path)) == (want, 0.4)
