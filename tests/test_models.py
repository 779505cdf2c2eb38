"""Fitted models against direct solutions, metrics against hand counts."""

import hashlib

import numpy as np
import pytest

from conftest import SMALL
from faultline import role_tables
from faultline.plans import models
from faultline.plans.registry import TEST_TIERS


def matrix(df, features):
    rows = df.select(*features, "LABEL").collect()
    data = np.array([[float(v) for v in r] for r in rows])
    return np.column_stack([np.ones(len(data)), data[:, :-1]]), data[:, -1]


@pytest.mark.parametrize("fit", [models.ols_injuries, models.ols_deaths])
def test_least_squares(tables, fit):
    fitted = fit(tables)
    x, y = matrix(fitted.train, fitted.features)
    solution = np.linalg.lstsq(x, y, rcond=None)[0]
    assert [fitted.intercept, *fitted.coefficients] == pytest.approx(solution, rel=1e-6)


def newton(x, y):
    """Minimum of sum(log loss) + |w|^2 / 2 with a free intercept."""
    spread = np.concatenate([[1.0], np.abs(x[:, 1:]).max(axis=0)])
    scaled, penalty = x / spread, np.diag(np.concatenate([[0.0], 1 / spread[1:] ** 2]))
    w = np.zeros(x.shape[1])

    def loss(v):
        z = scaled @ v
        return np.sum(np.logaddexp(0, z) - y * z) + v @ penalty @ v / 2

    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(scaled @ w, -500, 500)))
        gradient = scaled.T @ (p - y) + penalty @ w
        hessian = scaled.T @ (scaled * (p * (1 - p))[:, None]) + penalty + 1e-12 * np.eye(len(w))
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-10 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(gradient).max() < 1e-10:
            break
    return w / spread, loss(w)


@pytest.mark.parametrize("root", [SMALL, SMALL.replace("0.001", "0.01")])
@pytest.mark.parametrize("fit", [models.logit_recalls, models.logit_deaths])
def test_logistic_reaches_the_minimum(spark, root, fit):
    fitted = fit(role_tables(spark, root))
    x, y = matrix(fitted.train, fitted.features)
    w, _ = newton(x, y)
    assert [fitted.intercept, *fitted.coefficients] == pytest.approx(w.tolist(), rel=1e-4)


def test_one_aggregate_a_pass(spark):
    """A pass tries all lengths of the step in one aggregate, so a fit takes few jobs."""
    frame = models.recalls_frame(role_tables(spark, SMALL))
    spark.sparkContext.setJobGroup("fit", "jobs of the fit")
    try:
        models.fit_logistic("recalls", frame, models.RECALL_FEATURES)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("fit")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) <= 25


def scored(spark, pairs):
    return spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "LABEL double, PREDICTION double")


def test_confusion_fills_empty_cells(spark):
    cells = {r.CELL: (r.N, r.SHARE, r.SHARE_LABEL) for r in models.confusion(scored(spark, [(0, 0), (0, 0), (1, 0), (0, 1)])).collect()}
    assert cells == {
        "True Negative": (2, 0.5, "(50.0%)"),
        "False Positive": (1, 0.25, "(25.0%)"),
        "False Negative": (1, 0.25, "(25.0%)"),
        "True Positive": (0, 0.0, "(0.0%)"),
    }


def test_report(spark):
    df = scored(spark, [(0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (1, 0)])
    got = {r.CLASS: tuple(r)[1:] for r in models.classification_report(df).collect()}
    third = pytest.approx(2 / 3, abs=1e-6)
    assert got == {
        "0": (third, third, third, 3), "1": (third, third, third, 3),
        "accuracy": (None, None, third, 6), "macro avg": (third, third, third, 6), "weighted avg": (third, third, third, 6),
    }


def test_report_of_a_constant_label(spark):
    got = {r.CLASS: tuple(r)[1:] for r in models.classification_report(scored(spark, [(0, 0)] * 4)).collect()}
    assert got["1"] == (0.0, 0.0, 0.0, 0) and got["0"] == (1.0, 1.0, 1.0, 4)
    assert got["macro avg"] == (0.5, 0.5, 0.5, 4) and got["weighted avg"] == (1.0, 1.0, 1.0, 4)


def test_regression_metrics(spark):
    df = scored(spark, [(1, 2), (2, 2), (4, 3)])
    got = {r.METRIC: r.VALUE for r in models.regression_metrics(df, "m").collect()}
    assert got["RMSE"] == pytest.approx(np.sqrt(2 / 3), abs=1e-6) and got["MAE"] == pytest.approx(2 / 3, abs=1e-6)
    assert got["R2"] == pytest.approx(1 - 2 / (14 / 3), abs=1e-6)
    constant = {r.METRIC: r.VALUE for r in models.regression_metrics(scored(spark, [(1, 1)]), "m").collect()}
    assert constant["R2"] is None and constant["MAE"] == 0.0


def test_split_depends_on_the_key_alone(spark):
    df = spark.createDataFrame([("A", "B"), ("A", None), ("x", "y")], "a string, b string")
    got = [r[0] for r in df.select(models.in_training("a", "b")).collect()]
    assert got == [hashlib.md5(k.encode()).hexdigest()[:2] < "b3" for k in ("A|B", "A", "x|y")]


def test_high_flag_is_strictly_above_the_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (3.0,)], "m double")
    assert sorted(tuple(r) for r in models.with_high_flag(df, "m").collect()) == [(1.0, 0.0), (2.0, 0.0), (3.0, 1.0), (3.0, 1.0)]


def test_test_thresholds_are_named_like_the_parameters():
    assert set(TEST_TIERS) == {"min_vehicles", "high", "moderate"}
