"""Logistic calibration of a few features."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiolith.llm.common import map_rows


class Calibration:
    """score = sigmoid(bias + weights . standardised features)"""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float):
        self.mean, self.scale, self.weights, self.bias = mean, scale, weights, bias

    def __call__(self, features) -> float:
        z = float(((np.asarray(features, float) - self.mean) / self.scale) @ self.weights + self.bias)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def fit(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1e-3, steps: int = 50) -> Calibration:
    """Weighted logistic regression by Newton steps. ``share`` is the share of label 1 among all labelled rows;
    rows are weighted so that a balanced sample calibrates to it. With one class only, the score is constant."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    width = x.shape[1] if x.ndim == 2 else 1
    share = min(max(share, 1e-3), 1 - 1e-3)
    if not len(y) or y.min() == y.max():
        return Calibration(np.zeros(width), np.ones(width), np.zeros(width), math.log(share / (1 - share)))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum())
    beta = np.zeros(a.shape[1])
    penalty = ridge * np.eye(a.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        slope = a.T @ (w * (p - y)) + penalty @ beta
        bend = (a * (w * p * (1 - p))[:, None]).T @ a + penalty
        move = np.linalg.solve(bend, slope)
        beta -= np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return Calibration(mean, scale, beta[:-1], float(beta[-1]))


def fit_table(rows: DataFrame, width: int, share: float, ridge: float = 1e-3, steps: int = 50) -> Calibration:
    """``fit`` over a table (y, x array<double>) of any size that is read once a step: the tasks sum slopes and bends, and the
    driver gets a row of them for each batch of rows."""
    share = min(max(share, 1e-3), 1 - 1e-3)
    each = [f(F.col("x")[i]) for i in range(width) for f in (F.avg, F.stddev_pop)]
    ones, zeros, *moments = rows.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0), *each).first()  # one row
    if not ones or not zeros:
        return Calibration(np.zeros(width), np.ones(width), np.zeros(width), math.log(share / (1 - share)))
    mean, scale = np.array(moments[::2], float), np.array(moments[1::2], float)
    scale[scale < 1e-9] = 1.0
    beta = np.zeros(width + 1)
    penalty = ridge * np.eye(width + 1)
    penalty[-1, -1] = 1e-6
    for _ in range(steps):

        def task(beta=beta):
            def step(block):
                if not block["y"]:
                    return {"sums": []}
                y = np.array(block["y"], float)
                a = np.column_stack([(np.array(block["x"], float) - mean) / scale, np.ones(len(y))])
                w = np.where(y == 1, share / ones, (1 - share) / zeros)
                p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
                return {"sums": [[*(a.T @ (w * (p - y))), *((a * (w * p * (1 - p))[:, None]).T @ a).ravel()]]}

            return step

        parts = [r["sums"] for r in map_rows(rows.select("y", "x"), task, "sums array<double>", rows=1_000_000).collect()]
        total = np.array([math.fsum(column) for column in zip(*parts)])  # in any order
        slope, bend = total[: width + 1] + penalty @ beta, total[width + 1 :].reshape(width + 1, width + 1) + penalty
        move = np.linalg.solve(bend, slope)
        beta = beta - np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return Calibration(mean, scale, beta[:-1], float(beta[-1]))
