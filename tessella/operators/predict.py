"""Predicting a query's cost from its approximate answer, and how far off the predictions are."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linear_predict, pct_error


def fit_linear(points: DataFrame) -> DataFrame:
    """Least squares of y over x: slope, intercept, n. One aggregation."""
    return points.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_count("y", "x").alias("n"))


def fit_logarithm(points: DataFrame) -> DataFrame:
    """y = a + b log x over points with x over 0."""
    points = points.filter("x > 0").select("y", F.log("x").alias("x"))
    return points.agg(F.regr_intercept("y", "x").alias("a"), F.regr_slope("y", "x").alias("b"), F.regr_count("y", "x").alias("n"))


def fit_polynomial(points: DataFrame, degree: int) -> list[float]:
    """Coefficients, highest power first, from sums of powers: the data stays where it is. x is centred and scaled first."""
    s = points.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("d"), F.count("*").alias("n")).first()
    if not s.n:
        return []
    scale = s.d or 1.0
    u = (F.col("x") - s.m) / scale
    sums = points.agg(*(F.sum(F.pow(u, F.lit(k))).alias(f"p{k}") for k in range(2 * degree + 1)), *(F.sum(F.pow(u, F.lit(k)) * F.col("y")).alias(f"q{k}") for k in range(degree + 1))).first()
    a = np.array([[sums[f"p{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    c = np.linalg.lstsq(a, np.array([sums[f"q{i}"] for i in range(degree + 1)]), rcond=None)[0]
    in_x = np.poly1d([0.0])
    for k, value in enumerate(c):
        in_x += value * np.poly1d([1 / scale, -s.m / scale]) ** k
    return [float(v) for v in in_x.coeffs]


def fit_sigmoid(points: DataFrame, rounds: int = 200) -> tuple[float, float, float, float, float]:
    """low, high, b, c, d of low + (high - low) / (1 + b e^(-c (x - d))), with b = 1 (d takes its place).

    Gauss-Newton with damping; each round is one aggregation of the normal equations, so only sums reach the driver.
    """
    s = points.agg(F.min("y").alias("low"), F.max("y").alias("high"), F.avg("x").alias("d"), F.stddev_pop("x").alias("w")).first()
    p, damping = np.array([s.low, s.high, 1.0 / max(s.w or 0.0, 1e-9), s.d]), 1e-2
    rows = points.select("x", "y").persist()

    def sums(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        low, high, c, d = (float(v) for v in p)
        e = 1 / (1 + F.exp(F.least(F.lit(500.0), -c * (F.col("x") - d))))
        slope = (high - low) * e * (1 - e)
        parts = [1 - e, e, slope * (F.col("x") - d), slope * -c]
        left = F.col("y") - (low + (high - low) * e)
        got = rows.agg(*(F.sum(parts[i] * parts[j]).alias(f"h{i}{j}") for i in range(4) for j in range(i, 4)), *(F.sum(parts[i] * left).alias(f"g{i}") for i in range(4)), F.sum(left * left).alias("e")).first()
        h = np.array([[got[f"h{min(i, j)}{max(i, j)}"] for j in range(4)] for i in range(4)])
        return h, np.array([got[f"g{i}"] for i in range(4)]), got["e"]

    h, g, error = sums(p)
    for _ in range(rounds):
        step = np.linalg.lstsq(h + damping * np.diag(np.diag(h) + 1e-12), g, rcond=None)[0]
        h2, g2, e2 = sums(p + step)
        if e2 < error:
            p, h, g, damping, done = p + step, h2, g2, damping / 3, error - e2 < 1e-10 * max(error, 1e-12)
            error = e2
            if done:
                break
        else:
            damping *= 4
            if damping > 1e8:
                break
    rows.unpersist()
    return float(p[0]), float(p[1]), 1.0, float(p[2]), float(p[3])


def predictions(points: DataFrame, slope: float, intercept: float) -> DataFrame:
    return points.withColumn("predicted", linear_predict(F.col("x"), slope, intercept))


def errors(pairs: DataFrame) -> DataFrame:
    """pairs (query_id, real, predicted): adds the error in percent of the prediction."""
    return pairs.withColumn("error", pct_error(F.col("real"), F.col("predicted")))


def error_histogram(errors_: DataFrame, width: float = 10.0, most: int = 20) -> DataFrame:
    """bucket, n; the last bucket takes all that is beyond."""
    return errors_.filter("error is not null").groupBy(F.least(F.floor(F.col("error") / width), F.lit(most)).alias("bucket")).agg(F.count("*").alias("n"))
