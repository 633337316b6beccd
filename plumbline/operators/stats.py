"""Descriptive statistics, correlation and regression by sums that executors add up."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.rank import percentiles


def describe(rows: DataFrame, groups: list[str], x: str) -> DataFrame:
    """n, mean, median, sample deviation, quartiles, range, extremes and bias-corrected skew."""
    n = F.count(x)
    g1 = F.skewness(x)
    skew = F.when((n > 2) & (F.stddev_pop(x) > 0), F.sqrt(n * (n - 1.0)) / F.greatest(n - 2, F.lit(1)) * g1)
    sums = rows.groupBy(*groups).agg(n.alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"), skew.alias("skew"))
    q = percentiles(rows, groups, x, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    out = sums.join(q, groups) if groups else sums.join(F.broadcast(q))  # without groups, one row
    return out.select(*groups, "n", "mean", "median", "sd", "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"), "min", "max", "skew")


def within_differences(rows: DataFrame, keys: list[str], target: str, x: str) -> DataFrame:
    """Per question: mean of right minus mean of wrong runs, where there are both."""
    right, wrong = F.avg(F.when(F.col(target), F.col(x))), F.avg(F.when(~F.col(target), F.col(x)))
    got = rows.where(F.col(target).isNotNull()).groupBy(*keys).agg(right.alias("right"), wrong.alias("wrong"))
    return got.where("right is not null and wrong is not null").withColumn("difference", F.col("right") - F.col("wrong"))


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson of all pairs of columns, in one aggregation; each pair over the rows that have both."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    got = rows.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return got.select(F.inline(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def _moments(rows: DataFrame, terms: list[Column], y: Column, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, float, float, int]:
    """X'WX, X'Wy, y'Wy, sum of Wy and the count: one aggregation, one row to the driver."""
    w = weight if weight is not None else F.lit(1.0)
    k = len(terms)
    used = rows.select(*[t.cast("double").alias(f"t{i}") for i, t in enumerate(terms)], y.cast("double").alias("y"), w.cast("double").alias("w"))
    used = used.dropna()
    xx = [F.sum(F.col(f"t{i}") * F.col(f"t{j}") * F.col("w")).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)]
    xy = [F.sum(F.col(f"t{i}") * F.col("y") * F.col("w")).alias(f"y{i}") for i in range(k)]
    got = used.agg(*xx, *xy, F.sum(F.col("y") * F.col("y") * F.col("w")).alias("yy"), F.sum(F.col("y") * F.col("w")).alias("sy"), F.count(F.lit(1)).alias("n")).first()
    a, b = np.zeros((k, k)), np.zeros(k)
    for i in range(k):
        b[i] = got[f"y{i}"] or 0.0
        for j in range(i, k):
            a[i, j] = a[j, i] = got[f"x{i}_{j}"] or 0.0
    return a, b, got["yy"] or 0.0, got["sy"] or 0.0, got["n"]


def ols(rows: DataFrame, terms: list[Column], y: Column) -> tuple[np.ndarray, float]:
    """Least squares coefficients (terms as given, no intercept added) and R squared."""
    a, b, yy, sy, n = _moments(rows, terms, y)
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    around = yy - sy * sy / n if n else 0.0
    return beta, float(1 - (yy - beta @ b) / around) if around > 0 else float("nan")


def logistic(rows: DataFrame, terms: list[Column], y: Column, ridge: float = 1e-6, steps: int = 60, tolerance: float = 1e-9) -> np.ndarray:
    """Newton steps with a ridge on all terms but the first; each step is one aggregation over the rows."""
    k = len(terms)
    beta = np.zeros(k)
    rows = rows.select(*[t.cast("double").alias(f"t{i}") for i, t in enumerate(terms)], y.cast("double").alias("y")).dropna().persist()
    try:
        for _ in range(steps):
            z = F.lit(0.0)
            for i in range(k):
                z = z + F.col(f"t{i}") * F.lit(float(beta[i]))
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(z, F.lit(-500.0)), F.lit(500.0))))
            scored = rows.withColumn("p", p).withColumn("v", F.col("p") * (1 - F.col("p")))
            h = [F.sum(F.col(f"t{i}") * F.col(f"t{j}") * F.col("v")).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
            g = [F.sum(F.col(f"t{i}") * (F.col("y") - F.col("p"))).alias(f"g{i}") for i in range(k)]
            got = scored.agg(*h, *g).first()
            hess, grad = np.zeros((k, k)), np.zeros(k)
            for i in range(k):
                grad[i] = (got[f"g{i}"] or 0.0) - (ridge * beta[i] if i else 0.0)
                for j in range(i, k):
                    hess[i, j] = hess[j, i] = (got[f"h{i}_{j}"] or 0.0) + (ridge if i == j and i else 0.0)
            step = np.linalg.solve(hess + 1e-300 * np.eye(k), grad)
            beta = beta + step
            if np.abs(step).max() < tolerance:
                break
    finally:
        rows.unpersist()
    return beta


def residual(rows: DataFrame, terms: list[Column], y: str, out: str) -> DataFrame:
    """Adds what least squares on the terms leaves of y."""
    beta, _ = ols(rows, terms, F.col(y))
    fit = F.lit(0.0)
    for b, t in zip(beta, terms, strict=True):
        fit = fit + F.lit(float(b)) * t
    return rows.withColumn(out, F.col(y) - fit)
