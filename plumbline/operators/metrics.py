"""A registry of metrics: functions of (rows, groups) to a frame with ``groups`` and ``value``.

The built-in ones are aggregations that executors add up. ``from_values`` makes a metric of any
function of one group's arrays; it holds a group in a task and is for bounded cohorts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from plumbline.operators import calibration, rank

Metric = Callable[[DataFrame, list[str]], DataFrame]
_METRICS: dict[str, Metric] = {}


def register_metric(name: str, metric: Metric) -> None:
    """Makes a metric known; a name can be taken once."""
    if name in _METRICS:
        raise ValueError(f"a metric {name!r} is there already")
    _METRICS[name] = metric


def evaluate(name: str, rows: DataFrame, groups: list[str]) -> DataFrame:
    """The metric by group; ``rows`` has y (boolean) and x (double)."""
    return _METRICS[name](rows, groups).select(*groups, "value")


def from_values(f: Callable[[np.ndarray, np.ndarray], float]) -> Metric:
    """A metric of a function of a group's y and x."""

    def metric(rows: DataFrame, groups: list[str]) -> DataFrame:
        def one(y: pd.Series, x: pd.Series) -> float:
            return float(f(y.to_numpy(bool), x.to_numpy(float)))

        one.__annotations__ = {"y": pd.Series, "x": pd.Series, "return": float}
        udf = F.pandas_udf(one, DoubleType())
        return rows.where("y is not null and x is not null").groupBy(*groups).agg(udf("y", "x").alias("value"))

    return metric


register_metric("auroc", lambda rows, groups: rank.auroc(rows, groups, "y", "x").withColumn("value", F.col("auroc")))
register_metric("ece", lambda rows, groups: calibration.ece(calibration.reliability(rows, groups, F.col("y"), F.col("x")), groups).withColumn("value", F.col("ece")))
register_metric("mean_difference", lambda rows, groups: rows.groupBy(*groups).agg((F.avg(F.when(F.col("y"), F.col("x"))) - F.avg(F.when(~F.col("y"), F.col("x")))).alias("value")))
