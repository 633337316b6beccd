"""Queries by name with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.domain import Tables, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None, domain: bool = True):
    """Registers a function of ``Tables``; ``oracle`` is DuckDB SQL over the domain's tables."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            SQL[name] = sql(oracle) if domain else oracle
        return f

    return register


def r(x: Column | str, name: str, digits: int = 10) -> Column:
    """A rounded double, free of the last bits that depend on the order of addition."""
    x = F.col(x) if isinstance(x, str) else x
    return (F.round(x, digits) + F.lit(0.0)).alias(name)


def n(x: Column | str, name: str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return x.cast("bigint").alias(name)


def auroc_sql(source: str, keys: str, w: str = "1") -> str:
    """Area by group of a relation with y, x and the keys."""
    part = f"PARTITION BY {keys}" if keys else ""
    k, by = (f"{keys},", f"GROUP BY {keys}") if keys else ("", "")
    return f"""SELECT {k} CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives,
  CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN round(CAST(sum(2 * p * nb + p * n) AS DOUBLE) / (CAST(2 AS DOUBLE) * CAST(sum(p) AS DOUBLE) * CAST(sum(n) AS DOUBLE)), 10) END AS auroc
FROM (SELECT *, coalesce(sum(n) OVER ({part} ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM
  (SELECT {k} x, sum(CASE WHEN y THEN {w} ELSE 0 END) AS p, sum(CASE WHEN NOT y THEN {w} ELSE 0 END) AS n FROM {source} WHERE y IS NOT NULL AND x IS NOT NULL GROUP BY {k} x)) {by}"""


GROUPED = "SELECT *, 'pooled' AS grouping, CAST(NULL AS VARCHAR) AS grp FROM {0} UNION ALL SELECT *, 'subject', subject FROM {0}"


def reliability_sql(source: str, keys: list[str], bin_: str = "least(9, CAST(floor(c * 10) AS INT))", bins: int = 10) -> str:
    """Bins by group of a relation with y (boolean) and c."""
    k = ", ".join(keys)
    on = " AND ".join(f"g.{x} IS NOT DISTINCT FROM s.{x}" for x in keys)
    return f"""SELECT {", ".join(f"g.{x}" for x in keys)}, CAST(g.bin AS INT) AS bin, coalesce(s.n, 0) AS n, round(sc / s.n, 10) AS mean_predicted, round(sy / s.n, 10) AS accuracy,
  round(coalesce(abs(sy / s.n - sc / s.n) * s.n / g.total, 0), 10) AS contribution
FROM (SELECT {k}, total, unnest(range({bins})) AS bin FROM (SELECT {k}, count(*) AS total FROM {source} WHERE y IS NOT NULL AND c IS NOT NULL GROUP BY {k})) g
LEFT JOIN (SELECT {k}, {bin_} AS bin, count(*) AS n, sum(c) AS sc, CAST(sum(CAST(y AS INT)) AS DOUBLE) AS sy FROM {source} WHERE y IS NOT NULL AND c IS NOT NULL GROUP BY ALL) s ON {on} AND g.bin = s.bin"""
