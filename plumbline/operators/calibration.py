"""Reliability tables and expected calibration error in three binnings, kept apart on purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 10


def fixed_bin(c: Column, bins: int = BINS) -> Column:
    """min(bins - 1, floor(c * bins)): the last bin holds 1."""
    return F.least(F.lit(bins - 1), F.floor(c * bins).cast("int"))


def edge_bin(c: Column, bins: int = BINS) -> Column:
    """The bin by comparison with evenly spaced double edges; differs from ``fixed_bin`` where those are inexact."""
    edges = F.array(*[F.lit(i * (1.0 / bins)) for i in range(1, bins)])
    return F.size(F.filter(edges, lambda e: e <= c))


def uneven_bin(c: Column, edges: list[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= c))


def reliability(rows: DataFrame, groups: list[str], target: Column, predictor: Column, weight: Column | None = None, bin_of=fixed_bin, bins: int = BINS, keep_empty: bool = True) -> DataFrame:
    """Per group and bin: n, mean_predicted, accuracy, contribution; all bins are there, empty ones with null means."""
    w = weight if weight is not None else F.lit(1)
    used = rows.where(target.isNotNull() & predictor.isNotNull()).select(*groups, target.cast("int").alias("y"), predictor.alias("c"), w.cast("bigint").alias("w"))
    used = used.withColumn("bin", bin_of(F.col("c"))).where("w > 0")
    sums = used.groupBy(*groups, "bin").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("c")).alias("sc"), F.sum(F.col("w") * F.col("y")).alias("sy"))
    if groups:
        # A group's bins side by side, so that empty ones come out without a join.
        packed = sums.groupBy(*groups).agg(F.collect_list(F.struct("bin", "n", "sc", "sy")).alias("got"), F.sum("n").alias("total"))
    else:
        packed = sums.agg(F.collect_list(F.struct("bin", "n", "sc", "sy")).alias("got"), F.sum("n").alias("total"))
    each = packed.select(*groups, "total", "got", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    each = each.withColumn("s", F.get(F.filter("got", lambda g: g["bin"] == F.col("bin")), F.lit(0)))
    n = F.coalesce("s.n", F.lit(0).cast("bigint"))
    out = each.select(
        *groups,
        "bin",
        n.alias("n"),
        (F.col("s.sc") / F.col("s.n")).alias("mean_predicted"),
        (F.col("s.sy") / F.col("s.n")).alias("accuracy"),
        F.coalesce(F.abs(F.col("s.sy") / F.col("s.n") - F.col("s.sc") / F.col("s.n")) * F.col("s.n") / F.col("total"), F.lit(0.0)).alias("contribution"),
    )
    return out if keep_empty else out.where("n > 0")


def ece(bins_table: DataFrame, groups: list[str]) -> DataFrame:
    """Per group: n and the sum of the bins' contributions; null without rows."""
    n = F.sum("n")
    return bins_table.groupBy(*groups).agg(n.alias("n"), F.when(n > 0, F.sum("contribution")).alias("ece"))


def audit(tables: DataFrame, cohort: DataFrame, groups: list[str], target: str, predictor: str, tolerance: float = 1e-9) -> DataFrame:
    """Defects of reliability tables by ``source``, against the rows that they were made of.

    Groups without all bins, groups whose counts are not the cohort's, accuracies out of bounds, groups
    whose contributions don't add up to the error (recomputed from the rows), and pooled counts that are
    not the sum of the subjects'.
    """
    used = cohort.where(F.col(target).isNotNull() & F.col(predictor).isNotNull()).select(*groups, F.col(target).cast("int").alias("__y"), F.col(predictor).alias("__c"))
    total = used.groupBy(*groups).agg(F.count(F.lit(1)).alias("__total"))
    by_bin = used.groupBy(*groups, fixed_bin(F.col("__c")).alias("__bin")).agg(F.abs(F.sum(F.col("__c")) - F.sum("__y")).alias("__gap"))
    error = by_bin.groupBy(*groups).agg(F.sum("__gap").alias("__gaps"))
    same = lambda a, b: [a[g].eqNullSafe(b[g]) for g in groups]
    truth = total.join(error, same(total, error)).select(*[total[g] for g in groups], "__total", (F.col("__gaps") / F.col("__total")).alias("__ece"))
    page = tables.groupBy("source", *groups).agg(
        F.count(F.lit(1)).alias("bins"), F.sum("n").alias("n"), F.sum("contribution").alias("total"), F.count_if(~F.col("accuracy").between(0, 1)).alias("bad")
    )
    page = page.join(truth, same(page, truth)).select("source", page["grouping"], "bins", "n", "total", "bad", "__total", "__ece")
    parts = page.where("grouping = 'subject'").groupBy("source").agg(F.sum("n").alias("__parts"))
    return page.join(parts, "source", "left").groupBy("source").agg(
        F.count_if(F.col("bins") != BINS).alias("cardinality"),
        F.count_if(F.col("n") != F.col("__total")).alias("counts"),
        F.sum("bad").alias("bounds"),
        F.count_if(F.abs(F.col("total") - F.col("__ece")) > tolerance).alias("sums"),
        F.count_if((F.col("grouping") == "pooled") & (F.col("n") != F.col("__parts"))).alias("partition"),
    )
