"""Exact rank statistics: areas under ROC curves, average ranks, rank correlation.

All rest on one operator, ``below``: for each distinct value of a group, how much weight lies
below it. It is a running sum, but not one over a whole group in a task: values are dealt to
ranges between approximate quantiles, ranges are summed, and the running sum is taken within a
range. Values keep their type, so large integers that differ stay apart. The counts of distinct
values, which are read several times for that, are written once, so what they were counted from
is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.records import kept

#: Ranges that a group's distinct values are dealt to.
RANGES = 32
#: Up to so many distinct values of all groups together, a group's are sorted whole, in one task.
WHOLE = 200_000


def below(counts: DataFrame, groups: list[str], value: str, sums: list[str], ranges: int | None = None) -> DataFrame:
    """Adds ``<sum>_below`` to (groups, value, sums), one row per distinct value of a group.

    ``counts`` is a written table. Without a number of ranges, its size chooses: small ones aren't dealt out.
    """
    if ranges is None:
        ranges = RANGES if counts.count() > WHOLE else 1
    if ranges == 1:
        whole = Window.partitionBy(*groups).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return counts.select("*", *[F.coalesce(F.sum(s).over(whole), F.lit(0)).alias(f"{s}_below") for s in sums])
    # Keys are doubled with their nullness so that null groups meet.
    key = [F.coalesce(F.col(g).cast("string"), F.lit("\0")).alias(f"__{g}") for g in groups]
    rows = counts.select("*", *key)
    keys = [f"__{g}" for g in groups]
    quantiles = F.percentile_approx(F.col(value).cast("double"), [i / ranges for i in range(1, ranges)], 1000)
    bounds = rows.groupBy(*keys).agg(quantiles.alias("__bounds")) if keys else rows.agg(quantiles.alias("__bounds"))
    rows = rows.join(bounds, keys) if keys else rows.join(F.broadcast(bounds))  # without groups, one row
    rows = rows.withColumn("__range", F.size(F.filter("__bounds", lambda b: b < F.col(value).cast("double")))).drop("__bounds")
    totals = rows.groupBy(*keys, "__range").agg(*[F.sum(s).alias(f"__{s}") for s in sums])
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "__range", *[F.coalesce(F.sum(f"__{s}").over(before), F.lit(0)).alias(f"__{s}") for s in sums])
    rows = rows.join(starts, [*keys, "__range"])
    inner = Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(*counts.columns, *[(F.col(f"__{s}") + F.coalesce(F.sum(s).over(inner), F.lit(0))).alias(f"{s}_below") for s in sums])


def auroc(rows: DataFrame, groups: list[str], target: str, score: str, weight: str | None = None, ranges: int | None = None) -> DataFrame:
    """Per group: positives, negatives, auroc (ties count half; null for one class). Nulls are left out."""
    w = F.col(weight) if weight else F.lit(1)
    used = rows.where(F.col(target).isNotNull() & F.col(score).isNotNull())
    counts = used.groupBy(*groups, score).agg(F.sum(F.when(F.col(target), w).otherwise(0)).cast("bigint").alias("__p"), F.sum(F.when(F.col(target), 0).otherwise(w)).cast("bigint").alias("__n"))
    return areas(kept(counts, "counts"), groups, score, ranges)


def areas(counts: DataFrame, groups: list[str], score: str, ranges: int | None = None) -> DataFrame:
    """Areas from ``__p`` and ``__n``, the positives and negatives of each distinct score of a group."""
    ranked = below(counts, groups, score, ["__n"], ranges)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    twice = F.sum((wide("__p") * (2 * wide("__n_below") + wide("__n"))).cast("decimal(38,0)"))
    both = F.sum("__p").cast("double") * F.sum("__n").cast("double")
    area = F.when(both > 0, twice.cast("double") / (2 * both)).alias("auroc")
    return ranked.groupBy(*groups).agg(F.sum("__p").alias("positives"), F.sum("__n").alias("negatives"), area)


def average_ranks(rows: DataFrame, groups: list[str], value: str, out: str = "rank", ranges: int | None = None) -> DataFrame:
    """Adds the average rank (from 1) of a value in its group; rows without it are left out."""
    used = rows.where(F.col(value).isNotNull())
    counts = kept(used.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("__c")), "counts")
    ranked = below(counts, groups, value, ["__c"], ranges).withColumn(out, F.col("__c_below") + (F.col("__c") + 1) / 2.0)
    keys = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*groups, value]]
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    return used.alias("a").join(ranked.select(*groups, value, out).alias("b"), on).select("a.*", f"b.{out}")


def percentiles(rows: DataFrame, groups: list[str], value: str, shares: dict[str, float], ranges: int | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, one column for each share; nulls are left out.

    ``percentile`` holds a group's distinct values in one task; here they stay dealt to ranges.
    """
    counts = kept(rows.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("__c")), "counts")
    ranked = below(counts, groups, value, ["__c"], ranges)
    totals = counts.groupBy(*groups).agg(F.sum("__c").alias("__total")) if groups else counts.agg(F.sum("__c").alias("__total"))
    if groups:
        names = [f"__g{i}" for i in range(len(groups))]
        totals = totals.select(*[F.col(g).alias(a) for g, a in zip(groups, names, strict=True)], "__total")
        on = F.lit(True)
        for g, a in zip(groups, names, strict=True):
            on = on & F.col(g).eqNullSafe(F.col(a))
        ranked = ranked.join(totals, on)
    else:
        ranked = ranked.join(F.broadcast(totals))  # one row
    at = lambda k: F.max(F.when((F.col("__c_below") <= k) & (k < F.col("__c_below") + F.col("__c")), F.col(value).cast("double")))
    place = {name: F.lit(q) * (F.col("__total") - 1) for name, q in shares.items()}
    got = ranked.groupBy(*groups).agg(*[c for name, p in place.items() for c in (at(F.floor(p)).alias(f"__lo_{name}"), at(F.ceil(p)).alias(f"__hi_{name}"), F.max(p - F.floor(p)).alias(f"__f_{name}"))])
    return got.select(*groups, *[(F.col(f"__lo_{name}") + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * F.col(f"__f_{name}")).alias(name) for name in shares])


def spearman(rows: DataFrame, groups: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """Per group: pairs and Pearson correlation of average ranks over rows that have both values.

    Equal pairs are counted once, and both columns are ranked in one pass. Average ranks have the mean
    (n + 1) / 2, so the correlation comes from products of distances to it.
    """
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*groups, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    pairs = kept(both.groupBy(*groups, "__x", "__y").agg(F.count(F.lit(1)).alias("__c")), "pairs")
    sides = F.inline(F.array(F.struct(F.lit(0).alias("__side"), F.col("__x").alias("__v")), F.struct(F.lit(1).alias("__side"), F.col("__y").alias("__v"))))
    counts = pairs.select(*groups, "__c", sides).groupBy(*groups, "__side", "__v").agg(F.sum("__c").alias("__c"))
    ranked = below(kept(counts, "counts"), [*groups, "__side"], "__v", ["__c"])
    ranked = kept(ranked.select(*groups, "__side", "__v", (F.col("__c_below") + (F.col("__c") + 1) / 2.0).alias("__rank")), "ranks")
    for side, column in enumerate(("__x", "__y")):
        own = ranked.where(F.col("__side") == side).select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__v").alias(f"{column}v"), F.col("__rank").alias(f"{column}r"))
        on = F.col(column) == F.col(f"{column}v")
        for i, g in enumerate(groups):
            on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
        pairs = pairs.join(own, on).drop(f"{column}v", *[f"__g{i}" for i in range(len(groups))])
    n = F.sum("__c")
    moment = lambda a, b: F.sum(F.col("__c") * F.col(a) * F.col(b)) - n * F.pow((n + 1) / 2.0, F.lit(2.0))
    xy, xx, yy = moment("__xr", "__yr"), moment("__xr", "__xr"), moment("__yr", "__yr")
    return pairs.groupBy(*groups).agg(n.alias("n"), F.when((n >= least) & (xx > 0) & (yy > 0), xy / F.sqrt(xx * yy)).alias("rho"))


def with_groups(rows: DataFrame, subject: str = "subject") -> DataFrame:
    """Each row once pooled (subject null) and once in its subject."""
    pairs = F.array(F.struct(F.lit("pooled").alias("grouping"), F.lit(None).cast("string").alias("grp")), F.struct(F.lit("subject").alias("grouping"), F.col(subject).alias("grp")))
    return rows.select("*", F.inline(pairs))


def macro(metrics: DataFrame, by: list[str], value: str, counts: list[str], n_subjects: int = 5) -> DataFrame:
    """The unweighted mean over all subjects, undefined if any is; counts are summed."""
    subjects = metrics.where("grouping = 'subject'")
    defined = F.count(value) == n_subjects
    rows = subjects.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counts], F.when(defined, F.avg(value)).alias(value))
    return rows.select(*by, F.lit("macro").alias("grouping"), F.lit(None).cast("string").alias("grp"), *counts, value)


def paired_difference(rows: DataFrame, groups: list[str], target: str, scores: list[str], reference: str) -> DataFrame:
    """Areas of several scores on the rows that have all, and each one's difference to the reference's."""
    common = rows
    for s in scores:
        common = common.where(F.col(s).isNotNull())
    pairs = F.inline(F.array(*[F.struct(F.lit(s).alias("score_name"), F.col(s).cast("double").alias("x")) for s in scores]))
    areas = auroc(common.select(*groups, target, pairs), [*groups, "score_name"], target, "x")
    ref = areas.where(F.col("score_name") == reference).select(*groups, F.col("auroc").alias("ref"))
    joined = areas.join(ref, groups) if groups else areas.join(F.broadcast(ref))  # without groups, one row
    return joined.select(*groups, "score_name", "auroc", (F.col("auroc") - F.col("ref")).alias("difference"))


def feature_cohort(rows: DataFrame, groups: list[str], target: Column, value: Column) -> DataFrame:
    """Counts of a metric's cohort: a row without target counts as that before its value is looked at."""
    no_target, no_value = target.isNull(), target.isNotNull() & value.isNull()
    return rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(no_target).alias("target_missing"),
        F.count_if(no_value).alias("predictor_missing"),
        F.count_if(target.isNotNull() & value.isNotNull()).alias("eligible"),
        F.count_if(target & value.isNotNull()).alias("positive"),
    )


def cohort_areas(rows: DataFrame, by: list[str], target: str, value: str, subject: str = "subject") -> DataFrame:
    """Per metric, pooled and by subject: the cohort's counts and the area.

    Rows are counted once by metric, subject and value; the pooled counts are sums of those, so no row
    is doubled.
    """
    y, x = F.col(target), F.col(value)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    counts = rows.groupBy(*by, subject, value).agg(one(y).alias("__p"), one(~y).alias("__n"), one(y.isNull()).alias("__m"))
    sums = [F.sum(c).alias(c) for c in ("__p", "__n", "__m")]
    own = kept(counts, "counts").select(*by, F.lit("subject").alias("grouping"), F.col(subject).alias("grp"), value, "__p", "__n", "__m")
    pooled = own.groupBy(*by, value).agg(*sums).select(*by, F.lit("pooled").alias("grouping"), F.lit(None).cast("string").alias("grp"), value, "__p", "__n", "__m")
    every = kept(own.unionByName(pooled), "grouped")
    keys = [*by, "grouping", "grp"]
    known = F.col("__p") + F.col("__n")
    cohort = every.groupBy(*keys).agg(
        F.sum(known + F.col("__m")).alias("total"),
        F.sum("__m").alias("target_missing"),
        F.coalesce(F.sum(F.when(x.isNull(), known)), F.lit(0)).alias("predictor_missing"),
        F.coalesce(F.sum(F.when(x.isNotNull(), known)), F.lit(0)).alias("eligible"),
        F.coalesce(F.sum(F.when(x.isNotNull(), F.col("__p"))), F.lit(0)).alias("positive"),
    )
    got = areas(every.where(x.isNotNull() & (known > 0)).drop("__m"), keys, value)
    on = F.lit(True)
    for k in keys:
        on = on & cohort[k].eqNullSafe(got[k])
    return cohort.join(got, on, "left").select(*[cohort[k] for k in keys], "total", "target_missing", "predictor_missing", "eligible", "positive", "auroc")
