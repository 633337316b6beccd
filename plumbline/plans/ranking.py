"""Ranking metrics: areas, ranks, correlations, and the analyses made of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.operators import bootstrap, rank, stats
from plumbline.plans.domain import Tables
from plumbline.plans.registry import GROUPED, auroc_sql, n, query, r
from plumbline.sources.records import kept

_LABELLED = "SELECT l.quality = 1 AS y, d.n_chars AS x, d.doc_id % 3 AS w, d.lang, d.source FROM labels l JOIN documents d USING (doc_id)"


def _labelled(t: Tables):
    labels = t.read("labels", "doc_id", "quality")
    docs = t.read("documents", "doc_id", "n_chars", "lang", "source")
    return labels.join(docs, "doc_id").select((F.col("quality") == 1).alias("y"), F.col("n_chars").alias("x"), (F.col("doc_id") % 3).alias("w"), "lang", "source")


@query("agg01", f"SELECT * FROM ({auroc_sql(f'({_LABELLED})', '', 'w')})")
def agg01(t):
    return rank.auroc(_labelled(t), [], "y", "x", "w").select("positives", "negatives", r("auroc", "auroc"))


@query("agg02", f"SELECT * FROM ({auroc_sql(f'({_LABELLED})', 'lang')})")
def agg02(t):
    return rank.auroc(_labelled(t), ["lang"], "y", "x").select("lang", "positives", "negatives", r("auroc", "auroc"))


@query("agg03", "SELECT qid, subject, run_id, n_think, rank() OVER (PARTITION BY subject ORDER BY n_think) + (count(*) OVER (PARTITION BY subject, n_think) - 1) / CAST(2 AS DOUBLE) AS rank FROM nat")
def agg03(t):
    return rank.average_ranks(t.nat.select("qid", "subject", "run_id", "n_think"), ["subject"], "n_think")


_METRICS = f"""g AS ({GROUPED.format("long")}),
c AS (SELECT fx, grouping, grp, count(*) AS total, count(*) FILTER (correct IS NULL) AS target_missing, count(*) FILTER (correct IS NOT NULL AND x IS NULL) AS predictor_missing,
  count(*) FILTER (correct IS NOT NULL AND x IS NOT NULL) AS eligible, count(*) FILTER (correct AND x IS NOT NULL) AS positive FROM g GROUP BY ALL),
a AS ({auroc_sql("(SELECT fx, grouping, grp, correct AS y, x FROM g)", "fx, grouping, grp")}),
m AS (SELECT c.*, a.auroc FROM c LEFT JOIN a ON a.fx = c.fx AND a.grouping = c.grouping AND a.grp IS NOT DISTINCT FROM c.grp),
mac AS (SELECT fx, 'macro' AS grouping, CAST(NULL AS VARCHAR) AS grp, CAST(sum(total) AS BIGINT) AS total, CAST(sum(target_missing) AS BIGINT) AS target_missing, CAST(sum(predictor_missing) AS BIGINT) AS predictor_missing, CAST(sum(eligible) AS BIGINT) AS eligible, CAST(sum(positive) AS BIGINT) AS positive,
  CASE WHEN count(auroc) = 5 THEN avg(auroc) END AS auroc FROM m WHERE grouping = 'subject' GROUP BY fx),
every AS (SELECT * FROM m UNION ALL SELECT * FROM mac)
"""
_COUNTS = ["total", "target_missing", "predictor_missing", "eligible", "positive"]


def metric_rows(long, by):
    """Seven rows for each metric: pooled, the subjects, and their macro mean; with cohort counts."""
    m = rank.cohort_areas(long, by, "correct", "x").withColumn("auroc", F.round("auroc", 10))
    return m.unionByName(rank.macro(m, by, "auroc", _COUNTS))


def _with_reason(m):
    reason = F.when(F.col("auroc").isNotNull(), None).when(F.col("grouping") == "macro", "incomplete_subject_macro").when(F.col("eligible") == 0, "no_eligible_observations").otherwise("single_target_class")
    return m.withColumn("reason", reason)


_REASON = "CASE WHEN auroc IS NOT NULL THEN NULL WHEN grouping = 'macro' THEN 'incomplete_subject_macro' WHEN eligible = 0 THEN 'no_eligible_observations' ELSE 'single_target_class' END AS reason"


@query("ana01", f"{_METRICS} SELECT fx, grouping, grp, total, target_missing, predictor_missing, eligible, positive, round(auroc, 5) AS auroc, {_REASON} FROM every")
def ana01(t):
    return _with_reason(metric_rows(t.long, ["fx"])).select("fx", "grouping", "grp", *_COUNTS, r("auroc", "auroc", 5), "reason")


@query("agg07", f"{_METRICS} SELECT fx, grouping, grp, eligible, auroc FROM m WHERE fx IN (6, 9)")
def agg07(t):
    out = rank.cohort_areas(t.long.where("fx in (6, 9)"), ["fx"], "correct", "x")
    return out.select("fx", "grouping", "grp", "eligible", r("auroc", "auroc"))


@query("agg08", f"{_METRICS} SELECT fx, eligible, positive, round(auroc, 5) AS auroc FROM mac")
def agg08(t):
    return metric_rows(t.long, ["fx"]).where("grouping = 'macro'").select("fx", "eligible", "positive", r("auroc", "auroc", 5))


@query("agg09", f"{_METRICS} SELECT fx, grouping, grp, total, target_missing, predictor_missing, eligible, positive, {_REASON} FROM every")
def agg09(t):
    return _with_reason(metric_rows(t.long, ["fx"])).select("fx", "grouping", "grp", *_COUNTS, "reason")


@query("sel03", "SELECT fx, count(*) AS total, count(*) FILTER (correct IS NULL) AS target_missing, count(*) FILTER (correct IS NOT NULL AND x IS NULL) AS predictor_missing, count(*) FILTER (correct IS NOT NULL AND x IS NOT NULL) AS eligible, count(*) FILTER (correct AND x IS NOT NULL) AS positive FROM long GROUP BY fx")
def sel03(t):
    return rank.feature_cohort(t.long, ["fx"], F.col("correct"), F.col("x"))


@query("sel08", "SELECT fx, round(min(x), 10) + 0 AS least, round(max(x), 10) + 0 AS most FROM long GROUP BY fx")
def sel08(t):
    """Oriented signals: higher means more likely right."""
    return t.long.groupBy("fx").agg(r(F.min("x"), "least"), r(F.max("x"), "most"))


_LOCAL = "lc AS (SELECT qid, subject, run_id, idx AS fx, correct, u.predictor, CASE u.predictor WHEN 1 THEN conf ELSE ent END AS x FROM ck, (SELECT unnest([1, 2]) AS predictor) u)"


@query("ana04", f"{_LOCAL}, g AS ({GROUPED.format('lc')}) {auroc_sql('(SELECT fx, predictor, grouping, grp, correct AS y, x FROM g)', 'fx, predictor, grouping, grp')}")
def ana04(t):
    """Areas of the checkpoints' own verdicts at each fraction, for two predictors."""
    rows = t.ck.select("qid", "subject", "run_id", F.col("idx").alias("fx"), "correct", F.inline(F.array(F.struct(F.lit(1).alias("predictor"), F.col("conf").alias("x")), F.struct(F.lit(2).alias("predictor"), F.col("ent").alias("x")))))
    out = rank.auroc(rank.with_groups(rows), ["fx", "predictor", "grouping", "grp"], "correct", "x")
    return out.select("fx", "predictor", "grouping", "grp", "positives", "negatives", r("auroc", "auroc"))


_COMMON = "common AS (SELECT subject, correct, -h_mean AS a, -h_tail AS b, confidence AS c FROM ev WHERE h_mean IS NOT NULL AND h_tail IS NOT NULL AND confidence IS NOT NULL)"


@query("agg26", f"{_COMMON}, three AS (SELECT correct AS y, s AS score_name, CASE s WHEN 'a' THEN a WHEN 'b' THEN b ELSE c END AS x FROM common, unnest(['a', 'b', 'c']) AS u(s)), ar AS ({auroc_sql('three', 'score_name')}) SELECT score_name, auroc, round(auroc - (SELECT auroc FROM ar WHERE score_name = 'a'), 5) AS difference FROM ar")
def agg26(t):
    rows = t.ev.select("correct", (-F.col("h_mean")).alias("a"), (-F.col("h_tail")).alias("b"), F.col("confidence").alias("c"))
    return rank.paired_difference(rows, [], "correct", ["a", "b", "c"], "a").select("score_name", r("auroc", "auroc"), r("difference", "difference", 5))


@query("sel04", f"{_COMMON} SELECT subject, count(*) AS n, count(*) FILTER (correct) AS positive FROM common GROUP BY subject")
def sel04(t):
    """Rows on which all of several signals are finite."""
    from plumbline.functions.scalars import finite

    rows = t.ev
    for c in ("h_mean", "h_tail", "confidence"):
        rows = rows.where(finite(F.col(c)).isNotNull())
    return rows.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("positive"))


_RANKED = "rk AS (SELECT subject, rank() OVER (PARTITION BY subject ORDER BY h_mean) + (count(*) OVER (PARTITION BY subject, h_mean) - 1) / CAST(2 AS DOUBLE) AS a, rank() OVER (PARTITION BY subject ORDER BY n_think) + (count(*) OVER (PARTITION BY subject, n_think) - 1) / CAST(2 AS DOUBLE) AS b FROM nat)"


@query("agg20", f"{_RANKED} SELECT subject, count(*) AS n, round(corr(a, b), 10) AS rho FROM rk GROUP BY subject")
def agg20(t):
    return rank.spearman(t.nat.select("subject", "h_mean", "n_think"), ["subject"], "h_mean", "n_think").select("subject", "n", r("rho", "rho"))


@query("agg19", "SELECT subject, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(corr(h_mean, confidence), 10) END AS pearson FROM nat WHERE h_mean IS NOT NULL AND confidence IS NOT NULL GROUP BY subject")
def agg19(t):
    rows = t.nat.where("h_mean is not null and confidence is not null")
    return rows.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), r(F.when(F.count(F.lit(1)) >= 3, F.corr("h_mean", "confidence")), "pearson"))


_FOUR = ["h_mean", "h_tail", "confidence", "n_think"]
_PAIRS = [(a, b) for i, a in enumerate(_FOUR) for b in _FOUR[i + 1 :]]


@query("agg21", " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 10) AS r FROM nat" for a, b in _PAIRS))
def agg21(t):
    return stats.correlations(t.nat, _FOUR).select("x", "y", r("r", "r"))


@query("srt05", "c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 10) AS r FROM nat" for a, b in _PAIRS) + ") SELECT * FROM c WHERE NOT (x = 'h_mean' AND y = 'h_tail') ORDER BY abs(r) DESC, x, y LIMIT 3")
def srt05(t):
    """The most correlated pairs without an excluded one; ties by name."""
    got = stats.correlations(t.nat, _FOUR).select("x", "y", r("r", "r")).where(~((F.col("x") == "h_mean") & (F.col("y") == "h_tail")))
    return got.orderBy(F.abs("r").desc(), "x", "y").limit(3)


@query("agg22", "d AS (SELECT h_mean - avg(h_mean) OVER (PARTITION BY subject) AS a, n_think - avg(n_think) OVER (PARTITION BY subject) AS b FROM nat) SELECT count(*) AS n, round(corr(a, b), 10) AS r FROM d")
def agg22(t):
    """Correlation after taking out subject means; the means come by an aggregate and a join of five rows."""
    means = t.nat.groupBy("subject").agg(F.avg("h_mean").alias("ma"), F.avg("n_think").alias("mb"))
    rows = t.nat.join(means, "subject").select((F.col("h_mean") - F.col("ma")).alias("a"), (F.col("n_think") - F.col("mb")).alias("b"))
    return rows.agg(F.count(F.lit(1)).alias("n"), r(F.corr("a", "b"), "r"))


# -- bootstrap ----------------------------------------------------------------------------

_CL = "cl AS (SELECT subject, qid, row_number() OVER (PARTITION BY subject ORDER BY qid) - 1 AS rk, count(*) OVER (PARTITION BY subject) AS size FROM (SELECT DISTINCT subject, qid FROM ev))"


def _draws_sql(replicates: int) -> str:
    key = "('draw:' || replicate || ':' || subject || ':' || rk)"
    return f"""{_CL}, dr AS (SELECT replicate, subject, ('0x' || substr(md5{key}, 1, 15))::BIGINT % size AS rk FROM cl, unnest(range({replicates})) AS u(replicate)),
dm AS (SELECT replicate, subject, rk, count(*) AS m FROM dr GROUP BY ALL), plan AS (SELECT CAST(replicate AS INT) AS replicate, subject, qid, m FROM dm JOIN cl USING (subject, rk))"""


@query("bst04", f"{_draws_sql(20)} SELECT * FROM plan")
def bst04(t):
    return bootstrap.hashed_draws(t.ev, "subject", "qid", 20)


@query("jn09", f"{_draws_sql(5)} SELECT replicate, ev.subject, count(*) AS rows_hit, CAST(sum(m) AS BIGINT) AS rows_drawn FROM ev JOIN plan ON ev.subject = plan.subject AND ev.qid = plan.qid GROUP BY ALL")
def jn09(t):
    """Clusters of a plan joined to their rows; multiplicity is kept as a weight, never as copies."""
    plan = bootstrap.hashed_draws(t.ev, "subject", "qid", 5)
    return t.ev.join(plan, ["subject", "qid"]).groupBy("replicate", "subject").agg(F.count(F.lit(1)).alias("rows_hit"), n(F.sum("m"), "rows_drawn"))


def _boot_sql(replicates: int) -> str:
    src = "(SELECT replicate, correct AS y, -h_mean AS x, m FROM ev JOIN plan ON ev.subject = plan.subject AND ev.qid = plan.qid)"
    return f"{_draws_sql(replicates)}, b AS ({auroc_sql(src, 'replicate', 'm')})"


def _replicates(t, replicates):
    plan = bootstrap.hashed_draws(t.ev, "subject", "qid", replicates)
    rows = t.ev.select("subject", "qid", "correct", (-F.col("h_mean")).alias("x")).join(plan, ["subject", "qid"])
    return rank.auroc(rows, ["replicate"], "correct", "x", "m")


@query("bst06", f"{_boot_sql(50)} SELECT replicate, positives, negatives, auroc FROM b")
def bst06(t):
    """Replicate areas by weights: a row meets its question's multiplicity in the replicates that drew it, and is never repeated for it."""
    return _replicates(t, 50).select("replicate", "positives", "negatives", r("auroc", "auroc"))


@query("bst07", f"{_boot_sql(50)} SELECT count(auroc) AS valid, round(quantile_cont(auroc, 0.025), 5) AS lo, round(quantile_cont(auroc, 0.975), 5) AS hi FROM b")
def bst07(t):
    got = bootstrap.interval(_replicates(t, 50).withColumn("auroc", F.round("auroc", 10)), [], "auroc", 50)
    return got.select("valid", r("lo", "lo", 5), r("hi", "hi", 5))


@query("bst08", f"{_draws_sql(30)}, s AS (SELECT replicate, ev.subject, correct AS y, -h_mean AS x, m FROM ev JOIN plan ON ev.subject = plan.subject AND ev.qid = plan.qid), b AS ({auroc_sql('s', 'replicate, subject', 'm')}) SELECT replicate, CASE WHEN count(auroc) = 5 THEN round(avg(auroc), 5) END AS macro FROM b GROUP BY replicate")
def bst08(t):
    """Macro of each replicate, undefined where a subject is."""
    plan = bootstrap.hashed_draws(t.ev, "subject", "qid", 30)
    rows = t.ev.select("subject", "qid", "correct", (-F.col("h_mean")).alias("x")).join(plan, ["subject", "qid"])
    got = rank.auroc(rows, ["replicate", "subject"], "correct", "x", "m").withColumn("auroc", F.round("auroc", 10))
    return got.groupBy("replicate").agg(r(F.when(F.count("auroc") == 5, F.avg("auroc")), "macro", 5))


_DIFF = "df AS (SELECT subject, qid, avg(h_mean) FILTER (correct) - avg(h_mean) FILTER (NOT correct) AS d FROM ev GROUP BY ALL HAVING count(*) FILTER (correct) > 0 AND count(*) FILTER (NOT correct) > 0)"


@query("bst09", f"{_draws_sql(30)}, {_DIFF} SELECT replicate, round(sum(d * m) / sum(m), 10) AS mean FROM plan JOIN df USING (subject, qid) GROUP BY replicate")
def bst09(t):
    """Replicate means of fixed question differences, weighted by multiplicity."""
    plan = bootstrap.hashed_draws(t.ev, "subject", "qid", 30)
    d = stats.within_differences(t.ev, ["subject", "qid"], "correct", "h_mean")
    return plan.join(d, ["subject", "qid"]).groupBy("replicate").agg(r(F.try_divide(F.sum(F.col("difference") * F.col("m")), F.sum("m")), "mean"))


@query("bst05", f"{_draws_sql(4)} SELECT format('bootstrap-r{{:06d}}-s{{:02d}}-d{{:06d}}', replicate, list_position(list_sort(list_distinct((SELECT list(subject) FROM cl))), subject) - 1, row_number() OVER (PARTITION BY replicate, subject ORDER BY qid, k) - 1) AS draw_id, replicate, subject, qid FROM plan, unnest(range(m)) AS u(k)")
def bst05(t):
    """A plan as one row for each draw, with its identifier; the tasks make the rows, as many as there are.

    A question's draws are numbered from the sum of those before it in its subject, so no subject has to fit a task.
    """
    from pyspark.sql import Window

    plan = kept(bootstrap.hashed_draws(t.ev, "subject", "qid", 4), "plan")
    numbered = rank.below(plan, ["replicate", "subject"], "qid", ["m"])
    subjects = plan.select("subject").distinct().select("subject", (F.row_number().over(Window.orderBy("subject")) - 1).alias("s"))  # a row a subject
    rows = numbered.join(F.broadcast(subjects), "subject").select("replicate", "subject", "qid", "s", F.explode(F.sequence("m_below", F.col("m_below") + F.col("m") - 1)).alias("d"))
    return rows.select(F.format_string("bootstrap-r%06d-s%02d-d%06d", "replicate", "s", "d").alias("draw_id"), "replicate", "subject", "qid")


#: Questions of a plan made on the driver, and rows of a cohort resampled in the tasks; beyond, draws by hash join to rows as weights.
MOST_QUESTIONS, MOST_FIGURE_ROWS = 200_000, 100_000


def _questions(t) -> tuple[dict[str, list] | None, int]:
    """Questions by subject, none if there are too many for a plan on the driver; and the runs with a verdict."""
    rows = t.ev.groupBy("subject", "qid").agg(F.count(F.lit(1)).alias("runs")).limit(MOST_QUESTIONS + 1).collect()
    if len(rows) > MOST_QUESTIONS:
        return None, 0
    out: dict[str, list] = {}
    for s, q in sorted((x["subject"], x["qid"]) for x in rows):
        out.setdefault(s, []).append(q)
    return out, sum(x["runs"] for x in rows)


@query("bst01")
def bst01(t):
    """The plan of one generator as rows (replicate, position, drawn question); of draws by hash if it is too large."""
    questions, _ = _questions(t)
    if questions is None:
        return bootstrap.hashed_plan(t.ev, "subject", "qid", 10).select("replicate", "position", F.col("qid").cast("bigint"))
    plan = bootstrap.draw_plan(questions, 10)
    names = np.array([q for pool in questions.values() for q in pool], np.int64)
    starts = np.repeat(_starts(questions), [len(pool) for pool in questions.values()])
    shared = t.spark.sparkContext.broadcast((plan, names, starts))

    def rows(batches):
        plan, names, starts = shared.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                drawn = names[starts + plan[i]]  # the plan's own type may be too small for a place among all questions
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(drawn), i), pa.int32()), pa.array(np.arange(len(drawn)), pa.int32()), pa.array(drawn)], names=["replicate", "position", "qid"])

    return t.spark.range(0, len(plan), 1, len(plan)).mapInArrow(rows, "replicate int, position int, qid bigint")


def _starts(questions):
    out, a = [], 0
    for pool in questions.values():
        out.append(a)
        a += len(pool)
    return out


def _plan_rows(t, plan):
    rows = [(i, k, int(x)) for i, row in enumerate(plan) for k, x in enumerate(row)]
    return t.spark.createDataFrame(rows, "replicate int, position int, draw int")


@query("bst02", "SELECT replicate, CAST(i - 1 AS INT) AS position, draws[i] AS draw FROM (VALUES (0, [0, 2, 1, 1, 1, 2]), (1, [0, 2, 0, 0, 1, 2])) AS v(replicate, draws), unnest(range(1, 7)) AS u(i)")
def bst02(t):
    """An explicit plan, checked against its subjects' ranges."""
    plan = bootstrap.explicit_plan({"a": [1, 2, 3], "b": [4, 5, 6]}, [[0, 2, 1, 1, 1, 2], [0, 2, 0, 0, 1, 2]])
    return _plan_rows(t, plan)


@query("bst03", "SELECT replicate, CAST(i - 1 AS INT) AS position, draws[i] AS draw FROM (VALUES (0, [1, 0, 0, 1]), (1, [1, 1, 1, 0])) AS v(replicate, draws), unnest(range(1, 5)) AS u(i)")
def bst03(t):
    """A plan read from one row for each draw."""
    rows = [(0, "a", 0, 2), (0, "a", 1, 1), (0, "b", 0, 3), (0, "b", 1, 4), (1, "a", 0, 2), (1, "a", 1, 2), (1, "b", 0, 4), (1, "b", 1, 3)]
    draws = t.spark.createDataFrame(rows, "replicate_id int, subject string, draw_index int, question_id bigint")
    plan = bootstrap.plan_from_draws(draws, {"a": [1, 2], "b": [3, 4]})
    return _plan_rows(t, plan)


@query("bst06_plan")
def bst06_plan(t):
    """Intervals of all features from one shared plan: sorted once for each feature, weighed for each replicate. Too large a plan or cohort takes draws by hash."""
    questions, runs = _questions(t)
    if questions is None or runs > bootstrap.MOST_ROWS:
        rows = t.long.join(bootstrap.hashed_draws(t.ev, "subject", "qid", 1000), ["subject", "qid"])
        got = rank.auroc(rows, ["fx", "replicate"], "correct", "x", "m").withColumnRenamed("auroc", "estimate")
        return bootstrap.interval(got, ["fx"], "estimate", 1000)
    m = bootstrap.multiplicities(bootstrap.draw_plan(questions, 1000), [len(p) for p in questions.values()])
    names = [q for pool in questions.values() for q in pool]
    got = bootstrap.bootstrap_auroc(t.spark, t.long, "fx", "correct", "x", "qid", m, names)
    return bootstrap.interval(got, ["fx"], "estimate", 1000)


def _figures(t):
    """Runs with a verdict and their confidence at three fractions, by the one aggregation that makes the runs."""
    at = lambda i: F.max(F.when(F.col("idx") == i, F.col("conf"))).alias(str(i))
    return t._by_run(*[at(i) for i in (0, 5, 10)]).where("correct is not null").select("qid", "subject", "correct", "0", "5", "10")


def _on_driver(rows):
    """A written cohort on the driver, or nothing if it has too many rows for that: they are counted before any is fetched."""
    return rows.orderBy("qid").toPandas() if rows.count() <= MOST_FIGURE_ROWS else None


def _figure_rows(t):
    return _on_driver(kept(_figures(t), "figures"))


def _resampled(t, rows, statistic, replicates: int):
    got = bootstrap.resample(t.spark, rows, statistic, "qid", "subject", replicates)
    return t.spark.createDataFrame([(i, *(float(x) for x in row)) for i, row in enumerate(got.itertuples(index=False))], "k int, point double, lo double, hi double")


def _finite(c: str):
    return F.when(F.abs(c) < float("inf"), F.col(c))


def _by_fraction(rows, value=_finite):
    """A row for each of the three fractions: k, x."""
    return rows.select("*", F.posexplode(F.array(*[value(c) for c in ("0", "5", "10")])).alias("k", "x"))


def means(v):
    import numpy as np

    return np.nanmean(v[["0", "5", "10"]].to_numpy(float), axis=0)


@query("bst10")
def bst10(t):
    """Any vector statistic, here means at three fractions, under physical resampling; of a large cohort by sums of each question, weighed by its draws."""
    figures = kept(_figures(t), "figures")
    if (rows := _on_driver(figures)) is not None:
        return _resampled(t, rows, means, 200)
    known = {c: F.nanvl(c, F.lit(None).cast("double")) for c in ("0", "5", "10")}
    sums = figures.groupBy("subject", "qid").agg(*[f(x).alias(f"{name}{c}") for c, x in known.items() for name, f in (("s", F.sum), ("n", F.count))])
    drawn = sums.join(bootstrap.hashed_lists(sums, "subject", "qid", 200), ["subject", "qid"])
    by = drawn.select("*", F.explode(F.concat(F.array(F.lit(-1)), "drawn")).alias("replicate")).groupBy("replicate").agg(*[F.sum(f"{name}{c}").alias(f"{name}{c}") for c in known for name in "sn"])
    got = by.select("replicate", F.posexplode(F.array(*[F.try_divide(f"s{c}", f"n{c}") for c in known])).alias("k", "mean"))
    return bootstrap.point_interval(got, "mean")


def areas(v):
    import numpy as np

    out, y = [], v["correct"].to_numpy(bool)
    for c in ("0", "5", "10"):
        x = v[c].to_numpy(float)
        ok = np.isfinite(x)
        order = np.argsort(x[ok], kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(x[ok][order]) != 0))) if ok.any() else np.zeros(0, int)
        out.append(bootstrap.weighted_auroc(y[ok], order, starts, np.ones(ok.sum(), np.int64)) if ok.sum() >= 2 else np.nan)
    return out


@query("bst11")
def bst11(t):
    """A curve of areas over columns under physical resampling; missing values drop out by column. A large cohort is sorted once and weighed for all replicates."""
    figures = kept(_figures(t), "figures")
    if (rows := _on_driver(figures)) is not None:
        return _resampled(t, rows, areas, 200)
    got = bootstrap.weighted_areas(figures, "subject", "qid", "correct", ["0", "5", "10"], 200)
    return bootstrap.point_interval(got, "auroc")


def refit(v):
    import numpy as np

    x, z, y = v["10"].to_numpy(float), v["0"].to_numpy(float), v["correct"].to_numpy(bool)
    ok = np.isfinite(x) & np.isfinite(z)
    a = np.stack([np.ones(ok.sum()), z[ok]], 1)
    left = x[ok] - a @ np.linalg.lstsq(a, x[ok], rcond=None)[0]
    order = np.argsort(left, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], np.diff(left[order]) != 0)))
    return [bootstrap.weighted_auroc(y[ok], order, starts, np.ones(ok.sum(), np.int64))]


@query("bst12")
def bst12(t):
    """The area of a residual that is fitted anew in each replicate; by weights if the cohort is large."""
    if (rows := _figure_rows(t)) is not None:
        return _resampled(t, rows, refit, 100)
    rows = bootstrap.weighted_rows(_figures(t), "subject", "qid", 100).select("replicate", "m", "correct", _finite("10").alias("x"), _finite("0").alias("z")).where("x is not null and z is not null")
    total = {name: F.sum(F.col("m") * c).alias(name) for name, c in {"n": F.lit(1.0), "sz": F.col("z"), "sx": F.col("x"), "szz": F.col("z") * F.col("z"), "szx": F.col("z") * F.col("x")}.items()}
    spread = F.col("n") * F.col("szz") - F.col("sz") * F.col("sz")
    slope = F.when(spread > 1e-12 * F.col("n") * F.col("szz"), (F.col("n") * F.col("szx") - F.col("sz") * F.col("sx")) / spread).otherwise(0.0)
    fits = rows.groupBy("replicate").agg(*total.values()).select("replicate", slope.alias("slope"))
    left = rows.join(fits, "replicate").select("replicate", "m", "correct", (F.col("x") - F.col("slope") * F.col("z")).alias("left"))  # the intercept changes no order
    return bootstrap.point_interval(rank.auroc(left, ["replicate"], "correct", "left", "m").withColumn("k", F.lit(0)), "auroc")
