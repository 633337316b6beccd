"""Analyses made of several operators: the tables of one build, figure panels, length against entropy, the pilot's batteries."""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions import scalars
from plumbline.functions.scalars import SUBJECTS
from plumbline.operators import calibration, rank, stats
from plumbline.plans import calibrating, ranking
from plumbline.plans.domain import RUN, Tables
from plumbline.plans.registry import GROUPED, auroc_sql, n, query, r, reliability_sql
from plumbline.sources.records import scratch, write_parquet

# -- one build, eight tables ----------------------------------------------------------------


class Built(Tables):
    """Tables of which the runs, with their slots, are built and written once; all others come from those."""

    @cached_property
    def runs(self):
        path = scratch(self.spark, "trajectories")
        write_parquet(Tables(self.spark, self.sf_dir).runs, path)
        return self.spark.read.parquet(path)

    @cached_property
    def nat(self):
        return self.runs.drop("slots")

    @cached_property
    def ck(self):
        rows = self.runs.select(*RUN, "subject", "gold", "n_think", F.posexplode("slots").alias("idx", "s")).where("s is not null")
        return rows.select(*RUN, "subject", "gold", "n_think", "idx", "s.*")


def analysis_tables(t: Tables) -> dict:
    """Eight tables of five analyses over one build of the trajectories."""
    t = Built(t.spark, t.sf_dir)
    within = calibrating.ana05(t)
    natural, checkpoint = calibrating.ana02(t), calibrating.ana03(t)
    bins = natural.select(F.lit("natural").alias("family"), "grouping", "grp", "bin", "n", "contribution").unionByName(
        checkpoint.select(F.concat(F.lit("checkpoint-"), F.col("predictor").cast("string"), F.lit("-"), F.col("idx").cast("string")).alias("family"), "grouping", "grp", "bin", "n", "contribution")
    )
    return {
        "trajectory_features": (t.features.select("switches"), "switches"),
        "trajectory_events": (calibrating.agg12(t), "trajectory_count"),
        "primary_auroc": (ranking.ana01(t), "auroc"),
        "secondary_checkpoint_auroc": (ranking.ana04(t), "auroc"),
        "calibration_metrics": (calibration.ece(bins, ["family", "grouping", "grp"]), "ece"),
        "reliability_bins": (bins, "n"),
        "within_question_summary": (within.groupBy("fx").agg(F.avg("difference").alias("mean")), "mean"),
        "within_question_distribution": (within, "difference"),
    }


_TABLES6 = {
    "trajectory_features": "SELECT CAST(switches AS DOUBLE) AS v FROM f",
    "trajectory_events": f"SELECT CAST(count(*) AS DOUBLE) AS v FROM ({GROUPED.format('f')}) GROUP BY grouping, grp",
    "primary_auroc": "SELECT round(auroc, 5) AS v FROM every",
    "secondary_checkpoint_auroc": f"SELECT auroc AS v FROM (WITH lg AS ({GROUPED.format('lc')}) {auroc_sql('(SELECT fx, predictor, grouping, grp, correct AS y, x FROM lg)', 'fx, predictor, grouping, grp')})",
    "calibration_metrics": "SELECT sum(contribution) AS v FROM allbins GROUP BY family, grouping, grp",
    "reliability_bins": "SELECT CAST(n AS DOUBLE) AS v FROM allbins",
    "within_question_summary": "SELECT avg(round(a - b, 10)) AS v FROM wd GROUP BY fx",
    "within_question_distribution": "SELECT round(a - b, 10) AS v FROM wd",
}
_BINS6 = f"""nb AS (WITH g0 AS (SELECT subject, answer = gold AS y, confidence AS c FROM nat), g AS ({GROUPED.format('g0')}) {reliability_sql('g', ['grouping', 'grp'])}),
cb AS (WITH g0 AS (SELECT idx, subject, correct AS y, u.predictor, CASE u.predictor WHEN 1 THEN conf ELSE least(1.0, ent / 5) END AS c FROM ck, (SELECT unnest([1, 2]) AS predictor) u), g AS ({GROUPED.format('g0')}) {reliability_sql('g', ['idx', 'predictor', 'grouping', 'grp'])}),
allbins AS (SELECT 'natural' AS family, grouping, grp, bin, n, contribution FROM nb UNION ALL SELECT 'checkpoint-' || predictor || '-' || idx, grouping, grp, bin, n, contribution FROM cb)"""


@query(
    "ana06",
    f"{ranking._METRICS}, {ranking._LOCAL}, {calibrating._WITHIN}, {_BINS6} " + " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) AS rows, count(v) AS defined, round(sum(v), 4) + 0 AS total FROM ({body})" for k, body in _TABLES6.items()),
)
def ana06(t):
    """Five analyses of one build of the trajectories, which is written once: rows, defined values and their sum of each of eight tables."""
    out = None
    for name, (table, value) in analysis_tables(t).items():
        one = table.agg(F.count(F.lit(1)).alias("rows"), F.count(value).alias("defined"), r(F.sum(F.col(value).cast("double")), "total", 4)).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("name", "rows", "defined", "total")


@query(
    "set02",
    f"""SELECT 'natural' AS family, grouping, grp, NULL::INT AS idx, CAST(NULL AS INT) AS predictor, n, ece FROM (WITH {calibrating._NATURAL}, e AS ({calibrating._ECE.format('grouping, grp')}) SELECT * FROM e UNION ALL SELECT 'macro', NULL, CAST(sum(n) AS BIGINT), CASE WHEN count(ece) = 5 THEN round(avg(ece), 4) END FROM e WHERE grouping = 'subject')
  UNION ALL SELECT 'checkpoint', grouping, grp, idx, predictor, n, ece FROM (WITH {calibrating._CHECK} {calibrating._ECE.format('idx, predictor, grouping, grp')})""",
)
def set02(t):
    """The metrics of two families one after the other; keys that one lacks are null."""
    a = calibrating.ana02_ece(t).withColumn("family", F.lit("natural"))
    b = calibrating.ana03_ece(t).withColumn("family", F.lit("checkpoint"))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.select("family", "grouping", "grp", F.col("idx").cast("int").alias("idx"), F.col("predictor").cast("int").alias("predictor"), "n", "ece")


# -- panels of figures ------------------------------------------------------------------------


@query("ana07_deciles", "tk AS (SELECT vec_id, least((i - 1) * 10 // 64, 9) AS bin, abs(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, unnest(range(1, 65)) AS u(i)), m AS (SELECT vec_id, bin, avg(v) AS m FROM tk GROUP BY ALL) SELECT bin, count(*) AS traces, round(avg(m), 10) AS mean, round(min(m), 10) AS least, round(max(m), 10) AS most FROM m GROUP BY bin")
def ana07_deciles(t):
    """Evolution over the tenths of a trace: each trace's mean first, then the mean of those."""
    rows = t.read("embeddings", "embedding").select(F.posexplode(scalars.tenths_means(F.transform("embedding", lambda x: F.abs(x.cast("double"))))).alias("bin", "m"))
    return rows.groupBy(n("bin", "bin")).agg(F.count("m").alias("traces"), r(F.avg("m"), "mean"), r(F.min("m"), "least"), r(F.max("m"), "most"))


_ENDS = "en AS (SELECT ev.correct AS y, ev.answer = ck.ans AS same, least(1.0, ck.ent / 5) AS p, ck.conf AS c FROM ev JOIN ck ON ck.qid = ev.qid AND ck.run_id = ev.run_id AND ck.idx = 10 WHERE ck.ent IS NOT NULL AND ck.conf IS NOT NULL), two AS (SELECT 'probability' AS predictor, y, same, round(p, 10) AS c FROM en UNION ALL SELECT 'confidence', y, same, round(c, 10) FROM en)"
_EDGE = "CAST(len(list_filter([i * CAST(0.1 AS DOUBLE) FOR i IN range(1, 10)], lambda e: e <= c)) AS INT)"


@query(
    "ana10_endpoint",
    f"{_ENDS}, rb AS ({reliability_sql('two', ['predictor'], _EDGE)}), ar AS ({auroc_sql('(SELECT predictor, y, c AS x FROM two)', 'predictor')}) SELECT rb.predictor, CAST(sum(n) AS BIGINT) AS n, round(sum(contribution), 8) AS ece, max(ar.auroc) AS auroc, max((SELECT round(avg(CAST(same AS INT)), 10) FROM en)) AS matches FROM rb JOIN ar ON ar.predictor = rb.predictor GROUP BY rb.predictor",
)
def ana10_endpoint(t):
    """Two readouts of one endpoint probe, calibrated on the runs that have both."""
    end = t.ck.where("idx = 10 and ent is not null and conf is not null").select(*RUN, "ans", (F.least(F.lit(1.0), F.col("ent") / 5)).alias("p"), F.col("conf").alias("c"))
    rows = t.ev.select(*RUN, "correct", "answer").join(end, RUN).withColumn("same", F.col("answer") == F.col("ans"))
    two = rows.select("correct", "same", F.inline(F.array(F.struct(F.lit("probability").alias("predictor"), F.round("p", 10).alias("x")), F.struct(F.lit("confidence").alias("predictor"), F.round("c", 10).alias("x")))))
    bins = calibration.reliability(two, ["predictor"], F.col("correct"), F.col("x"), bin_of=calibration.edge_bin)
    areas = rank.auroc(two, ["predictor"], "correct", "x").select("predictor", r("auroc", "auroc"))
    match = two.groupBy("predictor").agg(r(F.avg(F.col("same").cast("int")), "matches"))
    got = calibration.ece(bins, ["predictor"]).join(areas, "predictor").join(match, "predictor")
    return got.select("predictor", n("n", "n"), r("ece", "ece", 8), "auroc", "matches")


@query(
    "ana11_concentration",
    "SELECT ev.correct, count(*) AS n, round(median(ck.conf), 10) AS median, round(100 * avg(CAST(ck.conf >= 0.9 AS INT)), 8) AS over_90, round(100 * avg(CAST(ck.conf >= 0.99 AS INT)), 8) AS over_99, round(100 * avg(CAST(ck.ent < 0.1 AS INT)), 8) AS sure, round(avg(CAST(ck.ans = ev.answer AS INT)), 10) AS matches FROM ev JOIN ck ON ck.qid = ev.qid AND ck.run_id = ev.run_id AND ck.idx = 10 GROUP BY ev.correct",
)
def ana11_concentration(t):
    """How concentrated the endpoint's distribution is, by outcome."""
    rows = t.ev.select(*RUN, "correct", "answer").join(t.ck.where("idx = 10").select(*RUN, "ans", "conf", "ent"), RUN)
    share = lambda c, k, name, digits: r(F.avg(c.cast("int")) * k, name, digits)
    sums = rows.groupBy("correct").agg(
        F.count(F.lit(1)).alias("n"), share(F.col("conf") >= 0.9, 100, "over_90", 8), share(F.col("conf") >= 0.99, 100, "over_99", 8), share(F.col("ent") < 0.1, 100, "sure", 8), share(F.col("ans") == F.col("answer"), 1, "matches", 10)
    )
    return sums.join(rank.percentiles(rows, ["correct"], "conf", {"median": 0.5}).select("correct", r("median", "median")), "correct")


@query(
    "ana11_change",
    "m AS (SELECT ev.correct, idx, avg(ck.ent) AS m, count(ck.ent) AS c FROM ck JOIN ev USING (qid, run_id) GROUP BY ALL) SELECT correct, round(max(m) FILTER (idx = 0), 10) AS first, round(max(m) FILTER (idx = 5), 10) AS half, round(max(m) FILTER (idx = 10), 10) AS last, round(max(m), 10) AS peak, round(max(m) FILTER (idx = 10) - max(m) FILTER (idx = 0), 9) + 0 AS change, round(max(m) FILTER (idx = 5) - max(m) FILTER (idx = 0), 9) + 0 AS early, round(max(m) FILTER (idx = 10) - max(m) FILTER (idx = 5), 9) + 0 AS late, min(c) AS fewest FROM m GROUP BY correct",
)
def ana11_change(t):
    """Where the curves of each outcome start, peak and end, and how much changes early and late."""
    rows = t.ck.select(*RUN, "idx", "ent").join(t.ev.select(*RUN, "correct"), RUN)
    m = rows.groupBy("correct", "idx").agg(F.avg("ent").alias("m"), F.count("ent").alias("c"))
    at = lambda i: F.max(F.when(F.col("idx") == i, F.col("m")))
    return m.groupBy("correct").agg(
        r(at(0), "first"), r(at(5), "half"), r(at(10), "last"), r(F.max("m"), "peak"), r(at(10) - at(0), "change", 9), r(at(5) - at(0), "early", 9), r(at(10) - at(5), "late", 9), F.min("c").alias("fewest")
    )


# -- length against entropy ---------------------------------------------------------------------

_E12 = "e AS (SELECT subject, correct, CAST(correct AS INT)::DOUBLE AS c, CAST(n_think AS DOUBLE) AS len, ln(n_think + 1) AS l, h_mean AS h, h_tail AS ht FROM ev)"
_D12 = f"""{_E12},
mu AS (SELECT subject, avg(h) AS mh, avg(l) AS ml, avg(c) AS mc FROM e GROUP BY subject),
d AS (SELECT e.*, h - mh AS y1, l - ml AS l1, c - mc AS c1, l * c - avg(l * c) OVER (PARTITION BY subject) AS i1 FROM e JOIN mu USING (subject)),
s AS (SELECT sum(l1 * l1) AS ll, sum(l1 * c1) AS lc, sum(c1 * c1) AS cc, sum(l1 * i1) AS li, sum(c1 * i1) AS ci, sum(i1 * i1) AS ii, sum(l1 * y1) AS ly, sum(c1 * y1) AS cy, sum(i1 * y1) AS iy, sum(y1 * y1) AS yy, (SELECT var_pop(h) * count(*) FROM e) AS sst FROM d),
b AS (SELECT (ly * cc - cy * lc) / (ll * cc - lc * lc) AS bl, (cy * ll - ly * lc) / (ll * cc - lc * lc) AS bc, (ll * (cc * iy - cy * ci) - lc * (lc * iy - cy * li) + ly * (lc * ci - cc * li)) / (ll * (cc * ii - ci * ci) - lc * (lc * ii - ci * li) + li * (lc * ci - cc * li)) AS bi, ly / ll AS bare, yy, ly, cy, sst FROM s),
eff AS (SELECT subject, mh - bl * ml - bc * mc AS a FROM mu, b),
fit AS (SELECT regr_slope(h, l) AS k, regr_intercept(h, l) AS a FROM e),
sc AS (SELECT correct AS y, unnest(['entropy', 'length', 'residual', 'subject_residual']) AS signal, unnest([round(-h, 8), round(-l, 8), round(a + k * l - h, 8), round(bare * l1 - y1, 8)]) AS x FROM d, fit, b),
ar AS ({auroc_sql('sc', 'signal')}),
rk AS (SELECT rank() OVER (ORDER BY len) + (count(*) OVER (PARTITION BY len) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY h) + (count(*) OVER (PARTITION BY h) - 1) / 2.0::DOUBLE AS b FROM e)"""
_N12 = "(SELECT count(*) FROM e)"
_ROWS12 = [
    ("'descriptive', 'wrong_minus_right', 'median_length'", "(SELECT median(len) FILTER (NOT correct) - median(len) FILTER (correct) FROM e)", _N12),
    ("'primary', 'all', 'pearson_length'", "(SELECT corr(len, h) FROM e)", _N12),
    ("'primary', 'all', 'pearson_log_length'", "(SELECT corr(l, h) FROM e)", _N12),
    ("'primary', 'all', 'spearman_length'", "(SELECT corr(a, b) FROM rk)", _N12),
    ("'secondary', 'all', 'pearson_within_subject'", "(SELECT corr(l1, y1) FROM d)", _N12),
    ("'secondary', 'all', 'pearson_log_length_tail'", "(SELECT corr(l, ht) FROM e)", _N12),
    *[(f"'outcome', '{k}', 'pearson_log_length'", f"(SELECT corr(l, h) FROM e WHERE correct = {v})", f"(SELECT count(*) FROM e WHERE correct = {v})") for k, v in (("right", "true"), ("wrong", "false"))],
    *[(f"'subject', '{s}', 'pearson_log_length'", f"(SELECT corr(l, h) FROM e WHERE subject = '{s}')", f"(SELECT count(*) FROM e WHERE subject = '{s}')") for s in SUBJECTS],
    ("'adjusted', 'all', 'intercept'", f"(SELECT a FROM eff WHERE subject = '{SUBJECTS[0]}')", _N12),
    ("'adjusted', 'all', 'log_length'", "(SELECT bl FROM b)", _N12),
    ("'adjusted', 'all', 'correct'", "(SELECT bc FROM b)", _N12),
    *[(f"'adjusted', 'all', 'subject:{s}'", f"(SELECT a FROM eff WHERE subject = '{s}') - (SELECT a FROM eff WHERE subject = '{SUBJECTS[0]}')", _N12) for s in SUBJECTS[1:]],
    ("'adjusted', 'all', 'r_squared'", "(SELECT 1 - (yy - bl * ly - bc * cy) / sst FROM b)", _N12),
    ("'unadjusted', 'all', 'log_length'", "(SELECT k FROM fit)", _N12),
    ("'interaction', 'all', 'log_length_x_correct'", "(SELECT bi FROM b)", _N12),
    *[("'area', 'all', '" + k + "'", f"(SELECT auroc FROM ar WHERE signal = '{k}')", _N12) for k in ("entropy", "length", "residual", "subject_residual")],
    *[(f"'paired', 'all', 'entropy_minus_{k}'", f"(SELECT auroc FROM ar WHERE signal = 'entropy') - (SELECT auroc FROM ar WHERE signal = '{k}')", _N12) for k in ("length", "residual")],
    ("'area', 'all', 'residual_refit'", "(SELECT auroc FROM ar WHERE signal = 'residual')", _N12),
]


def _length_rows(t):
    return t.ev.select("subject", "correct", F.col("correct").cast("double").alias("c"), F.col("n_think").cast("double").alias("len"), F.ln(F.col("n_think") + 1).alias("l"), F.col("h_mean").alias("h"), F.col("h_tail").alias("ht"))


def _dummies():
    return [F.when(F.col("subject") == s, 1.0).otherwise(0.0) for s in SUBJECTS[1:]]


@query("ana12", f"{_D12} " + " UNION ALL ".join(f"SELECT analysis, subset, statistic, CAST({count} AS BIGINT) AS n, round({value}, 6) + 0 AS estimate FROM (SELECT {names.split(',')[0]} AS analysis, {names.split(',')[1]} AS subset, {names.split(',')[2]} AS statistic)" for names, value, count in _ROWS12))
def ana12(t):
    """Length against entropy: thirty point estimates (the eight of a joint logistic model are ``ana12_logit``)."""
    path = scratch(t.spark, "length-entropy")
    write_parquet(_length_rows(t), path)  # read by all that follows
    e = t.spark.read.parquet(path)
    one = F.lit(1.0)
    means = e.groupBy("subject").agg(F.avg("h").alias("mh"), F.avg("l").alias("ml"))
    d = e.join(means, "subject").select("subject", "correct", "h", "l", (F.col("h") - F.col("mh")).alias("y1"), (F.col("l") - F.col("ml")).alias("l1"))
    sums = e.agg(
        F.count(F.lit(1)).alias("n"), F.corr("len", "h").alias("raw"), F.corr("l", "h").alias("log"), F.corr("l", "ht").alias("tail"),
        F.regr_slope("h", "l").alias("k"), F.regr_intercept("h", "l").alias("a"),
        *[F.corr(F.when(c, F.col("l")), F.when(c, F.col("h"))).alias(f"r_{name}") for name, c in (("right", F.col("correct")), ("wrong", ~F.col("correct")))],
        *[F.count_if(c).alias(f"n_{name}") for name, c in (("right", F.col("correct")), ("wrong", ~F.col("correct")))],
    ).first()
    inner = d.agg(F.corr("l1", "y1").alias("within"), (F.sum(F.col("l1") * F.col("y1")) / F.sum(F.col("l1") * F.col("l1"))).alias("only")).first()
    medians = {x["correct"]: x["m"] for x in rank.percentiles(e, ["correct"], "len", {"m": 0.5}).collect()}  # two rows
    rho = rank.spearman(e, [], "len", "h").first()["rho"]
    adjusted, r2 = stats.ols(e, [one, F.col("l"), F.col("c"), *_dummies()], F.col("h"))
    crossed, _ = stats.ols(e, [one, F.col("l"), F.col("c"), F.col("l") * F.col("c"), *_dummies()], F.col("h"))
    x = {"entropy": -F.col("h"), "length": -F.col("l"), "residual": F.lit(sums["a"]) + F.lit(sums["k"]) * F.col("l") - F.col("h"), "subject_residual": F.lit(inner["only"]) * F.col("l1") - F.col("y1")}
    long = d.select("correct", F.inline(F.array(*[F.struct(F.lit(k).alias("signal"), F.round(v, 8).alias("x")) for k, v in x.items()])))
    area = {q["signal"]: q["auroc"] for q in rank.auroc(long, ["signal"], "correct", "x").select("signal", F.round("auroc", 10).alias("auroc")).collect()}  # four rows
    total = sums["n"]
    out = [("descriptive", "wrong_minus_right", "median_length", total, medians[False] - medians[True])]
    out += [("primary", "all", k, total, v) for k, v in (("pearson_length", sums["raw"]), ("pearson_log_length", sums["log"]), ("spearman_length", rho))]
    out += [("secondary", "all", "pearson_within_subject", total, inner["within"]), ("secondary", "all", "pearson_log_length_tail", total, sums["tail"])]
    out += [("outcome", k, "pearson_log_length", sums[f"n_{k}"], sums[f"r_{k}"]) for k in ("right", "wrong")]
    by = {q["subject"]: q for q in e.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.corr("l", "h").alias("r")).collect()}  # five rows
    out += [("subject", s, "pearson_log_length", by[s]["n"], by[s]["r"]) for s in SUBJECTS if s in by]
    out += [("adjusted", "all", k, total, float(b)) for k, b in zip(["intercept", "log_length", "correct", *[f"subject:{s}" for s in SUBJECTS[1:]]], adjusted, strict=True)]
    out += [("adjusted", "all", "r_squared", total, r2), ("unadjusted", "all", "log_length", total, sums["k"]), ("interaction", "all", "log_length_x_correct", total, float(crossed[3]))]
    out += [("area", "all", k, total, area[k]) for k in x] + [("paired", "all", f"entropy_minus_{k}", total, area["entropy"] - area[k]) for k in ("length", "residual")]
    out += [("area", "all", "residual_refit", total, area["residual"])]
    rows = t.spark.createDataFrame([(a, b, c, int(k), None if v is None else float(v)) for a, b, c, k, v in out], "analysis string, subset string, statistic string, n bigint, estimate double")
    return rows.select("analysis", "subset", "statistic", "n", r("estimate", "estimate", 6))


@query("ana12_logit")
def ana12_logit(t):
    """The joint logistic model of correctness and its area on the rows that it was fitted to; tests hold it against plain Newton steps."""
    e = _length_rows(t)
    terms = [F.lit(1.0), F.col("h"), F.col("l"), *_dummies()]
    beta = stats.logistic(e, terms, F.col("c"))
    fit = sum((F.lit(float(b)) * x for b, x in zip(beta[1:], terms[1:], strict=True)), F.lit(float(beta[0])))
    area = rank.auroc(e.select("correct", F.round(fit, 8).alias("x")), [], "correct", "x").first()["auroc"]
    names = ["intercept", "entropy", "log_length", *[f"subject:{s}" for s in SUBJECTS[1:]], "area"]
    return t.spark.createDataFrame([(k, float(v)) for k, v in zip(names, [*beta, np.nan if area is None else area], strict=True)], "statistic string, estimate double")


# -- the pilot's batteries ------------------------------------------------------------------------

_SIX = {"H_think": "-h_mean", "H_tail": "-h_tail", "H_first": "-e0", "H_mid": "-e5", "H_last": "-e10", "confidence": "confidence"}
_CLOSED = "cl6 AS (SELECT n.subject, n.answer = n.gold AS y, h_mean, h_tail, e0, e5, e10, confidence FROM nat n JOIN at_ USING (qid, run_id) WHERE n_ck = 11 AND n.answer IS NOT NULL)"
_SIX_SQL = f"{_CLOSED}, sg AS (SELECT y, s AS signal, round(CASE s {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in _SIX.items())} END, 10) AS x FROM cl6, unnest([{', '.join(repr(k) for k in _SIX)}]) AS u(s))"


def _closed(t):
    """Closed runs with a verdict and their six signals, in long form: correct, signal, x."""
    at = lambda i: F.get("slots", F.lit(i))["ent"]
    x = {"H_think": -F.col("h_mean"), "H_tail": -F.col("h_tail"), "H_first": -at(0), "H_mid": -at(5), "H_last": -at(10), "confidence": F.col("confidence")}
    rows = t.runs.where("n_ck = 11 and correct is not null")
    return rows.select("correct", F.inline(F.array(*[F.struct(F.lit(k).alias("signal"), F.round(v, 10).alias("x")) for k, v in x.items()])))


@query("ana15_areas", f"{_SIX_SQL} {auroc_sql('sg', 'signal')}")
def ana15_areas(t):
    """The pilot's areas of six signals on closed runs."""
    return rank.auroc(_closed(t), ["signal"], "correct", "x").select("signal", "positives", "negatives", r("auroc", "auroc"))


@query("ana15_shapes", f"{_SIX_SQL} SELECT signal, y AS correct, count(x) AS n, round(avg(x), 10) AS mean, round(median(x), 10) AS median, round(quantile_cont(x, 0.25), 10) AS q25, round(quantile_cont(x, 0.75), 10) AS q75, round(avg(CAST(abs(x) <= 0.05 AS INT)), 10) AS near_zero FROM sg GROUP BY ALL")
def ana15_shapes(t):
    """The pilot's distributions of each signal by outcome, and the share near zero."""
    rows, keys = _closed(t), ["signal", "correct"]
    sums = rows.groupBy(*keys).agg(F.count("x").alias("n"), r(F.avg("x"), "mean"), r(F.avg((F.abs("x") <= 0.05).cast("int")), "near_zero"))
    q = rank.percentiles(rows, keys, "x", {"median": 0.5, "q25": 0.25, "q75": 0.75}).select(*keys, *[r(c, c) for c in ("median", "q25", "q75")])
    return sums.join(q, keys).select(*keys, "n", "mean", "median", "q25", "q75", "near_zero")


@query("ana15_bins", f"{_SIX_SQL}, b AS (SELECT 1 AS k, y, x AS c FROM sg WHERE signal = 'confidence'), u AS ({reliability_sql('b', ['k'], 'CAST(len(list_filter([0.2, 0.4, 0.6, 0.8], lambda e: e <= c)) AS INT)', 5)}) SELECT bin, n, mean_predicted, accuracy, contribution FROM u WHERE n > 0")
def ana15_bins(t):
    """The pilot's calibration of stated confidence in five uneven bins, empty ones left out."""
    rows = _closed(t).where("signal = 'confidence'")
    got = calibration.reliability(rows, [], F.col("correct"), F.col("x"), bin_of=lambda c: calibration.uneven_bin(c, [0.2, 0.4, 0.6, 0.8]), bins=5, keep_empty=False)
    return got.select("bin", n("n", "n"), r("mean_predicted", "mean_predicted"), r("accuracy", "accuracy"), r("contribution", "contribution"))
