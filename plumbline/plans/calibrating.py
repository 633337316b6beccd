"""Calibration, within-question differences and event summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import calibration, rank, stats, trajectory
from plumbline.plans.domain import RUN
from plumbline.plans.registry import GROUPED, n, query, r, reliability_sql

_BINS = ["n", "mean_predicted", "accuracy", "contribution"]


def _bins(table, keys):
    return table.select(*keys, "bin", n("n", "n"), r("mean_predicted", "mean_predicted"), r("accuracy", "accuracy"), r("contribution", "contribution"))


@query("agg04", f"b AS (SELECT subject, correct AS y, confidence AS c FROM ev) {reliability_sql('b', ['subject'])}")
def agg04(t):
    return _bins(calibration.reliability(t.ev, ["subject"], F.col("correct"), F.col("confidence")), ["subject"])


_EDGES = "CAST(len(list_filter([i * CAST(0.1 AS DOUBLE) FOR i IN range(1, 10)], lambda e: e <= c)) AS INT)"


@query("agg05", f"b AS (SELECT 1 AS k, quality = 1 AS y, (l.doc_id % 101) / CAST(100 AS DOUBLE) AS c FROM labels l) {reliability_sql('b', ['k'], _EDGES)}")
def agg05(t):
    rows = t.read("labels", "doc_id", "quality").select(F.lit(1).alias("k"), (F.col("quality") == 1).alias("y"), (F.col("doc_id") % 101 / F.lit(100.0)).alias("c"))
    return _bins(calibration.reliability(rows, ["k"], F.col("y"), F.col("c"), bin_of=calibration.edge_bin), ["k"])


_UNEVEN = [0.7, 0.8, 0.9, 0.95]


@query("agg06", f"b AS (SELECT 1 AS k, correct AS y, conf AS c FROM ck), u AS ({reliability_sql('b', ['k'], f'CAST(len(list_filter({_UNEVEN}, lambda e: e <= c)) AS INT)', 5)}) SELECT bin, n, mean_predicted, accuracy, round(mean_predicted - accuracy, 5) AS gap, contribution FROM u WHERE n > 0")
def agg06(t):
    got = calibration.reliability(t.ck, [], F.col("correct"), F.col("conf"), bin_of=lambda c: calibration.uneven_bin(c, _UNEVEN), bins=5, keep_empty=False)
    got = _bins(got, [])
    return got.select("bin", "n", "mean_predicted", "accuracy", r(F.col("mean_predicted") - F.col("accuracy"), "gap", 5), "contribution")


_NATURAL = f"g0 AS (SELECT subject, answer = gold AS y, confidence AS c FROM nat), g AS ({GROUPED.format('g0')}), rb AS ({reliability_sql('g', ['grouping', 'grp'])})"
_ECE = "SELECT {0}, CAST(sum(n) AS BIGINT) AS n, round(sum(contribution), 4) AS ece FROM rb GROUP BY {0}"


@query("ana02", f"{_NATURAL} SELECT * FROM rb")
def ana02(t):
    rows = rank.with_groups(t.nat)
    return _bins(calibration.reliability(rows, ["grouping", "grp"], F.col("correct"), F.col("confidence")), ["grouping", "grp"])


@query("ana02_ece", f"{_NATURAL}, e AS ({_ECE.format('grouping, grp')}) SELECT * FROM e UNION ALL SELECT 'macro', NULL, CAST(sum(n) AS BIGINT), CASE WHEN count(ece) = 5 THEN round(avg(ece), 4) END FROM e WHERE grouping = 'subject'")
def ana02_ece(t):
    e = calibration.ece(ana02(t), ["grouping", "grp"]).select("grouping", "grp", n("n", "n"), r("ece", "ece", 4))
    m = rank.macro(e.withColumn("k", F.lit(0)), ["k"], "ece", ["n"]).select("grouping", "grp", n("n", "n"), r("ece", "ece", 4))
    return e.unionByName(m)


_CHECK = f"g0 AS (SELECT idx, subject, correct AS y, u.predictor, CASE u.predictor WHEN 1 THEN conf ELSE least(1.0, ent / 5) END AS c FROM ck, (SELECT unnest([1, 2]) AS predictor) u), g AS ({GROUPED.format('g0')}), rb AS ({reliability_sql('g', ['idx', 'predictor', 'grouping', 'grp'])})"
_KEYS3 = ["idx", "predictor", "grouping", "grp"]


def _checkpoint_rows(t):
    rows = trajectory.calibration_slots(t.runs).select("subject", "idx", F.col("s.correct").alias("correct"), F.col("s.conf").alias("conf"), F.col("s.ent").alias("ent"))
    both = F.inline(F.array(F.struct(F.lit(1).alias("predictor"), F.col("conf").alias("c")), F.struct(F.lit(2).alias("predictor"), F.least(F.lit(1.0), F.col("ent") / 5).alias("c"))))
    return rank.with_groups(rows.select("subject", "idx", "correct", both))


@query("ana03", f"{_CHECK} SELECT * FROM rb")
def ana03(t):
    return _bins(calibration.reliability(_checkpoint_rows(t), _KEYS3, F.col("correct"), F.col("c")), _KEYS3)


@query("ana03_ece", f"{_CHECK} {_ECE.format('idx, predictor, grouping, grp')}")
def ana03_ece(t):
    got = calibration.ece(ana03(t), _KEYS3)
    return got.select(*_KEYS3, n("n", "n"), r("ece", "ece", 4))


_WITHIN = "wd AS (SELECT fx, subject, qid, avg(x) FILTER (correct) AS a, avg(x) FILTER (NOT correct) AS b FROM long WHERE correct IS NOT NULL AND x IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (correct) > 0 AND count(*) FILTER (NOT correct) > 0)"


@query("agg10", f"{_WITHIN} SELECT fx, count(*) AS questions, round(avg(a - b), 10) + 0 AS mean, round(median(a - b), 10) + 0 AS median FROM wd GROUP BY fx")
def agg10(t):
    d = stats.within_differences(t.long.where("x is not null"), ["fx", "subject", "qid"], "correct", "x")
    return d.groupBy("fx").agg(n(F.count(F.lit(1)), "questions"), r(F.avg("difference"), "mean"), r(F.percentile("difference", F.lit(0.5)), "median"))


@query("ana05", f"{_WITHIN} SELECT fx, subject, qid, round(a - b, 10) + 0 AS difference FROM wd")
def ana05(t):
    return stats.within_differences(t.long.where("x is not null"), ["fx", "subject", "qid"], "correct", "x").select("fx", "subject", "qid", r("difference", "difference"))


@query("agg11", "SELECT qid, idx, round(avg(ck.ent) FILTER (ev.correct), 10) AS right_mean, round(avg(ck.ent) FILTER (NOT ev.correct), 10) AS wrong_mean FROM ck JOIN ev USING (qid, run_id) WHERE qid IN (SELECT qid FROM ev GROUP BY qid HAVING bool_or(correct) AND bool_or(NOT correct)) GROUP BY qid, idx")
def agg11(t):
    mixed = t.ev.groupBy("qid").agg(F.bool_or("correct").alias("a"), F.bool_or(~F.col("correct")).alias("b")).where("a and b").select("qid")
    rows = t.ck.select("qid", "run_id", "idx", "ent").join(t.ev.select("qid", "run_id", "correct"), RUN).join(mixed, "qid", "left_semi")
    return rows.groupBy("qid", "idx").agg(r(F.avg(F.when(F.col("correct"), F.col("ent"))), "right_mean"), r(F.avg(F.when(~F.col("correct"), F.col("ent"))), "wrong_mean"))


_EVENTS = {
    "trajectory_count": "count(*)",
    "switch_count_available": "count(*) FILTER (transitions > 0)",
    "switch_count_unavailable": "count(*) FILTER (transitions = 0)",
    "switch_count_sum": "CAST(coalesce(sum(switches) FILTER (transitions > 0), 0) AS BIGINT)",
    "switch_count_mean": "round(avg(switches) FILTER (transitions > 0), 10)",
    "first_appearance_found": "count(*) FILTER (answer IS NOT NULL AND fa IS NOT NULL)",
    "first_appearance_not_found": "count(*) FILTER (answer IS NOT NULL AND fa IS NULL)",
    "first_appearance_unavailable": "count(*) FILTER (answer IS NULL)",
    "first_appearance_mean_fraction": "round(avg(fa), 10)",
    "left_correct_true": "count(left_at)",
    "left_correct_false": "count(*) FILTER (transitions > 0 AND left_at IS NULL)",
    "left_correct_unavailable": "count(*) FILTER (transitions = 0)",
    "later_recovery_true": "count(*) FILTER (rec)",
    "later_recovery_false": "count(*) FILTER (left_at IS NOT NULL AND NOT coalesce(rec, false))",
    "later_recovery_not_applicable": "count(*) FILTER (transitions > 0 AND left_at IS NULL)",
    "later_recovery_unavailable": "count(*) FILTER (transitions = 0)",
    "endpoint_agreement_true": "count(*) FILTER (agrees)",
    "endpoint_agreement_false": "count(*) FILTER (NOT agrees)",
    "endpoint_agreement_unavailable": "count(*) FILTER (agrees IS NULL)",
    "stabilization_computed": "count(stabilization)",
    "stabilization_unavailable": "count(*) FILTER (stabilization IS NULL)",
    "stabilization_mean_fraction": "round(avg(stabilization), 10)",
}
_FX = f"""ap AS (SELECT f.qid, f.run_id, min(idx) / CAST(10 AS DOUBLE) AS fa FROM f JOIN ck ON f.qid = ck.qid AND f.run_id = ck.run_id WHERE ck.ans = f.answer GROUP BY ALL),
re AS (SELECT f.qid, f.run_id, true AS rec FROM f JOIN ck ON f.qid = ck.qid AND f.run_id = ck.run_id WHERE NOT ck.alias AND ck.correct AND ck.idx > f.left_at GROUP BY ALL),
fx AS (SELECT f.*, fa, rec, f.answer = ends.ea AS agrees FROM f LEFT JOIN ap USING (qid, run_id) LEFT JOIN re USING (qid, run_id) LEFT JOIN ends USING (qid, run_id))"""


@query("agg12", f"{_FX}, g AS ({GROUPED.format('fx')}) SELECT grouping, grp, {', '.join(f'{v} AS {k}' for k, v in _EVENTS.items())} FROM g GROUP BY grouping, grp")
def agg12(t):
    """The 22 event counters and means, pooled and by subject."""
    c, x = F.count_if, F.col
    told, left = x("transitions") > 0, x("left_at").isNotNull()
    rows = rank.with_groups(t.features)
    return rows.groupBy("grouping", "grp").agg(
        F.count(F.lit(1)).alias("trajectory_count"),
        c(told).alias("switch_count_available"),
        c(~told).alias("switch_count_unavailable"),
        n(F.coalesce(F.sum(F.when(told, x("switches"))), F.lit(0)), "switch_count_sum"),
        r(F.avg(F.when(told, x("switches"))), "switch_count_mean"),
        c(x("appearance_status") == "found").alias("first_appearance_found"),
        c(x("appearance_status") == "not_found").alias("first_appearance_not_found"),
        c(x("appearance_status") == "unavailable").alias("first_appearance_unavailable"),
        r(F.avg("first_appearance"), "first_appearance_mean_fraction"),
        c(left).alias("left_correct_true"),
        c(told & ~left).alias("left_correct_false"),
        c(~told).alias("left_correct_unavailable"),
        c(x("recovered")).alias("later_recovery_true"),
        c((x("recovery_status") == "evaluated") & ~x("recovered")).alias("later_recovery_false"),
        c(told & (x("recovery_status") == "not_applicable")).alias("later_recovery_not_applicable"),
        c(~told).alias("later_recovery_unavailable"),
        c(x("endpoint_agrees")).alias("endpoint_agreement_true"),
        c(~x("endpoint_agrees")).alias("endpoint_agreement_false"),
        c(x("endpoint_agrees").isNull()).alias("endpoint_agreement_unavailable"),
        F.count("stabilization").alias("stabilization_computed"),
        c(x("stabilization").isNull()).alias("stabilization_unavailable"),
        r(F.avg("stabilization"), "stabilization_mean_fraction"),
    )


@query("win01", "SELECT qid, run_id, CAST(switches AS BIGINT) AS switches, CAST(transitions AS BIGINT) AS transitions FROM f")
def win01(t):
    return t.features.select("qid", "run_id", "switches", "transitions")


@query("win02", f"{_FX} SELECT qid, run_id, left_at IS NOT NULL AS left_correct, CASE WHEN left_at IS NOT NULL THEN coalesce(rec, false) END AS later_recovered FROM fx")
def win02(t):
    return t.features.select("qid", "run_id", F.col("left_at").isNotNull().alias("left_correct"), F.when(F.col("left_at").isNotNull(), F.col("recovered")).alias("later_recovered"))


@query("win03", f"{_FX} SELECT qid, run_id, fa AS first_appearance, CASE WHEN answer IS NULL THEN 'unavailable' WHEN fa IS NULL THEN 'not_found' ELSE 'found' END AS status FROM fx")
def win03(t):
    return t.features.select("qid", "run_id", "first_appearance", F.col("appearance_status").alias("status"))


@query("win04", "SELECT qid, run_id, stabilization FROM f")
def win04(t):
    return t.features.select("qid", "run_id", "stabilization")


@query("win05", "SELECT n.qid, n.run_id, CASE WHEN n.answer IS NULL THEN 'natural_answer_invalid_or_missing' END AS reason, CASE WHEN n.answer IS NOT NULL THEN c.ans = n.answer END AS agrees FROM nat n LEFT JOIN ck c ON c.qid = n.qid AND c.run_id = n.run_id AND c.idx = 10")
def win05(t):
    return t.features.select("qid", "run_id", F.col("endpoint_reason").alias("reason"), F.col("endpoint_agrees").alias("agrees"))


_LAG = "lg AS (SELECT *, lag(ans) OVER w AS pa, row_number() OVER w AS rn FROM ck WINDOW w AS (PARTITION BY qid, run_id ORDER BY idx))"


@query("win06", f"{_LAG} SELECT qid, run_id, max(idx) FILTER (rn = 1 OR ans IS DISTINCT FROM pa) AS commit_at, count(*) FILTER (rn > 1 AND ans IS DISTINCT FROM pa) AS flips FROM lg GROUP BY qid, run_id")
def win06(t):
    got = t.runs.withColumn("c", trajectory.commit_and_flips())
    return got.select("qid", "run_id", F.col("c.commit_at").alias("commit_at"), F.col("c.flips").alias("flips"))


@query("win09", "SELECT qid, run_id, " + ", ".join(f"max(conf) FILTER (idx = {i}) AS f{i}" for i in range(11)) + " FROM ck GROUP BY qid, run_id")
def win09(t):
    """A wide matrix of runs by fractions; missing checkpoints are null."""
    wide = t.ck.groupBy("qid", "run_id").pivot("idx", list(range(11))).agg(F.max("conf"))
    return wide.select("qid", "run_id", *[F.col(str(i)).alias(f"f{i}") for i in range(11)])


@query("win10", "SELECT user_id AS qid, max(pos) + 1 AS next_sequence, max_by(event_type, pos) AS last_type, max(pos) FILTER (event_type = 'error') AS last_failure FROM o GROUP BY user_id")
def win10(t):
    """The next sequence number of each question's log, its last event and its last failure."""
    seq = F.col("run_id") * 11 + F.col("idx")
    return t.ck.groupBy("qid").agg(n(F.max(seq) + 1, "next_sequence"), F.max_by("event_type", seq).alias("last_type"), n(F.max(F.when(F.col("event_type") == "error", seq)), "last_failure"))


_TRACE = "tk AS (SELECT vec_id, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, unnest(range(1, 65)) AS u(i))"


@query("win07", f"{_TRACE} SELECT vec_id, i, round(avg(v) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING), 10) AS smooth FROM tk")
def win07(t):
    """Centred means of 25 points, fewer at the ends."""
    from pyspark.sql import Window

    rows = t.read("embeddings", "vec_id", "embedding").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    w = Window.partitionBy("vec_id").orderBy("i").rowsBetween(-12, 12)
    return rows.select("vec_id", n("i", "i"), r(F.avg(F.col("v").cast("double")).over(w), "smooth"))


@query(
    "win08",
    r"wl AS (SELECT doc_id, i - 1 AS i, len(w[i]) / CAST(20 AS DOUBLE) AS v FROM (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents), unnest(range(1, len(w) + 1)) AS u(i)), m AS (SELECT doc_id, i, count(*) OVER w AS c, avg(v) OVER w AS a FROM wl WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 127 PRECEDING AND CURRENT ROW)) SELECT doc_id, i, round(a, 10) AS smooth FROM m WHERE c = 128",
)
def win08(t):
    """Means of 128 points in a row, full windows only, over traces of thousands of points (word lengths, twentieths)."""
    from pyspark.sql import Window

    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    traces = t.read("documents", "doc_id", "text").select("doc_id", F.transform(words, lambda w: F.length(w) / F.lit(20.0)).alias("a")).where("size(a) >= 128")
    rows = traces.select("doc_id", F.posexplode("a").alias("i", "v"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(-127, 0)
    return rows.select("doc_id", n("i", "i"), r(F.avg("v").over(w), "smooth")).where("i >= 127")


@query("fn25", "SELECT r.qid, r.run_id, i AS idx, CASE WHEN c.qid IS NULL THEN 'missing' ELSE 'eligible' END AS eligibility, CASE WHEN c.qid IS NULL THEN 'checkpoint_missing' WHEN c.correct IS NULL THEN 'checkpoint_local_correctness_unavailable' END AS reason, CASE WHEN c.correct IS NOT NULL THEN conf END AS confidence_used FROM nat r CROSS JOIN (SELECT CAST(unnest(range(11)) AS INT) AS i) LEFT JOIN ck c ON c.qid = r.qid AND c.run_id = r.run_id AND c.idx = i")
def fn25(t):
    return trajectory.calibration_slots(t.runs).select("qid", "run_id", "idx", "eligibility", "reason", "confidence_used")


@query("fn26", "SELECT qid, run_id, fx, round(x, 10) + 0 AS x FROM long")
def fn26(t):
    """The eleven features of each run."""
    return t.long.select("qid", "run_id", "fx", r("x", "x"))


@query("jn01", "SELECT n.qid, n.run_id, count(c.idx) AS present, 11 - count(c.idx) AS missing, string_agg(coalesce(c.ans, '-'), '' ORDER BY i) AS answers FROM nat n CROSS JOIN (SELECT unnest(range(11)) AS i) LEFT JOIN ck c ON c.qid = n.qid AND c.run_id = n.run_id AND c.idx = i GROUP BY n.qid, n.run_id")
def jn01(t):
    """Runs joined to their checkpoints by the parent's identifier, as eleven ordered slots; a checkpoint without a run is an error."""
    name = F.concat_ws("-", F.lit("run"), F.col("qid").cast("string"), F.col("run_id").cast("string"))
    checkpoints = t.ck.select(name.alias("parent_id"), "idx", "ans")
    runs = trajectory.attached(t.nat.withColumn("record_id", name), checkpoints, "record_id", "parent_id", "idx", ["ans"])
    present = F.size(F.filter("slots", lambda s: s.isNotNull()))
    return runs.select("qid", "run_id", n(present, "present"), n(F.lit(11) - present, "missing"), F.array_join(F.transform("slots", lambda s: F.coalesce(s["ans"], F.lit("-"))), "").alias("answers"))
