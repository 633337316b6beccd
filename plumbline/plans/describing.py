"""Descriptive tables, regressions and figure analyses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import scalars
from plumbline.operators import rank, stats
from plumbline.plans.domain import RUN
from plumbline.plans.registry import auroc_sql, n, query, r


@query("agg13", "SELECT ev.correct, idx, round(avg(ck.ent), 10) AS mean FROM ck JOIN ev USING (qid, run_id) GROUP BY ev.correct, idx")
def agg13(t):
    return _verdicts(t).groupBy("correct", "idx").agg(r(F.avg("ent"), "mean"))


def _verdicts(t):
    """Checkpoints with the verdict of their run."""
    return t.ck.select(*RUN, "subject", "idx", "ent", "conf", "k_keep", "ans").join(t.ev.select(*RUN, "correct"), RUN)


@query("agg13_gap", "m AS (SELECT idx, avg(ck.ent) FILTER (ev.correct) AS a, avg(ck.ent) FILTER (NOT ev.correct) AS b FROM ck JOIN ev USING (qid, run_id) GROUP BY idx) SELECT idx, round(a, 10) AS right_mean, round(b, 10) AS wrong_mean, round(b - a, 10) AS gap FROM m")
def agg13_gap(t):
    wide = _verdicts(t).groupBy("idx").pivot("correct", [True, False]).agg(F.avg("ent"))
    return wide.select("idx", r("true", "right_mean"), r("false", "wrong_mean"), r(F.col("false") - F.col("true"), "gap"))


@query("agg14", "SELECT ev.correct, round(avg(ck.ent) FILTER (idx = 10) - avg(ck.ent) FILTER (idx = 0), 10) + 0 AS change FROM ck JOIN ev USING (qid, run_id) GROUP BY ev.correct")
def agg14(t):
    """Change between two fractions as a difference of separate means."""
    return _verdicts(t).groupBy("correct").agg(r(F.avg(F.when(F.col("idx") == 10, F.col("ent"))) - F.avg(F.when(F.col("idx") == 0, F.col("ent"))), "change"))


@query("agg15", "SELECT correct, count(*) AS n, round(median(confidence), 10) AS median, round(avg(CAST(confidence >= 0.9 AS INT)), 10) AS share_90, round(avg(CAST(confidence >= 0.99 AS INT)), 10) AS share_99, round(avg(CAST(h_tail < 0.1 AS INT)), 10) AS low_entropy FROM ev GROUP BY correct")
def agg15(t):
    share = lambda c: F.avg(c.cast("int"))
    c = F.col("confidence")
    return t.ev.groupBy("correct").agg(F.count(F.lit(1)).alias("n"), r(F.percentile(c, F.lit(0.5)), "median"), r(share(c >= 0.9), "share_90"), r(share(c >= 0.99), "share_99"), r(share(F.col("h_tail") < 0.1), "low_entropy"))


_TABLE1 = """q AS (SELECT subject, qid, count(*) AS k, count(*) FILTER (correct) AS c FROM ev GROUP BY ALL),
a AS (SELECT subject, count(*) AS runs FROM nat GROUP BY subject),
s AS (SELECT subject, sum(k) AS k, sum(c) AS c, count(*) FILTER (c > 0 AND c < k) AS mixed FROM q GROUP BY subject),
j AS (SELECT subject, runs, k, c, mixed FROM s JOIN a USING (subject)), w AS (SELECT * FROM j UNION ALL SELECT 'Total', sum(runs), sum(k), sum(c), sum(mixed) FROM j)"""


def _table1(t):
    q = t.nat.groupBy("subject", "qid").agg(F.count(F.lit(1)).alias("runs"), F.count("correct").alias("k"), F.count_if("correct").alias("c"))
    rolled = q.rollup("subject").agg(F.sum("runs").alias("runs"), F.sum("k").alias("k"), F.sum("c").alias("c"), F.count_if((F.col("c") > 0) & (F.col("c") < F.col("k"))).alias("mixed"))
    return rolled.withColumn("subject", F.coalesce("subject", F.lit("Total")))


@query("agg16", f"{_TABLE1} SELECT subject, CAST(k AS BIGINT) AS evaluable, CAST(c AS BIGINT) AS right_runs, CAST(k - c AS BIGINT) AS wrong_runs, round(100.0::DOUBLE * k / runs, 10) AS evaluable_percent, round(100.0::DOUBLE * c / k, 10) AS accuracy, CAST(mixed AS BIGINT) AS mixed FROM w")
def agg16(t):
    got = _table1(t)
    return got.select("subject", n("k", "evaluable"), n("c", "right_runs"), n(F.col("k") - F.col("c"), "wrong_runs"), r(100.0 * F.col("k") / F.col("runs"), "evaluable_percent"), r(100.0 * F.col("c") / F.col("k"), "accuracy"), n("mixed", "mixed"))


@query("ana13", f"{_TABLE1} SELECT subject, format('{{}} ({{:.1f}}%)', CAST(k AS BIGINT), 100.0::DOUBLE * k / runs) AS evaluable, format('{{}} / {{}}', CAST(c AS BIGINT), CAST(k - c AS BIGINT)) AS outcomes, CAST(mixed AS BIGINT) AS mixed FROM w")
def ana13(t):
    """The cohort table as it is printed."""
    got = _table1(t)
    return got.select("subject", F.format_string("%d (%.1f%%)", "k", 100.0 * F.col("k") / F.col("runs")).alias("evaluable"), F.format_string("%d / %d", "c", F.col("k") - F.col("c")).alias("outcomes"), n("mixed", "mixed"))


_DESC = "count({0}) AS n, round(avg({0}), 10) AS mean, round(median({0}), 10) AS median, round(stddev_samp({0}), 10) AS sd, round(quantile_cont({0}, 0.25), 10) AS q1, round(quantile_cont({0}, 0.75), 10) AS q3, round(quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25), 10) AS iqr, min({0}) AS min, max({0}) AS max, round(skewness({0}), 8) AS skew"


@query("agg17", f"SELECT subject, {_DESC.format('h_mean')} FROM nat GROUP BY subject".replace("min(h_mean) AS min, max(h_mean) AS max", "round(min(h_mean), 10) AS min, round(max(h_mean), 10) AS max"))
def agg17(t):
    got = stats.describe(t.nat, ["subject"], "h_mean")
    return got.select("subject", "n", *[r(c, c) for c in ("mean", "median", "sd", "q1", "q3", "iqr", "min", "max")], r("skew", "skew", 8))


@query("agg18", "SELECT subject, round(median(h_mean) FILTER (correct) - median(h_mean) FILTER (NOT correct), 10) AS difference FROM ev GROUP BY subject")
def agg18(t):
    """Median of right minus median of wrong runs."""
    medians = rank.percentiles(t.ev, ["subject", "correct"], "h_mean", {"median": 0.5})
    of = lambda c: F.max(F.when(c, F.col("median")))
    return medians.groupBy("subject").agg(r(of(F.col("correct")) - of(~F.col("correct")), "difference"))


@query("agg23", "SELECT round(regr_intercept(h_mean, n_think), 8) AS intercept, round(regr_slope(h_mean, n_think), 8) AS slope, round(regr_r2(h_mean, n_think), 8) AS r2 FROM nat")
def agg23(t):
    beta, r2 = stats.ols(t.nat, [F.lit(1.0), F.col("n_think")], F.col("h_mean"))
    row = t.spark.range(1)
    return row.select(r(F.lit(float(beta[0])), "intercept", 8), r(F.lit(float(beta[1])), "slope", 8), r(F.lit(r2), "r2", 8))


def _dummies(column, levels):
    return [(F.col(column) == x).cast("double") for x in levels[1:]]


_EACH = f"""se AS (SELECT subject, list_position([{', '.join(repr(x) for x in scalars.SUBJECTS)}], subject) - 1 AS s, regr_intercept(h_mean, n_think) AS a, regr_slope(h_mean, n_think) AS b, count(*) * (var_pop(h_mean) - covar_pop(h_mean, n_think) * covar_pop(h_mean, n_think) / var_pop(n_think)) AS sse FROM nat GROUP BY subject),
fit AS (SELECT 1 - sum(sse) / (SELECT count(*) * var_pop(h_mean) FROM nat) AS r2, max(a) FILTER (s = 0) AS a0, max(b) FILTER (s = 0) AS b0 FROM se)"""


@query("agg23_dummies", f"{_EACH} SELECT CAST(term AS INT) AS term, round(beta, 6) + 0 AS beta, round(r2, 6) AS r2 FROM (SELECT 0 AS term, a0 AS beta FROM fit UNION ALL SELECT 1, b0 FROM fit UNION ALL SELECT 1 + s, a - a0 FROM se, fit WHERE s > 0 UNION ALL SELECT 5 + s, b - b0 FROM se, fit WHERE s > 0), fit")
def agg23_dummies(t):
    """Least squares with subject dummies and their interaction with length."""
    d = _dummies("subject", scalars.SUBJECTS)
    terms = [F.lit(1.0), F.col("n_think"), *d, *[x * F.col("n_think") for x in d]]
    beta, r2 = stats.ols(t.nat, terms, F.col("h_mean"))
    rows = t.spark.createDataFrame([(i, float(b), float(r2)) for i, b in enumerate(beta)], "term int, beta double, r2 double")
    return rows.select("term", r("beta", "beta", 6), r("r2", "r2", 6))


_RES = "rs AS (SELECT correct AS y, h_mean - (SELECT regr_intercept(h_mean, n_think) FROM ev) - (SELECT regr_slope(h_mean, n_think) FROM ev) * n_think AS x FROM ev)"


@query("agg24", f"{_RES}, k AS (SELECT y, round(x, 9) + 0 AS x FROM rs) {auroc_sql('k', '')}".replace(", 10) END AS auroc", ", 8) END AS auroc"))
def agg24(t):
    """Area of what a linear fit on length leaves of entropy."""
    rows = stats.residual(t.ev, [F.lit(1.0), F.col("n_think")], "h_mean", "left")
    got = rank.auroc(rows.withColumn("left", F.round("left", 9) + 0.0), [], "correct", "left")
    return got.select("positives", "negatives", r("auroc", "auroc", 8))


@query("agg25")
def agg25(t):
    """Logistic regression of the verdict on entropy and length by Newton steps."""
    beta = stats.logistic(t.ev, [F.lit(1.0), F.col("h_mean"), F.col("n_think") / 10], F.col("correct").cast("double"))
    return t.spark.createDataFrame([(i, round(float(b), 6)) for i, b in enumerate(beta)], "term int, beta double")


@query("agg27", "SELECT subject, count(*) AS n, round(avg(h_tail), 10) AS mean, round(median(h_tail), 10) AS median, round(quantile_cont(h_tail, 0.25), 10) AS q25, round(quantile_cont(h_tail, 0.75), 10) AS q75, round(avg(CAST(h_tail <= 0.05 AS INT)), 10) AS near_zero FROM nat GROUP BY subject")
def agg27(t):
    sums = t.nat.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.avg("h_tail").alias("mean"), F.avg((F.col("h_tail") <= 0.05).cast("int")).alias("near_zero"))
    got = sums.join(rank.percentiles(t.nat, ["subject"], "h_tail", {"median": 0.5, "q25": 0.25, "q75": 0.75}), "subject")
    return got.select("subject", "n", *[r(c, c) for c in ("mean", "median", "q25", "q75", "near_zero")])


@query("agg28", "SELECT idx, count(DISTINCT qid) AS questions, round(avg(ent), 10) AS mean, round(median(ent), 10) AS median, round(avg(CAST(correct AS INT)), 10) AS accuracy FROM ck GROUP BY idx")
def agg28(t):
    sums = t.ck.groupBy("idx").agg(F.countDistinct("qid").alias("questions"), r(F.avg("ent"), "mean"), r(F.avg(F.col("correct").cast("int")), "accuracy"))
    return sums.join(rank.percentiles(t.ck, ["idx"], "ent", {"median": 0.5}).select("idx", r("median", "median")), "idx")


@query("agg29", "m AS (SELECT idx, avg(ck.ent) FILTER (ev.correct) - avg(ck.ent) FILTER (NOT ev.correct) AS gap FROM ck JOIN ev USING (qid, run_id) GROUP BY idx) SELECT round(max(gap), 10) AS gap, max_by(idx, gap) AS idx FROM m")
def agg29(t):
    """Where the gap between right and wrong runs is widest."""
    wide = _verdicts(t).groupBy("idx").pivot("correct", [True, False]).agg(F.avg("ent")).withColumn("gap", F.col("true") - F.col("false"))
    return wide.agg(r(F.max("gap"), "gap"), F.max_by("idx", "gap").alias("idx"))


_POS = "wl AS (SELECT doc_id, l.quality = 1 AS y, i - 1 AS k, len(w[i]) / CAST(20 AS DOUBLE) AS v FROM (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents) JOIN labels l USING (doc_id), unnest(range(1, len(w) + 1)) AS u(i)), pb AS (SELECT width, k // width AS bin, avg(v) FILTER (y) AS a, avg(v) FILTER (NOT y) AS b FROM wl, unnest([400, 100]) AS z(width) GROUP BY ALL)"


def _word_traces(t):
    """Traces of thousands of points: the lengths of a document's words, twentieths."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return t.read("documents", "doc_id", "text").select("doc_id", F.transform(words, lambda w: F.length(w) / F.lit(20.0)).alias("a"))


@query("agg30", f"{_POS} SELECT CAST(width AS INT) AS width, count(*) AS bins, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS both_bins, count(*) FILTER (a < b) AS lower_bins FROM pb GROUP BY width")
def agg30(t):
    """Bins of 400 and of 100 positions: in how many of those that have both are right traces the lower ones."""
    rows = _word_traces(t).join(t.read("labels", "doc_id", "quality").withColumn("y", F.col("quality") == 1), "doc_id")
    # Summed in the row first: a row for each bin of a trace goes on, not one for each of its points.
    part = lambda width: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size("a") - 1) / width).cast("int"), F.lit(0))), lambda b: F.struct(F.lit(width).alias("width"), b.alias("bin"), scalars.total(F.slice("a", b * width + 1, F.lit(width))).alias("s"), F.least(F.lit(width), F.size("a") - b * width).alias("c")))
    each = rows.where(F.size("a") > 0).select("y", F.inline(F.concat(part(400), part(100))))
    mean = lambda y: F.sum(F.when(F.col("y") == y, F.col("s"))) / F.sum(F.when(F.col("y") == y, F.col("c")))
    got = each.groupBy("width", "bin").agg(F.round(mean(True), 12).alias("a"), F.round(mean(False), 12).alias("b"))
    return got.groupBy("width").agg(F.count(F.lit(1)).alias("bins"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both_bins"), F.count_if(F.col("a") < F.col("b")).alias("lower_bins"))


@query("agg31", "SELECT idx, count(*) AS n, count(ans) AS parsed, count(*) FILTER (ans IS NULL AND conf < 0.5) AS recovered, count(*) FILTER (ans IS NOT NULL OR conf < 0.5) AS usable, round(100.0::DOUBLE * count(*) FILTER (ans IS NOT NULL OR conf < 0.5) / count(*), 1) AS usable_percent FROM ck GROUP BY idx")
def agg31(t):
    parsed, saved = F.col("ans").isNotNull(), F.col("ans").isNull() & (F.col("conf") < 0.5)
    usable = F.count_if(parsed | saved)
    return t.ck.groupBy("idx").agg(F.count(F.lit(1)).alias("n"), F.count_if(parsed).alias("parsed"), F.count_if(saved).alias("recovered"), usable.alias("usable"), F.round(100.0 * usable / F.count(F.lit(1)), 1).alias("usable_percent"))


@query("agg32", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3", domain=False)
def agg32(t):
    """Value counts, the most frequent first; ties by value."""
    return t.read("events", "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("agg33", "d AS (SELECT DISTINCT subject, qid, n_think FROM nat) SELECT subject, count(*) AS n, round(avg(n_think), 10) AS mean, median(n_think) AS median, min(n_think) AS min, max(n_think) AS max FROM d GROUP BY subject")
def agg33(t):
    rows = t.nat.select("subject", "qid", "n_think").dropDuplicates(["subject", "qid"])
    return rows.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), r(F.avg("n_think"), "mean"), F.percentile("n_think", F.lit(0.5)).alias("median"), F.min("n_think").alias("min"), F.max("n_think").alias("max"))


_VEC = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS a FROM embeddings)"


def _vectors(t):
    return t.read("embeddings", "vec_id", "label", "embedding").select("vec_id", "label", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("a"))


@query("agg34", "wd AS (SELECT doc_id, list_transform(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), lambda x: len(x) / CAST(20 AS DOUBLE)) AS a FROM documents) SELECT doc_id, CAST(len(a) AS INT) AS n, round(list_avg(a[1:1024]), 10) AS head, round(list_avg(a[greatest(len(a) - 1023, 1):]), 10) AS tail, round(len(list_filter(a, lambda x: x < 0.1)) / CAST(len(a) AS DOUBLE), 10) AS low_share FROM wd WHERE len(a) > 0")
def agg34(t):
    """Means of a trace's first and last 1,024 points, and the share of low ones."""
    low = F.size(F.filter("a", lambda x: x < 0.1)) / F.size("a")
    last = F.least(F.lit(1024), F.size("a"))
    rows = _word_traces(t).where(F.size("a") > 0)
    return rows.select("doc_id", F.size("a").alias("n"), r(scalars.mean(F.slice("a", 1, 1024)), "head"), r(scalars.mean(F.slice("a", -last, last)), "tail"), r(low, "low_share"))


@query("agg35", "SELECT count(*) AS records, CAST(sum(strlen(props)) AS BIGINT) AS bytes, CAST(ceil(sum(strlen(props)) * 1.25) AS BIGINT) AS needed, CASE WHEN sum(strlen(props)) * 1.25 <= 100000000 THEN 'sufficient' ELSE 'insufficient' END AS free_space FROM events", domain=False)
def agg35(t):
    """Bytes of the stored records with a quarter to spare, against the space that is free."""
    size = F.sum(F.octet_length("props"))
    return t.read("events", "props").agg(F.count(F.lit(1)).alias("records"), n(size, "bytes"), n(F.ceil(size * 1.25), "needed"), F.when(size * 1.25 <= 100_000_000, "sufficient").otherwise("insufficient").alias("free_space"))


# -- traces -------------------------------------------------------------------------------


@query("fn01", "e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings), m AS (SELECT vec_id, list_transform(a, lambda x: x - list_max(a)) AS s FROM e), z AS (SELECT vec_id, s, list_sum(list_transform(s, lambda x: exp(x))) AS z FROM m) SELECT vec_id, round(ln(z) - list_sum(list_transform(s, lambda x: exp(x) * x)) / z, 10) AS entropy FROM z")
def fn01(t):
    rows = t.read("embeddings", "vec_id", "embedding").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    return rows.select("vec_id", r(scalars.entropy_of_logits(F.col("a")), "entropy"))


_STEPS = "st2 AS (SELECT vec_id, k, list_transform(embedding[k * 16 + 1:k * 16 + 16], lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings, unnest(range(4)) AS u(k)), p AS (SELECT vec_id, k, list_transform(a, lambda x: exp(x - list_max(a))) AS x FROM st2), pp AS (SELECT vec_id, k, list_transform(x, lambda y: y / list_sum(x)) AS p FROM p)"


@query("fn02", f"{_STEPS} SELECT vec_id, k AS step, round(-list_sum(list_transform(p, lambda y: y * ln(y))), 10) AS entropy FROM pp")
def fn02(t):
    """Entropies of the steps of a trace."""
    rows = t.read("embeddings", "vec_id", "embedding").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    steps = rows.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("a", k * 16 + 1, 16)).alias("s"))
    trace = steps.select("vec_id", F.posexplode("s").alias("step", "x"))
    return trace.select("vec_id", n("step", "step"), r(scalars.entropy(scalars.softmax(F.col("x"))), "entropy"))


_AD = "l4 AS (SELECT vec_id, [CAST(embedding[i] AS DOUBLE) FOR i IN [2, 3, 5, 8]] AS a FROM embeddings), x4 AS (SELECT vec_id, list_transform(a, lambda x: exp(x - list_max(a))) AS e FROM l4), p4 AS (SELECT vec_id, list_transform(e, lambda y: y / list_sum(e)) AS p FROM x4)"


def _four(t):
    """Probabilities over the four answer tokens: their logits are selected, then normalised."""
    ids = F.array(*[F.lit(i) for i in (1, 2, 4, 7)])
    rows = t.read("embeddings", "vec_id", "embedding").withColumn("ids", ids)
    return rows.select("vec_id", scalars.softmax(F.transform("ids", lambda i: F.get("embedding", i).cast("double"))).alias("p"))


@query("fn03", f"{_AD} SELECT vec_id, round(-list_sum(list_transform(p, lambda y: y * ln(y))), 10) AS entropy, round(list_max(p), 10) AS most FROM p4")
def fn03(t):
    return _four(t).select("vec_id", r(scalars.entropy(F.col("p")), "entropy"), r(F.array_max("p"), "most"))


@query("fn04", f"{_VEC} SELECT vec_id, round(list_avg(a), 10) AS mean, round(list_avg(a[58:64]), 10) AS tail, CAST(len(a) AS BIGINT) AS count FROM v")
def fn04(t):
    """Mean and tail mean (the last tenth, one at least) of a trace."""
    return _vectors(t).select("vec_id", r(scalars.mean(F.col("a")), "mean"), r(scalars.tail_mean(F.col("a")), "tail"), n(F.size("a"), "count"))


@query("fn17", f"{_VEC} SELECT vec_id, len(a[(vec_id % 10) + 1:(vec_id % 10) + 20]) AS kept, round(list_sum(a[(vec_id % 10) + 1:(vec_id % 10) + 20]), 10) AS total FROM v")
def fn17(t):
    """The slice of a trace that boundaries in JSON name; null without them."""
    rows = _vectors(t).withColumn("b", F.to_json(F.struct((F.col("vec_id") % 10).alias("generated_start"), (F.col("vec_id") % 10 + 20).alias("generated_end_exclusive"))))
    rows = rows.withColumn("b", F.from_json("b", "generated_start int, generated_end_exclusive int"))
    part = F.when(F.col("b.generated_start").isNotNull(), F.slice("a", F.col("b.generated_start") + 1, F.col("b.generated_end_exclusive") - F.col("b.generated_start")))
    return rows.select("vec_id", n(F.size(part), "kept"), r(scalars.total(part), "total"))


@query("fn18", "tk AS (SELECT vec_id, i - 1 AS i, abs(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, unnest(range(1, 65)) AS u(i)) SELECT vec_id, least(i * 10 // 64, 9) AS bin, round(avg(v), 10) AS mean FROM tk GROUP BY ALL")
def fn18(t):
    return _vectors(t).select("vec_id", F.posexplode(scalars.tenths_means(F.col("a"))).alias("bin", "m")).select("vec_id", n("bin", "bin"), r("m", "mean"))


@query("fn19", "b AS (SELECT j, CAST(floor(j * 64 / 20.0::DOUBLE) AS INT) AS lo, CAST(floor((j + 1) * 64 / 20.0::DOUBLE) AS INT) AS hi FROM unnest(range(20)) AS u(j)), v AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS a FROM embeddings) SELECT vec_id, j AS bin, round(list_avg(a[lo + 1:hi]), 10) AS mean FROM v, b")
def fn19(t):
    return _vectors(t).select("vec_id", F.posexplode(scalars.profile_means(F.col("a"))).alias("bin", "m")).select("vec_id", n("bin", "bin"), r("m", "mean"))


@query("fn20", f"{_VEC} SELECT vec_id, CAST(i AS BIGINT) AS idx, CASE WHEN round_even(i / 10::DOUBLE * 64, 0) >= 1 THEN round(list_avg(a[1:CAST(round_even(i / 10::DOUBLE * 64, 0) AS INT)]), 10) END AS mean FROM v, unnest(range(11)) AS u(i)")
def fn20(t):
    kept = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: scalars.placement(i, F.size("a")))
    return _vectors(t).select("vec_id", F.posexplode(scalars.prefix_means(F.col("a"), kept)).alias("idx", "m")).select("vec_id", n("idx", "idx"), r("m", "mean"))


@query("fn21", f"{_AD} SELECT vec_id, round(p[vec_id % 4 + 1], 10) AS p FROM p4")
def fn21(t):
    letter = F.substr(F.lit("ABCD"), (F.col("vec_id") % 4).cast("int") + 1, F.lit(1))
    return _four(t).select("vec_id", r(scalars.letter_probability(F.col("p"), letter), "p"))


@query("fn23", f"{_VEC} SELECT count(*) AS pairs, count(*) FILTER (vec_id % 3 <> 0) AS close FROM v")
def fn23(t):
    """Traces that agree within a tolerance, value by value."""
    rows = _vectors(t).withColumn("b", F.transform("a", lambda x: x + F.when(F.col("vec_id") % 3 == 0, 1e-3).otherwise(1e-9)))
    return rows.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(scalars.close_arrays(F.col("a"), F.col("b"), 1e-6)).alias("close"))


@query("fn27", "SELECT doc_id, round(ln(n_chars), 10) AS log_chars, CAST(lang = 'en' AS DOUBLE) AS en, CAST(lang = 'de' AS DOUBLE) AS de FROM documents", domain=False)
def fn27(t):
    return t.read("documents", "doc_id", "n_chars", "lang").select("doc_id", r(F.ln("n_chars"), "log_chars"), (F.col("lang") == "en").cast("double").alias("en"), (F.col("lang") == "de").cast("double").alias("de"))


# -- figures ------------------------------------------------------------------------------


@query("ana07", "SELECT idx, round(avg(ent), 10) AS entropy, round(avg(conf), 10) AS confidence, count(*) AS n FROM ck JOIN (SELECT qid, run_id FROM ev) USING (qid, run_id) GROUP BY idx")
def ana07(t):
    """Evolution of the signals over the fractions of evaluable runs."""
    return _verdicts(t).groupBy("idx").agg(r(F.avg("ent"), "entropy"), r(F.avg("conf"), "confidence"), F.count(F.lit(1)).alias("n"))


_PRE = "pf AS (SELECT qid, run_id, idx, avg(ent) OVER (PARTITION BY qid, run_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS prefix, ent, conf FROM ck), ct AS (SELECT ev.correct AS y, idx, s AS signal, round(CASE s WHEN 1 THEN -prefix WHEN 2 THEN -pf.ent ELSE pf.conf END, 10) AS x FROM pf JOIN ev USING (qid, run_id), unnest([1, 2, 3]) AS u(s))"


@query("ana08", f"{_PRE} {auroc_sql('ct', 'signal, idx')}")
def ana08(t):
    """Areas of three signals at each fraction."""
    prefix = F.avg("ent").over(Window.partitionBy(*RUN).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    rows = t.ck.select(*RUN, "idx", "ent", "conf").withColumn("prefix", prefix).join(t.ev.select(*RUN, "correct"), RUN)
    x = lambda i, c: F.struct(F.lit(i).alias("signal"), F.round(c, 10).alias("x"))
    rows = rows.select("correct", "idx", F.inline(F.array(x(1, -F.col("prefix")), x(2, -F.col("ent")), x(3, F.col("conf")))))
    return rank.auroc(rows, ["signal", "idx"], "correct", "x").select("signal", "idx", "positives", "negatives", r("auroc", "auroc"))


@query("ana09", "tk AS (SELECT label % 2 = 1 AS y, least((i - 1) * 10 // 64, 9) AS bin, abs(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, unnest(range(1, 65)) AS u(i)) SELECT bin, round(avg(v) FILTER (y), 10) AS right_mean, round(avg(v) FILTER (NOT y), 10) AS wrong_mean, round(avg(v) FILTER (NOT y) - avg(v) FILTER (y), 9) + 0 AS gap FROM tk GROUP BY bin")
def ana09(t):
    """Profiles by outcome and their gap; bins of unequal size weigh their values alike."""
    rows = t.read("embeddings", "label", "embedding").select((F.col("label") % 2 == 1).alias("y"), F.posexplode("embedding").alias("i", "v"))
    rows = rows.select("y", F.least(F.floor(F.col("i") * 10 / 64), F.lit(9)).cast("bigint").alias("bin"), F.abs(F.col("v").cast("double")).alias("v"))
    a, b = F.avg(F.when(F.col("y"), F.col("v"))), F.avg(F.when(~F.col("y"), F.col("v")))
    return rows.groupBy("bin").agg(r(a, "right_mean"), r(b, "wrong_mean"), r(b - a, "gap", 9))


_FOREST = "fr AS (SELECT correct AS y, s AS signal, CASE s WHEN 'length' THEN CAST(-n_think AS DOUBLE) WHEN 'entropy' THEN -h_mean WHEN 'tail' THEN -h_tail ELSE confidence END AS x FROM ev, unnest(['length', 'entropy', 'tail', 'confidence']) AS u(s)), ar AS (" + auroc_sql("fr", "signal") + ")"


@query("ana10", f"{_FOREST} SELECT signal, positives, negatives, auroc, round(auroc - (SELECT auroc FROM ar WHERE signal = 'length'), 9) + 0 AS over_length FROM ar")
def ana10(t):
    """Areas of the signals and what they add to length alone."""
    rows = t.ev.select("correct", (-F.col("n_think")).cast("double").alias("length"), (-F.col("h_mean")).alias("entropy"), (-F.col("h_tail")).alias("tail"), "confidence")
    names = ["length", "entropy", "tail", "confidence"]
    long = rows.select("correct", F.inline(F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).alias("x")) for c in names])))
    ar = rank.auroc(long, ["signal"], "correct", "x").withColumn("auroc", F.round("auroc", 10))
    ref = ar.where("signal = 'length'").select(F.col("auroc").alias("ref"))
    return ar.join(F.broadcast(ref)).select("signal", "positives", "negatives", r("auroc", "auroc"), r(F.col("auroc") - F.col("ref"), "over_length", 9))


@query("ana11", "m AS (SELECT idx, avg(ck.ent) FILTER (ev.correct) AS a, avg(ck.ent) FILTER (NOT ev.correct) AS b FROM ck JOIN ev USING (qid, run_id) GROUP BY idx) SELECT round(max(a) - min(a), 10) AS right_range, round(max(b) - min(b), 10) AS wrong_range, min_by(idx, a) AS right_lowest, min_by(idx, b) AS wrong_lowest, round(max(a) FILTER (idx = 10) - max(a) FILTER (idx = 0), 9) + 0 AS right_change FROM m")
def ana11(t):
    """Shape of the entropy curves by outcome."""
    m = _verdicts(t).groupBy("idx").pivot("correct", [True, False]).agg(F.avg("ent")).withColumnsRenamed({"true": "a", "false": "b"})
    at = lambda i: F.max(F.when(F.col("idx") == i, F.col("a")))
    return m.agg(r(F.max("a") - F.min("a"), "right_range"), r(F.max("b") - F.min("b"), "wrong_range"), F.min_by("idx", "a").alias("right_lowest"), F.min_by("idx", "b").alias("wrong_lowest"), r(at(10) - at(0), "right_change", 9))


@query("ana15", "SELECT n_ck = 11 AS closed, correct, count(*) AS n, round(avg(h_mean), 10) AS mean, round(avg(n_think), 10) AS length FROM (SELECT *, answer = gold AS correct FROM nat) GROUP BY ALL")
def ana15(t):
    """The pilot's cohort tables: closed and truncated runs by outcome."""
    return t.nat.groupBy((F.col("n_ck") == 11).alias("closed"), "correct").agg(F.count(F.lit(1)).alias("n"), r(F.avg("h_mean"), "mean"), r(F.avg("n_think"), "length"))


@query("ana16", "SELECT 'entropy' AS series, idx AS x, round(avg(ent), 10) AS y FROM ck GROUP BY idx UNION ALL SELECT 'accuracy', idx, round(avg(CAST(correct AS INT)), 10) FROM ck GROUP BY idx UNION ALL SELECT 'switches', CAST(switches AS INT), CAST(count(*) AS DOUBLE) FROM f GROUP BY switches")
def ana16(t):
    """Series for plots."""
    a = t.ck.groupBy(F.col("idx").alias("x")).agg(r(F.avg("ent"), "y")).select(F.lit("entropy").alias("series"), "x", "y")
    b = t.ck.groupBy(F.col("idx").alias("x")).agg(r(F.avg(F.col("correct").cast("int")), "y")).select(F.lit("accuracy").alias("series"), "x", "y")
    c = t.features.groupBy(F.col("switches").cast("int").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("y")).select(F.lit("switches").alias("series"), "x", "y")
    return a.unionByName(b).unionByName(c)
