"""The domain's tables as views of the given event table, for Spark and (as SQL) for DuckDB.

A user's events in time order, eleven at a time, are the checkpoints of a run; the user is the
question, and its remainder modulo five the subject. The event type is the answer, the value
the confidence. Runs that end early lack checkpoints, one event type is no valid answer, and
short reasoning makes aliases, so all cases of the operators occur.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import SUBJECTS, placement
from plumbline.operators import trajectory

#: Features in their fixed order.
FEATURES = [
    "negative_mean_reasoning_entropy",
    "negative_tail_reasoning_entropy",
    "negative_answer_entropy_fraction_0.0",
    "negative_answer_entropy_fraction_0.5",
    "negative_answer_entropy_fraction_1.0",
    "natural_verbalized_confidence",
    "maximum_ad_probability_fraction_0.0",
    "maximum_ad_probability_fraction_0.5",
    "maximum_ad_probability_fraction_1.0",
    "negative_answer_switch_count",
    "negative_stabilization_fraction",
]
RUN = ["qid", "run_id"]

_SUBJECT_LIST = ", ".join(f"'{s}'" for s in SUBJECTS)
DOMAIN_SQL = f"""
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
ck0 AS (SELECT event_id, ts, event_type, user_id AS qid, [{_SUBJECT_LIST}][CAST(user_id % 5 AS INT) + 1] AS subject, CAST(pos // 11 AS BIGINT) AS run_id, CAST(pos % 11 AS INT) AS idx,
  CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'B' WHEN 'purchase' THEN 'C' WHEN 'signup' THEN 'D' END AS ans,
  value / 500.0 AS conf, value / 100.0 AS ent, substr('ABCD', CAST(user_id % 4 AS INT) + 1, 1) AS gold, CAST(user_id % 25 AS BIGINT) AS n_think FROM o),
ck AS (SELECT *, CAST(round_even(idx / CAST(10 AS DOUBLE) * n_think, 0) AS BIGINT) AS k_keep,
  idx > 0 AND round_even(idx / CAST(10 AS DOUBLE) * n_think, 0) = round_even((idx - 1) / CAST(10 AS DOUBLE) * n_think, 0) AS alias, ans = gold AS correct FROM ck0),
nat AS (SELECT qid, subject, run_id, n_think, gold, count(*) AS n_ck, max(ans) FILTER (idx = 10) AS answer, max(conf) FILTER (idx = 10) AS confidence, avg(ent) AS h_mean, max_by(ent, idx) AS h_tail FROM ck GROUP BY ALL),
ev AS (SELECT *, answer = gold AS correct FROM nat WHERE answer IS NOT NULL),
ph AS (SELECT *, row_number() OVER (PARTITION BY qid, run_id ORDER BY idx) AS rn FROM ck),
ph2 AS (SELECT *, lag(ans) OVER w AS pa, lag(correct) OVER w AS pc, lag(rn) OVER w AS pr, lag(idx) OVER w AS px FROM ph WHERE NOT alias WINDOW w AS (PARTITION BY qid, run_id ORDER BY idx)),
tr AS (SELECT qid, run_id, count(*) FILTER (ans IS NOT NULL AND pa IS NOT NULL AND rn - pr = idx - px) AS transitions, count(*) FILTER (ans <> pa AND rn - pr = idx - px) AS switches,
  min(idx) FILTER (ans <> pa AND rn - pr = idx - px AND pc AND NOT correct) AS left_at FROM ph2 GROUP BY ALL),
ends AS (SELECT qid, run_id, ans AS ea FROM ck WHERE idx = 10 AND ans IS NOT NULL),
grid AS (SELECT e.*, g.idx, c.ans, c.alias, c.qid IS NULL AS absent FROM ends e CROSS JOIN (SELECT unnest(range(11)) AS idx) g LEFT JOIN ck c ON c.qid = e.qid AND c.run_id = e.run_id AND c.idx = g.idx),
br AS (SELECT qid, run_id, coalesce(max(idx) FILTER (absent OR (NOT alias AND (ans IS NULL OR ans <> ea))), -1) AS b FROM grid GROUP BY ALL),
st AS (SELECT grid.qid, grid.run_id, min(idx) / CAST(10 AS DOUBLE) AS stabilization FROM grid JOIN br USING (qid, run_id) WHERE NOT absent AND NOT alias AND ans = ea AND idx > b GROUP BY ALL),
f AS (SELECT n.*, coalesce(switches, 0) AS switches, coalesce(transitions, 0) AS transitions, left_at, stabilization, answer = gold AS correct,
  (SELECT NULL) AS unused FROM nat n LEFT JOIN tr USING (qid, run_id) LEFT JOIN st USING (qid, run_id)),
at_ AS (SELECT qid, run_id, max(ent) FILTER (idx = 0) AS e0, max(ent) FILTER (idx = 5) AS e5, max(ent) FILTER (idx = 10) AS e10, max(conf) FILTER (idx = 0) AS c0, max(conf) FILTER (idx = 5) AS c5, max(conf) FILTER (idx = 10) AS c10 FROM ck GROUP BY ALL),
wide AS (SELECT f.qid, f.subject, f.run_id, f.correct, [-h_mean, -h_tail, -e0, -e5, -e10, confidence, c0, c5, c10, CAST(-switches AS DOUBLE), -stabilization] AS xs FROM f JOIN at_ USING (qid, run_id)),
long AS (SELECT qid, subject, run_id, correct, CAST(i AS INT) AS fx, xs[i] AS x FROM wide, unnest(range(1, 12)) AS u(i))
"""
DOMAIN_SQL = DOMAIN_SQL.replace(",\n  (SELECT NULL) AS unused", "").strip()


def sql(body: str) -> str:
    """A DuckDB statement over the domain's tables; ``body`` may start with more of them."""
    return f"WITH {DOMAIN_SQL}{',' if not body.lstrip().upper().startswith('SELECT') else ''}\n{body}"


class Tables:
    """The tables of a folder, each built once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str, *columns: str) -> DataFrame:
        """A given table, pruned to some columns."""
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df.select(*columns) if columns else df

    @cached_property
    def ck(self) -> DataFrame:
        """Checkpoints: qid, subject, run_id, idx, ans, conf, ent, gold, n_think, k_keep, alias, correct."""
        user = F.col("user_id")
        pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
        rows = self.read("events", "event_id", "ts", "user_id", "event_type", "value").withColumn("pos", pos)
        answer = F.create_map(*[F.lit(x) for pair in zip(["click", "view", "purchase", "signup"], "ABCD", strict=True) for x in pair])
        rows = rows.select(
            "event_id",
            "ts",
            "event_type",
            user.alias("qid"),
            F.element_at(F.array(*[F.lit(s) for s in SUBJECTS]), (user % 5).cast("int") + 1).alias("subject"),
            F.floor(F.col("pos") / 11).cast("bigint").alias("run_id"),
            (F.col("pos") % 11).alias("idx"),
            F.try_element_at(answer, "event_type").alias("ans"),
            (F.col("value") / 500.0).alias("conf"),
            (F.col("value") / 100.0).alias("ent"),
            F.substr(F.lit("ABCD"), (user % 4).cast("int") + 1, F.lit(1)).alias("gold"),
            (user % 25).alias("n_think"),
        )
        k = placement(F.col("idx"), F.col("n_think"))
        alias = (F.col("idx") > 0) & (k == placement(F.col("idx") - 1, F.col("n_think")))
        return rows.withColumns({"k_keep": k, "alias": alias, "correct": F.col("ans") == F.col("gold")})

    def _by_run(self, *more: Column) -> DataFrame:
        """Runs by one aggregation, which needs no exchange after the one that numbered the events."""
        last = F.col("idx") == 10
        out = self.ck.groupBy("qid", "subject", "run_id", "n_think", "gold").agg(
            F.count(F.lit(1)).alias("n_ck"),
            F.max(F.when(last, F.col("ans"))).alias("answer"),
            F.max(F.when(last, F.col("conf"))).alias("confidence"),
            F.avg("ent").alias("h_mean"),
            F.max_by("ent", "idx").alias("h_tail"),
            *more,
        )
        return out.withColumn("correct", F.col("answer") == F.col("gold"))

    @cached_property
    def nat(self) -> DataFrame:
        """Runs: qid, subject, run_id, n_think, gold, n_ck, answer, confidence, h_mean, h_tail, correct."""
        return self._by_run()

    @cached_property
    def ev(self) -> DataFrame:
        """Runs with a verdict."""
        return self.nat.where("correct is not null")

    @cached_property
    def runs(self) -> DataFrame:
        """Runs with their eleven slots (null where a checkpoint is missing)."""
        got = self._by_run(trajectory.gathered("idx", ["ans", "alias", "correct", "conf", "ent", "k_keep"]).alias("got"))
        return got.withColumn("slots", trajectory.placed("got")).drop("got")

    @cached_property
    def features(self) -> DataFrame:
        """Runs with the trajectory features: switches, transitions, left, recovered, stabilization and more."""
        return trajectory.features(self.runs)

    @cached_property
    def long(self) -> DataFrame:
        """A row per run and feature: qid, subject, run_id, correct, fx (1 to 11), x."""
        f, at = self.features, lambda i, c: F.get("slots", F.lit(i))[c]
        xs = [-f.h_mean, -f.h_tail, -at(0, "ent"), -at(5, "ent"), -at(10, "ent"), f.confidence, at(0, "conf"), at(5, "conf"), at(10, "conf"), -f.switches.cast("double"), -f.stabilization]
        return f.select("qid", "subject", "run_id", "correct", F.posexplode(F.array(*xs)).alias("fx", "x")).withColumn("fx", F.col("fx") + 1)
