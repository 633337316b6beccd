"""Validations of records and of result tables. What is stored comes from another computation than what it is checked with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import identity, scalars
from plumbline.operators import calibration, rank, schema, trajectory
from plumbline.plans.domain import RUN
from plumbline.plans.registry import GROUPED, n, query, r, reliability_sql
from plumbline.sources import records

#: The contract of an event's record, in the words of JSON Schema.
EVENT = {
    "type": "object",
    "required": ["event_id", "event_type", "value"],
    "additionalProperties": False,
    "properties": {
        "event_id": {"type": "integer", "minimum": 0},
        "event_type": {"type": "string", "enum": ["click", "view", "purchase", "signup", "error"]},
        "meta": {"type": "object", "required": ["hour"], "properties": {"hour": {"type": "integer", "maximum": 23}, "user_id": {"type": "integer"}}},
        "tags": {"type": "array", "items": {"type": "string", "pattern": "^[a-z]+$"}},
        "value": {"type": ["number", "null"], "maximum": 450},
    },
}

_EVENT_JSON = """SELECT event_id, event_type, value, user_id, hour(ts) AS h FROM events"""


@query(
    "val01",
    f"""SELECT event_id, CASE WHEN event_id % 41 = 0 THEN '<root>: malformed' WHEN event_id % 17 = 0 THEN '<root>: required' WHEN event_id % 43 = 0 THEN '<root>: additionalProperties'
  WHEN event_id % 19 = 0 OR event_type NOT IN ('click', 'view', 'purchase', 'signup', 'error') THEN 'event_type: enum' WHEN event_id % 23 = 0 THEN 'meta: required'
  WHEN h + CASE WHEN event_id % 29 = 0 THEN 24 ELSE 0 END > 23 THEN 'meta.hour: maximum' WHEN event_id % 31 = 0 THEN 'meta.user_id: type' WHEN event_id % 37 = 0 THEN 'tags.1: pattern'
  WHEN value > 450 THEN 'value: maximum' END AS first_error FROM ({_EVENT_JSON})""",
    domain=False,
)
def val01(t):
    """The first error by path of each record against a schema; the records are broken in eight ways."""
    i = F.col("event_id")
    hour = F.hour("ts") + F.when(i % 29 == 0, 24).otherwise(0)
    user = F.when(i % 31 == 0, F.concat(F.lit('"'), F.col("user_id").cast("string"), F.lit('"'))).otherwise(F.col("user_id").cast("string"))
    meta = F.concat(F.lit('{"user_id":'), user, F.when(i % 23 == 0, "").otherwise(F.concat(F.lit(',"hour":'), hour.cast("string"))), F.lit("}"))
    kind = F.when(i % 19 == 0, "Click!").otherwise(F.col("event_type"))
    value = F.when(i % 17 == 0, "").otherwise(F.concat(F.lit(',"value":'), F.coalesce(F.col("value").cast("string"), F.lit("null"))))
    text = F.concat(
        F.lit('{"event_id":'), i.cast("string"), F.lit(',"event_type":"'), kind, F.lit('","meta":'), meta, F.lit(',"tags":["a","'), F.when(i % 37 == 0, "B1").otherwise("b"), F.lit('"]'), value,
        F.when(i % 43 == 0, ',"more":1').otherwise(""), F.when(i % 41 == 0, "").otherwise("}"),
    )
    rows = t.read("events", "event_id", "event_type", "ts", "user_id", "value")
    return rows.select("event_id", schema.first_error(text, EVENT).alias("first_error"))


_TRACE3 = "tr3 AS (SELECT vec_id, vec_id % 6 AS k, list_transform(CASE WHEN vec_id % 5 = 0 THEN embedding[1:0] ELSE embedding[1:40 + CAST(vec_id % 6 AS INT)] END, lambda x: abs(CAST(x AS DOUBLE))) AS a FROM embeddings), nr AS (SELECT vec_id, a, len(a) + CASE WHEN vec_id % 11 = 0 THEN 1 ELSE 0 END AS stored_count, len(a) - CASE WHEN vec_id % 13 = 0 AND len(a) > 0 THEN 1 ELSE 0 END AS tokens, CASE WHEN vec_id % 7 = 0 THEN NULL WHEN len(a) = 0 AND vec_id % 9 = 0 THEN 0.5 WHEN len(a) > 0 THEN list_avg(a) END AS h_mean, CASE WHEN vec_id % 15 = 0 THEN 'present' WHEN len(a) = 0 THEN 'no_reasoning' ELSE 'present' END AS reasoning FROM tr3)"


@query(
    "val03",
    f"{_TRACE3} SELECT vec_id, CASE WHEN tokens <> len(a) THEN 'lengths' WHEN stored_count <> len(a) THEN 'count' WHEN (reasoning = 'no_reasoning') <> (len(a) = 0) THEN 'no_reasoning' WHEN (len(a) = 0) <> (h_mean IS NULL) THEN 'summary' END AS error FROM nr",
)
def val03(t):
    """Rules of a run's row: arrays of one length, the stored count, no reasoning exactly if there are no tokens, summaries only then missing."""
    i = F.col("vec_id")
    a = F.when(i % 5 == 0, F.slice("embedding", 1, 0)).otherwise(F.slice("embedding", F.lit(1), (40 + i % 6).cast("int")))
    rows = t.read("embeddings", "vec_id", "embedding").select("vec_id", F.transform(a, lambda x: F.abs(x.cast("double"))).alias("a")).withColumn("len", F.size("a"))
    stored = rows.select(
        "vec_id",
        "len",
        F.slice("a", F.lit(1), F.col("len") - F.when((i % 13 == 0) & (F.col("len") > 0), 1).otherwise(0)).alias("tokens"),
        (F.col("len") + F.when(i % 11 == 0, 1).otherwise(0)).alias("stored_count"),
        F.when(i % 7 == 0, None).when((F.col("len") == 0) & (i % 9 == 0), 0.5).when(F.col("len") > 0, scalars.mean(F.col("a"))).alias("h_mean"),
        F.when(i % 15 == 0, "present").when(F.col("len") == 0, "no_reasoning").otherwise("present").alias("reasoning"),
    )
    empty = F.col("len") == 0
    error = (
        F.when(F.size("tokens") != F.col("len"), "lengths")
        .when(F.col("stored_count") != F.col("len"), "count")
        .when((F.col("reasoning") == "no_reasoning") != empty, "no_reasoning")
        .when(empty != F.col("h_mean").isNull(), "summary")
    )
    return stored.select("vec_id", error.alias("error"))


_BUNDLE = """bu AS (SELECT event_id, CASE WHEN event_id % 47 = 0 THEN 'terminal_infrastructure_failure' ELSE 'complete' END AS outcome,
  CASE WHEN ans IS NULL THEN 'missing' WHEN event_id % 13 = 0 THEN 'out_of_domain' ELSE 'parsed' END AS answer_status,
  CASE WHEN conf IS NULL THEN 'missing' WHEN conf > 0.9 THEN 'out_of_range' ELSE 'parsed' END AS confidence_status,
  CASE WHEN ent IS NULL OR event_id % 17 = 0 THEN 'unavailable' ELSE 'computed' END AS entropy_status, ans, event_id % 29 = 0 AS flipped FROM ck),
bs AS (SELECT *, CASE WHEN (outcome = 'complete' AND answer_status = 'parsed' AND confidence_status = 'parsed' AND entropy_status = 'computed') <> flipped THEN 'valid' ELSE 'invalid' END AS output_status FROM bu)"""


@query(
    "val05",
    f"""{_BUNDLE} SELECT event_id, outcome, answer_status, confidence_status, entropy_status, output_status,
  CASE WHEN outcome <> 'complete' AND (output_status = 'valid' OR answer_status <> 'missing' OR confidence_status <> 'missing' OR entropy_status <> 'unavailable') THEN 'failure_with_outputs'
  WHEN outcome = 'complete' AND output_status = 'valid' AND NOT (answer_status = 'parsed' AND confidence_status = 'parsed' AND entropy_status = 'computed') THEN 'valid_without_triad'
  WHEN outcome = 'complete' AND output_status = 'invalid' AND answer_status = 'parsed' AND confidence_status = 'parsed' AND entropy_status = 'computed' THEN 'invalid_with_triad' END AS error FROM bs""",
)
def val05(t):
    """The bundle of a checkpoint's statuses: a failure has no outputs, and the output is valid exactly if the triad is."""
    i = F.col("event_id")
    rows = t.ck.select(
        "event_id",
        F.when(i % 47 == 0, "terminal_infrastructure_failure").otherwise("complete").alias("outcome"),
        F.when(F.col("ans").isNull(), "missing").when(i % 13 == 0, "out_of_domain").otherwise("parsed").alias("answer_status"),
        F.when(F.col("conf").isNull(), "missing").when(F.col("conf") > 0.9, "out_of_range").otherwise("parsed").alias("confidence_status"),
        F.when(F.col("ent").isNull() | (i % 17 == 0), "unavailable").otherwise("computed").alias("entropy_status"),
    )
    stored = ((F.col("outcome") == "complete") & trajectory.triad()) != (i % 29 == 0)
    rows = rows.withColumn("output_status", F.when(stored, "valid").otherwise("invalid"))
    return rows.withColumn("error", trajectory.bundle_error())


_P4 = "a4 AS (SELECT vec_id, [CAST(embedding[i] AS DOUBLE) FOR i IN [2, 3, 5, 8]] AS a FROM embeddings), e4 AS (SELECT vec_id, a, list_transform(a, lambda x: exp(x - list_max(a))) AS e FROM a4), q4 AS (SELECT vec_id, a, e, list_transform(e, lambda y: y / list_sum(e)) AS p FROM e4)"
_H4 = "h4 AS (SELECT vec_id, p, -list_sum(list_transform(list_filter(p, lambda x: x > 0), lambda x: x * ln(x))) AS again, ln(list_sum(e)) - list_sum(list_transform(list_zip(a, e), lambda z: (z[1] - list_max(a)) * z[2])) / list_sum(e) + CASE WHEN vec_id % 5 = 0 THEN 1e-3 ELSE 0 END AS stored, list_position(a, list_max(a)) AS top, CAST(CASE WHEN vec_id % 9 = 0 THEN vec_id % 4 + 1 ELSE list_position(p, list_max(p)) END AS INT) AS named FROM q4)"


def _logits(t):
    return t.read("embeddings", "vec_id", "embedding").select("vec_id", F.array(*[F.get("embedding", F.lit(i)).cast("double") for i in (1, 2, 4, 7)]).alias("a"))


@query("val06", f"{_P4}, {_H4} SELECT vec_id, round(again, 8) AS entropy, abs(again - stored) <= 1e-6 AS entropy_holds, top = named AS answer_holds FROM h4")
def val06(t):
    """The entropy of the stored probabilities against the one stored, which came from the logits; and the answer at its index."""
    p = scalars.softmax(F.col("a"))
    top = F.array_max("a")
    weights = F.transform("a", lambda x: F.exp(x - top))
    moment = scalars.total(F.transform("a", lambda x: F.exp(x - top) * (x - top)))
    stored = F.ln(scalars.total(weights)) - moment / scalars.total(weights) + F.when(F.col("vec_id") % 5 == 0, 1e-3).otherwise(0.0)
    rows = _logits(t).select("vec_id", "a", p.alias("p"), stored.alias("stored"))
    named = F.when(F.col("vec_id") % 9 == 0, F.col("vec_id") % 4 + 1).otherwise(F.array_position("p", F.array_max("p"))).cast("int")
    again = scalars.entropy(F.col("p"))
    return rows.select("vec_id", r(again, "entropy", 8), (F.abs(again - F.col("stored")) <= 1e-6).alias("entropy_holds"), (F.array_position("a", F.array_max("a")) == named).alias("answer_holds"))


#: What a checkpoint takes over from its run.
INHERITED = ["subject", "gold", "n_think", "question_hash", "prompt_version", "model_id", "seed", "sample_index"]
_SIDE = "md5('q' || qid) AS question_hash, 'v' || (qid % 3) AS prompt_version, 'm' || (run_id % 2) AS model_id, 42 + qid % 2 AS seed, qid * 100 + run_id AS sample_index, 'run-' || qid || '-' || run_id AS record_id"
_CHILD = f"""pa AS (SELECT *, {_SIDE} FROM nat WHERE answer IS NOT NULL),
ch AS (SELECT event_id, qid, run_id, idx, CASE WHEN event_id % 31 = 0 THEN NULL ELSE subject END AS subject, gold, n_think + CASE WHEN event_id % 37 = 0 THEN 1 ELSE 0 END AS n_think, {_SIDE.replace("'v' || (qid % 3)", "'v' || (qid % 3 + CASE WHEN event_id % 41 = 0 THEN 1 ELSE 0 END)")},
  'ck-' || (event_id - CASE WHEN event_id % 53 = 0 THEN 1 ELSE 0 END) AS checkpoint_id, idx / CAST(10 AS DOUBLE) + CASE WHEN event_id % 43 = 0 THEN 1e-9 ELSE 0 END AS fraction FROM ck),
dup AS (SELECT checkpoint_id FROM ch GROUP BY ALL HAVING count(*) > 1)"""
_WRONG = ", ".join(f"CASE WHEN c.{f} IS DISTINCT FROM p.{f} THEN '{f}' END" for f in INHERITED)


def _side(rows: DataFrame, version=0) -> DataFrame:
    q, run = F.col("qid"), F.col("run_id")
    text = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    return rows.withColumns(
        {
            "question_hash": F.md5(text("q", q).cast("binary")),
            "prompt_version": text("v", q % 3 + version),
            "model_id": text("m", run % 2),
            "seed": 42 + q % 2,
            "sample_index": q * 100 + run,
            "record_id": F.concat_ws("-", F.lit("run"), q.cast("string"), run.cast("string")),
        }
    )


@query(
    "val07",
    f"{_CHILD} SELECT c.event_id, p.record_id IS NULL AS orphan, CASE WHEN p.record_id IS NULL THEN '' ELSE array_to_string(list_filter([{_WRONG}], lambda x: x IS NOT NULL), ',') END AS wrong_fields, dup.checkpoint_id IS NOT NULL AS duplicate, c.fraction = c.idx / CAST(10 AS DOUBLE) AS canonical FROM ch c LEFT JOIN pa p USING (record_id) LEFT JOIN dup ON dup.checkpoint_id = c.checkpoint_id",
)
def val07(t):
    """Checkpoints against their runs: orphans, which of eight inherited fields differ, repeated identifiers, fractions that are not the canonical double."""
    i = F.col("event_id")
    child = _side(t.ck, F.when(i % 41 == 0, 1).otherwise(0)).withColumns(
        {
            "subject": F.when(i % 31 == 0, None).otherwise(F.col("subject")),
            "n_think": F.col("n_think") + F.when(i % 37 == 0, 1).otherwise(0),
            "checkpoint_id": F.concat(F.lit("ck-"), (i - F.when(i % 53 == 0, 1).otherwise(0)).cast("string")),
            "fraction": F.col("idx") / 10.0 + F.when(i % 43 == 0, 1e-9).otherwise(0.0),
        }
    )
    got = trajectory.inheritance(child, _side(t.nat.where("answer is not null")), "record_id", INHERITED, "checkpoint_id")
    return got.select("event_id", "orphan", F.array_join("wrong_fields", ",").alias("wrong_fields"), "duplicate", (F.col("fraction") == F.col("idx") / 10.0).alias("canonical"))


@query(
    "val08",
    """pr AS (SELECT qid, run_id, n_think, k FROM nat, unnest(range(CASE WHEN qid % 13 = 0 AND run_id = 0 THEN 2 ELSE 1 END)) AS u(k) WHERE answer IS NOT NULL),
pn AS (SELECT qid, run_id, count(*) AS parents, max(n_think) AS nt FROM pr GROUP BY ALL),
sk AS (SELECT event_id, ck.qid, ck.run_id, idx, k_keep + CASE WHEN event_id % 27 = 0 THEN 1 ELSE 0 END AS stored, alias <> (event_id % 33 = 0) AS stored_alias, CASE WHEN n_think > 0 THEN k_keep / CAST(n_think AS DOUBLE) END AS fraction, parents, nt FROM ck LEFT JOIN pn USING (qid, run_id))
SELECT event_id, CAST(coalesce(parents, 0) AS BIGINT) AS parents, CASE WHEN parents = 1 THEN stored = round_even(idx / CAST(10 AS DOUBLE) * nt, 0) END AS placed,
  CASE WHEN parents = 1 THEN stored_alias = (idx > 0 AND round_even(idx / CAST(10 AS DOUBLE) * nt, 0) = round_even((idx - 1) / CAST(10 AS DOUBLE) * nt, 0)) END AS alias_holds, CASE WHEN parents = 1 AND nt > 0 THEN fraction = round_even(idx / CAST(10 AS DOUBLE) * nt, 0) / CAST(nt AS DOUBLE) END AS fraction_holds FROM sk""",
)
def val08(t):
    """Placement, alias and fraction recomputed from the one eligible parent; none is judged without exactly one."""
    i = F.col("event_id")
    twice = F.explode(F.sequence(F.lit(1), F.when((F.col("qid") % 13 == 0) & (F.col("run_id") == 0), 2).otherwise(1)))
    parents = t.nat.where("answer is not null").select(*RUN, "n_think", twice.alias("copy")).groupBy(*RUN).agg(F.count(F.lit(1)).alias("parents"), F.max("n_think").alias("nt"))
    stored = t.ck.select(
        "event_id", *RUN, "idx",
        (F.col("k_keep") + F.when(i % 27 == 0, 1).otherwise(0)).alias("stored"),
        (F.col("alias") != (i % 33 == 0)).alias("stored_alias"),
        F.when(F.col("n_think") > 0, F.col("k_keep") / F.col("n_think").cast("double")).alias("fraction"),
    )
    got = stored.join(parents, RUN, "left").withColumn("one", F.coalesce(F.col("parents") == 1, F.lit(False)))
    k = scalars.placement(F.col("idx"), F.col("nt"))
    alias = (F.col("idx") > 0) & (k == scalars.placement(F.col("idx") - 1, F.col("nt")))
    return got.select(
        "event_id",
        n(F.coalesce("parents", F.lit(0)), "parents"),
        F.when(F.col("one"), F.col("stored") == k).alias("placed"),
        F.when(F.col("one"), F.col("stored_alias") == alias).alias("alias_holds"),
        F.when(F.col("one") & (F.col("nt") > 0), F.col("fraction") == k / F.col("nt").cast("double")).alias("fraction_holds"),
    )


#: The manifest that every record has to agree with.
MANIFEST = {"study_id": "study-1", "schema_version": "v2", "model_run_id": "model-0", "seed": "42"}
_STATED = {
    "study_id": ("'study-' || (1 + CASE WHEN user_id % 25 = 3 THEN 1 ELSE 0 END)", lambda: F.concat(F.lit("study-"), (1 + F.when(F.col("user_id") % 25 == 3, 1).otherwise(0)).cast("string"))),
    "schema_version": ("CASE WHEN value > 450 THEN 'v1' WHEN event_id % 71 = 0 THEN NULL ELSE 'v2' END", lambda: F.when(F.col("value") > 450, "v1").when(F.col("event_id") % 71 == 0, None).otherwise("v2")),
    "model_run_id": ("'model-' || (event_id % 97 // 96)", lambda: F.concat(F.lit("model-"), F.floor(F.col("event_id") % 97 / 96).cast("string"))),
    "seed": ("CAST(42 + CASE WHEN user_id % 31 = 5 THEN 1 ELSE 0 END AS VARCHAR)", lambda: (42 + F.when(F.col("user_id") % 31 == 5, 1).otherwise(0)).cast("string")),
}
_OFF = ", ".join(f"CASE WHEN {sql_} IS DISTINCT FROM '{MANIFEST[k]}' THEN '{k}' END" for k, (sql_, _) in _STATED.items())


@query("val10", f"SELECT event_id, errors FROM (SELECT event_id, array_to_string(list_filter([{_OFF}], lambda x: x IS NOT NULL), ',') AS errors FROM events) WHERE errors <> ''", domain=False)
def val10(t):
    """All points in which a record differs from its manifest, a table of one row."""
    manifest = t.spark.createDataFrame([tuple(MANIFEST.values())], ", ".join(f"want_{k} string" for k in MANIFEST))
    rows = t.read("events", "event_id", "user_id", "value").select("event_id", *[make().alias(k) for k, (_, make) in _STATED.items()]).join(F.broadcast(manifest))  # one row
    errors = F.array_compact(F.array(*[F.when(~F.col(k).eqNullSafe(F.col(f"want_{k}")), k) for k in MANIFEST]))
    return rows.select("event_id", F.array_join(errors, ",").alias("errors")).where("errors <> ''")



@query("val11", "SELECT subject, count(DISTINCT ('study-1', 'model-' || (qid % 50 // 49), 'questions-1', 'config-' || (n_think // 24))) AS provenances, count(DISTINCT ('study-1', 'model-' || (qid % 50 // 49), 'questions-1', 'config-' || (n_think // 24))) = 1 AS single FROM nat GROUP BY subject")
def val11(t):
    """Whether all runs of a table share the four identifiers of where they come from."""
    name = lambda prefix, x: F.concat(F.lit(prefix), x.cast("bigint").cast("string"))
    ids = F.struct(F.lit("study-1"), name("model-", F.floor(F.col("qid") % 50 / 49)), F.lit("questions-1"), name("config-", F.floor(F.col("n_think") / 24)))
    k = F.count_distinct(ids)
    return t.nat.groupBy("subject").agg(k.alias("provenances"), (k == 1).alias("single"))


_AUDIT_G = f"g0 AS (SELECT subject, answer = gold AS y, confidence AS c FROM nat), g AS ({GROUPED.format('g0')})"


@query(
    "val12",
    f"""{_AUDIT_G}, rb AS ({reliability_sql('g', ['grouping', 'grp'])}),
tb AS (SELECT grouping, grp, bin, n + CASE WHEN grouping = 'subject' AND bin = 2 THEN 1 ELSE 0 END AS n, accuracy + CASE WHEN bin = 4 AND grouping = 'pooled' THEN 2 ELSE 0 END AS accuracy, contribution + CASE WHEN grouping = 'pooled' AND bin = 7 THEN 1e-6 ELSE 0 END AS contribution FROM rb WHERE NOT (grouping = 'subject' AND bin = 9 AND grp = (SELECT min(grp) FROM rb))),
ca AS (SELECT grouping, grp, count(*) AS n FROM g WHERE y IS NOT NULL AND c IS NOT NULL GROUP BY ALL),
ea AS (SELECT grouping, grp, sum(contribution) AS ece FROM rb GROUP BY ALL),
two AS (SELECT 'stored' AS source, * FROM (SELECT grouping, grp, bin, n, accuracy, contribution FROM rb) UNION ALL SELECT 'tampered', * FROM tb),
pg AS (SELECT source, grouping, grp, count(*) AS bins, sum(n) AS n, sum(contribution) AS total, count(*) FILTER (accuracy NOT BETWEEN 0 AND 1) AS bad FROM two GROUP BY ALL)
SELECT source, count(*) FILTER (bins <> 10) AS cardinality, count(*) FILTER (pg.n <> ca.n) AS counts, CAST(sum(bad) AS BIGINT) AS bounds, count(*) FILTER (abs(total - ece) > 1e-9) AS sums,
  count(*) FILTER (pg.grouping = 'pooled' AND pg.n <> (SELECT sum(n) FROM pg q WHERE q.source = pg.source AND q.grouping = 'subject')) AS partition FROM pg JOIN ca ON ca.grouping = pg.grouping AND ca.grp IS NOT DISTINCT FROM pg.grp JOIN ea ON ea.grouping = pg.grouping AND ea.grp IS NOT DISTINCT FROM pg.grp GROUP BY source""",
)
def val12(t):
    """Audit of a reliability table against its cohort: cardinality, counts, bounds, bins that sum to the error, and the partition by subject.

    The table as it is, and a copy with five defects; the error comes from the rows, not from the bins.
    """
    keys = ["grouping", "grp"]
    rows = rank.with_groups(t.nat.select("subject", "correct", "confidence"))
    used = rows.where("correct is not null and confidence is not null")
    bins = calibration.reliability(rows, keys, F.col("correct"), F.col("confidence")).select(*keys, "bin", "n", r("accuracy", "accuracy"), r("contribution", "contribution"))
    least = used.where("grouping = 'subject'").agg(F.min("grp")).first()[0]
    hit = lambda g, b: (F.col("grouping") == g) & (F.col("bin") == b)
    bad = bins.where(~(hit("subject", 9) & F.col("grp").eqNullSafe(F.lit(least)))).select(
        *keys, "bin",
        (F.col("n") + F.when(hit("subject", 2), 1).otherwise(0)).alias("n"),
        (F.col("accuracy") + F.when(hit("pooled", 4), 2).otherwise(0)).alias("accuracy"),
        (F.col("contribution") + F.when(hit("pooled", 7), 1e-6).otherwise(0.0)).alias("contribution"),
    )
    both = bins.withColumn("source", F.lit("stored")).unionByName(bad.withColumn("source", F.lit("tampered")))
    return calibration.audit(both, used, keys, "correct", "confidence")


@query(
    "val13",
    """qs AS (SELECT DISTINCT qid, subject FROM nat), mf AS (SELECT qid, subject, row_number() OVER (ORDER BY subject, qid) - 1 AS i FROM qs),
bd AS (SELECT CASE WHEN i % 40 = 39 THEN qid + 1 ELSE qid END AS qid, CASE WHEN i % 50 = 25 THEN '~' ELSE subject END AS subject, i + CASE WHEN i % 30 = 29 THEN 1 ELSE 0 END AS i, CASE WHEN i % 20 = 19 THEN i - 1 ELSE i END AS source_row FROM mf),
tw AS (SELECT 'good' AS manifest, qid, subject, i, i AS source_row FROM mf UNION ALL SELECT 'broken', qid, subject, i, source_row FROM bd)
SELECT manifest, count(*) AS questions, count(*) - count(DISTINCT qid) AS repeated_ids, count(*) - count(DISTINCT source_row) AS repeated_rows, count(*) FILTER (i <> p) AS misplaced, count(*) FILTER (subject < before) AS out_of_block
FROM (SELECT *, row_number() OVER (PARTITION BY manifest ORDER BY i, qid) - 1 AS p, lag(subject) OVER (PARTITION BY manifest ORDER BY i, qid) AS before FROM tw) GROUP BY manifest""",
)
def val13(t):
    """Invariants of a question manifest: size, unique identifiers and source rows, contiguous places, subjects in blocks; a good and a broken one.

    A manifest is a list of questions that one task can number; its records are far more.
    """
    q = t.nat.select("qid", "subject").distinct()
    good = q.withColumn("i", F.row_number().over(Window.orderBy("subject", "qid")) - 1).withColumn("source_row", F.col("i"))
    i = F.col("i")
    broken = good.select(
        F.when(i % 40 == 39, F.col("qid") + 1).otherwise(F.col("qid")).alias("qid"),
        F.when(i % 50 == 25, "~").otherwise(F.col("subject")).alias("subject"),
        (i + F.when(i % 30 == 29, 1).otherwise(0)).alias("i"),
        F.when(i % 20 == 19, i - 1).otherwise(i).alias("source_row"),
    )
    both = good.withColumn("manifest", F.lit("good")).unionByName(broken.withColumn("manifest", F.lit("broken")))
    w = Window.partitionBy("manifest").orderBy("i", "qid")
    both = both.withColumns({"p": F.row_number().over(w) - 1, "before": F.lag("subject").over(w)})
    c = F.count(F.lit(1))
    return both.groupBy("manifest").agg(
        c.alias("questions"),
        (c - F.count_distinct("qid")).alias("repeated_ids"),
        (c - F.count_distinct("source_row")).alias("repeated_rows"),
        F.count_if(F.col("i") != F.col("p")).alias("misplaced"),
        F.count_if(F.col("subject") < F.col("before")).alias("out_of_block"),
    )


@query(
    "val14",
    """ln AS (SELECT 'nation' AS file, n_nationkey AS k, n_name AS line FROM nation UNION ALL SELECT 'region', r_regionkey, r_name FROM region),
fs AS (SELECT file, string_agg(line || chr(10), '' ORDER BY k) AS body FROM ln GROUP BY file)
SELECT file, CAST(strlen(body) AS BIGINT) AS bytes, sha256(body) AS sha256, file = 'nation' AS unchanged FROM fs""".replace("ln AS", "WITH ln AS", 1),
    domain=False,
)
def val14(t):
    """Bytes and digests of two source files, and whether they are the same afterwards; one of them is changed meanwhile."""
    path = records.scratch(t.spark, "snapshot")
    for name, key, column in (("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name")):
        t.read(name, key, column).coalesce(1).sortWithinPartitions(key).select(column).write.text(f"{path}/{name}")
    shot = lambda: records.snapshot(t.spark, f"{path}/*/*.txt").select(F.regexp_extract("path", "([a-z]+)/[^/]*$", 1).alias("file"), "bytes", "sha256")
    kept = f"{path}/before"
    shot().write.parquet(kept)
    t.read("region", "r_name").coalesce(1).write.mode("overwrite").text(f"{path}/region")
    t.spark.createDataFrame([("more",)], "value string").coalesce(1).write.mode("append").text(f"{path}/region")
    before = t.spark.read.parquet(kept)
    return records.unchanged(before, shot().groupBy("file").agg(F.sum("bytes").alias("bytes"), F.min("sha256").alias("sha256")), "file")


_CANONICAL = "'{\"serialization_version\":\"part1-canonical-json-v1\",\"value\":{\"conv\":' || conv_id || ',\"turn\":' || turn || '}}'"


@query("val15", f"SELECT conv_id, turn, sha256({_CANONICAL}) AS digest, turn % 5 <> 0 AS unchanged FROM conversations", domain=False)
def val15(t):
    """A prompt's digest recomputed from the row's fields, against the digest of the text that was sent, some of them edited."""
    own = identity.digest(identity.canonical_json(identity.json_of(conv=F.col("conv_id"), turn=F.col("turn"))))
    sent = F.concat(F.lit('{"serialization_version":"part1-canonical-json-v1","value":{"conv":'), F.col("conv_id").cast("string"), F.lit(',"turn":'), F.col("turn").cast("string"), F.lit("}}"))
    edited = F.when(F.col("turn") % 5 == 0, F.concat(sent, F.lit(" "))).otherwise(sent)
    rows = t.read("conversations", "conv_id", "turn").select("conv_id", "turn", own.alias("digest"), F.sha2(edited.cast("binary"), 256).alias("stored"))
    return rows.select("conv_id", "turn", "digest", (F.col("digest") == F.col("stored")).alias("unchanged"))
