"""Coverage and attempt lifecycles over logs derived from the event table.

Each run is a key. Its checkpoints are audit events, four to an attempt, of which one in seven
was lost; a run with an answer has a terminal record. Duplicates, defects and failures are set
by remainders of the question, so that all dispositions occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import retry_policy
from plumbline.operators import coverage, events
from plumbline.plans.domain import RUN
from plumbline.plans.registry import query

_TYPES = {"click": events.COMPLETED, "view": events.FAILED, "purchase": events.INTERRUPTED, "signup": events.RECOVERED, "error": events.FAILED}
_CATEGORY = {"view": "transient_worker_failure", "purchase": "interrupted_process", "error": "corrupt_immutable_manifest"}

AUDIT = """au AS (SELECT event_id, qid, run_id, CAST(1 + idx // 4 AS INT) AS attempt, qid * 100000 + run_id * 10 + 1 + idx // 4 AS attempt_id, idx AS seq,
  CASE WHEN idx % 4 = 0 THEN 'attempt_started' WHEN event_type = 'click' THEN 'attempt_completed' WHEN event_type IN ('view', 'error') THEN 'attempt_failed' WHEN event_type = 'purchase' THEN 'attempt_interrupted' ELSE 'terminal_result_recovered' END AS type,
  CASE WHEN idx % 4 <> 0 AND event_type IN ('click', 'signup') AND event_id % 3 <> 0 THEN qid * 1000 + run_id END AS record_id,
  CASE WHEN idx % 4 = 0 OR event_type IN ('click', 'signup') THEN NULL WHEN event_type = 'error' THEN 'do_not_retry' WHEN idx // 4 = 2 THEN 'exhausted' ELSE 'retry' END AS retry_decision,
  CASE WHEN idx % 4 = 0 OR event_type IN ('click', 'signup') THEN NULL WHEN event_type = 'error' THEN 'terminal' ELSE 'retryable' END AS retry_class
  FROM ck WHERE event_id % 7 <> 0),
tm AS (SELECT qid * 1000 + run_id AS record_id, qid, run_id, qid * 100000 + run_id * 10 + 3 AS attempt_id, CASE WHEN n_think = 3 THEN 'terminal_infrastructure_failure' ELSE 'complete' END AS outcome FROM nat WHERE answer IS NOT NULL)
"""
_MATCHED = f"""{AUDIT}, ma AS (SELECT au.*, coalesce(tm.attempt_id = au.attempt_id AND tm.qid = au.qid AND tm.run_id = au.run_id, false) AS matches FROM au LEFT JOIN tm USING (record_id)),
at2 AS (SELECT qid, run_id, attempt, attempt_id, count(*) FILTER (type = 'attempt_started') AS starts, bool_or(attempt_id IN (SELECT attempt_id FROM tm)) AS has_record,
  string_agg(CASE type WHEN 'attempt_failed' THEN 'F' WHEN 'attempt_interrupted' THEN 'I' WHEN 'attempt_completed' THEN 'C' WHEN 'terminal_result_recovered' THEN 'R' END, '' ORDER BY seq) AS types,
  string_agg(CASE WHEN type <> 'attempt_started' THEN CASE WHEN matches THEN '1' ELSE '0' END END, '' ORDER BY seq) AS hits,
  string_agg(CASE WHEN type <> 'attempt_started' THEN CASE WHEN retry_decision = 'exhausted' THEN 'x' ELSE '-' END END, '' ORDER BY seq) AS spent FROM ma GROUP BY ALL)"""


def audit(t) -> DataFrame:
    step = F.col("idx") % 4
    kind = F.when(step == 0, events.STARTED).otherwise(F.element_at(F.create_map(*[F.lit(x) for p in _TYPES.items() for x in p]), F.col("event_type")))
    attempt = (1 + F.floor(F.col("idx") / 4)).cast("int")
    category = F.when(step != 0, F.try_element_at(F.create_map(*[F.lit(x) for p in _CATEGORY.items() for x in p]), "event_type"))
    policy = retry_policy(category, attempt)
    done = (step != 0) & F.col("event_type").isin("click", "signup") & (F.col("event_id") % 3 != 0)
    rows = t.ck.where("event_id % 7 <> 0")
    return rows.select(
        "event_id",
        *RUN,
        attempt.alias("attempt"),
        (F.col("qid") * 100000 + F.col("run_id") * 10 + attempt).alias("attempt_id"),
        F.col("idx").alias("seq"),
        kind.alias("type"),
        F.when(done, F.col("qid") * 1000 + F.col("run_id")).alias("record_id"),
        policy["decision"].alias("retry_decision"),
        policy["classification"].alias("retry_class"),
    )


def terminals(t) -> DataFrame:
    outcome = F.when(F.col("n_think") == 3, "terminal_infrastructure_failure").otherwise("complete")
    return t.nat.where("answer is not null").select((F.col("qid") * 1000 + F.col("run_id")).alias("record_id"), *RUN, (F.col("qid") * 100000 + F.col("run_id") * 10 + 3).alias("attempt_id"), outcome.alias("outcome"))


@query("evt01", f"{AUDIT} SELECT qid, run_id, count(DISTINCT attempt) AS consumed, count(DISTINCT attempt) = max(attempt) AS sequential FROM au WHERE type = 'attempt_started' GROUP BY qid, run_id")
def evt01(t):
    return events.consumed(audit(t), RUN)


@query(
    "evt02",
    f"""{_MATCHED} SELECT 'missing_completion' AS finding, record_id AS id FROM tm WHERE record_id NOT IN (SELECT record_id FROM ma WHERE matches AND type IN ('attempt_completed', 'terminal_result_recovered'))
UNION ALL SELECT 'missing_start', attempt_id FROM (SELECT attempt_id FROM at2 UNION SELECT attempt_id FROM tm) WHERE attempt_id NOT IN (SELECT attempt_id FROM au WHERE type = 'attempt_started')
UNION ALL SELECT 'orphaned', attempt_id FROM at2 WHERE starts > 0 AND types IS NULL AND NOT has_record
UNION ALL SELECT 'inconsistent_completion', attempt_id FROM at2 WHERE NOT contains(coalesce(types, ''), 'I') AND attempt_id IN (SELECT attempt_id FROM ma WHERE type IN ('attempt_completed', 'terminal_result_recovered') AND NOT matches)""",
)
def evt02(t):
    return events.findings(audit(t), terminals(t), RUN)


_COHERENT = """CASE WHEN types IS NULL THEN true WHEN types IN ('F', 'I') THEN NOT has_record WHEN types IN ('C', 'R') THEN hits = '1' WHEN types = 'RC' THEN hits = '11'
  WHEN types = 'CI' THEN hits = '00' AND NOT has_record WHEN types = 'IC' THEN has_record AND spent[1] = 'x' AND hits = '01' WHEN types = 'CIC' THEN has_record AND spent[2] = 'x' AND hits = '101' ELSE false END"""


@query("evt03", f"{_MATCHED} SELECT attempt_id, {_COHERENT} AS coherent FROM at2")
def evt03(t):
    return events.attempts(audit(t), terminals(t), RUN).select("attempt_id", events.coherent().alias("coherent"))


_SPENT = """la AS (SELECT qid, run_id, max(attempt) FILTER (type = 'attempt_started') AS last FROM au GROUP BY ALL),
cl2 AS (SELECT au.qid, au.run_id, count(*) FILTER (type IN ('attempt_failed', 'attempt_interrupted')) AS closures, max_by(retry_decision, seq) FILTER (type IN ('attempt_failed', 'attempt_interrupted')) AS decision FROM au JOIN la ON la.qid = au.qid AND la.run_id = au.run_id AND au.attempt = la.last WHERE last >= 3 GROUP BY ALL),
sp AS (SELECT qid, run_id FROM cl2 WHERE (closures = 0 OR decision = 'exhausted') AND qid * 1000 + run_id NOT IN (SELECT record_id FROM tm))"""


@query("evt04", f"{AUDIT}, {_SPENT} SELECT qid, run_id FROM sp")
def evt04(t):
    return events.terminalization(audit(t), terminals(t), RUN)


@query(
    "evt05",
    f"""{AUDIT}, {_SPENT}, g2 AS (SELECT qid, run_id, count(DISTINCT attempt) FILTER (type = 'attempt_started') AS attempts, max_by(retry_class, seq) FILTER (type = 'attempt_failed') AS last_class FROM au GROUP BY ALL),
w2 AS (SELECT n.qid, n.run_id, tm.outcome, coalesce(attempts, 0) AS attempts, last_class, sp.qid IS NOT NULL AS spent FROM nat n LEFT JOIN tm ON tm.qid = n.qid AND tm.run_id = n.run_id LEFT JOIN g2 ON g2.qid = n.qid AND g2.run_id = n.run_id LEFT JOIN sp ON sp.qid = n.qid AND sp.run_id = n.run_id),
s2 AS (SELECT *, CASE WHEN outcome = 'complete' THEN 'completed' WHEN outcome IS NOT NULL OR last_class = 'terminal' THEN 'terminal' WHEN spent THEN 'terminalization_required' ELSE 'retryable' END AS status FROM w2)
SELECT qid, run_id, status, CASE WHEN outcome = 'complete' THEN 'terminal_result_exists' WHEN outcome IS NOT NULL THEN 'terminal_infrastructure_failure' WHEN last_class = 'terminal' THEN 'nonretryable_failure' WHEN spent THEN 'terminal_result_required' WHEN attempts = 0 THEN 'not_started' ELSE 'retryable_interruption_or_failure' END AS reason,
  attempts, CASE WHEN status = 'retryable' THEN attempts + 1 END AS next_attempt FROM s2""",
)
def evt05(t):
    return events.resume(t.nat.select(*RUN), audit(t), terminals(t), RUN)


@query(
    "evt06",
    f"""{_MATCHED}, ls AS (SELECT attempt_id, max(seq) AS seq FROM au GROUP BY ALL),
r2 AS (SELECT attempt_id, 'terminal_result_recovered' AS type, record_id FROM tm WHERE record_id NOT IN (SELECT record_id FROM ma WHERE matches AND type IN ('attempt_completed', 'terminal_result_recovered'))
UNION ALL SELECT attempt_id, 'attempt_interrupted', NULL FROM at2 WHERE starts > 0 AND types IS NULL AND NOT has_record) SELECT attempt_id, CAST(coalesce(seq, -1) + 1 AS BIGINT) AS seq, type, record_id FROM r2 LEFT JOIN ls USING (attempt_id)""",
)
def evt06(t):
    return events.reconcile(audit(t), terminals(t), RUN)


@query("evt08", f"{AUDIT}, p2 AS (SELECT event_id, attempt_id, seq, lag(seq) OVER (PARTITION BY attempt_id ORDER BY event_id) AS p FROM au) SELECT event_id, 'sequence_not_increasing' AS error FROM p2 WHERE seq <= p")
def evt08(t):
    return events.order_errors(audit(t).withColumn("place", F.col("event_id")))


@query("fn29", f"{AUDIT} SELECT event_id, retry_class AS classification, retry_decision AS decision, CASE WHEN retry_decision = 'retry' THEN CASE attempt WHEN 1 THEN 30 ELSE 120 END END AS backoff FROM au WHERE retry_class IS NOT NULL")
def fn29(t):
    """Retry policy of each failure: class, decision and seconds to wait."""
    rows = t.ck.where("event_id % 7 <> 0 and idx % 4 <> 0")
    category = F.try_element_at(F.create_map(*[F.lit(x) for p in _CATEGORY.items() for x in p]), "event_type")
    policy = retry_policy(category, (1 + F.floor(F.col("idx") / 4)).cast("int"))
    got = rows.select("event_id", policy.alias("p")).where("p is not null")
    return got.select("event_id", F.col("p.classification").alias("classification"), F.col("p.decision").alias("decision"), F.col("p.backoff").alias("backoff"))


@query("jn11", f"{_MATCHED} SELECT event_id, record_id FROM ma WHERE matches")
def jn11(t):
    """Events and terminal records that agree in attempt and key."""
    return events.matched(audit(t), terminals(t), RUN).where("matches").select("event_id", "record_id")


@query("set04", f"{AUDIT}, s2 AS (SELECT attempt_id, list(DISTINCT type) AS types FROM au GROUP BY ALL) SELECT attempt_id FROM s2 WHERE list_has_any(types, ['attempt_failed', 'attempt_interrupted'])")
def set04(t):
    """Attempts whose event types meet a set."""
    got = audit(t).groupBy("attempt_id").agg(F.collect_set("type").alias("types"))
    return got.where(F.arrays_overlap("types", F.array(F.lit(events.FAILED), F.lit(events.INTERRUPTED)))).select("attempt_id")


@query("set03", f"{AUDIT} SELECT record_id FROM tm EXCEPT SELECT record_id FROM au")
def set03(t):
    """Records that no event names."""
    return terminals(t).select("record_id").exceptAll(terminals(t).select("record_id").intersect(audit(t).select("record_id"))).distinct()


# -- coverage -----------------------------------------------------------------------------

COVER = """ex AS (SELECT qid, CAST(r AS BIGINT) AS run_id FROM (SELECT DISTINCT qid FROM nat), unnest(range(10)) AS u(r)),
ob AS (SELECT qid, run_id, CASE WHEN qid % 11 = 1 THEN 'schema_incompatible' WHEN qid % 11 = 2 THEN 'manifest_incompatible' END AS defect, CASE WHEN n_think = 3 THEN 'terminal_infrastructure_failure' ELSE 'complete' END AS outcome FROM nat, unnest(range(CASE WHEN qid % 13 = 0 AND run_id = 0 THEN 2 ELSE 1 END)) AS u(k) WHERE answer IS NOT NULL),
tried AS (SELECT DISTINCT qid, run_id FROM nat),
og AS (SELECT qid, run_id, count(*) AS seen, min(defect) AS defect, min(outcome) AS outcome FROM ob GROUP BY ALL),
nd AS (SELECT ex.qid, ex.run_id, CASE WHEN seen > 1 THEN 'duplicate' WHEN seen IS NULL AND tried.qid IS NOT NULL THEN 'retryable_incomplete' WHEN seen IS NULL THEN 'missing' WHEN defect IS NOT NULL THEN defect ELSE outcome END AS disposition
  FROM ex LEFT JOIN og ON og.qid = ex.qid AND og.run_id = ex.run_id LEFT JOIN tried ON tried.qid = ex.qid AND tried.run_id = ex.run_id),
cx AS (SELECT ex.qid, ex.run_id, CAST(i AS INT) AS idx FROM ex, unnest(range(11)) AS u(i)),
cd AS (SELECT cx.qid, cx.run_id, cx.idx, CASE WHEN nd.disposition = 'terminal_infrastructure_failure' THEN 'ineligible' WHEN nd.disposition <> 'complete' THEN CASE WHEN ck.qid IS NOT NULL THEN 'retryable_incomplete' ELSE 'missing' END WHEN ck.ans IS NOT NULL THEN 'complete' WHEN ck.qid IS NOT NULL THEN 'retryable_incomplete' ELSE 'missing' END AS disposition
  FROM cx JOIN nd ON nd.qid = cx.qid AND nd.run_id = cx.run_id LEFT JOIN ck ON ck.qid = cx.qid AND ck.run_id = cx.run_id AND ck.idx = cx.idx)
"""


def expected(t) -> DataFrame:
    return t.nat.select("qid").distinct().withColumn("run_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint"))))


def observations(t) -> DataFrame:
    twice = F.explode(F.sequence(F.lit(1), F.when((F.col("qid") % 13 == 0) & (F.col("run_id") == 0), 2).otherwise(1)))
    defect = F.when(F.col("qid") % 11 == 1, "schema_incompatible").when(F.col("qid") % 11 == 2, "manifest_incompatible")
    outcome = F.when(F.col("n_think") == 3, "terminal_infrastructure_failure").otherwise("complete")
    return t.nat.where("answer is not null").select(*RUN, defect.alias("defect"), outcome.alias("outcome"), twice.alias("k")).drop("k")


def natural_classes(t) -> DataFrame:
    return coverage.classify(expected(t), observations(t), t.nat.select(*RUN), RUN)


def checkpoint_classes(t) -> DataFrame:
    keys = [*RUN, "idx"]
    space = expected(t).withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(10)))).withColumn("idx", F.col("idx").cast("int"))
    rows = t.ck.where("ans is not null").select(*RUN, F.col("idx").cast("int").alias("idx"), F.lit(None).cast("string").alias("defect"), F.lit("complete").alias("outcome"))
    tried = t.ck.select(*RUN, F.col("idx").cast("int").alias("idx"))
    return coverage.classify_checkpoints(space, rows, tried, natural_classes(t), RUN, keys)


@query("cov01", f"{COVER} SELECT qid, run_id, disposition FROM nd")
def cov01(t):
    return natural_classes(t)


@query("cov02", f"{COVER} SELECT qid, run_id, idx, disposition FROM cd")
def cov02(t):
    return checkpoint_classes(t)


_PART = "SELECT kind, disposition, count(n.disposition) AS n FROM (SELECT '{0}' AS kind, unnest([{1}]) AS d) k LEFT JOIN {2} n ON n.disposition = k.d GROUP BY kind, k.d"
_BOTH = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, k.d AS disposition, count(x.disposition) AS n FROM (SELECT unnest([{', '.join(repr(v) for v in names)}]) AS d) k LEFT JOIN {table} x ON x.disposition = k.d GROUP BY k.d"
    for kind, names, table in (("natural", coverage.NATURAL, "nd"), ("checkpoint", coverage.CHECKPOINT, "cd"))
)


def _partitions(t):
    a = coverage.partition(natural_classes(t), coverage.NATURAL).withColumn("kind", F.lit("natural"))
    return a, coverage.partition(checkpoint_classes(t), coverage.CHECKPOINT).withColumn("kind", F.lit("checkpoint"))


@query("cov03", f"{COVER}, pt AS ({_BOTH}) SELECT * FROM pt")
def cov03(t):
    """The exhaustive partitions of both key spaces."""
    a, b = _partitions(t)
    return a.unionByName(b).select("kind", "disposition", "n")


@query("cov03_ready", f"{COVER}, z AS (SELECT (SELECT count(*) FROM nd WHERE disposition NOT IN ('complete', 'terminal_infrastructure_failure')) = 0 AND (SELECT count(*) FROM cd WHERE disposition IN ('retryable_incomplete', 'missing', 'duplicate')) = 0 AS c, (SELECT count(*) FROM nd WHERE disposition = 'terminal_infrastructure_failure') AS f) SELECT c AS coverage_complete, c AS structurally_valid, c AND f = 0 AS paper_analysis_ready FROM z")
def cov03_ready(t):
    a, b = _partitions(t)
    return coverage.readiness(a, b)


#: The statuses of a run's and of a checkpoint's output, all values of each (fixed values of the data model).
NATURAL_STATUS = {
    "stop_reason": ["eos", "max_new_tokens", "stopping_criterion", "error", "other"],
    "reasoning_status": ["closed", "missing_close", "no_reasoning", "malformed"],
    "answer_parse_status": ["parsed", "missing", "malformed", "out_of_domain"],
    "confidence_parse_status": ["parsed", "missing", "malformed", "out_of_range"],
}
CHECKPOINT_STATUS = {
    "checkpoint_model_output_status": ["valid", "invalid"],
    "answer_parse_status": ["parsed", "missing", "malformed", "out_of_domain"],
    "confidence_parse_status": ["parsed", "missing", "malformed", "out_of_range"],
    "answer_token_status": ["located", "missing", "ambiguous", "unsupported"],
    "entropy_status": ["computed", "unavailable", "invalid"],
}
_DIMS = {"answer": ["A", "B", "C", "D"], "verdict": ["right", "wrong"], "closed": ["yes", "no"]}
_MODEL = "mo AS (SELECT answer, CASE WHEN answer = gold THEN 'right' ELSE 'wrong' END AS verdict, CASE WHEN n_ck = 11 THEN 'yes' ELSE 'no' END AS closed FROM nat WHERE answer IS NOT NULL)"
_NATURAL_SQL = {
    "stop_reason": "CASE WHEN n_ck = 11 THEN 'eos' WHEN n_ck > 5 THEN 'max_new_tokens' WHEN qid % 7 = 0 THEN 'error' ELSE 'stopping_criterion' END",
    "reasoning_status": "CASE WHEN n_think = 0 THEN 'no_reasoning' WHEN n_ck = 11 THEN 'closed' WHEN qid % 5 = 0 THEN 'malformed' ELSE 'missing_close' END",
    "answer_parse_status": "CASE WHEN answer IS NOT NULL THEN 'parsed' WHEN qid % 3 = 0 THEN 'out_of_domain' ELSE 'missing' END",
    "confidence_parse_status": "CASE WHEN confidence IS NULL THEN 'missing' WHEN confidence > 0.9 THEN 'out_of_range' ELSE 'parsed' END",
}
_CHECKPOINT_SQL = {
    "checkpoint_model_output_status": "CASE WHEN ans IS NOT NULL AND conf <= 0.9 THEN 'valid' ELSE 'invalid' END",
    "answer_parse_status": "CASE WHEN ans IS NOT NULL THEN 'parsed' WHEN idx % 3 = 0 THEN 'malformed' ELSE 'missing' END",
    "confidence_parse_status": "CASE WHEN conf IS NULL THEN 'missing' WHEN conf > 0.9 THEN 'out_of_range' ELSE 'parsed' END",
    "answer_token_status": "CASE WHEN ans IS NULL THEN 'unsupported' WHEN idx = 4 THEN 'ambiguous' ELSE 'located' END",
    "entropy_status": "CASE WHEN ent IS NULL THEN 'unavailable' WHEN ent > 4.9 THEN 'invalid' ELSE 'computed' END",
}


def _status_sql(source: str, exprs: dict, domains: dict) -> str:
    names = list(domains)
    cells = ", ".join(f"(SELECT unnest([{', '.join(repr(v) for v in vs)}]) AS {k})" for k, vs in domains.items())
    on = " AND ".join(f"m.{k} = c.{k}" for k in names)
    return f"ms AS (SELECT {', '.join(f'{e} AS {k}' for k, e in exprs.items())} FROM {source}), cells AS (SELECT * FROM {cells}) SELECT {', '.join(f'c.{k}' for k in names)}, count(m.{names[0]}) AS n FROM cells c LEFT JOIN ms m ON {on} GROUP BY ALL"


@query("cov04", _status_sql("ck", _CHECKPOINT_SQL, CHECKPOINT_STATUS))
def cov04(t):
    """Checkpoints' outputs: counts over the whole product of five statuses."""
    rows = t.ck.select(*[F.expr(e).alias(k) for k, e in _CHECKPOINT_SQL.items()])
    return coverage.matrix(rows, CHECKPOINT_STATUS)


@query("cov04_natural", _status_sql("nat", _NATURAL_SQL, NATURAL_STATUS))
def cov04_natural(t):
    """Runs' outputs: counts over the whole product of four statuses."""
    rows = t.nat.select(*[F.expr(e).alias(k) for k, e in _NATURAL_SQL.items()])
    return coverage.matrix(rows, NATURAL_STATUS)


def _model_rows(t):
    verdict = F.when(F.col("answer") == F.col("gold"), "right").otherwise("wrong")
    return t.nat.where("answer is not null").select("answer", verdict.alias("verdict"), F.when(F.col("n_ck") == 11, "yes").otherwise("no").alias("closed"))


@query("jn07", f"{_MODEL}, cells AS (SELECT answer, closed FROM (SELECT unnest(['A', 'B', 'C', 'D']) AS answer), (SELECT unnest(['yes', 'no']) AS closed)) SELECT c.answer, c.closed, count(m.answer) AS n FROM cells c LEFT JOIN mo m ON m.answer = c.answer AND m.closed = c.closed GROUP BY ALL")
def jn07(t):
    """All combinations of two enumerations with their counts, zeros kept."""
    return coverage.matrix(_model_rows(t), {k: _DIMS[k] for k in ("answer", "closed")})


@query("jn08", f"{COVER} SELECT count(*) AS keys, count(DISTINCT qid) AS questions FROM cx")
def jn08(t):
    """The expected key space: questions by runs by checkpoints."""
    space = expected(t).withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(10))))
    return space.agg(F.count(F.lit(1)).alias("keys"), F.countDistinct("qid").alias("questions"))


@query("jn06", f"{COVER} SELECT 'missing' AS side, qid, run_id FROM (SELECT qid, run_id FROM ex EXCEPT SELECT qid, run_id FROM nat) UNION ALL SELECT 'unexpected', qid, run_id FROM (SELECT qid, run_id FROM nat EXCEPT SELECT qid, run_id FROM ex)")
def jn06(t):
    """Expected but absent, and present but unexpected keys."""
    have = t.nat.select(*RUN)
    a = expected(t).join(have, RUN, "left_anti").withColumn("side", F.lit("missing"))
    return a.unionByName(have.join(expected(t), RUN, "left_anti").withColumn("side", F.lit("unexpected"))).select("side", *RUN)


_SHARDS = f"""{COVER}, fl AS (SELECT qid % 16 AS shard, 'natural' AS kind, CAST(qid AS VARCHAR) || ':' || run_id AS line FROM ob UNION ALL SELECT qid % 16, 'checkpoint', CAST(qid AS VARCHAR) || ':' || run_id || ':' || idx FROM ck WHERE ans IS NOT NULL UNION ALL SELECT qid % 16, 'audit', CAST(qid AS VARCHAR) || ':' || run_id FROM tried),
inv AS (SELECT shard, kind, count(*) AS lines, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes, CAST(sum(('0x' || substr(md5(line), 1, 8))::BIGINT) AS BIGINT) AS mark FROM fl GROUP BY ALL),
sh AS (SELECT qid % 16 AS shard, count(*) AS observed, count(DISTINCT qid * 1000 + run_id) AS keys, count(*) FILTER (defect IS NOT NULL) AS defects FROM ob GROUP BY ALL),
at2 AS (SELECT qid % 16 AS shard, count(*) AS attempted FROM tried GROUP BY ALL)"""


def _files(t):
    """The lines of each shard's three files: observed runs, usable checkpoints, attempted runs."""
    shard = F.pmod("qid", F.lit(16)).alias("shard")
    line = lambda *c: F.concat_ws(":", *[F.col(x).cast("string") for x in c]).alias("line")
    a = observations(t).select(shard, F.lit("natural").alias("kind"), line(*RUN))
    b = t.ck.where("ans is not null").select(shard, F.lit("checkpoint").alias("kind"), line(*RUN, "idx"))
    return a.unionByName(b).unionByName(t.nat.select(shard, F.lit("audit").alias("kind"), line(*RUN)))


@query("cov05", f"{_SHARDS} SELECT inv.shard, kind, lines, bytes, mark, attempted, observed, keys, defects FROM inv JOIN at2 USING (shard) JOIN sh USING (shard)")
def cov05(t):
    """What a scan of each shard finds: its files, the keys attempted there, what was observed, and defects."""
    found = observations(t).withColumn("shard", F.pmod("qid", F.lit(16)))
    found = found.groupBy("shard").agg(F.count(F.lit(1)).alias("observed"), F.countDistinct(*RUN).alias("keys"), F.count("defect").alias("defects"))
    tried = t.nat.groupBy(F.pmod("qid", F.lit(16)).alias("shard")).agg(F.countDistinct(*RUN).alias("attempted"))
    return coverage.inventory(_files(t), ["shard", "kind"], "line").join(tried, "shard").join(found, "shard").select("shard", "kind", "lines", "bytes", "mark", "attempted", "observed", "keys", "defects")


@query("cov06", f"{_SHARDS}, it AS (SELECT string_agg('shard-' || lpad(CAST(shard AS VARCHAR), 3, '0') || '/' || kind || ':' || bytes || ':' || mark, ',' ORDER BY shard, kind) AS files FROM inv) SELECT sha256('study-1|questions-1|model-0|' || files) AS report_id FROM it")
def cov06(t):
    """An identity of the report over its inputs: the manifests' and every file's path, size and mark, in whatever order they come."""
    files = coverage.inventory(_files(t), ["shard", "kind"], "line")
    path = F.concat(F.lit("shard-"), F.lpad(F.col("shard").cast("string"), 3, "0"), F.lit("/"), F.col("kind"))
    return coverage.report_identity(files.select(path.alias("path"), "bytes", "mark"), ["study-1", "questions-1", "model-0"])


@query("cov07", "sm AS (SELECT qid, run_id, answer, n_ck FROM nat WHERE qid % 50 < 2 AND run_id < 2) SELECT CASE WHEN answer IS NOT NULL THEN 'complete' WHEN n_ck = 11 THEN 'retryable_incomplete' ELSE 'missing' END AS disposition, count(*) AS n FROM sm GROUP BY ALL")
def cov07(t):
    """The partition of a smoke scope: a few questions and runs, simpler rules."""
    rows = t.nat.where("qid % 50 < 2 and run_id < 2")
    d = F.when(F.col("answer").isNotNull(), "complete").when(F.col("n_ck") == 11, "retryable_incomplete").otherwise("missing")
    return rows.groupBy(d.alias("disposition")).agg(F.count(F.lit(1)).alias("n"))


@query("stream01", f"{AUDIT} SELECT qid, run_id, attempt, attempt_id, CAST(max(CASE WHEN type = 'attempt_started' THEN 1 ELSE 0 END) AS INT) AS started, max_by(type, seq) FILTER (type <> 'attempt_started') AS last_closing, max(seq) AS last_seq FROM au GROUP BY ALL")
def stream01(t):
    """Attempt states from the log as a stream: several micro-batches, state carried between them."""
    from plumbline.sources.records import scratch
    from plumbline.streaming import lifecycle

    root = scratch(t.spark, "stream")
    rows = audit(t)
    rows.repartition(4).write.parquet(f"{root}/log")
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/log")
    lifecycle.keep_latest(lifecycle.attempt_states(stream, RUN), f"{root}/states", f"{root}/checkpoint").awaitTermination()
    return lifecycle.latest(t.spark.read.option("basePath", f"{root}/states").parquet(f"{root}/states"), RUN)


@query("stream02", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL", domain=False)
def stream02(t):
    """Events by type and hour; the same function runs on a stream under a watermark."""
    from plumbline.streaming import lifecycle

    return lifecycle.event_rates(t.read("events", "ts", "event_type"))
