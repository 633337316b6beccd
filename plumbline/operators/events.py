"""Attempt lifecycles out of an append-only event log.

Events are (key..., attempt, attempt_id, seq, type, record_id, retry_decision); terminal records
are (record_id, key..., attempt_id). All is grouped by attempt or key, which are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STARTED, FAILED, INTERRUPTED, COMPLETED, RECOVERED = "attempt_started", "attempt_failed", "attempt_interrupted", "attempt_completed", "terminal_result_recovered"
CLOSING = [FAILED, INTERRUPTED, COMPLETED, RECOVERED]


def matched(events: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``matches``: the event's record exists and has the event's attempt and key."""
    own = records.select("record_id", *[F.col(k).alias(f"__{k}") for k in keys], F.col("attempt_id").alias("__attempt"))
    got = events.join(own, "record_id", "left")
    same = F.col("__attempt") == F.col("attempt_id")
    for k in keys:
        same = same & (F.col(f"__{k}") == F.col(k))
    return got.withColumn("matches", F.coalesce(same, F.lit(False))).drop("__attempt", *[f"__{k}" for k in keys])


def consumed(events: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: started attempts and whether they are 1, 2, ... without a gap."""
    got = events.where(F.col("type") == STARTED).groupBy(*keys).agg(F.array_sort(F.collect_set("attempt")).alias("attempts"))
    top = F.array_max("attempts")
    return got.select(*keys, F.size("attempts").cast("bigint").alias("consumed"), (F.size("attempts") == top).alias("sequential"))


def attempts(events: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Per attempt: its closing events in order, how they match, and whether it has a record."""
    rows = matched(events, records, keys)
    item = F.when(F.col("type").isin(*CLOSING), F.struct("seq", "type", "matches", "retry_decision"))
    got = rows.groupBy(*keys, "attempt", "attempt_id").agg(
        F.count_if(F.col("type") == STARTED).alias("starts"),
        F.min_by("type", "seq").alias("first_type"),
        F.array_sort(F.collect_list(item)).alias("closing"),
    )
    return got.join(records.select("attempt_id").distinct().withColumn("has_record", F.lit(True)), "attempt_id", "left").withColumn("has_record", F.coalesce("has_record", F.lit(False)))


def coherent() -> Column:
    """Which ordered lists of closing events make sense, with their matches and the attempt's record."""
    types = F.transform("closing", lambda c: c["type"])
    hits = F.transform("closing", lambda c: c["matches"])
    record = F.col("has_record")
    is_ = lambda *t: types == F.array(*[F.lit(x) for x in t])
    hit = lambda *b: hits == F.array(*[F.lit(x) for x in b])
    spent = lambda i: F.coalesce(F.get("closing", F.lit(i))["retry_decision"] == "exhausted", F.lit(False))
    return (
        F.when(F.size("closing") == 0, True)
        .when(is_(FAILED) | is_(INTERRUPTED), ~record)
        .when(is_(COMPLETED) | is_(RECOVERED), hit(True))
        .when(is_(RECOVERED, COMPLETED), hit(True, True))
        .when(is_(COMPLETED, INTERRUPTED), hit(False, False) & ~record)
        .when(is_(INTERRUPTED, COMPLETED), record & spent(0) & hit(False, True))
        .when(is_(COMPLETED, INTERRUPTED, COMPLETED), record & spent(1) & hit(True, False, True))
        .otherwise(False)
    )


def findings(events: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """(finding, id): records without completion, attempts without start, orphans, and wrong completions."""
    rows = matched(events, records, keys)
    done = rows.where(F.col("type").isin(COMPLETED, RECOVERED) & F.col("matches")).select("record_id").distinct()
    lost = records.join(done, "record_id", "left_anti").select(F.lit("missing_completion").alias("finding"), F.col("record_id").alias("id"))
    a = attempts(events, records, keys)
    known = a.select("attempt_id", "starts").unionByName(records.select("attempt_id", F.lit(0).cast("bigint").alias("starts"))).groupBy("attempt_id").agg(F.sum("starts").alias("starts"))
    unstarted = known.where("starts = 0").select(F.lit("missing_start").alias("finding"), F.col("attempt_id").alias("id"))
    orphan = a.where((F.col("starts") > 0) & (F.size("closing") == 0) & ~F.col("has_record")).select(F.lit("orphaned").alias("finding"), F.col("attempt_id").alias("id"))
    wrong = F.exists("closing", lambda c: c["type"].isin(COMPLETED, RECOVERED) & ~c["matches"]) & ~F.exists("closing", lambda c: c["type"] == INTERRUPTED)
    wrong = a.where(wrong).select(F.lit("inconsistent_completion").alias("finding"), F.col("attempt_id").alias("id"))
    return lost.unionByName(unstarted).unionByName(orphan).unionByName(wrong)


def terminalization(events: DataFrame, records: DataFrame, keys: list[str], limit: int = 3) -> DataFrame:
    """Keys without a record whose last allowed attempt has no closure, or an exhausted one."""
    closes = F.col("type").isin(FAILED, INTERRUPTED)
    started = F.max(F.when(F.col("type") == STARTED, F.col("attempt")))
    top = events.groupBy(*keys).agg(started.alias("last")).where(F.col("last") >= limit)
    rows = events.join(top, keys).where(F.col("attempt") == F.col("last"))
    got = rows.groupBy(*keys).agg(F.max_by(F.when(closes, F.col("retry_decision")), F.when(closes, F.col("seq"))).alias("decision"), F.count_if(closes).alias("closures"))
    return got.where((F.col("closures") == 0) | (F.col("decision") == "exhausted")).join(records.select(*keys).distinct(), keys, "left_anti").select(*keys)


def resume(work: DataFrame, events: DataFrame, records: DataFrame, keys: list[str], limit: int = 3) -> DataFrame:
    """Per work item: what to do next, why, and the next attempt's number."""
    started = F.count_distinct(F.when(F.col("type") == STARTED, F.col("attempt")))
    fail = F.col("type") == FAILED
    got = events.groupBy(*keys).agg(started.alias("attempts"), F.max_by(F.when(fail, F.col("retry_class")), F.when(fail, F.col("seq"))).alias("last_class"))
    out = work.join(records.select(*keys, "outcome"), keys, "left").join(got, keys, "left")
    out = out.join(terminalization(events, records, keys, limit).withColumn("spent", F.lit(True)), keys, "left")
    n = F.coalesce("attempts", F.lit(0))
    status = F.when(F.col("outcome") == "complete", "completed").when(F.col("outcome").isNotNull(), "terminal").when(F.col("last_class") == "terminal", "terminal").when(F.col("spent"), "terminalization_required").otherwise("retryable")
    reason = (
        F.when(F.col("outcome") == "complete", "terminal_result_exists")
        .when(F.col("outcome").isNotNull(), "terminal_infrastructure_failure")
        .when(F.col("last_class") == "terminal", "nonretryable_failure")
        .when(F.col("spent"), "terminal_result_required")
        .when(n == 0, "not_started")
        .otherwise("retryable_interruption_or_failure")
    )
    return out.select(*keys, status.alias("status"), reason.alias("reason"), n.cast("bigint").alias("attempts"), F.when(status == "retryable", n + 1).cast("bigint").alias("next_attempt"))


def reconcile(events: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Events to append: recoveries of records without completion, interruptions of orphans."""
    found = findings(events, records, keys)
    last = events.groupBy("attempt_id").agg(F.max("seq").alias("seq"))
    rec = found.where("finding = 'missing_completion'").join(records.select(F.col("record_id").alias("id"), "attempt_id"), "id")
    rec = rec.select("attempt_id", F.lit(RECOVERED).alias("type"), F.col("id").alias("record_id"))
    orphan = found.where("finding = 'orphaned'").select(F.col("id").alias("attempt_id"), F.lit(INTERRUPTED).alias("type"), F.lit(None).cast("bigint").alias("record_id"))
    return rec.unionByName(orphan).join(last, "attempt_id", "left").select("attempt_id", (F.coalesce("seq", F.lit(-1)) + 1).cast("bigint").alias("seq"), "type", "record_id")


def order_errors(events: DataFrame) -> DataFrame:
    """Events whose sequence doesn't rise in physical order within their attempt, or whose identifier recurs."""
    earlier = F.lag("seq").over(Window.partitionBy("attempt_id").orderBy("place"))
    a = events.withColumn("p", earlier).where("seq <= p").select("event_id", F.lit("sequence_not_increasing").alias("error"))
    b = events.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("event_id", F.lit("duplicate_event_id").alias("error"))
    return a.unionByName(b)
