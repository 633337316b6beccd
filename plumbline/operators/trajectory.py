"""Operators on the ordered checkpoints of a run, held as an array of eleven slots.

A slot is null where the checkpoint is missing. An alias repeats an earlier probe: it is passed
over. A missing checkpoint, or one without a valid answer, ends adjacency.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 11


def triad() -> Column:
    """Whether a checkpoint's answer, confidence and entropy are all there."""
    return (F.col("answer_status") == "parsed") & (F.col("confidence_status") == "parsed") & (F.col("entropy_status") == "computed")


def bundle_error() -> Column:
    """What is wrong with a checkpoint's statuses taken together; null if nothing is."""
    outputs = (F.col("output_status") == "valid") | (F.col("answer_status") != "missing") | (F.col("confidence_status") != "missing") | (F.col("entropy_status") != "unavailable")
    complete, valid = F.col("outcome") == "complete", F.col("output_status") == "valid"
    return F.when(~complete & outputs, "failure_with_outputs").when(complete & valid & ~triad(), "valid_without_triad").when(complete & ~valid & triad(), "invalid_with_triad")


def inheritance(children: DataFrame, parents: DataFrame, key: str, fields: list[str], ident: str) -> DataFrame:
    """Adds orphan, wrong_fields (inherited fields that differ from the parent's) and duplicate (an identifier met twice)."""
    side = parents.select(key, *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__here"))
    twice = children.groupBy(ident).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(ident, F.lit(True).alias("__twice"))
    got = children.join(side, key, "left").join(twice, ident, "left")
    wrong = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"__{f}")), f) for f in fields]))
    out = {"orphan": F.col("__here").isNull(), "wrong_fields": F.when(F.col("__here").isNull(), F.array().cast("array<string>")).otherwise(wrong), "duplicate": F.col("__twice").isNotNull()}
    return got.withColumns(out).drop(*[f"__{f}" for f in fields], "__here", "__twice")


def attached(parents: DataFrame, children: DataFrame, key: str, parent_key: str, index: str, fields: list[str]) -> DataFrame:
    """Parents with their children as eleven ordered slots (null where one is missing); orphans are an error."""
    orphans = children.join(parents.select(F.col(key).alias(parent_key)), parent_key, "left_anti")
    least = orphans.agg(F.min(parent_key).alias("k"), F.count(F.lit(1)).alias("n")).first()
    if least["n"]:
        raise ValueError(f"{least['n']} checkpoints have no run, the first of {least['k']}")
    got = children.groupBy(parent_key).agg(gathered(index, fields).alias("got")).withColumnRenamed(parent_key, key)
    empty = F.array().cast(got.schema["got"].dataType)
    return parents.join(got, key, "left").withColumn("got", F.coalesce("got", empty)).withColumn("slots", placed("got")).drop("got")


def gathered(index: str, fields: list[str]) -> Column:
    """An aggregate of a run's checkpoints; eleven at most are gathered, so its size is bounded."""
    item = F.struct(F.col(index).alias("i"), F.struct(*fields).alias("v"))
    return F.collect_list(F.when(F.col(index).between(0, SLOTS - 1), item))


def placed(got: str) -> Column:
    """The gathered checkpoints as an array by index, null where one is missing."""
    place = lambda i: F.get(F.filter(got, lambda g: g["i"] == i), F.lit(0))["v"]
    return F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), place)


def walk(column: str = "slots") -> Column:
    """switches, transitions, left_at (index of the first switch from right to wrong) and recovered, in one pass."""
    return F.expr(f"""
      aggregate(sequence(0, {SLOTS - 1}),
        named_struct('p', cast(null AS string), 'c', cast(null AS boolean), 'switches', 0L, 'transitions', 0L, 'left_at', cast(null AS int), 'recovered', false),
        (a, i) -> CASE
          WHEN {column}[i] IS NULL THEN named_struct('p', cast(null AS string), 'c', cast(null AS boolean), 'switches', a.switches, 'transitions', a.transitions, 'left_at', a.left_at, 'recovered', a.recovered)
          WHEN {column}[i].alias THEN a
          WHEN {column}[i].ans IS NULL THEN named_struct('p', cast(null AS string), 'c', cast(null AS boolean), 'switches', a.switches, 'transitions', a.transitions, 'left_at', a.left_at, 'recovered', a.recovered)
          ELSE named_struct('p', {column}[i].ans, 'c', {column}[i].correct,
            'switches', a.switches + if(a.p IS NOT NULL AND a.p <> {column}[i].ans, 1L, 0L),
            'transitions', a.transitions + if(a.p IS NOT NULL, 1L, 0L),
            'left_at', coalesce(a.left_at, if(a.p <> {column}[i].ans AND a.c AND NOT {column}[i].correct, i, null)),
            'recovered', a.recovered OR coalesce(a.left_at IS NOT NULL AND {column}[i].correct, false)) END)""")


def stabilization(column: str = "slots") -> Column:
    """Fraction from which all physical answers equal the last one; null if the last is missing or invalid."""
    end = f"{column}[{SLOTS - 1}]"
    return F.expr(f"""
      CASE WHEN {end}.ans IS NOT NULL THEN
        aggregate(reverse(sequence(0, {SLOTS - 1})), named_struct('ok', true, 'i', cast(null AS int)), (a, i) -> CASE
          WHEN {column}[i] IS NULL THEN named_struct('ok', false, 'i', a.i)
          WHEN {column}[i].alias THEN a
          WHEN {column}[i].ans = {end}.ans THEN if(a.ok, named_struct('ok', true, 'i', i), a)
          ELSE named_struct('ok', false, 'i', a.i) END).i / 10.0D END""")


def first_appearance(answer: Column, column: str = "slots") -> Column:
    """First fraction at which the natural answer shows, aliases too."""
    hits = F.filter(F.transform(column, lambda s, i: F.struct(i.alias("i"), (s["ans"] == answer).alias("ok"))), lambda x: x["ok"])
    return F.get(hits, F.lit(0))["i"] / F.lit(10.0)


def commit_and_flips(column: str = "slots") -> Column:
    """Index from which the present answers stay the same, and changes between neighbours; nulls compare as values."""
    return F.expr(f"""
      aggregate(filter(sequence(0, {SLOTS - 1}), i -> {column}[i] IS NOT NULL), named_struct('n', 0, 'p', cast(null AS string), 'commit_at', cast(null AS int), 'flips', 0L),
        (a, i) -> named_struct('n', a.n + 1, 'p', {column}[i].ans,
          'commit_at', if(a.n = 0 OR NOT (a.p <=> {column}[i].ans), i, a.commit_at),
          'flips', a.flips + if(a.n > 0 AND NOT (a.p <=> {column}[i].ans), 1L, 0L)))""")


def features(runs: DataFrame) -> DataFrame:
    """Adds the trajectory's events and the reason of each that is undefined."""
    end = F.get("slots", F.lit(SLOTS - 1))
    out = runs.withColumn("w", walk()).withColumns({"stabilization": stabilization(), "first_appearance": first_appearance(F.col("answer"))})
    agrees = F.when(F.col("answer").isNotNull() & end["ans"].isNotNull(), end["ans"] == F.col("answer"))
    return out.select(
        *[c for c in out.columns if c != "w"],
        F.col("w.switches").alias("switches"),
        F.col("w.transitions").alias("transitions"),
        F.col("w.left_at").alias("left_at"),
        F.col("w.recovered").alias("recovered"),
        F.when(F.col("answer").isNull(), "unavailable").when(F.col("first_appearance").isNull(), "not_found").otherwise("found").alias("appearance_status"),
        F.when(F.col("w.left_at").isNull(), "not_applicable").otherwise("evaluated").alias("recovery_status"),
        agrees.alias("endpoint_agrees"),
        F.when(F.col("answer").isNull(), "natural_answer_invalid_or_missing").when(end.isNull(), "checkpoint_1.0_missing").when(end["ans"].isNull(), "checkpoint_1.0_answer_invalid").alias("endpoint_reason"),
        F.when(end.isNull(), "checkpoint_1.0_missing").when(end["ans"].isNull(), "checkpoint_1.0_answer_invalid").when(F.col("stabilization").isNull(), "no_complete_stable_physical_suffix").alias("stabilization_reason"),
    )


def calibration_slots(runs: DataFrame, failed: Column | None = None) -> DataFrame:
    """A row per run and index with what calibration needs and why it is missing, reasons in fixed order."""
    rows = runs.withColumn("failed", failed if failed is not None else F.lit(False)).select("*", F.posexplode("slots").alias("idx", "s"))
    target = F.col("s.correct").isNotNull()
    reason = (
        F.when(F.col("failed"), "ineligible_natural_failure")
        .when(F.col("s").isNull(), "checkpoint_missing")
        .when(~target, "checkpoint_local_correctness_unavailable")
        .when(F.col("s.conf").isNull(), "checkpoint_confidence_not_parsed")
    )
    status = F.when(F.col("failed"), "ineligible_natural_failure").when(F.col("s").isNull(), "missing").otherwise("eligible")
    rows = rows.withColumns({"reason": reason, "eligibility": status})
    return rows.withColumn("confidence_used", F.when(F.col("reason").isNull(), F.col("s.conf"))).drop("failed")
