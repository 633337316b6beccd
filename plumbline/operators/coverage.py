"""Coverage of a fixed space of keys: one disposition for each expected key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NATURAL = ["complete", "terminal_infrastructure_failure", "retryable_incomplete", "missing", "duplicate", "schema_incompatible", "manifest_incompatible"]
CHECKPOINT = ["complete", "terminal_infrastructure_failure", "retryable_incomplete", "missing", "duplicate", "ineligible"]
OUTCOMES = ["complete", "terminal_infrastructure_failure"]


def natural_disposition(seen: Column, attempted: Column, defect: Column, outcome: Column) -> Column:
    """Duplicates go before all; then absence, then defects, then the outcome."""
    return (
        F.when(seen > 1, "duplicate")
        .when((seen == 0) & attempted, "retryable_incomplete")
        .when(seen == 0, "missing")
        .when(defect.isNotNull(), defect)
        .when(outcome.isin(*OUTCOMES), outcome)
        .otherwise("schema_incompatible")
    )


def checkpoint_disposition(seen: Column, attempted: Column, defect: Column, outcome: Column, parent: Column) -> Column:
    """Beneath a failed parent a key is ineligible; beneath another that isn't complete nothing counts as there."""
    unusable = F.when(attempted, "retryable_incomplete").otherwise("missing")
    below = F.when(seen > 1, "duplicate").otherwise(unusable)
    own = F.when(seen > 1, "duplicate").when((seen == 0) | defect.isNotNull() | ~F.coalesce(outcome.isin(*OUTCOMES), F.lit(False)), unusable).otherwise(outcome)
    return F.when(parent == "terminal_infrastructure_failure", "ineligible").when(parent != "complete", below).otherwise(own)


def observed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: seen, defect and outcome of its observations (of the least where there are more)."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("seen"), F.min("defect").alias("defect"), F.min("outcome").alias("outcome"))


def classify(expected: DataFrame, rows: DataFrame, attempted: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys with their disposition as runs."""
    got = expected.join(observed(rows, keys), keys, "left").join(attempted.select(*keys).distinct().withColumn("attempted", F.lit(True)), keys, "left")
    seen, tried = F.coalesce("seen", F.lit(0)), F.coalesce("attempted", F.lit(False))
    return got.select(*expected.columns, natural_disposition(seen, tried, F.col("defect"), F.col("outcome")).alias("disposition"))


def classify_checkpoints(expected: DataFrame, rows: DataFrame, attempted: DataFrame, parents: DataFrame, parent_keys: list[str], keys: list[str]) -> DataFrame:
    """Expected checkpoint keys with their disposition, given their parents'."""
    got = expected.join(observed(rows, keys), keys, "left").join(attempted.select(*keys).distinct().withColumn("attempted", F.lit(True)), keys, "left")
    got = got.join(parents.select(*parent_keys, F.col("disposition").alias("parent")), parent_keys)
    seen, tried = F.coalesce("seen", F.lit(0)), F.coalesce("attempted", F.lit(False))
    return got.select(*expected.columns, checkpoint_disposition(seen, tried, F.col("defect"), F.col("outcome"), F.col("parent")).alias("disposition"))


def partition(classified: DataFrame, names: list[str]) -> DataFrame:
    """Counts of all dispositions, zeros included."""
    domain = classified.sparkSession.createDataFrame([(x,) for x in names], "disposition string")
    counts = classified.groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))
    return domain.join(counts, "disposition", "left").select("disposition", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def matrix(rows: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    """Counts over all combinations of some enumerations, zeros included."""
    cells = rows.sparkSession.range(1).select(*[F.lit(0).alias("__one")])
    for name, values in domains.items():
        cells = cells.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    counts = rows.groupBy(*domains).agg(F.count(F.lit(1)).alias("n"))
    return cells.drop("__one").join(counts, list(domains), "left").select(*domains, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def readiness(natural: DataFrame, checkpoints: DataFrame, unexpected: Column | int = 0) -> DataFrame:
    """Three independent verdicts: complete coverage, a valid structure, ready for analysis."""
    total = lambda df, names, a: df.agg(F.sum(F.when(F.col("disposition").isin(*names), F.col("n")).otherwise(0)).alias(a))
    defects = [x for x in NATURAL if x not in OUTCOMES]
    a = total(natural, defects, "nd").join(F.broadcast(total(natural, ["terminal_infrastructure_failure"], "nt")))
    b = total(checkpoints, ["retryable_incomplete", "missing", "duplicate"], "cd").join(F.broadcast(total(checkpoints, ["terminal_infrastructure_failure"], "ct")))
    both = a.join(F.broadcast(b))
    covered = (F.col("nd") == 0) & (F.col("cd") == 0)
    valid = covered & (F.lit(unexpected) == 0)
    return both.select(covered.alias("coverage_complete"), valid.alias("structurally_valid"), (valid & (F.col("nt") + F.col("ct") == 0)).alias("paper_analysis_ready"))


def inventory(lines: DataFrame, files: list[str], line: str) -> DataFrame:
    """Per file: lines, bytes and a mark that does not depend on the lines' order (the sum of their digests' first 32 bits)."""
    mark = F.conv(F.substring(F.md5(F.col(line).cast("binary")), 1, 8), 16, 10).cast("bigint")
    return lines.groupBy(*files).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length(line) + 1).cast("bigint").alias("bytes"), F.sum(mark).alias("mark"))


def report_identity(files: DataFrame, manifests: list[str]) -> DataFrame:
    """The digest of a report's inputs: manifests as given, and files (path, bytes, mark) by path. An inventory has a row a file."""
    item = F.concat_ws(":", "path", F.col("bytes").cast("string"), F.col("mark").cast("string"))
    got = files.agg(F.array_sort(F.collect_list(item)).alias("every"))
    return got.select(F.sha2(F.concat_ws("|", *[F.lit(m) for m in manifests], F.array_join("every", ",")).cast("binary"), 256).alias("report_id"))
