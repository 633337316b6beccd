"""Record files: strict and lenient JSON lines, typed CSV, Parquet, atomic publishing.

Lines are read as text with their place, so any number of files and sizes is split among tasks.
Physical order in a file comes from the byte order of its splits: ``_metadata.file_block_start``
and the row's number in it.
"""

from __future__ import annotations

import atexit
import contextlib
import itertools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, MapType, StructType

_run, _count = uuid.uuid4().hex[:12], itertools.count()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.gettempdir()
    top, n = f"{root.rstrip('/')}/records-{_run}", next(_count)
    if n == 0:
        atexit.register(_sweep, spark, top)
    return f"{top}/{n:04d}-{name}"


def _sweep(spark: SparkSession, top: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        fs, path = _fs(spark, top)
        fs.delete(path, True)


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): the lines of text files, numbered from 1 in each.

    A file that goes to one task is numbered by its reader's order; a file over many splits is
    numbered by a running sum over its splits, never by a sort of all its lines.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"))
    rows = rows.withColumn("part", F.shiftright("m", 33)).withColumn("nth", F.col("m").bitwiseAND(F.lit((1 << 33) - 1)))
    spans = rows.groupBy("file", "part", "block").agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("file", "part", "block", "first", before.alias("before"))
    return rows.join(spans, ["file", "part", "block"]).select("file", (F.col("before") + F.col("nth") - F.col("first") + 1).alias("line_no"), "value")


def strict(rows: DataFrame, schema: str) -> DataFrame:
    """Lines with their record and status: ``record``, ``tail`` (a bad last line) or ``malformed_middle``."""
    last = rows.groupBy("file").agg(F.max("line_no").alias("last"))
    parsed = rows.join(last, "file").withColumn("record", F.from_json("value", f"{schema}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    ok = F.col("record").isNotNull() & F.col("record._bad").isNull() & F.col("value").rlike(r"^\s*\{")
    return parsed.withColumn("status", F.when(ok, "record").when(F.col("line_no") == F.col("last"), "tail").otherwise("malformed_middle"))


def reject_middle(rows: DataFrame) -> DataFrame:
    """The records of ``strict`` lines; running it fails if a line before the last is malformed."""
    fail = F.raise_error(F.concat(F.lit("malformed JSON in "), F.col("file"), F.lit(" at line "), F.col("line_no").cast("string")))
    checked = rows.withColumn("status", F.when(F.col("status") == "malformed_middle", fail.cast("string")).otherwise(F.col("status")))
    return checked.where("status = 'record'")


def lenient(rows: DataFrame, schema: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Records with a key, and the errors as (place, message)."""
    parsed = rows.withColumn("record", F.from_json("value", f"{schema}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("record").isNull() | F.col("record._bad").isNotNull() | ~F.col("value").rlike(r"^\s*\{")
    message = F.when(bad, "malformed JSON").when(F.col(f"record.{key}").isNull(), "unassignable row")
    tagged = parsed.withColumn("message", message)
    errors = tagged.where("message is not null").select(F.concat_ws(":", "file", F.col("line_no").cast("string")).alias("place"), "message")
    return tagged.where("message is null").select("record.*").drop("_bad"), errors


def write_parquet(df: DataFrame, path: str) -> None:
    """Parquet as the merged tables are kept: zstd, no dictionary, an error if the path is there."""
    df.write.mode("errorifexists").option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)


def csv_cell(c: Column, kind) -> Column:
    """A cell's text: null empty, booleans in lower case, nested values as JSON, numbers in their shortest form."""
    if isinstance(kind, (ArrayType, StructType, MapType)):
        return F.to_json(c)
    if isinstance(kind, BooleanType):
        return F.when(c, "true").when(~c, "false")
    if isinstance(kind, (DoubleType, FloatType)):
        finite = ~F.isnan(c) & (F.abs(c) != float("inf"))
        return F.when(c.isNull(), None).when(finite, c.cast("string")).otherwise(F.raise_error(F.lit("a CSV cell must be finite")).cast("string"))
    return c.cast("string")


def write_csv(df: DataFrame, path: str) -> None:
    """Typed CSV with a header and LF line ends."""
    cells = df.select(*[csv_cell(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
    cells.write.mode("errorifexists").csv(path, header=True, nullValue="", emptyValue='""', lineSep="\n")


#: Canonical texts by contract type.
CANONICAL = {"boolean": "^(true|false)$", "integer": "^(0|-?[1-9][0-9]*)$", "finite_float": r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE]-?[0-9]+)?$"}
_CAST = {"boolean": "boolean", "integer": "bigint", "finite_float": "double", "string": "string"}


def read_csv(spark: SparkSession, path: str, contract: dict[str, tuple[str, bool]]) -> DataFrame:
    """CSV by a contract of (type, nullable); a noncanonical number or a null where none may be fails."""
    raw = spark.read.csv(path, schema=", ".join(f"`{c}` STRING" for c in contract), header=True, enforceSchema=False, mode="FAILFAST", nullValue="")
    out = []
    for c, (kind, nullable) in contract.items():
        cell = F.col(f"`{c}`")
        bad = F.lit(False) if nullable else cell.isNull()
        if kind in CANONICAL:
            bad = bad | (cell.isNotNull() & ~cell.rlike(CANONICAL[kind]))
        checked = F.when(bad, F.raise_error(F.lit(f"column {c} has a cell that breaks its contract")).cast("string")).otherwise(cell)
        out.append(checked.cast(_CAST[kind]).alias(c))
    return raw.select(*out)


def publish(df: DataFrame, path: str) -> None:
    """Writes beside the path, reads back and compares, then renames; never over what is there.

    The check and the rename are two steps: on a store without atomic renames a second writer could come
    in between, so one writer at a time publishes to a path there.
    """
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    stage = f"{path}.stage-{uuid.uuid4().hex[:8]}"
    write_parquet(df, stage)
    back = spark.read.schema(df.schema).parquet(stage)
    if not same_bag(df, back):
        raise ValueError("what was staged differs from what was meant")
    _, staged = _fs(spark, stage)
    if not fs.rename(staged, target):
        raise FileExistsError(path)


def same_bag(a: DataFrame, b: DataFrame) -> bool:
    """Equal rows with equal counts: counts and sums of two hashes, one small row from each side."""

    def mark(df: DataFrame):
        cols = [F.col(f"`{c}`") for c in sorted(df.columns)]
        one, two = F.xxhash64(*cols), F.xxhash64(F.lit("2"), *cols)
        return tuple(df.agg(F.count(F.lit(1)), F.sum(one.cast("decimal(38,0)")), F.sum(two.cast("decimal(38,0)"))).first())

    return mark(a) == mark(b)


def sample_by(df: DataFrame, stratum: str, ident: str, quota: int, seed: int = 42) -> DataFrame:
    """The rows with the least seeded digests of each stratum, with their place from 0.

    Each task keeps its own least first, so a stratum isn't sorted in one place.
    """
    key, nth = "__key", "__nth"
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(key, ident))
    rows = df.withColumn(key, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ident).cast("string")).cast("binary"))).withColumn(nth, rank)
    # The bound on the rank itself is what lets tasks drop the rest before the exchange.
    return rows.where(F.col(nth) <= quota).withColumn("place", F.col(nth) - 1).drop(key, nth)


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, bytes, sha256) of the files under a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def unchanged(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """The files as they were, and whether each still has its bytes and digest; a file that is gone or new has changed."""
    now = after.select(F.col(key).alias("__key"), F.col("bytes").alias("__bytes"), F.col("sha256").alias("__sha"))
    both = before.join(now, F.col(key) == F.col("__key"), "full")
    same = F.col("bytes").eqNullSafe(F.col("__bytes")) & F.col("sha256").eqNullSafe(F.col("__sha"))
    return both.select(F.coalesce(key, "__key").alias(key), "bytes", "sha256", same.alias("unchanged"))


def create_once(spark: SparkSession, path: str, text: str) -> None:
    """Makes a file that isn't there yet; the file system refuses a second one, so of two writers one fails."""
    fs, target = _fs(spark, path)
    try:
        out = fs.create(target, False)
    except Exception as e:
        if fs.exists(target):
            raise FileExistsError(path) from e
        raise
    try:
        out.write(bytearray(text.encode()))
        out.hsync()
    finally:
        out.close()


def write_report(table: DataFrame, path: str, sink: str) -> None:
    """A small sorted table as lines of text: ``latex``, ``markdown`` or ``json``."""
    names = table.columns
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names]
    if sink == "json":
        table.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])).alias("value")).coalesce(1).write.text(path)
        return
    if sink == "latex":
        numbers = [f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal") for f in table.schema.fields]
        before = [f"\\begin{{tabular}}{{{''.join('r' if x else 'l' for x in numbers)}}}", " & ".join(names) + " \\\\"]
        row, after = F.concat(F.concat_ws(" & ", *text), F.lit(" \\\\")), ["\\end{tabular}"]
    elif sink == "markdown":
        before = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
        row, after = F.concat(F.lit("| "), F.concat_ws(" | ", *text), F.lit(" |")), []
    else:
        raise ValueError(f"unknown sink: {sink}")
    lines = [x["v"] for x in table.select(row.alias("v")).collect()]  # a report is small
    spark = table.sparkSession
    spark.createDataFrame([(x,) for x in [*before, *lines, *after]], "value string").coalesce(1).write.text(path)


def audit_keys() -> list:
    """The nine keys of the audit log's order: shard, shard events first, question, run, checkpoint, attempt, sequence, type, identifier."""
    number = lambda c, start: F.substring(c, start, 9).cast("int")
    return [
        number("shard_id", 7),
        F.when(F.col("event_scope") == "shard", 0).otherwise(1),
        F.coalesce("question_id", F.lit("")),
        F.coalesce("run_id", F.lit(-1)),
        F.coalesce(number("checkpoint_id", 4), F.lit(-2)),
        F.coalesce("attempt_number", F.lit(-1)),
        F.col("event_sequence"),
        F.col("event_type"),
        F.col("event_id"),
    ]


def kept(df: DataFrame, name: str) -> DataFrame:
    """A frame written to the run's folder and read back: what it was made of is not computed again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _finish(fs, path_of, file: str, good: str) -> None:
    """Puts the repaired lines in the file's place; may be repeated after any step."""
    parts = [x.getPath() for x in fs.listStatus(path_of(good)) if x.getPath().getName().startswith("part-")]
    if parts:
        fs.delete(path_of(file), False)
        if not fs.rename(parts[0], path_of(file)):
            raise OSError(f"{file} could not be put back")
    fs.delete(path_of(good), True)


def recover_tails(spark: SparkSession, pattern: str, schema: str, journal: str) -> list[tuple[str, int, str]]:
    """Repairs JSON-lines files whose last line is broken: (file, bytes, sha256 of what was cut off) of each.

    The cut bytes go to quarantine and an entry to the journal before the file is touched; both are files
    that can be made only once. A repair that stopped halfway is finished by the next call, and files
    without a broken end are left alone. A broken line before the last is an error. The driver goes
    through the repaired files one by one: they are logs, one writer at a time.
    """
    fs, _ = _fs(spark, journal)
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if fs.exists(path_of(journal)):
        for x in fs.listStatus(path_of(journal)):
            name = x.getPath().getName()
            if name.endswith(".good") and fs.exists(path_of(f"{journal}/{name}/_SUCCESS")):
                entry = spark.read.json(f"{journal}/{name.removesuffix('.good')}.json", schema="file STRING").first()
                _finish(fs, path_of, entry["file"], f"{journal}/{name}")
    rows = strict(lines(spark, pattern), schema)
    reject_middle(rows).count()
    found = rows.where("status = 'tail'").select("file", "value", F.octet_length("value").alias("bytes"), F.sha2(F.col("value").cast("binary"), 256).alias("sha256")).collect()  # a row a file
    out = []
    for r in sorted(found):
        name = f"{journal}/{uuid.uuid5(uuid.NAMESPACE_URL, r['file']).hex}.{r['sha256'][:16]}"
        entry = spark.createDataFrame([(r["file"], r["bytes"], r["sha256"])], "file string, bytes int, sha256 string").select(F.to_json(F.struct("*"))).first()[0]
        for end, text in ((".quarantine", r["value"]), (".json", entry)):
            with contextlib.suppress(FileExistsError):  # made by a repair that stopped halfway
                create_once(spark, name + end, text)
        good = rows.where((F.col("file") == r["file"]) & (F.col("status") == "record"))
        good.coalesce(1).sortWithinPartitions("line_no").select("value").write.mode("overwrite").text(f"{name}.good")
        _finish(fs, path_of, r["file"], f"{name}.good")
        out.append((r["file"], r["bytes"], r["sha256"]))
    return out
