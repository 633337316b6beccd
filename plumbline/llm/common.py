"""What the corpus operators share: the shared folder, staged tables, Arrow chunks."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of every word and normalisation rule here, as a regex class.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
#: Bytes of text that a Python worker takes in hand at once (a longer text is a chunk of its own).
CHUNK_BYTES = 1 << 20

_run = uuid.uuid4().hex[:12]
_paths: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A named input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this run that the driver and all executors see.

    It lies in ``spark.checkpoint.dir``. Only a session on one machine may have none; it gets a
    temporary folder, set as its checkpoint folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext.getCheckpointDir()
        root = known.rsplit("/", 1)[0] if known else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/plumbline-{_run}"


def _sweep(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone, and the folder with it
        delete(spark, path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; the folder goes when the driver ends."""
    top = shared_dir(spark)
    if not _paths:
        atexit.register(_sweep, spark, top)
    _paths.append(f"{top}/{len(_paths):05d}-{name}")
    return _paths[-1]


def written() -> int:
    """How many paths ``scratch`` has given out."""
    return len(_paths)


def forget(spark: SparkSession, start: int, end: int) -> None:
    """Removes what lies at the paths given out from ``start`` to before ``end``, once nothing reads it any more."""
    for path in _paths[start:end]:
        delete(spark, path)


def sweep(spark: SparkSession) -> None:
    """Lets shuffle files go: they stay until the driver collects the frames that made them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    """Removes a path of the shared folder."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def chunks(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Arrow batches cut to about CHUNK_BYTES of text, with the texts as UTF-8 (null: empty)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        data = column.cast(pa.large_binary())
        start = size = 0
        texts: list[bytes] = []
        for k in range(batch.num_rows):
            value = data[k].as_py() or b""
            if texts and size + len(value) > CHUNK_BYTES:
                yield batch.slice(start, len(texts)), texts
                start, size, texts = k, 0, []
            texts.append(value)
            size += len(value)
        yield batch.slice(start, len(texts)), texts
