"""Exact dedup as a stateful stream.

Each batch of documents has a name. It is keyed by the digest of its normalised text and put
into an inbox in the shared folder under that name, once: a batch that is there is not taken
again, and one that stopped halfway leaves nothing in the inbox, as it is written beside it and
then renamed. A Structured Streaming query over the inbox keeps, in RocksDB state that never
expires, one entry per digest: the smallest identifier, where that document's content lies (its
file), and how many rows have come. State and offsets are kept in the shared folder, so a later
batch, or a restart after a lost executor, goes on from what is there.

Rows that hit an entry are then compared byte by byte with the content that the entry points
to, fetched by identifier and file; rows of one digest and unlike bytes are grouped by their
bytes instead. Only texts that may have hit are shuffled: a bitmap of the digests that came more
than once, of ``MOST_BITS`` bits at most, is broadcast, and a text whose bit isn't set stays
where it is. The bitmap only saves work: what it lets through by chance is joined like any other.
Everything is DataFrame operations.

Defined results: a null text counts as empty; a very long one is digested and compared whole; a
null identifier sorts last and may stay only if its group has no other; rows that repeat an
identifier with equal text (or have none, in a group without identifiers) count each and share
one verdict, so all of them are ``kept`` if one is, and ``keep`` returns one of them; an empty
table gives an empty result; columns of any other name are left out of sight, and ``keep`` hands
them on. On a store without atomic renames, no other writer may add a batch at the same time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import SPACE, fresh, scratch, stage

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State in RocksDB, of which an executor holds only the partitions it works on just now.
STATE_CONF = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.unloadOnCommit": "true"}
INBOX = "id BIGINT, digest STRING, place STRING"
#: Bits of the bitmap of repeated digests: 16 for each, and never more than this (128 MB).
BITS_EACH, MOST_BITS = 16, 1 << 30
#: Bits in a row of the bitmap (that of Spark's bitmap functions).
ROW_BITS = 1 << 15


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


class ExactDedup:
    """A deduplicating stream with its state in ``root`` (a folder that all executors share).

    ``digest`` makes the key from normalised text; any function of the text gives exact
    results, as bytes are compared, but a weak one costs more comparisons.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, digest: Callable[[Column], Column] = sha256):
        self.spark, self.digest = spark, digest
        self.root = root or scratch(spark, "exact-dedup")

    def add(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> bool:
        """Takes a named batch in, once; false if it was in already."""
        there = self._path(f"inbox/{batch}")
        fs = there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fresh_batch = not fs.exists(there)
        if fresh_batch:
            keyed = docs.select(
                F.col(f"`{id_col}`").cast("bigint").alias("id"),
                self.digest(normalised(F.col(f"`{text_col}`"))).alias("digest"),
                F.input_file_name().alias("place"),
            )
            keyed.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/coming/{batch}")
            fs.mkdirs(there.getParent())
            if not fs.rename(self._path(f"coming/{batch}"), there):
                raise OSError(f"batch {batch} could not be put into the inbox")
        self._advance()
        return fresh_batch

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _inbox(self, reader):
        return reader.schema(INBOX).option("recursiveFileLookup", "true").parquet(f"{self.root}/inbox")

    def _advance(self) -> None:
        spark = self.spark
        entry = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("place"))
        state = (
            self._inbox(spark.readStream)
            .groupBy("digest")
            .agg(F.min(entry).alias("first"), F.count(F.lit(1)).alias("n"))
        )
        before = {k: spark.conf.get(k) for k in STATE_CONF}
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        try:
            # Totals only grow, so a digest's last row holds; a batch written twice changes nothing.
            query = (
                state.writeStream.outputMode("update")
                .option("checkpointLocation", f"{self.root}/state")
                .trigger(availableNow=True)
                .foreachBatch(self._emit)
                .start()
            )
            query.awaitTermination()
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)

    def _emit(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/groups/batch={batch:08d}")

    def groups(self) -> DataFrame:
        """One row per digest so far: digest, keep_id, place, group_size."""
        schema = "digest STRING, first STRUCT<none: BOOLEAN, id: BIGINT, place: STRING>, n BIGINT"
        return (
            self.spark.read.schema(schema)
            .option("basePath", f"{self.root}/groups")
            .parquet(f"{self.root}/groups")
            .groupBy("digest")
            .agg(F.min("first").alias("first"), F.max("n").alias("group_size"))
            .select("digest", F.col("first.id").alias("keep_id"), F.col("first.place").alias("place"), "group_size")
        )

    def repeated(self, groups: DataFrame) -> tuple[DataFrame, int]:
        """Bitmap of the digests that came more than once (slot, bits) and its size: at most MOST_BITS, whatever the input."""
        many = groups.where("group_size > 1")
        size, wanted = ROW_BITS, min(BITS_EACH * many.count(), MOST_BITS)
        while size < wanted:
            size *= 2
        rows = many.select(spot("digest", size).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("slot"))
        return stage(rows.agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")), "exact-repeated"), size

    def verdicts(self, content: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Per row of all batches: id, digest, keep_id, group_size, kept; ``content`` holds their texts."""
        groups = stage(self.groups(), "exact-groups")
        return self._verdicts(content, groups, self.repeated(groups), id_col, text_col)

    def _verdicts(self, content: DataFrame, groups: DataFrame, repeated: tuple[DataFrame, int], id_col: str, text_col: str) -> DataFrame:
        keyed = self._inbox(self.spark.read)
        out = keyed.join(groups.drop("place"), "digest").select("id", "digest", "keep_id", "group_size", F.lit(None).cast("string").alias("bytes"))
        # Written before it is made distinct: an aggregate right on the join would keep it from being split.
        unlike = stage(self._unlike(content, groups, repeated, id_col, text_col), "exact-unlike").distinct()
        if not unlike.isEmpty():
            out = out.join(unlike, "digest", "left_anti").unionByName(self._by_bytes(content, unlike, id_col, text_col))
        kept = F.col("id").eqNullSafe(F.col("keep_id"))
        return out.select("id", "digest", "keep_id", "group_size", kept.alias("kept"), "bytes")

    def _unlike(self, content: DataFrame, groups: DataFrame, repeated: tuple[DataFrame, int], id_col: str, text_col: str) -> DataFrame:
        """Digests with a row whose bytes differ from the content that the state points to."""
        text = normalised(F.col(f"`{text_col}`"))
        rows = content.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), text.alias("body"), F.input_file_name().alias("at")).withColumn("digest", self.digest(F.col("body")))
        rows = marked(rows, "digest", repeated, "hit").where("hit").drop("hit")
        many = stage(groups.where("group_size > 1").select("digest", "keep_id", "place"), "exact-many")
        hits = stage(rows.join(many, "digest"), "exact-hits")
        # The content that the entry points to: the row of its identifier in its file.
        first = (
            hits.where(F.col("id").eqNullSafe(F.col("keep_id")))
            .groupBy("digest")
            .agg(F.min_by("body", F.struct(F.col("at") != F.col("place"), F.col("body"))).alias("first_body"))
        )
        first = stage(first, "exact-first")  # a table of its own: only a join of two exchanges can be split at a hot digest
        return hits.join(first, "digest").where(F.col("body") != F.col("first_body")).select("digest")

    def _by_bytes(self, content: DataFrame, unlike: DataFrame, id_col: str, text_col: str) -> DataFrame:
        text = normalised(F.col(f"`{text_col}`"))
        rows = content.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), self.digest(text).alias("digest"), text.alias("bytes"))
        rows = rows.join(unlike, "digest", "left_semi")
        entry = F.struct(F.col("id").isNull().alias("none"), F.col("id"))
        groups = rows.groupBy("digest", "bytes").agg(F.min(entry).alias("first"), F.count(F.lit(1)).alias("group_size"))
        groups = groups.select("digest", "bytes", F.col("first.id").alias("keep_id"), "group_size")
        return rows.join(groups, ["digest", "bytes"]).select("id", "digest", "keep_id", "group_size", "bytes")


def spot(digest: str, size: int) -> Column:
    """A digest's bit in a bitmap."""
    return F.pmod(F.xxhash64(F.col(digest)), F.lit(size))


def marked(rows: DataFrame, digest: str, repeated: tuple[DataFrame, int], name: str) -> DataFrame:
    """Adds a boolean: whether a row's digest may have come more than once (false is certain)."""
    bitmap, size = repeated
    slot, bits = fresh(rows, "__slot"), fresh(rows, "__bits")
    at = spot(digest, size)
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col(bits), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    # A bitmap has MOST_BITS / 8 bytes at most, so it may be broadcast.
    rows = rows.join(F.broadcast(bitmap.select(F.col("slot").alias(slot), F.col("bits").alias(bits))), F.bitmap_bucket_number(at) == F.col(slot), "left")
    return rows.withColumn(name, F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))).drop(slot, bits)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verdicts on one table: doc_id, keep_id, group_size, kept, text_sha256."""
    stream = ExactDedup(docs.sparkSession)
    stream.add(docs, "all", id_col, text_col)
    found = stream.verdicts(docs, id_col, text_col)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; of rows that repeat an identifier and its text, one.

    A row whose digest came once stays where it is; only the others are shuffled, to choose among them.
    """
    stream = ExactDedup(docs.sparkSession)
    stream.add(docs, "all", id_col, text_col)
    groups = stage(stream.groups(), "exact-groups")
    repeated = stream.repeated(groups)
    ident, sha, key, hit, nth = (fresh(docs, c) for c in ("__id", "__sha", "__key", "__hit", "__nth"))
    kept = stream._verdicts(docs, groups, repeated, id_col, text_col).where("kept").select(F.col("id").alias(ident), F.col("digest").alias(sha))
    kept = stage(marked(kept, sha, repeated, "hit").where("hit").drop("hit"), "exact-kept").distinct()
    rows = marked(docs.withColumn(key, sha256(normalised(F.col(f"`{text_col}`")))), key, repeated, hit)
    several = rows.where(F.col(hit)).join(kept, F.col(f"`{id_col}`").cast("bigint").eqNullSafe(F.col(ident)) & (F.col(key) == F.col(sha)))
    several = several.withColumn(nth, F.row_number().over(Window.partitionBy(ident, sha).orderBy(sha))).where(F.col(nth) == 1)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return rows.where(~F.col(hit)).select(*columns).unionByName(several.select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
