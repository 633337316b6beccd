"""Delta-maintained token counts.

``Rollup`` keeps additive totals (documents, tokens) by source, language and tokenizer version
in a folder. A batch of signed changes is summed per cell first, then written as one file set
under the batch's name; a batch whose marker is there is not taken again, and one that stopped
halfway is written over, so a commit may be repeated without counting twice. ``compact`` folds
committed batches into one and may be repeated too; a folded batch counts as committed. Totals
are the sum over batches: no document row is read again. One writer at a time commits or folds.

Changes: an insert adds a document's count, a delete takes it away, a revision takes the old
count away and adds the new one (under its tokenizer version).

Defined results: null sources and languages are cells of their own; a null or empty text has no
tokens and counts as a document; a very long text is encoded whole, alone in its chunk; rows
that repeat an identifier count each, as identifiers are not read; cells whose documents and
tokens cancel out are left out; an empty batch commits and changes nothing, and an empty table
has no totals; columns of any other name are left out of sight.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import tokens
from plumbline.llm.common import NOT_SPACE, chunks, delete, scratch

CELL = ["source", "lang", "tokenizer"]
SCHEMA = "source STRING, lang STRING, tokenizer STRING, n_docs BIGINT, n_tokens BIGINT"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"{NOT_SPACE}+")).cast("bigint")


def _count(path: str):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            n = [len(tokens.encoded(t.decode(), path)) // 4 for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64())], names=["source", "lang", "words", "n"])

    return count


def counted(docs: DataFrame, path: str | None = None, source_col: str = "source", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(source, lang, words, n): words and BPE tokens of each document."""
    named = [F.col(f"`{c}`").cast("string").alias(name) for c, name in ((source_col, "source"), (lang_col, "lang"))]
    text = F.col(f"`{text_col}`")
    rows = docs.select(*named, word_count(text).alias("words"), text.alias("text"))
    return rows.mapInArrow(_count(path or tokens.default_path()), "source STRING, lang STRING, words BIGINT, n BIGINT")


def change(rows: DataFrame, sign: int, tokenizer: str, n: Column) -> DataFrame:
    """Signed changes of documents: +1 puts them in, -1 takes them out."""
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("bigint").alias("n_docs"), (n * sign).cast("bigint").alias("n_tokens"))


class Rollup:
    """Totals in the folder ``root``, which all executors share."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or scratch(spark, "rollup")

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _names(self) -> list[str]:
        fs, top = self._fs(self.root)
        return sorted(x.getPath().getName() for x in fs.listStatus(top)) if fs.exists(top) else []

    def _marked(self, path: str) -> bool:
        fs, where = self._fs(f"{self.root}/{path}/_SUCCESS")
        return fs.exists(where)

    def _fold(self) -> tuple[str | None, set[str]]:
        """The newest whole fold and the batches in it; the names are written last."""
        folds = [x for x in self._names() if x.startswith("fold=") and self._marked(f"{x}/batches")]
        if not folds:
            return None, set()
        rows = self.spark.read.schema("batch STRING").parquet(f"{self.root}/{folds[-1]}/batches").collect()
        return folds[-1], {x["batch"] for x in rows}

    def _open(self, folded: set[str]) -> list[str]:
        """Committed batches that no fold holds."""
        return [b for x in self._names() if x.startswith("batch=") and (b := x.removeprefix("batch=")) not in folded and self._marked(x)]

    def committed(self, batch: str) -> bool:
        return self._marked(f"batch={batch}") or batch in self._fold()[1]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Takes a batch of signed changes in, once; false if it was in already."""
        if self.committed(batch):
            return False
        sums = changes.groupBy(*CELL).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.root}/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) after all committed batches."""
        return self._sums(*self._fold())

    def _sums(self, fold: str | None, folded: set[str]) -> DataFrame:
        done = [f"{self.root}/batch={b}" for b in self._open(folded)] + ([f"{self.root}/{fold}/sums"] if fold else [])
        rows = self.spark.read.schema(SCHEMA).parquet(*done) if done else self.spark.createDataFrame([], SCHEMA)
        sums = rows.groupBy(*CELL).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> bool:
        """Folds the committed batches into one; false if there were none. One that stopped halfway may be repeated."""
        fold, folded = self._fold()
        fresh = self._open(folded)
        if fresh:
            new = f"fold={int(fold.removeprefix('fold=')) + 1 if fold else 0:010d}"
            self._sums(fold, folded).write.mode("overwrite").parquet(f"{self.root}/{new}/sums")
            names = self.spark.createDataFrame([(b,) for b in sorted(folded.union(fresh))], "batch STRING")
            names.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{new}/batches")
            fold, folded = new, folded.union(fresh)
        for x in self._names():
            if x.removeprefix("batch=") in folded if x.startswith("batch=") else x.startswith("fold=") and fold and x < fold:
                delete(self.spark, f"{self.root}/{x}")
        return bool(fresh)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts all documents in words, then revises them to BPE tokens; takes those without a word out and puts them back.

    The totals cover every row. The four batches are committed twice over, as a driver that starts again would.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rollup = Rollup(spark)
    path = scratch(spark, "token-counts")
    counted(docs).write.parquet(path)
    rows = spark.read.parquet(path)
    batches = {
        "0-insert": change(rows, 1, "words", F.col("words")),
        "1-revise": change(rows, -1, "words", F.col("words")).unionByName(change(rows, 1, "byte_bpe_50k", F.col("n"))),
        "2-delete": change(rows.where("words = 0"), -1, "byte_bpe_50k", F.col("n")),
        "3-restore": change(rows.where("words = 0"), 1, "byte_bpe_50k", F.col("n")),
    }
    for _ in range(2):
        for name, changes in batches.items():
            rollup.commit(name, changes)
    delete(spark, path)
    return rollup.totals()
