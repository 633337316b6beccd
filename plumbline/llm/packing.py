"""Packing documents into windows by best-fit decreasing.

A document is its token ids and an end id. Documents over a window are first cut into full
windows; the rest is a short piece. Each task packs the pieces of its rows: longest first, each
into the tightest open window that holds it. Open windows hang on the leaves of a segment tree
indexed by remaining capacity, so the tightest is the first leaf at or after the piece's length
that has one, found in logarithmic time. Nothing is shuffled; a task packs blocks of ``BLOCK``
pieces, so its memory is bounded whatever the partition holds, at the cost of a few windows
left open in each block.

Defined results: a null text counts as empty and gives the end id alone; a very long text is cut
into full windows like any other; rows that repeat an identifier are packed each; a null
identifier stays null; an empty table gives an empty result; columns of any other name are left
out of sight. Pieces of equal length go in the order of their rows. Window numbers are unique
over all tasks (the task's number above 40 bits), not gapless.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import tokens
from plumbline.llm.common import chunks

WINDOW, END = 1024, 0
#: Pieces that are packed together.
BLOCK = 200_000
SCHEMA = "doc_id BIGINT, start BIGINT, length BIGINT, ids_crc32 BIGINT, doc_tokens BIGINT, sequence_id BIGINT, offset BIGINT"


class OpenWindows:
    """Open windows by remaining capacity: a segment tree of which leaves are in use."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.used = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(self.size)]

    def put(self, room: int, name: int) -> None:
        self.at[room].append(name)
        k = room + self.size
        while k:
            self.used[k] += 1
            k >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the window with the least room of at least ``need``: (room, name)."""
        k = need + self.size
        if not self.used[k]:
            while k > 1 and (k & 1 or not self.used[k + 1]):  # up, till a right neighbour has one
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:  # down, left first
                k *= 2
                if not self.used[k]:
                    k += 1
        room = k - self.size
        while k:
            self.used[k] -= 1
            k >>= 1
        return room, self.at[room].pop()


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window number and offset of each piece, and how many windows there are."""
    tree, count = OpenWindows(window), 0
    name, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        found = tree.tightest(need)
        if found is None:
            found, count = (window, count), count + 1
        room, name[k] = found
        offset[k] = window - room
        if room > need:
            tree.put(room - need, int(name[k]))
    return name, offset, count


def _pack(path: str, window: int, end: int, block: int):
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal number
            doc, start, length, crc, total = zip(*rows, strict=True)
            name, offset, count = best_fit(np.array(length, np.int64), window)
            cols = [doc, start, length, crc, total, name + number, offset]
            number += count
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch, texts in chunks(batches, "text"):
            for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                data = tokens.encoded(text.decode(), path) + end.to_bytes(4, "little")
                for a in range(0, len(data), 4 * window):
                    part = data[a : a + 4 * window]
                    rows.append((doc, a // 4, len(part) // 4, zlib.crc32(part), len(data) // 4))
                    if len(rows) >= block:
                        yield flush()
        if rows:
            yield flush()

    return pack


def packed(docs: DataFrame, path: str | None = None, window: int = WINDOW, end: int = END, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_pack(path or tokens.default_path(), window, end, block), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
