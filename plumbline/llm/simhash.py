"""SimHash near-dedup with covering locality-sensitive hashing.

Masks: bit i of a fingerprint is given a nonzero vector p(i) of r+1 bits, and the table of each
nonzero vector v compares the bits with <v, p(i)> = 1. The r bits or fewer in which two
fingerprints differ span at most r dimensions, so some v is orthogonal to all of them, and in
its table the two agree: every pair within the radius collides in one of 2^(r+1) - 1 tables.

Only distinct fingerprints enter the tables. In a bucket, a search that takes each reached
fingerprint out of what is left finds its groups and gives one edge for each fingerprint but
the first: a tree of links within the radius, never all pairs. A bucket with more fingerprints
than ``SPLIT`` is hashed again with another assignment p, which is again covering for what may
still differ in it, and once more if need be. After three rounds at most 17 of the 64 bits are
free, so a bucket of the last round has 2^17 (131,072) distinct fingerprints at most: one
megabyte, searched in one task, each fingerprint against what is left. Trees are joined to components by alternating large-star and small-star rounds, each
written to the shared folder.

Defined results: a null or empty text has fingerprint zero and is linked like any other; a very
long text is read whole, alone in its chunk; a bit set in just half of the shingles is 0; a null
identifier is larger than any other; rows that repeat an identifier keep a row each; an empty
table gives an empty result; columns of any other name are left out of sight, and ``keep`` hands
them on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import chunks, fresh, stage

SHINGLE, SEED, RADIUS, BITS = 4, 42, 4, 64
#: A bucket with more distinct fingerprints is hashed again.
SPLIT = 4096
ROUNDS = 3


def masks(radius: int = RADIUS, turn: int = 0) -> list[int]:
    """The 2^(radius+1) - 1 covering masks; ``turn`` chooses another assignment of vectors to bits."""
    n = (1 << (radius + 1)) - 1
    vector = [1 + (i * (1, 3, 5)[turn] + i // n * (0, 7, 13)[turn]) % n for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (v & vector[i]).bit_count() & 1) for v in range(1, n + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    ends = end[k - 1 :].tolist()
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start[: len(ends)].tolist(), ends, strict=True)), np.uint64, len(ends))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([signed(fingerprint(t)) for t in texts], pa.int64())], names=["doc_id", "fp"])


def tree(values: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join all of the values that chains of links within the radius join."""
    out, left = [], values
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found, left = left[near], left[~near]
                out.append((np.full(len(found), x), found))
                todo.extend(found)
    return out


def _search(radius: int, split: int | None):
    """Over rows sorted by bucket: links, and the rows of buckets over ``split`` as (bucket, fp, null)."""
    empty = np.zeros(0, np.int64)

    def batch_of(bucket, fp, other) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(fp, pa.int64()), pa.array(other, pa.int64())], names=["b0", "fp", "other"])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, over = None, [], False  # the bucket that may go on in the next batch

        def close():
            if key is None or over:
                return
            values = np.concatenate(held).view(np.uint64)
            for a, b in tree(values, radius):
                yield batch_of(pa.nulls(len(a), pa.int64()), a.view(np.int64), b.view(np.int64))

        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(j).to_numpy(zero_copy_only=False) for j in range(2)], 1)
            fp = batch.column(2).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]).any(1))))
            ends = np.append(cut[1:], len(fp))
            links: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b in zip(cut.tolist(), ends.tolist(), strict=True):
                last = b == len(fp)
                if not last and b - a == 1 and a:  # alone in its bucket
                    continue
                name = tuple(k[a])
                if name != key:
                    yield from close()
                    key, held, over = name, [], False
                if over:
                    yield batch_of(k[a:b, 0], fp[a:b], pa.nulls(b - a, pa.int64()))
                    continue
                held.append(fp[a:b])
                if split and sum(map(len, held)) > split:
                    values = np.concatenate(held)
                    yield batch_of(np.full(len(values), name[0]), values, pa.nulls(len(values), pa.int64()))
                    over, held = True, []
                elif not last:
                    links += tree(np.concatenate(held).view(np.uint64), radius)
                    key, held = None, []
            if links:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*links, strict=True))
                yield batch_of(pa.nulls(len(a), pa.int64()), a, b)
        yield from close()
        yield batch_of(empty, empty, empty)

    return search


def _tables(rows: DataFrame, radius: int, turn: int) -> DataFrame:
    """A row per fingerprint and table: table number (with those of earlier rounds), compared bits, fp."""
    n = 1 << (radius + 1)
    every = masks(radius, turn)
    if turn == 0:
        cells = [F.struct(F.lit(t).cast("bigint").alias("b0"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("b1")) for t, m in enumerate(every, 1)]
        return rows.select(F.explode(F.array(*cells)).alias("c"), "fp").select("c.b0", "c.b1", "fp")
    # Rows of an oversize bucket share the bits that its masks compare; add this round's bits to them.
    seen = F.lit(0).cast("bigint")
    for earlier in range(turn):
        digit = F.pmod(F.shiftright(F.col("b0"), (radius + 1) * earlier), F.lit(n))
        seen = seen.bitwiseOR(F.element_at(F.array(*[F.lit(signed(m)) for m in masks(radius, earlier)]), digit.cast("int")))
    rows = rows.withColumn("seen", seen)
    cells = [F.struct((F.col("b0") + F.lit(t << ((radius + 1) * turn)).cast("bigint")).alias("b0"), F.col("fp").bitwiseAND(F.col("seen").bitwiseOR(F.lit(signed(m)))).alias("b1")) for t, m in enumerate(every, 1)]
    return rows.select(F.explode(F.array(*cells)).alias("c"), "fp").select("c.b0", "c.b1", "fp")


def links(fps: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that join what chains within the radius join."""
    found, rows = None, fps.select("fp")
    for turn in range(ROUNDS):
        dealt = _tables(rows, radius, turn).repartition("b0", "b1").sortWithinPartitions("b0", "b1")
        out = stage(dealt.mapInArrow(_search(radius, split if turn + 1 < ROUNDS else None), "b0 BIGINT, fp BIGINT, other BIGINT"), f"simhash-{turn}")
        edges = out.where("other is not null").select(F.col("fp").alias("a"), F.col("other").alias("b"))
        found = edges if found is None else found.unionByName(edges)
        rows = out.where("other is null").select("b0", "fp")
        if rows.isEmpty():
            break
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b), a > b; the root is the least node that it reaches."""
    edges, mark = stage(edges, "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # The least neighbours are a table of their own: a join of two exchanges can be split at a hub.
        least = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "stars-large")
        large = stage(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "stars-mid")
        least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "stars-small")
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        edges = stage(small, "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(now)


def near_dedup(docs: DataFrame, radius: int = RADIUS, split: int = SPLIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, fp (the fingerprint as a signed long), component_id."""
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    prints = stage(rows.mapInArrow(_fingerprints, "doc_id BIGINT, fp BIGINT"), "simhash-prints")
    fps = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(fps, radius, split))
    placed = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = stage(placed.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-components")
    return prints.join(placed.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest identifier of their component."""
    ident = fresh(docs, "__id")
    stay = near_dedup(docs, id_col=id_col, text_col=text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(ident)).distinct()
    return docs.join(stay, F.col(f"`{id_col}`").cast("bigint").eqNullSafe(F.col(ident)), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
