"""Substring dedup by level-wise doubling.

The levels are windows of L words (half of the window asked for), 2L (that window), 4L, 8L, ...
A window of one level is looked at only where the level below found a repeat in another
document, so what is handled shrinks from level to level. The query goes on doubling until no
candidate survives (``longest``), which tells how long the longest repeat of each document is
(``longest_repeat``). Words go by the level of the window asked for, so a caller of ``result`` who
wants nothing else may end there. What a level has written goes when the next one has its candidates.

A level needs not all positions: of every window of 2L words, the L-word window in it with the
least hash stands for it (its seed). Equal windows have equal seeds, so a window whose seed occurs
in one document only is unique; that drops nearly everything, at about two positions in L.
Windows in a row that share a seed form a run. A run that recurs word for word in a later document
is settled whole; of each distinct run only the first document goes on to have its windows
compared one by one. So thousands of copies cost as one. Runs, and windows of the length asked
for, are told apart by 128 bits of BLAKE2b of their words; seeds, and the windows of higher levels,
by polynomials modulo a prime (see ``wordhash``).

Above the first level, documents are not read again. The stretches of words that its candidates
cover are cut out once, in the join that also makes what stays of each document; stretches of the
same words (by the same 128 bits) are one piece, which knows the least and the greatest document that
has it. A level cuts the pieces down to what its candidates cover, so what is shuffled shrinks too.

A level is some ten jobs, which small tables don't repay: once the words of all candidates together
are ``FEW`` or less (they are counted, and shrink from level to level), the levels that are left run
one after the other in a single task, by the same rules.

Every comparison is a grouped minimum followed by a join back, so a passage in a third of all
documents makes a small partial aggregate and a join side that Spark can split.

Defined results: a null or empty text has no words; a very long one is handled whole, alone in
its chunk; a null identifier is neither smaller nor larger than another: its row loses nothing
and makes no other lose; rows that repeat an identifier with the same text get the same result
each; repeats inside one document stay; an empty table gives an empty result; columns of any
other name are left out of sight.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import chunks, forget, stage, sweep, written
from plumbline.llm.exact_dedup import BITS_EACH, ROW_BITS, marked, spot
from plumbline.llm.wordhash import BASES, Sums, Words

WINDOW = 50
RUN = "seed BIGINT, run BINARY, lo INT, hi INT"
SCAN = "doc_id BIGINT, thash BIGINT, n_words BIGINT, kept_sha256 STRING, seeds ARRAY<STRUCT<seed: BIGINT, run: BINARY, lo: INT, hi: INT>>"
KEY, KEY_TYPE = ["doc_id", "thash"], "doc_id BIGINT, thash BIGINT"
#: A piece: the name of a stretch of words of the first level's candidates, and where in it this piece begins.
PIECE, PIECE_TYPE = ["piece", "begin"], "piece BINARY, begin INT"
#: Words of all candidates together that one task takes through the levels that are left (some 500 MB).
FEW = 2_000_000
#: Most bits of the bitmap of repeated texts (32 MB); a fuller one lets more texts through, which later joins drop.
MOST_BITS = 1 << 28
#: Up to this width a sliding minimum compares every value of the window.
NARROW = 64


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each full window of ``width`` values, where its least value is (the leftmost)."""
    n = len(values) - width + 1
    if width <= NARROW:
        return np.lib.stride_tricks.sliding_window_view(values, width).argmin(1) + np.arange(n)
    # Ranks, ties in order of place; a window's least is the lesser of a block's end and the next one's start.
    order = np.argsort(values, kind="stable")
    rank = np.full(-(-len(values) // width) * width, len(values), np.int64)
    rank[order] = np.arange(len(values))
    block = rank.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return order[np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])]


def runs(words: Words, sums: Sums, text: int, lo: int, hi: int, window: int, seed: int) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Seeds of one text's windows that start from lo to hi: seed hash, run digest, first and last window start of the run."""
    if hi < lo:
        none = np.zeros(0, np.int64)
        return none, [], none, none
    base = int(words.first[text])
    at = np.arange(base + lo, base + hi + window - seed + 1)
    s = sums.spans(at, at + seed)
    pick = sliding_argmin(s, window - seed + 1)
    a = np.flatnonzero(np.concatenate(([True], pick[1:] != pick[:-1])))
    b = np.concatenate((a[1:], [len(pick)])) - 1
    return s[pick[a]], words.digests(base + lo + a, base + lo + b + window), a + lo, b + lo


def _scan(window: int, seed: int):
    item = pa.struct([("seed", pa.int64()), ("run", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32())])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            words = Words(texts)
            sums = Sums(words.values(), BASES[0])
            size = np.diff(words.first)
            found = [runs(words, sums, k, 0, int(size[k]) - window, window, seed) for k in range(len(texts))]
            offsets = np.concatenate(([0], np.cumsum([len(f[0]) for f in found])))
            cols = [np.concatenate([f[j] for f in found]) for j in (0, 2, 3)]
            inner = pa.StructArray.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array([d for f in found for d in f[1]], pa.binary()), pa.array(cols[1].astype(np.int32)), pa.array(cols[2].astype(np.int32))], fields=list(item)
            )
            sha = [hashlib.sha256(words.joined[words.at[a] : max(words.at[a], words.at[b] - 1)]).hexdigest() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(sha), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)],
                names=["doc_id", "thash", "n_words", "kept_sha256", "seeds"],
            )

    return scan


def _ranges(batch: pa.RecordBatch, k: int, fields: int = 2, name: str = "ranges") -> np.ndarray:
    """The (lo, hi) pairs of row k, from its column ``ranges``, and what comes after them there."""
    value = batch.column(batch.schema.get_field_index(name))[k].values
    return np.stack([value.field(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in range(fields)], 1)


def _merged(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (lo, hi) pairs of r as few as can be: those that touch are one."""
    r = r[np.argsort(r[:, 0], kind="stable")]
    upto = np.maximum.accumulate(r[:, 1])
    new = np.flatnonzero(np.concatenate((np.ones(min(len(r), 1), bool), r[1:, 0] > upto[:-1] + 1)))
    return r[new, 0], upto[np.append(new[1:], len(r))[: len(new)] - 1]


def _islands(words: int):
    """From the starts of repeated windows to those of windows twice as long of which every part is repeated, how many words they cover, and the starts to remove."""

    def islands(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, covered, remove = [], [], []
            for k in range(batch.num_rows):
                r = _ranges(batch, k, 3)
                lo, hi = _merged(r)
                out.append([{"lo": int(a), "hi": int(b)} for a, b in zip(lo, hi - words, strict=True) if b >= a])
                covered.append(sum(x["hi"] - x["lo"] + 2 * words for x in out[-1]))
                remove.append([{"lo": int(a), "hi": int(b)} for a, b in zip(*_merged(r[r[:, 2] > 0]), strict=True)])
            kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, kind), pa.array(covered, pa.int64()), pa.array(remove, kind)],
                names=[*batch.schema.names[:2], "ranges", "covered", "remove"],
            )

    return islands


def _extend(window: int):
    """Seeds of the pieces of a higher level."""

    def extend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            words = Words(texts)
            sums = Sums(words.values(), BASES[0])
            size = np.diff(words.first)
            found = [runs(words, sums, k, 0, int(size[k]) - window, window, window // 2) for k in range(len(texts))]
            row = pa.array(np.repeat(np.arange(len(texts)), [len(f[0]) for f in found]))
            seed, lo, hi = (np.concatenate([f[j] for f in found]) for j in (0, 2, 3))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(row) for c in range(4)] + [pa.array(seed, pa.int64()), pa.array([d for f in found for d in f[1]], pa.binary()), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
                names=[*PIECE, "least", "most", "seed", "run", "lo", "hi"],
            )

    return extend


def _pieces(window: int):
    """The words that the candidates of a level above cover, a row for each range."""

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            words = Words(texts)
            row, begin, cut = [], [], []
            for k in range(len(texts)):
                for lo, hi in _ranges(batch, k).tolist():
                    row.append(k)
                    begin.append(batch.column(1)[k].as_py() + lo)
                    cut.append(words.joined[words.at[words.first[k] + lo] : words.at[words.first[k] + hi + window] - 1])
            first, least, most = (batch.column(c).take(pa.array(row, pa.int64())) for c in (0, 2, 3))
            yield pa.RecordBatch.from_arrays([first, pa.array(begin, pa.int32()), least, most, pa.array(cut, pa.binary())], names=[*PIECE, "least", "most", "text"])

    return pieces


def _double(window: int):
    """All levels from ``window`` on over few pieces: the longest repeat of each that has one."""

    def double(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if not rows:
            return
        words = Words([r[3] for r in rows])
        both = [Sums(words.values(j), b) for j, b in enumerate(BASES)]
        low, high = (np.repeat(np.array([r[j] for r in rows], np.int64), np.diff(words.first)) for j in (1, 2))
        end = np.repeat(words.first[1:], np.diff(words.first))
        at, size = np.arange(len(words)), window
        longest = np.zeros(len(rows), np.int64)
        while True:
            at = at[at + size <= end[at]]  # a window lies in one piece
            if not len(at):
                break
            name = np.unique(np.stack([x.spans(at, at + size) for x in both], 1), axis=0, return_inverse=True)[1].ravel()
            least, most = np.full(name.max() + 1, np.iinfo(np.int64).max), np.full(name.max() + 1, np.iinfo(np.int64).min)
            np.minimum.at(least, name, low[at])
            np.maximum.at(most, name, high[at])
            at = at[(least < most)[name]]
            longest[np.searchsorted(words.first, at, "right") - 1] = size
            there = np.zeros(len(words) + size, bool)
            there[at] = True
            at, size = at[there[at + size]], 2 * size  # both halves are repeated
        hit = np.flatnonzero(longest)
        yield pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k in hit], pa.binary()), pa.array(longest[hit])], names=["piece", "words"])

    return double


def _windows(window: int, exact: bool):
    """Every window of the given starts: its digest, or at higher levels two polynomials of 61 bits."""

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            lead = batch.schema.get_field_index("text")
            words = Words(texts)
            row, at, last = [], [], []
            for k in range(len(texts)):
                for lo, hi, upto in _ranges(batch, k, 3).tolist():
                    at.append(np.arange(lo, hi + 1))
                    row.append(np.full(hi + 1 - lo, k))
                    last.append(np.full(hi + 1 - lo, upto))
            row_, at_ = np.concatenate(row), np.concatenate(at)
            start = words.first[row_] + at_
            if exact:
                named = words.digests(start, start + window)
            else:
                both = [Sums(words.values(j), b).spans(start, start + window) for j, b in enumerate(BASES)]
                named = [x.tobytes() for x in np.stack(both, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(row_)) for c in range(lead)] + [pa.array(named, pa.binary()), pa.array(at_.astype(np.int32)), pa.array(np.concatenate(last))],
                names=[*batch.schema.names[:lead], "w", "at", "last"],
            )

    return windows


def _cut(window: int, further: bool):
    """Applies removals: kept text and its digest of each document with window starts to remove; if wanted, also the words that the candidates of the next level cover."""
    kind = pa.list_(pa.struct([("piece", pa.binary()), ("text", pa.binary())]))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            removed, sha, kept, pieces = [], [], [], []
            for k, text in enumerate(texts):
                words = text.split()
                step = np.zeros(len(words) + 1, np.int64)
                r = _ranges(batch, k, name="remove")
                np.add.at(step, r[:, 0], 1)
                np.add.at(step, r[:, 1] + window, -1)
                keep = np.cumsum(step)[:-1] == 0
                left = b" ".join([w for w, ok in zip(words, keep.tolist(), strict=True) if ok])
                removed.append(int(len(words) - keep.sum()))
                sha.append(hashlib.sha256(left).hexdigest() if removed[-1] else None)
                kept.append(left.decode() if removed[-1] else None)
                own = [b" ".join(words[lo : hi + 2 * window]) for lo, hi in _ranges(batch, k).tolist()] if further else []
                pieces.append([{"piece": hashlib.blake2b(w, digest_size=16).digest(), "text": w} for w in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string()), pa.array(pieces, kind)],
                names=[*KEY, "n_removed", "sha", "kept_text", "pieces"],
            )

    return cut


def among(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``column`` is among ``keys`` (one column, distinct), and by chance some others; no row leaves its task."""
    size, wanted = ROW_BITS, min(BITS_EACH * keys.count(), MOST_BITS)
    while size < wanted:
        size *= 2
    slots = keys.select(spot(column, size).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("slot"))
    slots = stage(slots.agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")), f"{column}-bitmap")
    return marked(rows, column, (slots, size), "may").where("may").drop("may")


class Repeats:
    """The repeated windows of a table; ``result`` has what stays of each document."""

    def __init__(self, docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", few: int = FEW):
        if window < 2:
            raise ValueError("a window has two words at least")
        self.few = few
        self.window, self.seed = window, (window + 1) // 2
        text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
        self.docs = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("thash"), text.alias("text"))

    def _level(self, seeds: DataFrame, texts: DataFrame | None, words: int) -> tuple[DataFrame, DataFrame]:
        """Per document or piece with a repeated window: starts of windows twice as long that may be repeated, how many words they cover, starts to remove; the texts they lie in."""
        # Aggregates are tables of their own: only a join of two exchanges can be split at a hot key.
        key, kind, least, most = (KEY, KEY_TYPE, "doc_id", "doc_id") if texts is None else (PIECE, PIECE_TYPE, "least", "most")
        lead = list(dict.fromkeys([*key, least]))
        begun = written() - 1  # the seeds, written last
        spark = seeds.sparkSession
        classes = stage(seeds.groupBy("seed", "run").agg(F.min(least).alias("first"), F.max(most).alias("last")), f"runs-{words}")
        shared = classes.groupBy("seed").agg(F.min("first").alias("a"), F.max("last").alias("b"), (F.count(F.lit(1)) > 1).alias("more"))
        placed = seeds.join(classes, ["seed", "run"]).join(stage(shared.where("a < b").select("seed", "more"), f"several-{words}"), "seed")
        placed = stage(placed.select(*lead, "lo", "hi", "first", "last", (F.col("more") & (F.col(least) == F.col("first"))).alias("up")), f"placed-{words}")
        forget(spark, begun, written() - 1)  # all but the last went into it
        begun = written() - 1
        sweep(spark)
        if texts is None:  # of documents without a repeat hardly any text is read again
            texts = stage(among(self.docs, "thash", stage(placed.select("thash").distinct(), "repeated")), "windows-texts")
            here = written() - 1
        else:
            here = begun
        up = placed.where("up").groupBy(*key).agg(F.collect_list(F.struct("lo", "hi", "last")).alias("ranges"))
        dense = texts.join(up, key).select(*lead, "text", "ranges").mapInArrow(_windows(words, words == self.window), f"{kind}{'' if least in key else ', least BIGINT'}, w BINARY, at INT, last BIGINT")
        dense = stage(dense, f"windows-{words}")
        sweep(spark)
        several = dense.groupBy("w").agg(F.min(least).alias("first"), F.max("last").alias("upto")).where("first < upto")
        one = dense.join(stage(several, f"least-{words}"), "w").select(*lead, F.col("at").alias("lo"), F.col("at").alias("hi"), "first")
        starts = placed.where("first < last").select(*lead, "lo", "hi", "first").unionByName(one)
        starts = starts.groupBy(*key).agg(F.collect_list(F.struct("lo", "hi", (F.col(least) > F.col("first")).alias("gone"))).alias("ranges"))
        span = "ARRAY<STRUCT<lo: INT, hi: INT>>"
        found = stage(starts.mapInArrow(_islands(words), f"{kind}, ranges {span}, covered BIGINT, remove {span}"), f"candidates-{words}")
        forget(spark, begun, max(here, begun + 1))  # all but the texts and what was found
        forget(spark, here + 1, written() - 1)
        sweep(spark)
        return found, texts

    def levels(self, longest: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """What is known of every document, of those with a repeat also what stays, and, if wanted, (doc_id, thash, longest_repeat).

        Level by level: windows that were found repeated at one length alone are extended to twice that
        length, until no candidate survives or the level asked for is done. After the first level, the
        stretches of words that candidates cover take the place of documents: like stretches are one piece,
        which knows the least and the greatest document that has it.
        """
        spark, words = self.docs.sparkSession, self.window
        scan = stage(self.docs.mapInArrow(_scan(words, self.seed), SCAN), "windows-scan")
        begun = written() - 1
        every = stage(scan.drop("seeds"), "every")
        # Most seeds of the first level occur once: they go before anything is kept for a run.
        seeds = scan.where("doc_id is not null and size(seeds) > 0").select(*KEY, F.inline("seeds"))
        shared = seeds.groupBy("seed").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("seed")
        shared = stage(shared, f"shared-{words}")
        sweep(spark)
        seeds = stage(seeds.join(shared, "seed"), f"seeds-{words}")
        forget(spark, begun, begun + 1)
        forget(spark, begun + 2, written() - 1)
        sweep(spark)
        first = written()
        candidates, texts = self._level(seeds, None, words)
        # The join comes first: both have the same partitions, so rows that repeat an identifier need no other exchange.
        cut = texts.join(candidates.where("covered > 0 or size(remove) > 0"), KEY).select(*KEY, "text", "ranges", "remove").dropDuplicates(KEY)
        done = "n_removed BIGINT, sha STRING, kept_text STRING, pieces ARRAY<STRUCT<piece: BINARY, text: BINARY>>"
        cut = stage(cut.mapInArrow(_cut(words, longest), f"{KEY_TYPE}, {done}"), f"cut-{words}")
        forget(spark, first, written() - 2)  # the texts; what was found and the cut stay
        sweep(spark)
        stays = cut.where("n_removed > 0").drop("pieces")
        if not longest:
            return every, stays, None
        longest_of = lambda rows, key: rows.select(*key, F.lit(words).cast("bigint").alias("words"))
        found = longest_of(candidates, KEY)
        rows = cut.select(*KEY, F.inline("pieces"))
        members = rows.select(*KEY, "piece")
        rows = rows.groupBy("piece").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.first("text").alias("text"))
        texts = stage(rows.select("piece", F.lit(0).alias("begin"), "least", "most", "text"), f"pieces-{2 * words}")
        pieces = None
        while covered := candidates.agg(F.sum("covered")).first()[0] or 0:
            words *= 2
            if pieces is not None:
                rows = texts.join(candidates.where("covered > 0"), PIECE).select(*PIECE, "least", "most", "text", "ranges")
                texts = stage(rows.mapInArrow(_pieces(words), f"{PIECE_TYPE}, least BIGINT, most BIGINT, text BINARY"), f"pieces-{words}")
                forget(spark, last, last + 1)
            last = written() - 1
            if covered <= self.few:
                rest = texts.select("piece", "least", "most", "text").repartition(1).mapInArrow(_double(words), "piece BINARY, words BIGINT")
                here = stage(rest, "repeats-rest")
                pieces = here if pieces is None else pieces.unionByName(here)
                break
            seeds = stage(texts.mapInArrow(_extend(words), f"{PIECE_TYPE}, least BIGINT, most BIGINT, {RUN}"), f"extended-{words}")
            candidates, texts = self._level(seeds, texts, words)
            here = longest_of(candidates, ["piece"])
            pieces = here if pieces is None else pieces.unionByName(here)
        if pieces is not None:
            found = found.unionByName(members.join(pieces.groupBy("piece").agg(F.max("words").alias("words")), "piece").select(*KEY, "words"))
        return every, stays, found.groupBy(*KEY).agg(F.max("words").alias("longest_repeat"))

    def result(self, longest: bool = False) -> DataFrame:
        """Per document: doc_id, thash, n_words, n_removed, kept_sha256, kept_text where words went, and longest_repeat if wanted."""
        rows, cut, found = self.levels(longest)
        none = F.lit(0).cast("bigint")
        more = []
        if found is not None:
            rows, more = rows.join(found, KEY, "left"), [F.coalesce("longest_repeat", none).alias("longest_repeat")]
        return rows.join(cut, KEY, "left").select(*KEY, "n_words", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("sha", "kept_sha256").alias("kept_sha256"), "kept_text", *more)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).result(longest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


def sql(most: int = 0) -> str:
    """The same in SQL; with a number of levels, also ``longest_repeat`` (for documents under WINDOW * 2^most words).

    Windows are named by the least place of an equal one; a window twice as long is the pair of names of
    its halves.
    """
    level = []
    for k in range(1, most):
        same = "OVER (PARTITION BY a.name, b.name)"
        level.append(f"w{k} AS (SELECT a.doc_id, a.i, min(a.doc_id * 100000000 + a.i) {same} AS name, min(a.doc_id) {same} AS least, max(a.doc_id) {same} AS most FROM r{k - 1} a JOIN r{k - 1} b ON b.doc_id = a.doc_id AND b.i = a.i + {WINDOW * 2 ** (k - 1)})")
        level.append(f"r{k} AS (SELECT doc_id, i, name FROM w{k} WHERE least < most)")
    longest = " UNION ALL ".join(f"SELECT doc_id, {WINDOW * 2**k} AS words FROM r{k}" for k in range(most))
    levels = f"r0 AS MATERIALIZED (SELECT doc_id, i, name FROM p JOIN m USING (s)), {', '.join([*level, f'l AS (SELECT doc_id, max(words) AS words FROM ({longest}) GROUP BY doc_id)'])}," if most else ""
    return rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM d, unnest(range(1, len(w) - {WINDOW - 2})) AS t(i)),
m AS (SELECT s, min(doc_id) AS a, min(doc_id * 100000000 + i) AS name FROM p GROUP BY s HAVING count(DISTINCT doc_id) > 1),
{levels}
f AS (SELECT DISTINCT doc_id, i FROM p JOIN m USING (s) WHERE doc_id > a),
g AS (SELECT doc_id, list(i) AS gone_at FROM (SELECT DISTINCT doc_id, i + k AS i FROM f, unnest(range({WINDOW})) AS t(k)) GROUP BY doc_id),
k AS (SELECT d.doc_id, i, w[i] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
gone AS (SELECT doc_id, unnest(gone_at) AS i FROM g),
kept AS (SELECT k.doc_id, string_agg(x, ' ' ORDER BY k.i) AS s, count(*) AS n FROM k LEFT JOIN gone USING (doc_id, i) WHERE gone.i IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, {"CAST(coalesce(l.words, 0) AS BIGINT) AS longest_repeat, " if most else ""}sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id){" LEFT JOIN l USING (doc_id)" if most else ""}
"""


SQL = sql()
