"""Language identification with error-correcting output codes.

Each language gets a codeword (a row of a Hadamard matrix, so any two differ in half of the
bits). For each bit a binary n-gram classifier tells the languages that have it from those that
don't: the weight of an n-gram is the log ratio of its smoothed frequency in the two groups,
each group the mean of its languages. The frequencies are totals over all labelled training
documents, summed in the tasks and then over them. A text's margins, one for each bit, are
compared with each codeword by a logistic loss, weighted by how sure the bit is; the nearest
codeword wins, and a text whose second codeword is nearly as near is flagged.

Defined results: a null or empty text, or one without a letter (Unicode category L), is ``und``
with score 0, as is every text if no language was learned; labels that are null are not learned
from; a single known language is always predicted; of languages that decode equally well the
first by name wins, flagged as ambiguous; a very long text is read whole, alone in its chunk;
rows that repeat an identifier keep a row each; a null identifier is not held out; an empty
table gives an empty result; columns of any other name are left out of sight. A column with more
than ``MOST_LANGS`` distinct labels is refused, as it can't be one of languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import chunks

#: Cells of the n-gram table; n-grams of two to four bytes share it.
CELLS = 1 << 14
ORDERS = (2, 3, 4)
#: Languages that a model may have; the driver holds CELLS counts for each.
MOST_LANGS = 255
UNKNOWN = "und"
#: A text is ambiguous if its score is less than this.
AMBIGUOUS = 0.5
SCHEMA = "doc_id BIGINT, held_out BOOLEAN, lang_pred STRING, score DOUBLE, ambiguous BOOLEAN"
#: Letters, and the few numbers that the class takes for such.
_LETTERS = re.compile(r"[^\W\d_]+")
_NOT_LETTERS = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")


def has_letter(text: str) -> bool:
    return any(any(map(str.isalpha, m[0])) for m in _LETTERS.finditer(text))


def cells(text: bytes, n_cells: int = CELLS) -> np.ndarray:
    """Table cells of a text's n-grams; what is no letter is one blank."""
    plain = _NOT_LETTERS.sub(b" ", text.decode().lower().encode())
    b = np.frombuffer(b" " + plain + b" ", np.uint8).astype(np.uint32)
    out = []
    for n in ORDERS:
        if len(b) >= n:
            h = np.full(len(b) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for j in range(n):
                h = (h ^ b[j : len(b) - n + 1 + j]) * np.uint32(0x01000193)
            out.append((h ^ (h >> np.uint32(15))) % np.uint32(n_cells))
    return np.concatenate(out).astype(np.int64)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1; any two differ in half of the columns."""
    h = np.ones((1, 1), np.int8)
    while len(h) <= max(n, 7):
        h = np.block([[h, h], [h, -h]])
    return h[1 : n + 1, 1:]  # the first row and column are constant


@dataclass(frozen=True)
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # cells x bits

    def margins(self, text: bytes) -> np.ndarray:
        """Mean log ratio of the text's n-grams for each bit."""
        at, n = np.unique(cells(text, len(self.weights)), return_counts=True)
        return n @ self.weights[at] / n.sum()

    def decode(self, margins: np.ndarray) -> tuple[str, float]:
        """The nearest codeword and how much nearer it is than the next (0 to 1)."""
        sure = np.abs(margins) + 1e-9
        scale = sure.mean()
        loss = (sure / sure.sum() * np.logaddexp(0, -2 * self.code * margins / scale)).sum(1)
        order = np.argsort(loss, kind="stable")
        if len(order) == 1:
            return self.langs[0], 1.0
        return self.langs[order[0]], float(1 - np.exp(-4 * (loss[order[1]] - loss[order[0]])))

    def predict(self, text: bytes) -> tuple[str, float]:
        if not self.langs or not has_letter(text.decode()):
            return UNKNOWN, 0.0
        return self.decode(self.margins(text))


def _totals(n_cells: int):
    def totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch, texts in chunks(batches, "text"):
            for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(n_cells, np.int64)
                sums[lang] += np.bincount(cells(text, n_cells), minlength=n_cells)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "cell", "n"])

    return totals


def train(labelled: DataFrame, n_cells: int = CELLS, most: int = MOST_LANGS) -> Model:
    """A model of all rows of (lang, text). The driver gets one number for each language and cell."""
    named = labelled.where("lang is not null").select("lang").distinct().limit(most + 1).count()
    if named > most:
        raise ValueError(f"over {most} distinct labels: not a column of languages")
    sums = labelled.where("lang is not null").select("lang", "text").mapInArrow(_totals(n_cells), "lang STRING, cell BIGINT, n BIGINT")
    got = sums.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    if not langs:
        return Model([], np.zeros((0, 1), np.int8), np.zeros((n_cells, 1), np.float32))
    counts = np.full((len(langs), n_cells), 0.5)
    np.add.at(counts, (got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(), got["cell"].to_numpy()), got["n"].to_numpy())
    freq = counts / counts.sum(1, keepdims=True)
    code = codewords(len(langs))
    weights = np.zeros((n_cells, code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        up, down = code[:, bit] > 0, code[:, bit] < 0
        if up.any() and down.any():
            weights[:, bit] = np.log(freq[up].mean(0) / freq[down].mean(0))
    useful = np.abs(weights).sum(0) > 0
    return Model(langs, code[:, useful], weights[:, useful])


def _predict(model: Model):
    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            found = [model.predict(t) for t in texts]
            score = np.clip([s for _, s in found], 0, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([p for p, _ in found]), pa.array(score), pa.array([bool(p != UNKNOWN and s < AMBIGUOUS) for (p, _), s in zip(found, score, strict=True)])],
                names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    return predict


def held_out(ident: Column) -> Column:
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the labelled rows that are not held out, then predicts all rows.

    Held out are rows whose crc32 of the identifier's digits leaves 2 modulo 4.
    """
    ident = F.col(f"`{id_col}`")
    rows = docs.select(ident.cast("bigint").alias("doc_id"), held_out(ident).alias("held_out"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    model = train(rows.where("not held_out"))
    return rows.select("doc_id", "held_out", "text").mapInArrow(_predict(model), SCHEMA)


def _named(model: Model, text_col: str, lang_col: str):
    def named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, text_col):
            found = [model.predict(t) for t in texts]
            at = batch.schema.get_field_index(lang_col)
            given = batch.column(at).to_pylist()
            lang = [p if s >= AMBIGUOUS or g is None else g for (p, s), g in zip(found, given, strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(lang, batch.schema.field(at).type)).filter(pa.array([p != UNKNOWN for p, _ in found]))

    return named


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language can be told, with the predicted language in ``lang_col``; those without a letter go.

    A row flagged as ambiguous is routed by the label that it came with, if it has one. Nothing is
    shuffled.
    """
    rows = docs.select(held_out(F.col(f"`{id_col}`")).alias("held_out"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    return docs.mapInArrow(_named(train(rows.where("not held_out")), text_col, lang_col), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
