"""A training corpus from raw documents, in stages that are each written and read again.

Stages take and return the columns of documents, whatever further columns there are; the last
returns pieces of windows. Defined results: a null or empty text, or one without a letter, goes
at the first stage; of equal texts the smallest identifier stays, and of rows that repeat that
too, one; a null identifier stays only if its group has no other; of near documents the smallest
identifier of the component stays; a very long text is handled whole by every stage; null
sources are a leaf of their own; an empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import exact_dedup, language_id, mixing, packing, simhash
from plumbline.llm.common import forget, stage, written

#: The mix of the pipeline: nine tenths of the BPE tokens, no document twice.
MIX = mixing.Mix(share=0.9, epochs=1)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, under the predicted language; an ambiguous one keeps its own label."""
    return language_id.keep(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near fingerprints."""
    return simhash.keep(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents up to each leaf's share of the token budget; the tree's languages are the predicted ones."""
    return mixing.take(docs, MIX)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training windows."""
    return packing.packed(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]
#: Tokenizer, fingerprints and classifiers are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = written()
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        forget(spark, start, written() - 1)  # what led to this stage's rows: its own tables and the stage before
        start = written() - 1
    return STAGES[-1][1](spark, docs, sf_dir)
