"""Mixing sources to target weights.

A tree of domain, language and source has a weight on each node. The token budget is passed
down it: at each node the children share the budget by weight, and what a child can't use (its
documents' tokens times ``epochs``) goes to its siblings before it goes up. As children short
of tokens are settled in order of capacity over weight, a node's shares come from one running
sum over its children. Each leaf then takes whole epochs and, for the rest of its budget, the
shortest prefix that holds it of one more epoch in a seeded order. The prefix is found by a
sum over hash buckets and a running sum in the bucket where it ends, so a leaf with a third of
the corpus is never sorted in one task; what the documents are compared with is one cut-off for
each leaf.

Tokens are BPE ids, as packing counts them (without its end ids), or words between white space.
The children of one node are ranked in one task: a row for each domain, each language of a
domain, and each source of a language, never one for a document.

Defined results: null languages and sources are nodes of their own (named ''); a null or empty
text has no tokens and goes with its leaf's whole epochs; a very long text is counted whole and
taken whole if the prefix reaches it; rows that repeat an identifier share a place and are taken
or left by it; an empty table gives an empty result; columns of any other name are left out of
sight, and ``take`` hands them on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import tokens
from plumbline.llm.common import chunks, stage
from plumbline.llm.token_counts import word_count

LEAF = ["domain", "lang", "source"]
#: Digits of a place that are settled by sums; what shares them is sorted (a leaf's 65,536th part).
DIGITS = 4


@dataclass(frozen=True)
class Mix:
    """Budget (a share of all tokens), epochs at most, seed, SQL for each node's name and weight, and what a token is.

    ``tokens`` is the path of a vocabulary, "" for the default one, or "words".
    """

    share: float = 0.8
    epochs: int = 2
    seed: int = 17
    domain: str = "concat('group', coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS bigint), 0) % 4)"
    domain_weight: str = "CASE domain WHEN 'group0' THEN 0.4 WHEN 'group1' THEN 0.3 ELSE 0.15 END"
    lang_weight: str = "CASE lang WHEN 'en' THEN 0.5 WHEN 'de' THEN 0.2 WHEN 'fr' THEN 0.2 ELSE 0.1 END"
    source_weight: str = "1.0"
    tokens: str = ""


PRODUCTION = Mix()


def leaves(docs: DataFrame, mix: Mix, id_col: str, *more: Column, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, domain, lang, source and more of each row; no other name of the table gets in the way."""
    named = lambda c, name: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), named(lang_col, "lang"), named(source_col, "source"), *more)
    return rows.withColumn("domain", F.expr(mix.domain))


def order(mix: Mix, epoch, ident):
    """A document's place in an epoch: a digest of seed, epoch and identifier, then the identifier."""
    name = F.coalesce(ident.cast("string"), F.lit(""))
    return F.concat(F.md5(F.concat(F.lit(f"{mix.seed}:"), epoch.cast("string"), F.lit(":"), name).cast("binary")), F.lit(":"), F.lpad(name, 20, "0"))


def share_out(children: DataFrame, parent: list[str], weight: str) -> DataFrame:
    """Adds ``budget`` to children with a capacity ``cap``, out of their parent's ``given``."""
    node = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = node.orderBy(F.col("cap") / F.col("w"), *[F.col(c) for c in LEAF if c in children.columns]).rowsBetween(Window.unboundedPreceding, -1)
    rows = children.withColumn("w", F.expr(weight).cast("double"))
    rows = rows.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("w_left", F.sum("w").over(node) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", F.max((F.col("given") - F.col("cap_before")) / F.greatest("w_left", F.lit(1e-12))).over(node))
    return rows.withColumn("budget", F.least("cap", F.col("level") * F.col("w"))).drop("w", "cap_before", "w_left", "level", "given")


def budgets(counts: DataFrame, mix: Mix) -> DataFrame:
    """Per leaf of (domain, lang, source, tokens): its token budget."""
    caps = counts.withColumn("cap", F.col("tokens").cast("double") * mix.epochs)
    by_lang = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    by_domain = by_lang.groupBy("domain").agg(F.sum("cap").alias("cap"))
    total = F.sum("cap").over(Window.partitionBy(F.lit(0))) / mix.epochs * mix.share
    by_domain = share_out(by_domain.withColumn("given", total), [], mix.domain_weight)
    by_lang = share_out(by_lang.join(by_domain.select("domain", F.col("budget").alias("given")), "domain"), ["domain"], mix.lang_weight)
    return share_out(caps.join(by_lang.select("domain", "lang", F.col("budget").alias("given")), ["domain", "lang"]), ["domain", "lang"], mix.source_weight)


def plan(rows: DataFrame, mix: Mix) -> DataFrame:
    """Per leaf: whole epochs and the cut-off of the next (null: none of it).

    ``rows`` has doc_id, domain, lang, source, n_tokens and is read several times.
    """
    counts = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    goals = budgets(counts, mix).withColumn("goal", F.floor(F.col("budget") + 1e-6).cast("bigint"))
    goals = goals.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("goal") / F.greatest("tokens", F.lit(1))).cast("int")).otherwise(F.lit(mix.epochs)))
    goals = stage(goals.select(*LEAF, "whole", F.when(F.col("tokens") > 0, F.col("goal") - F.col("whole") * F.col("tokens")).otherwise(F.lit(0)).cast("bigint").alias("rest")), "mix-goals")
    placed = rows.join(goals.where("rest > 0"), LEAF).select(*LEAF, "n_tokens", order(mix, F.col("whole"), F.col("doc_id")).alias("place"))
    placed = stage(placed, "mix-places")
    # The end of each leaf's prefix, two hexadecimal digits of the place at a time: a sum for each
    # of 256 buckets, a running sum over those, and the bucket in which what is needed is reached.
    end = goals.where("rest > 0").select(*LEAF, F.lit("").alias("bucket"), F.col("rest").alias("need"))
    for digits in range(0, DIGITS, 2):
        inside = placed.withColumn("bucket", F.substring("place", 1, digits)).join(end, [*LEAF, "bucket"])
        sums = inside.groupBy(*LEAF, F.substring("place", 1, digits + 2).alias("bucket")).agg(F.sum("n_tokens").alias("n"), F.first("need").alias("need"))
        up_to = Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("n").over(up_to))
        end = stage(sums.where("upto - n < need and upto >= need").select(*LEAF, "bucket", (F.col("need") - (F.col("upto") - F.col("n"))).alias("need")), "mix-end")
    up_to = Window.partitionBy(*LEAF).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.withColumn("bucket", F.substring("place", 1, DIGITS)).join(end, [*LEAF, "bucket"])
    last = inside.withColumn("sofar", F.sum("n_tokens").over(up_to)).where("sofar - n_tokens < need")
    cuts = last.groupBy(*LEAF).agg(F.max("place").alias("cut"))
    return goals.join(cuts, LEAF, "left").select(*LEAF, "whole", "cut")


def _taken(rows: DataFrame, goals: DataFrame, mix: Mix) -> DataFrame:
    """``rows`` with a row for each epoch that takes it, in column epoch."""
    extra = F.coalesce(order(mix, F.col("whole"), F.col("doc_id")) <= F.col("cut"), F.lit(False))
    joined = rows.join(goals, LEAF).withColumn("times", F.col("whole") + extra.cast("int"))
    return joined.where("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))


def _count(path: str):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            n = pa.array([len(tokens.encoded(t.decode(), path)) // 4 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", *LEAF)], n], names=["doc_id", *LEAF, "n_tokens"])

    return count


def counted(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", **names: str) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens of each row, written out."""
    text = F.col(f"`{text_col}`")
    if mix.tokens == "words":
        return stage(leaves(docs, mix, id_col, word_count(text).alias("n_tokens"), **names), "mix-docs")
    rows = leaves(docs, mix, id_col, text.alias("text"), **names)
    return stage(rows.mapInArrow(_count(mix.tokens or tokens.default_path()), "doc_id BIGINT, domain STRING, lang STRING, source STRING, n_tokens BIGINT"), "mix-docs")


def mixed(docs: DataFrame, mix: Mix = PRODUCTION, **names: str) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epoch: a row for each time that a document is taken."""
    rows = counted(docs, mix, **names)
    return _taken(rows, plan(rows, mix), mix).select("doc_id", *LEAF, "n_tokens", "epoch")


def take(docs: DataFrame, mix: Mix = PRODUCTION, id_col: str = "doc_id", text_col: str = "text", **names: str) -> DataFrame:
    """The rows of ``docs`` that the mix takes, as often as it does, with their columns."""
    goals = stage(plan(counted(docs, mix, id_col, text_col, **names), mix), "mix-plan")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return _taken(leaves(docs, mix, id_col, whole, **names), goals, mix).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _share_sql(name: str, source: str, parent: str, weight: str, keys: str) -> str:
    part = f"PARTITION BY {parent}" if parent else ""
    before = f"({part} ORDER BY cap / w, {keys} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{name}_w AS (SELECT *, CAST({weight} AS DOUBLE) AS w FROM ({source})),
{name}_s AS (SELECT *, coalesce(sum(cap) OVER {before}, 0) AS cap_before, sum(w) OVER ({part}) - coalesce(sum(w) OVER {before}, 0) AS w_left FROM {name}_w),
{name}_l AS (SELECT *, max((given - cap_before) / greatest(w_left, 1e-12)) OVER ({part}) AS level FROM {name}_s),
{name} AS (SELECT * EXCLUDE (given), least(cap, level * w) AS budget FROM {name}_l)"""


def sql(mix: Mix) -> str:
    """The same mix in SQL, where tokens are words (SQL has no tokenizer)."""
    place = f"md5('{mix.seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) || ':' || lpad(coalesce(CAST(doc_id AS VARCHAR), ''), 20, '0')"
    keys = "domain, lang, source"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
rows_ AS (SELECT *, {mix.domain} AS domain FROM d),
caps AS (SELECT {keys}, sum(n_tokens) AS tokens, CAST(sum(n_tokens) AS DOUBLE) * {mix.epochs} AS cap FROM rows_ GROUP BY {keys}),
cl AS (SELECT domain, lang, sum(cap) AS cap FROM caps GROUP BY domain, lang),
cd AS (SELECT domain, sum(cap) AS cap FROM cl GROUP BY domain),
{_share_sql("bd", f"SELECT *, (SELECT sum(cap) FROM cd) / {mix.epochs} * {mix.share} AS given FROM cd", "", mix.domain_weight, "domain")},
{_share_sql("bl", "SELECT cl.*, bd.budget AS given FROM cl JOIN bd USING (domain)", "domain", mix.lang_weight, "domain, lang")},
{_share_sql("bs", "SELECT caps.*, bl.budget AS given FROM caps JOIN bl USING (domain, lang)", "domain, lang", mix.source_weight, keys)},
g AS (SELECT {keys}, tokens, CAST(floor(budget + 1e-6) AS BIGINT) AS goal FROM bs),
g2 AS (SELECT *, CASE WHEN tokens > 0 THEN CAST(floor(goal / tokens) AS INT) ELSE {mix.epochs} END AS whole FROM g),
g3 AS (SELECT {keys}, whole, CASE WHEN tokens > 0 THEN goal - whole * tokens ELSE 0 END AS rest FROM g2),
o AS (SELECT r.*, whole, rest, sum(n_tokens) OVER (PARTITION BY {keys} ORDER BY {place} ROWS UNBOUNDED PRECEDING) AS sofar FROM rows_ r JOIN g3 USING ({keys})),
n AS (SELECT *, whole + CASE WHEN sofar - n_tokens < rest THEN 1 ELSE 0 END AS times FROM o)
SELECT doc_id, {keys}, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(e AS INT) AS epoch FROM n, unnest(range(times)) AS u(e)
"""
