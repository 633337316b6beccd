"""Quality rules of documents and of their hosts.

Five rules are measured on each whole text. Their failures are summed by host, and each host's
rate is shrunk towards the corpus by a beta prior fitted to the hosts. The prior's moments are
those of the true rates: the spread that chance alone gives hosts of their sizes is taken out,
so a corpus of small hosts that differ by chance only gets a heavy prior. A host is bad by a
rule if most of its documents break it (shrunk rate over one half) and the odds that they do are
over ``LIFT`` times those of the whole corpus; a bad host loses its documents with it.

DataFrame functions only: repeated three-word windows are found by sorting each document's
windows by hash and position, and comparing the words of neighbours that agree.

Defined results: a null or empty text has no words and fails; a very long text is measured
whole (its windows' keys give the position as many bits as it needs); a null host has no
verdict, so its documents are judged alone; one host alone has no spread, so its rate is the
corpus's and it is never bad; rows that repeat an identifier are judged each; a null identifier
stays null; an empty table gives an empty result; columns of any other name are left out of
sight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import SPACE, stage

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A host is bad by a rule if its odds of failing are over 1 and over this many times the corpus's odds.
LIFT = 10.0
#: Bounds of the correlation within a host: chance alone, and hosts that fail wholly or not at all.
LEAST, MOST = 1e-6, 1 - 1e-6
SYMBOLS = "#*$%&|<>"
RULES = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "odd_words": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)",
}


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{host_col}`").cast("string").alias("host"), text.alias("t"))
    rows = rows.select(
        "doc_id",
        "host",
        F.filter(F.split("t", f"{SPACE}+"), lambda w: w != "").alias("w"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda line: F.length(F.translate(line, " \t\x0b\x0c\r", "")) > 0).alias("lines"),
    )
    rows = rows.withColumn("n", F.size("w"))
    # A key is a window's hash with its position in the low bits, as many as the text's length needs.
    rows = rows.withColumn("b", F.length(F.bin(F.col("n").cast("bigint"))))
    keys = "transform(sequence(0, n - 3), i -> shiftleft(shiftright(xxhash64(w[i], w[i + 1], w[i + 2]), b), b) | i)"
    rows = rows.withColumn("s", F.expr(f"CASE WHEN n >= 3 THEN sort_array({keys}) ELSE cast(array() AS array<bigint>) END"))
    same = "shiftright(x, b) = shiftright(get(s, i {} 1), b)"
    rows = rows.withColumn("c", F.expr(f"transform(filter(s, (x, i) -> {same.format('-')} OR {same.format('+')}), x -> cast(x & (shiftleft(1L, b) - 1) AS int))"))
    rows = rows.withColumn("t", F.expr("sort_array(transform(c, p -> struct(concat_ws(' ', w[p], w[p + 1], w[p + 2]) AS t, p AS p)))"))
    rows = rows.withColumn("r", F.expr("sort_array(transform(filter(t, (x, i) -> x.t = get(t, i - 1).t OR x.t = get(t, i + 1).t), x -> x.p))"))
    return rows.select(
        "doc_id",
        "host",
        F.col("n").cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.expr("aggregate(transform(r, (p, i) -> least(3, coalesce(get(r, i + 1) - p, 3))), 0L, (a, x) -> a + x)").alias("n_repeat_words"),
    )


def hosts(rows: DataFrame) -> DataFrame:
    """Per host: documents, shrunk failure rate of each rule, and whether it is good."""
    counts = stage(
        rows.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.expr(rule)).alias(name) for name, rule in RULES.items()]),
        "hosts",
    )
    # The driver gets a row of moments, whatever the number of hosts.
    n = F.col("n").cast("double")
    sums = [F.sum(n).alias("n"), F.sum(n * n).alias("nn"), F.count(F.lit(1)).alias("k")]
    got = counts.agg(*sums, *[F.sum(r).alias(f"{r}_f") for r in RULES], *[F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_q") for r in RULES]).first()
    out, good = counts, F.lit(True)
    for r in RULES:
        mean, weight = prior(got["n"] or 0, got["nn"] or 0, got["k"], got[f"{r}_f"] or 0, got[f"{r}_q"] or 0)
        rate = (F.col(r) + mean * weight) / (F.col("n") + weight)
        out = out.withColumn(f"{r}_rate", rate)
        good = good & (F.col(f"{r}_rate") <= limit(mean))
    return out.withColumn("good", good)


def prior(n: float, nn: float, k: int, failed: float, q: float) -> tuple[float, float]:
    """Mean and weight (in documents) of the beta prior.

    ``n`` and ``nn`` are the sums of the hosts' sizes and of their squares, ``k`` their number, ``failed``
    the sum of failures f, ``q`` that of f * f / size. The weighted spread of the hosts' rates is, in
    expectation, m (1 - m) ((k - 1) + rho (n - nn / n - (k - 1))) for rates that correlate by rho within a
    host; the prior's weight is 1 / rho - 1.
    """
    mean = failed / n if n else 0.0
    noise, room = mean * (1 - mean) * (k - 1), n - nn / n - (k - 1) if n else 0.0
    rho = (q - n * mean * mean - noise) / (mean * (1 - mean) * room) if mean * (1 - mean) > 0 and room > 0 else 0.0
    rho = min(max(rho, LEAST), MOST)
    return mean, 1 / rho - 1


def limit(mean: float) -> float:
    """The shrunk rate over which a host is bad."""
    odds = max(1.0, LIFT * mean / (1 - mean)) if mean < 1 else float("inf")
    return odds / (1 + odds) if odds < float("inf") else 1.0


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The features of each row, base_failed and kept."""
    rows = stage(features(docs, id_col, text_col, host_col), "quality")
    verdicts = hosts(rows).select("host", "good")
    base = F.expr(f"{RULES['few_words']} or {RULES['repeats']}")
    return rows.join(verdicts, "host", "left").withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & F.coalesce("good", F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _rule_sql() -> str:
    priors = []
    for r in RULES:
        mean, q = f"(sum({r}) / sum(n))", f"sum({r} * {r} / n)"
        var, room = f"({mean} * (1 - {mean}))", "(sum(n) - sum(n * n) / sum(n) - (count(*) - 1))"
        rho = f"CASE WHEN {var} > 0 AND {room} > 0 THEN ({q} - sum(n) * {mean} * {mean} - {var} * (count(*) - 1)) / ({var} * {room}) ELSE 0 END"
        limit = f"CASE WHEN {mean} < 1 THEN greatest(1.0, {LIFT} * {mean} / (1 - {mean})) / (1 + greatest(1.0, {LIFT} * {mean} / (1 - {mean}))) ELSE 1.0 END"
        priors.append(f"{mean} AS {r}_mean, 1 / least(greatest({rho}, {LEAST}), {MOST}) - 1 AS {r}_weight, {limit} AS {r}_limit")
    good = " AND ".join(f"({r} + {r}_mean * {r}_weight) / (n + {r}_weight) <= {r}_limit" for r in RULES)
    counts = ", ".join(f"CAST(count(*) FILTER ({rule}) AS DOUBLE) AS {r}" for r, rule in RULES.items())
    return f"h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, {counts} FROM f WHERE host IS NOT NULL GROUP BY host), pr AS (SELECT {', '.join(priors)} FROM h), v AS (SELECT host, {good} AS good FROM h, pr)"


SQL = rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
m AS (SELECT doc_id, s FROM p GROUP BY 1, 2 HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM p JOIN m USING (doc_id, s), unnest(range(3)) AS u(k) GROUP BY doc_id),
f AS (SELECT w.doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
{_rule_sql()},
b AS (SELECT *, {RULES["few_words"]} OR {RULES["repeats"]} AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(good, true) AS kept FROM b LEFT JOIN v USING (host)
"""
