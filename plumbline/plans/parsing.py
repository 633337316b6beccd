"""Text functions over many generated texts: pieces chosen by the digits of a digest of the row's identifier.

The SQL builds the same texts and parses them in its own way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import identity, scalars
from plumbline.plans.registry import n, query

# -- texts ----------------------------------------------------------------------------------


def _digit(key: Column, k: int, salt: str = "") -> Column:
    """The k-th hexadecimal digit (from 1) of the key's digest."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string")).cast("binary")), k, 1), 16, 10).cast("int")


def _pick(pieces: list[str], digit: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in pieces]), digit % len(pieces) + 1)


def _text_sql(pieces: list[str], digit: str) -> str:
    quoted = ", ".join("'" + x.replace("'", "''") + "'" for x in pieces)
    return f"[{quoted}][{digit} % {len(pieces)} + 1]"


def _digit_sql(key: str, k: int, salt: str = "") -> str:
    return f"CAST('0x' || substr(md5('{salt}' || {key}), {k}, 1) AS INT)"


_CONV = "(conv_id || '.' || turn)"


def _conv(t):
    return t.read("conversations", "conv_id", "turn").withColumn("key", F.concat(F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")))


_HEADS = ["</think>", "Answer: D\n</think>", "x</think>y</think>", "no end"]
_LINES = ["Answer: B", "Answer:  C ", "  Answer: A", "Answer: Z", "Answer:", "answer: D", "Confidence: 85", "Confidence: 140", "\tConfidence: 7", "Confidence: high", "Confidence:", "so", "", "The Answer: A", "Confidence: -3", "Answer: AB"]
_NATURAL = "x AS (SELECT conv_id, turn, " + " || chr(10) || ".join([_text_sql(_HEADS, _digit_sql(_CONV, 1)), *[_text_sql(_LINES, _digit_sql(_CONV, k)) for k in range(2, 8)]]) + " AS out FROM conversations)"
_BLOCK = r"""ls AS (SELECT *, string_split(region, chr(10)) AS l FROM rg),
ai AS (SELECT *, list_max(list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '^[ \t]*Answer:'))) AS a FROM ls),
pt AS (SELECT *, trim(replace(substr(l[a], strpos(l[a], ':') + 1), chr(9), ' ')) AS raw, CASE WHEN regexp_matches(l[a + 1], '^[ \t]*Confidence:') THEN trim(replace(substr(l[a + 1], strpos(l[a + 1], ':') + 1), chr(9), ' ')) END AS ct FROM ai),
ps AS (SELECT *, CASE WHEN a IS NULL OR raw = '' THEN 'missing' WHEN raw IN ('A', 'B', 'C', 'D') THEN 'parsed' ELSE 'out_of_domain' END AS answer_status, try_cast(ct AS BIGINT) AS num FROM pt),
fin AS (SELECT *, CASE WHEN answer_status = 'parsed' THEN raw END AS answer, num AS confidence, CASE WHEN ct IS NULL THEN 'missing' WHEN num IS NULL THEN 'malformed' WHEN num BETWEEN 0 AND 100 THEN 'parsed' ELSE 'out_of_range' END AS confidence_status FROM ps)"""
_OUT = ["conv_id", "turn", "answer", "answer_status", "confidence", "confidence_status"]


def _block(rows, region: Column):
    got = rows.withColumn("p", scalars.terminal_block(region))
    return got.select("conv_id", "turn", *[F.col(f"p.{c}").alias(c) for c in _OUT[2:]])


@query("fn10", f"WITH {_NATURAL}, rg AS (SELECT *, CASE WHEN strpos(out, '</think>') > 0 THEN substr(out, strpos(out, '</think>') + 8) END AS region FROM x), {_BLOCK} SELECT {', '.join(_OUT)} FROM fin", domain=False)
def fn10(t):
    """Natural outputs: the last answer line after the reasoning, and the confidence right below it."""
    out = F.concat_ws("\n", _pick(_HEADS, _digit(F.col("key"), 1)), *[_pick(_LINES, _digit(F.col("key"), k)) for k in range(2, 8)])
    return _block(_conv(t), scalars.natural_region(out))


_BEGUN = [" A", " b", "C", " X", "", "  D ", " A B", "\nAnswer: C"]
_FORCED = f"rg AS (SELECT conv_id, turn, 'Answer:' || {_text_sql(_BEGUN, _digit_sql(_CONV, 1))} || chr(10) || {_text_sql(['Confidence: ', 'Confidence:', '', ' Confidence:  '], _digit_sql(_CONV, 2))} || ({_digit_sql(_CONV, 3)} * 16 + {_digit_sql(_CONV, 4)}) || {_text_sql(['', ' ', '%', chr(10) + 'x'], _digit_sql(_CONV, 5))} AS region FROM conversations)"


@query("fn11", f"WITH {_FORCED}, {_BLOCK} SELECT {', '.join(_OUT)} FROM fin", domain=False)
def fn11(t):
    """Forced outputs: what the inducer began is put back first."""
    d = lambda k: _digit(F.col("key"), k)
    number = (d(3) * 16 + d(4)).cast("string")
    forced = F.concat(_pick(_BEGUN, d(1)), F.lit("\n"), _pick(["Confidence: ", "Confidence:", "", " Confidence:  "], d(2)), number, _pick(["", " ", "%", "\nx"], d(5)))
    return _block(_conv(t), F.concat(F.lit("Answer:"), forced))


# -- tokens ---------------------------------------------------------------------------------

_ENV = "'{\"serialization_version\":\"part1-canonical-json-v1\",\"value\":'"


@query("fn09", f"SELECT doc_id, sha256({_ENV} || '{{\"prefix_version\":\"part1-token-id-prefix-v1\",\"token_ids\":[' || array_to_string(list_transform(range(1, doc_id % 17 + 1), lambda k: CAST('0x' || substr(md5('' || doc_id), CAST(k AS INT), 1) AS INT) * 1000 + k), ',') || ']}}}}') AS h FROM documents", domain=False)
def fn09(t):
    """The digest of a prefix of token ids, none to sixteen."""
    digest = F.md5(F.col("doc_id").cast("string").cast("binary"))
    many = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: F.conv(F.substring(digest, k, 1), 16, 10).cast("int") * 1000 + k)
    return t.read("documents", "doc_id").select("doc_id", identity.prefix_hash(F.slice(many, F.lit(1), (F.col("doc_id") % 17).cast("int"))).alias("h"))


@query("fn12", f"SELECT doc_id, CASE WHEN strpos(h, p) > 0 THEN CAST(strpos(h, p) - 1 AS INT) END AS at_start FROM (SELECT doc_id, md5('' || doc_id) AS h, substr(md5('part' || doc_id), 1, 1 + CAST(doc_id % 3 AS INT)) AS p FROM documents)", domain=False)
def fn12(t):
    """The first place of a run of one to three tokens in a longer one of 32, if it is there."""
    key = F.col("doc_id")
    whole, part = (F.split(F.md5(F.concat(F.lit(salt), key.cast("string")).cast("binary")), "") for salt in ("", "part"))
    return t.read("documents", "doc_id").select("doc_id", scalars.find_sequence(whole, F.slice(part, F.lit(1), (1 + key % 3).cast("int"))).alias("at_start"))


_TOKENS = ["The", " an", "swe", "r:", " ", "é", "long token", "\n"]
_TOKENS_SQL = "[" + ", ".join(_text_sql(_TOKENS, _digit_sql("doc_id", k)) for k in range(1, 7)) + "]"


@query("fn15", f"tk AS (SELECT doc_id, {_TOKENS_SQL} AS w, {_digit_sql('doc_id', 8)} * 2 AS p FROM documents), en AS (SELECT *, list_transform(range(1, 7), lambda k: len(array_to_string(w[1:k], ''))) AS ends FROM tk) SELECT doc_id, CASE WHEN p < ends[6] THEN CAST(len(list_filter(ends, lambda e: e <= p)) AS INT) END AS token FROM en".replace("tk AS", "WITH tk AS", 1), domain=False)
def fn15(t):
    """The token that holds a character of the joined text; null beyond its end."""
    tokens = F.array(*[_pick(_TOKENS, _digit(F.col("doc_id"), k)) for k in range(1, 7)])
    return t.read("documents", "doc_id").select("doc_id", scalars.token_at(tokens, _digit(F.col("doc_id"), 8) * 2).alias("token"))


# -- confidences ----------------------------------------------------------------------------

_BEFORE, _AFTER = ["", " ", "<", "< ", "", "x", "<<", ""], ["", ">", " >", "<|im_end|>", "><|im_end|>", "%", " ", " <|im_end|>"]
_RAW = f"rw AS (SELECT doc_id, lang, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE {_text_sql(_BEFORE, _digit_sql('doc_id', 1))} || ({_digit_sql('doc_id', 2)} * 8 + {_digit_sql('doc_id', 3)} % 8) || {_text_sql(_AFTER, _digit_sql('doc_id', 4))} END AS raw FROM documents), rv AS (SELECT *, CASE WHEN try_cast(coalesce(nullif(regexp_extract(trim(raw), '^([0-9]+)[ ]*(<.im_end.>)?$', 1), ''), nullif(regexp_extract(trim(raw), '^<[ ]*([0-9]+)[ ]*>(<.im_end.>)?$', 1), '')) AS INT) BETWEEN 0 AND 100 THEN CAST(coalesce(nullif(regexp_extract(trim(raw), '^([0-9]+)[ ]*(<.im_end.>)?$', 1), ''), nullif(regexp_extract(trim(raw), '^<[ ]*([0-9]+)[ ]*>(<.im_end.>)?$', 1), '')) AS INT) END AS v FROM rw)"


def _raw(t):
    d = lambda k: _digit(F.col("doc_id"), k)
    text = F.concat(_pick(_BEFORE, d(1)), (d(2) * 8 + d(3) % 8).cast("string"), _pick(_AFTER, d(4)))
    return t.read("documents", "doc_id", "lang").withColumn("raw", F.when(F.col("doc_id") % 11 != 0, text)).withColumn("v", scalars.repaired_confidence(F.col("raw")))


@query("fn13", f"WITH {_RAW} SELECT doc_id, v AS confidence FROM rv", domain=False)
def fn13(t):
    """Repair of a stated confidence that is wrapped or ends in a token of the chat format."""
    return _raw(t).select("doc_id", F.col("v").alias("confidence"))


@query("ana14", f"WITH {_RAW} SELECT lang, count(*) AS n, count(*) FILTER (regexp_full_match(raw, '[0-9]+') AND v IS NOT NULL) AS parsed, count(*) FILTER (v IS NOT NULL AND NOT regexp_full_match(raw, '[0-9]+')) AS recovered, count(v) AS usable FROM rv GROUP BY lang", domain=False)
def ana14(t):
    """Confidences before and after repair."""
    rows = _raw(t)
    plain = F.col("raw").rlike("^[0-9]+$") & F.col("v").isNotNull()
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(plain).alias("parsed"), F.count_if(F.col("v").isNotNull() & ~plain).alias("recovered"), F.count("v").alias("usable"))


_LOOSE = ["Answer: D", "**Answer**: b", "_answer_ : `c`", "ANSWER:a", "confidence: 40", "**Confidence**: 120", "Confidence 30", "_confidence_:\n7", "Answer - A", "Answers: C", "so", "Answer: E", "CONFIDENCE : `99`", "answer:\n\n**B**", "Confidence: 1000", "x"]
_LOOSE_SQL = " || ' ' || ".join(_text_sql(_LOOSE, _digit_sql(_CONV, k)) for k in range(1, 5))


@query(
    "fn14",
    rf"WITH lo AS (SELECT conv_id, turn, replace(replace(replace(lower({_LOOSE_SQL}), '*', ''), '_', ''), '`', '') AS s FROM conversations) SELECT conv_id, turn, upper(list_last(regexp_extract_all(s, 'answer\s*:\s*([abcd])', 1))) AS answer, CASE WHEN regexp_matches(s, 'confidence\s*:\s*[0-9]') THEN least(100, CAST(list_last(regexp_extract_all(s, 'confidence\s*:\s*([0-9]{{1,3}})', 1)) AS INT)) END AS confidence FROM lo",
    domain=False,
)
def fn14(t):
    """A tolerant parse: any case, emphasis, the last match."""
    text = F.concat_ws(" ", *[_pick(_LOOSE, _digit(F.col("key"), k)) for k in range(1, 5)])
    return _conv(t).select("conv_id", "turn", scalars.tolerant_answer(text).alias("answer"), scalars.tolerant_confidence(text).alias("confidence"))


# -- times and expected keys ------------------------------------------------------------------

_DATES = ["2026-02-28", "2026-02-29", "2024-02-29", "2026-13-01", "2026-00-10", "2026-04-31", "2026-12-31", "26-01-01"]
_TIMES = ["10:00:00", "23:59:59", "24:00:00", "10:60:00", "10:00:60", "10:00", "07:08:09.25", "1:00:00"]
_ENDS = ["Z", "z", "+02:00", "-11:30", "", "+2:00", " Z", "+02:00 x"]


@query(
    "fn22",
    f"WITH ts AS (SELECT doc_id, {_text_sql(_DATES, _digit_sql('doc_id', 1))} AS d, {_text_sql(['T', 'T', 't', ' '], _digit_sql('doc_id', 2))} AS sep, {_text_sql(_TIMES, _digit_sql('doc_id', 3))} AS h, {_text_sql(_ENDS, _digit_sql('doc_id', 4))} AS z FROM documents) SELECT doc_id, try_cast(d AS DATE) IS NOT NULL AND len(d) = 10 AND sep = 'T' AND h IN ('10:00:00', '23:59:59', '07:08:09.25') AND z IN ('Z', '+02:00', '-11:30') AS valid FROM ts",
    domain=False,
)
def fn22(t):
    """Times with an offset, of dates that exist."""
    d = lambda k: _digit(F.col("doc_id"), k)
    text = F.concat(_pick(_DATES, d(1)), _pick(["T", "T", "t", " "], d(2)), _pick(_TIMES, d(3)), _pick(_ENDS, d(4)))
    return t.read("documents", "doc_id").select("doc_id", scalars.is_rfc3339(text).alias("valid"))


@query("sel06", "SELECT c_custkey AS qid, CASE WHEN q.qid IS NULL THEN 'skipped' WHEN q.full_runs > 0 THEN 'closed' ELSE 'truncated' END AS status FROM customer LEFT JOIN (SELECT qid, count(*) FILTER (n_ck = 11) AS full_runs FROM nat GROUP BY qid) q ON q.qid = c_custkey")
def sel06(t):
    """Each question of a manifest (the customers) as closed, truncated or skipped."""
    got = t.nat.groupBy("qid").agg(F.count_if(F.col("n_ck") == 11).alias("full"))
    expected = t.read("customer", "c_custkey").select(n("c_custkey", "qid"))
    return expected.join(got, "qid", "left").select("qid", F.when(F.col("full").isNull(), "skipped").when(F.col("full") > 0, "closed").otherwise("truncated").alias("status"))
