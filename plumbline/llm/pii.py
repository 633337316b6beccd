"""Personal data in text: patterns propose, checksums confirm, context words adjust the score.

Base spans are the leftmost matches of four patterns with a test of their digits (Luhn for
cards). The method proposes more: cards, phone numbers and account numbers (IBAN, mod 97) cut
out of runs of digits that the base patterns swallow whole, and secrets (keys of known form,
long hexadecimal strings). Each proposal starts with its kind's score, gains by a checksum or a
known form and by words of its kind just before it, loses by words of other numbers, and is a
span from ``ACCEPT`` on. DataFrame functions only: the places of
matches come from the lengths of the texts between them.

The patterns are those of the kinds' definitions in a form that can't backtrack: quantifiers
are possessive where what follows can't match inside, and a run is tried from its start only
(or from where the last match ended), since a run that fails there fails further on.

Defined results: a null or empty text has no spans; a very long one is searched whole, in time
that grows with its length; of two proposals that overlap, the leftmost is looked at; rows that
repeat an identifier get a row each; a null identifier stays null; an empty table gives an
empty result; columns of any other name are left out of sight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE = list(PATTERNS)
PROPOSED = {
    "card": r"(?<![0-9])(?:[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{13,19})(?![0-9])",
    "phone": r"\+[0-9]{1,3}[\x20.-]?\([0-9]{2,4}\)[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9A-Fa-f]{32,128}|AKIA[0-9A-Z]{16}|gh[a-z]_[0-9A-Za-z]{36})(?![A-Za-z0-9])",
}
KINDS = [*BASE, "iban", "secret"]
#: A text without this has no match of the kind.
NEEDS = {"email": "[@]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "secret": "[0-9A-Fa-f]{32}|AKIA[0-9A-Z]|gh[a-z]_"}
START = {"card": 0.3, "phone": 0.6, "iban": 0.3, "secret": 0.4}
KNOWN_KEY = "^(?:AKIA|gh[a-z]_)"
CHECKSUM, NEAR, ACCEPT = 0.3, 40, 0.5
#: Words just before a proposal that speak for it, and those that speak against any.
FOR = {"card": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta", "phone": "phone|tel|call|mobile|fax|telefon|appel|llame", "iban": "iban|account|bank|konto|compte|cuenta", "secret": "token|secret|api|key|password|passwd|bearer|credential"}
AGAINST = "order|isbn|serial|version|invoice|tracking|sku"
HELPS, HARMS = 0.2, 0.2

_ITEM = "struct<s: int, e: int, m: string>"


def located(text: str, matches: str, pattern: str) -> Column:
    """Start and end (code points) of each match; ``text`` and ``matches`` name columns."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    step = "named_struct('p', a.p + length(x.g) + length(x.m), 'out', array_append(a.out, named_struct('s', a.p + length(x.g), 'e', a.p + length(x.g) + length(x.m), 'm', x.m)))"
    return F.expr(
        f"CASE WHEN size({matches}) = 0 THEN cast(array() AS array<{_ITEM}>) ELSE "
        f"aggregate(zip_with(slice(split({text}, '{quoted}', -1), 1, size({matches})), {matches}, (g, m) -> named_struct('g', g, 'm', m)), "
        f"named_struct('p', 0, 'out', cast(array() AS array<{_ITEM}>)), (a, x) -> {step}, a -> a.out) END"
    )


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of a string pass Luhn's test."""
    d = F.reverse(_digits(m))
    digit = lambda i: F.substring(d, i, 1).cast("int")
    value = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), lambda a, i: a + F.coalesce(value(i), F.lit(0)))
    return total % 10 == 0


def mod97(m: Column) -> Column:
    """Whether an account number leaves 1 modulo 97, its country and check digits moved to the end."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    code = lambda i: F.ascii(F.substring(moved, i, 1))
    step = lambda a, i: F.when(code(i) >= 65, (a * 100 + code(i) - 55) % 97).otherwise((a * 10 + code(i) - 48) % 97)
    return (F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1) & F.length(plain).between(15, 34)


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def score(kind: str, item: Column) -> Column:
    """A proposal's score, between 0 and 1."""
    before = F.lower(F.substring(F.col("t"), F.greatest(item["s"] - NEAR, F.lit(0)) + 1, F.least(item["s"], F.lit(NEAR))))
    checked = {"card": luhn, "iban": mod97}.get(kind)
    total = F.lit(START[kind]) + F.when(before.rlike(rf"\b(?:{FOR[kind]})"), HELPS).otherwise(0.0) - F.when(before.rlike(rf"\b(?:{AGAINST})\b"), HARMS).otherwise(0.0)
    if kind == "secret":
        total = total + F.when(item["m"].rlike(KNOWN_KEY), CHECKSUM).otherwise(0.0)
    if checked is not None:
        total = total + F.when(checked(item["m"]), CHECKSUM).otherwise(-0.3)
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def _valid(kind: str) -> Column:
    return F.filter(f"m_{kind}", lambda x: valid(kind, x["m"]))


def _scored(kind: str) -> Column:
    return F.transform(f"q_{kind}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), score(kind, x).alias("score")))


def _apart(items: Column, kind: str) -> Column:
    """Items that overlap no base span of the kind."""
    return F.filter(items, lambda x: ~F.exists(kind, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text, base and added spans by kind (arrays of s, e, m; the added have a score too)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    none = F.array().cast("array<string>")
    found = lambda kind, p: F.when(F.col("t").rlike(NEEDS[kind]), F.regexp_extract_all("t", F.lit(p), 0)).otherwise(none)
    rows = rows.select("*", *[found(k, p).alias(f"m_{k}") for k, p in PATTERNS.items()], *[found(k, p).alias(f"q_{k}") for k, p in PROPOSED.items()])
    rows = rows.select("doc_id", "t", *[located("t", f"m_{k}", p).alias(f"m_{k}") for k, p in PATTERNS.items()], *[located("t", f"q_{k}", p).alias(f"q_{k}") for k, p in PROPOSED.items()])
    rows = rows.select("doc_id", "t", *[_valid(k).alias(k) for k in BASE], *[_scored(k).alias(f"q_{k}") for k in PROPOSED])
    added = []
    for k in PROPOSED:
        fresh = F.filter(f"q_{k}", lambda x: x["score"] >= ACCEPT)
        if k in BASE:
            fresh = _apart(fresh, k)
        added.append(fresh.alias(f"added_{k}"))
    return rows.select("doc_id", F.col("t").alias("text"), *BASE, *added)


def _listed(kind: str, column: Column) -> Column:
    return F.transform(column, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def spans(found: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_sha256, all spans as text, and how many they are."""
    plain = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    every = []
    for k in KINDS:
        parts = [plain(c) for c in (k, f"added_{k}") if c in found.columns]
        every.append(_listed(k, F.sort_array(F.concat(*parts)) if len(parts) > 1 else parts[0]))
    base = F.array_join(F.concat(*[_listed(k, F.col(k)) for k in BASE]), ",")
    return found.select("doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE], F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(F.concat(*every), ",").alias("spans"), F.size(F.concat(*every)).cast("bigint").alias("n_spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(find(spark.read.parquet(f"{sf_dir}/documents.parquet")))
