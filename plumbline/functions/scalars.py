"""Scalar expressions over Spark columns: entropies, placements, parses of answers and confidences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
LETTERS = "ABCD"
SUBJECTS = ["high_school_mathematics", "high_school_physics", "high_school_chemistry", "high_school_biology", "high_school_psychology"]
RETRYABLE = ["interrupted_process", "temporary_filesystem_failure", "transient_worker_failure", "transient_cuda_runtime_failure"]
TERMINAL = [
    "invalid_configuration",
    "schema_incompatibility",
    "manifest_incompatibility",
    "tokenizer_preflight_incompatibility",
    "deterministic_context_overflow",
    "reproducible_cuda_oom",
    "unsupported_model_or_tokenizer_behaviour",
    "corrupt_immutable_manifest",
]
MAX_ATTEMPTS = 3
BACKOFF = [0, 30, 120]


def finite(x: Column) -> Column:
    """The number, or null where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    """Mean of an array without nulls; null if it is empty."""
    return F.when(F.size(values) > 0, total(values) / F.size(values))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, shifted by their maximum."""
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(shifted, lambda x: x / total(shifted))


def entropy(probabilities: Column) -> Column:
    """Entropy in nats; zero probabilities add nothing."""
    return -F.aggregate(F.filter(probabilities, lambda p: p > 0), F.lit(0.0), lambda a, p: a + p * F.ln(p))


def entropy_of_logits(logits: Column) -> Column:
    """Entropy in nats in one pass: ln Z - sum(e^(x-m) (x-m)) / Z."""
    top = F.array_max(logits)
    zero = F.struct(F.lit(0.0).alias("z"), F.lit(0.0).alias("s"))
    sums = F.aggregate(logits, zero, lambda a, x: F.struct((a["z"] + F.exp(x - top)).alias("z"), (a["s"] + F.exp(x - top) * (x - top)).alias("s")))
    return F.transform(F.array(sums), lambda s: F.ln(s["z"]) - s["s"] / s["z"])[0]


def tail_mean(values: Column, share: float = 0.1) -> Column:
    """Mean of the last max(1, ceil(share n)) values."""
    k = F.greatest(F.lit(1), F.ceil(F.size(values) * F.lit(share)).cast("int"))
    return F.when(F.size(values) > 0, mean(F.slice(values, -k, k)))


def placement(index: Column, length: Column) -> Column:
    """Tokens kept at a tenth: index / 10 * length, halves to even, between 0 and length."""
    return F.least(F.greatest(F.rint(index / F.lit(10.0) * length).cast("bigint"), F.lit(0).cast("bigint")), length.cast("bigint"))


def tenths_means(values: Column, bins: int = 10) -> Column:
    """Means by token progress: value i of n falls in bin min(i * bins // n, bins - 1); empty bins are null."""
    n = F.size(values)
    # bin b holds i with ceil(b n / bins) <= i < ceil((b + 1) n / bins)
    lo = lambda b: F.floor((b * n + bins - 1) / bins).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.when(lo(b + 1) > lo(b), mean(F.slice(values, lo(b) + 1, F.greatest(lo(b + 1) - lo(b), F.lit(0))))))


def profile_means(values: Column, bins: int = 20) -> Column:
    """Means between the truncated edges of an even division into bins; empty bins are null."""
    n = F.size(values)
    edge = lambda j: (j * n / F.lit(float(bins))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda j: F.when(edge(j + 1) > edge(j), mean(F.slice(values, edge(j) + 1, F.greatest(edge(j + 1) - edge(j), F.lit(0))))))


def prefix_means(values: Column, kept: Column) -> Column:
    """For each kept length, the mean of that many first values; null for none."""
    return F.transform(kept, lambda k: F.when(k >= 1, mean(F.slice(values, 1, F.greatest(k, F.lit(1)).cast("int")))))


def close_arrays(a: Column, b: Column, tolerance: float) -> Column:
    """Equal lengths and no two values further apart than the tolerance."""
    return (F.size(a) == F.size(b)) & F.forall(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: F.abs(p["a"] - p["b"]) <= tolerance)


def letter_probability(probabilities: Column, letter: Column) -> Column:
    """The probability of the selected letter; null without one."""
    at = F.instr(F.lit(LETTERS), letter)
    return F.when(at > 0, F.get(probabilities, at - 1))


def find_sequence(values: Column, part: Column) -> Column:
    """Start (from 0) of the first place where an array holds another; null if none."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(values) - F.size(part), F.lit(0)))
    return F.get(F.filter(starts, lambda i: F.slice(values, i + 1, F.size(part)) == part), F.lit(0))


def correct(predicted: Column, gold: Column) -> Column:
    return predicted == gold


# -- text ---------------------------------------------------------------------------------

CLOSE = "</think>"
_BLANK, _LINE = r"[ \t]", r"[^\r\n]"
_ANSWER = rf"(?m)^{_BLANK}*Answer:{_BLANK}*({_LINE}*?){_BLANK}*$"


def terminal_block(region: Column) -> Column:
    """Parse of the last ``Answer:`` line of a region and of a ``Confidence:`` line right after it.

    A struct of answer, answer_status, confidence_text, confidence, normalized and confidence_status.
    """
    # Lines are looked at, not a whole-text pattern, so a long text can't backtrack.
    lines = F.split(region, "\n")
    is_answer = lambda x: x.rlike(rf"^{_BLANK}*Answer:")
    at = F.array_max(F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), is_answer(x).alias("ok"))), lambda s: s["ok"]), lambda s: s["i"]))
    answer_line = F.get(lines, at)
    raw = F.trim(F.regexp_replace(F.regexp_extract(answer_line, rf"^{_BLANK}*Answer:(.*)$", 1), r"[\r\t]", " "))
    next_line = F.get(lines, at + 1)
    has = next_line.rlike(rf"^{_BLANK}*Confidence:")
    conf = F.when(has, F.trim(F.regexp_replace(F.regexp_extract(next_line, rf"^{_BLANK}*Confidence:(.*)$", 1), r"[\r\t]", " ")))
    number = F.when(conf.rlike("^[+-]?[0-9]{1,18}$"), F.try_to_number(conf, F.lit("S999999999999999999")).cast("bigint"))
    answer_status = F.when(at.isNull() | (raw == ""), "missing").when(raw.isin(*LETTERS), "parsed").otherwise("out_of_domain")
    conf_status = F.when(at.isNull() | ~F.coalesce(has, F.lit(False)), "missing").when(number.isNull(), "malformed").when(number.between(0, 100), "parsed").otherwise("out_of_range")
    return F.struct(
        F.when(answer_status == "parsed", raw).alias("answer"),
        answer_status.alias("answer_status"),
        F.when(at.isNotNull(), conf).alias("confidence_text"),
        number.alias("confidence"),
        F.when(conf_status == "parsed", number / 100.0).alias("normalized"),
        conf_status.alias("confidence_status"),
    )


def natural_region(text: Column) -> Column:
    """What follows the first closing tag of the reasoning; null without one."""
    at = F.instr(text, CLOSE)
    return F.when(at > 0, F.substr(text, at + F.lit(len(CLOSE))))


def repaired_confidence(raw: Column) -> Column:
    """0 to 100 out of a text that holds only that, perhaps in <>, perhaps with one end-of-turn token; else null."""
    s = F.trim(F.regexp_replace(F.trim(raw), r"<\|im_end\|>$", ""))
    s = F.when(s.rlike("^<[ \t]*[0-9]+[ \t]*>$"), F.regexp_extract(s, "([0-9]+)", 1)).otherwise(s)
    n = F.when(s.rlike("^[0-9]{1,9}$"), F.try_to_number(s, F.lit("999999999")).cast("int"))
    return F.when(n.between(0, 100), n)


_EMPH = "[*_`]*"


def tolerant_answer(text: Column) -> Column:
    """The last answer letter, whatever its case and emphasis; null if none."""
    found = F.regexp_extract_all(text, F.lit(rf"(?i){_EMPH}Answer{_EMPH}\s*:\s*{_EMPH}\s*([ABCD])"), 1)
    return F.when(F.size(found) > 0, F.upper(F.element_at(found, -1)))


def tolerant_confidence(text: Column) -> Column:
    """The last confidence of up to three digits, at most 100; null if none."""
    found = F.regexp_extract_all(text, F.lit(rf"(?i){_EMPH}Confidence{_EMPH}\s*:\s*{_EMPH}\s*([0-9]{{1,3}})"), 1)
    return F.when(F.size(found) > 0, F.least(F.element_at(found, -1).cast("int"), F.lit(100)))


def token_at(tokens: Column, position: Column) -> Column:
    """Index of the token whose characters hold a position of the joined text; null outside."""
    ends = F.transform(tokens, lambda x, i: F.aggregate(F.slice(tokens, 1, i + 1), F.lit(0), lambda a, t: a + F.length(t)))
    inside = F.filter(F.transform(ends, lambda e, i: F.struct(i.alias("i"), (e > position).alias("past"))), lambda s: s["past"])
    return F.when(position >= 0, F.get(inside, F.lit(0))["i"])


def prompt(question: Column, choices: Column) -> Column:
    """The question, an empty line, and the choices lettered."""
    lettered = F.transform(choices, lambda c, i: F.concat(F.substr(F.lit(LETTERS), i + 1, F.lit(1)), F.lit(". "), c))
    return F.concat_ws("\n", question, F.lit(""), F.array_join(lettered, "\n"))


def is_rfc3339(text: Column) -> Column:
    """A date, a time and an offset that exist; T and Z are capitals."""
    shape = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$")
    return shape & F.try_to_timestamp(text).isNotNull()


def retry_policy(category: Column, attempt: Column) -> Column:
    """Struct of classification, decision and backoff seconds; null for an unknown category or attempt."""
    backoff = F.get(F.array(*[F.lit(x) for x in BACKOFF]), attempt.cast("int"))
    make = lambda c, d, b: F.struct(F.lit(c).alias("classification"), F.lit(d).alias("decision"), b.cast("int").alias("backoff"))
    none = F.lit(None)
    return (
        F.when(~attempt.between(1, MAX_ATTEMPTS), None)
        .when(category.isin(*TERMINAL), make("terminal", "do_not_retry", none))
        .when(category.isin(*RETRYABLE) & (attempt == MAX_ATTEMPTS), make("retryable", "exhausted", none))
        .when(category.isin(*RETRYABLE), make("retryable", "retry", backoff))
    )


def snippet(text: Column, most: int) -> Column:
    """The start of a text on one line, with dots if more follows."""
    line = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.concat(F.substring(line, 1, most), F.when(F.length(line) > most, "...").otherwise(""))


def intervention(kept: Column, length: Column) -> Column:
    return F.when(kept == 0, "no_reasoning_baseline").when(kept >= length, "full_chain").otherwise("partial_reasoning")
