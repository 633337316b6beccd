"""Validation against a schema, held against a plain validator."""

import json
import random
import re

import pytest

from plumbline.operators import schema
from plumbline.plans.auditing import EVENT

CHECK_ORDER = schema.CHECKS


def kind(x):
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "boolean"
    if isinstance(x, (int, float)):
        return "integer" if float(x).is_integer() else "number"
    return {str: "string", list: "array", dict: "object"}[type(x)]


def is_a(x, names):
    names = [names] if isinstance(names, str) else names
    return kind(x) in names or (kind(x) == "integer" and "number" in names)


def broken(x, rule):
    found = {
        "type": "type" in rule and not is_a(x, rule["type"]),
        "enum": "enum" in rule and x not in rule["enum"],
        "const": "const" in rule and x != rule["const"],
        "minimum": "minimum" in rule and is_a(x, "number") and x < rule["minimum"],
        "maximum": "maximum" in rule and is_a(x, "number") and x > rule["maximum"],
        "minLength": "minLength" in rule and kind(x) == "string" and len(x) < rule["minLength"],
        "pattern": "pattern" in rule and kind(x) == "string" and not re.search(rule["pattern"], x),
        "required": kind(x) == "object" and any(n not in x for n in rule.get("required", [])),
        "additionalProperties": kind(x) == "object" and rule.get("additionalProperties") is False and bool(set(x) - set(rule.get("properties", {}))),
    }
    return [c for c in CHECK_ORDER if found[c]]


def errors(x, rule, path=()):
    out = [(path, k, c) for k, c in enumerate(broken(x, rule))]
    if kind(x) == "object":
        for name, sub in rule.get("properties", {}).items():
            if name in x:
                out += errors(x[name], sub, (*path, name))
    if kind(x) == "array" and "items" in rule:
        for i, item in enumerate(x):
            out += errors(item, rule["items"], (*path, i))
    return out


def first(text, rule):
    try:
        x = json.loads(text)
    except ValueError:
        return "<root>: malformed"
    found = sorted(errors(x, rule), key=lambda e: (e[0], e[1]))
    return f"{'.'.join(map(str, found[0][0])) or '<root>'}: {found[0][2]}" if found else None


DEEP = {
    "type": "object",
    "required": ["a"],
    "properties": {
        "a": {"type": "object", "required": ["x"], "additionalProperties": False, "properties": {"x": {"type": "integer", "minimum": 1}, "y": {"enum": ["p", None, 3]}}},
        "b": {"type": ["array", "null"], "items": {"type": "object", "required": ["k"], "properties": {"k": {"type": "string", "minLength": 2, "pattern": "^[a-z]+$"}}}},
        "c": {"const": "fixed"},
        "d": {"type": "number", "maximum": 2.5},
    },
}


def records(n):
    rng = random.Random(n)
    pick = lambda *xs: rng.choice(xs)
    for _ in range(n):
        x = {"a": {"x": pick(1, 2, 0, 1.0, "1", None), "y": pick("p", None, 3, "q")}, "b": [{"k": pick("ab", "a", "aB", 3)} for _ in range(rng.randrange(4))], "c": pick("fixed", "other"), "d": pick(1, 2.5, 2.6, True)}
        for name in list(x):
            if rng.random() < 0.15:
                x[name] = pick(None, 3, "s", [], {}, {"more": 1})
            if rng.random() < 0.1:
                del x[name]
        if rng.random() < 0.1 and isinstance(x.get("a"), dict):
            x["a"]["more"] = 1
        yield json.dumps(x)[: None if rng.random() < 0.95 else -1]


def test_first_error_by_path(spark):
    texts = [*records(300), "", "null", "3", "[]", '{"a": {"x": 1}}', None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["e"] for r in df.select("i", schema.first_error(df["t"], DEEP).alias("e")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == ("<root>: malformed" if t is None else first(t, DEEP)), t
    assert len(set(got.values())) > 10


def test_records_of_events(spark):
    good = '{"event_id": 1, "event_type": "view", "value": 2.5, "tags": ["a"]}'
    df = spark.createDataFrame([(good,), (good.replace("view", "look"),), (good.replace('"a"', '"a", "B"'),)], "t string")
    assert [r["e"] for r in df.select(schema.first_error(df["t"], EVENT).alias("e")).collect()] == [None, "event_type: enum", "tags.1: pattern"]
    with pytest.raises(ValueError, match="event_type: enum .2 records"):
        schema.require(df, "t", EVENT)
    assert schema.require(df.limit(1), "t", EVENT).count() == 1
