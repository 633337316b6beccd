"""Validation of JSON records against a schema: the first error by path, as a column.

The schema is a dictionary in the words of JSON Schema: type (one or a list), required,
properties, additionalProperties (false), enum, const, minimum, maximum, minLength, pattern and
items. Errors are looked for in order of path, an object before what is in it and names in their
order, so the first is that of the least path; at one path, in the order of ``CHECKS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHECKS = ["type", "enum", "const", "minimum", "maximum", "minLength", "pattern", "required", "additionalProperties"]
ROOT = "<root>"


def _kind(value: Column) -> Column:
    """The JSON type of a variant; null if there is none. A number without a fraction is an integer."""
    s = F.schema_of_variant(value)
    whole = F.expr("true") & (F.try_variant_get(value, "$", "double") % 1 == 0)
    number = F.when(whole, "integer").otherwise("number")
    return (
        F.when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s == "VOID", "null")
        .when(s.isNotNull(), number)
    )


def _is(kind: Column, wanted: str | list[str]) -> Column:
    names = [wanted] if isinstance(wanted, str) else list(wanted)
    return kind.isin(*names, *(["integer"] if "number" in names else []))


def _member(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$['{name}']", "variant")


def _own(value: Column, rule: dict) -> list[tuple[str, Column]]:
    """(check, broken) of one value."""
    kind = _kind(value)
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    same = lambda x: F.to_json(value) == F.to_json(F.parse_json(F.lit(_json(x))))
    found = {}
    if "type" in rule:
        found["type"] = ~_is(kind, rule["type"])
    if "enum" in rule:
        ok = F.lit(False)
        for x in rule["enum"]:
            ok = ok | same(x)
        found["enum"] = ~ok
    if "const" in rule:
        found["const"] = ~same(rule["const"])
    if "minimum" in rule:
        found["minimum"] = _is(kind, "number") & (number < rule["minimum"])
    if "maximum" in rule:
        found["maximum"] = _is(kind, "number") & (number > rule["maximum"])
    if "minLength" in rule:
        found["minLength"] = _is(kind, "string") & (F.length(text) < rule["minLength"])
    if "pattern" in rule:
        found["pattern"] = _is(kind, "string") & ~text.rlike(rule["pattern"])
    if "required" in rule:
        missing = F.lit(False)
        for name in rule["required"]:
            missing = missing | _kind(_member(value, name)).isNull()
        found["required"] = _is(kind, "object") & missing
    if rule.get("additionalProperties") is False:
        names = F.map_keys(F.try_variant_get(value, "$", "map<string, variant>"))
        found["additionalProperties"] = _is(kind, "object") & (F.size(F.array_except(names, F.array(*[F.lit(n) for n in rule.get("properties", {})]).cast("array<string>"))) > 0)
    return [(check, found[check]) for check in CHECKS if check in found]


def _json(x) -> str:
    import json

    return json.dumps(x)


def _errors(value: Column, rule: dict, path: str, there: Column) -> list[Column]:
    """Messages in order of path, each null where its check holds or the value isn't there."""
    name = path or ROOT
    out = [F.when(there & F.coalesce(broken, F.lit(False)), F.lit(f"{name}: {check}")) for check, broken in _own(value, rule)]
    for child in sorted(rule.get("properties", {})):
        member = _member(value, child)
        out += _errors(member, rule["properties"][child], f"{path}.{child}" if path else child, there & _kind(member).isNotNull())
    if "items" in rule:
        each = F.try_variant_get(value, "$", "array<variant>")

        def first(item: Column, i: Column) -> Column:
            found = F.coalesce(*_errors(item, rule["items"], "", F.lit(True)), F.lit(None).cast("string"))
            inner = F.when(found.startswith(ROOT), F.substring(found, len(ROOT) + 1, 1 << 30)).otherwise(F.concat(F.lit("."), found))
            return F.when(found.isNotNull(), F.concat(F.lit(f"{path}." if path else ""), i.cast("string"), inner))

        broken = F.filter(F.transform(each, first), lambda m: m.isNotNull())
        out.append(F.when(there & (_kind(value) == "array"), F.get(broken, F.lit(0))))
    return out


def first_error(record: Column, schema: dict) -> Column:
    """``path: check`` of the first error of a JSON string, null if it is valid, ``<root>: malformed`` if it is no JSON."""
    value = F.try_parse_json(record)
    return F.coalesce(F.when(value.isNull(), F.lit(f"{ROOT}: malformed")), *_errors(value, schema, "", F.lit(True)), F.lit(None).cast("string"))


def require(rows: DataFrame, record: str, schema: dict) -> DataFrame:
    """The rows, if all are valid; else an error with the least message and how many rows are broken."""
    bad = rows.select(first_error(F.col(record), schema).alias("e")).where("e is not null").agg(F.min("e").alias("e"), F.count(F.lit(1)).alias("n")).first()
    if bad["n"]:
        raise ValueError(f"{bad['e']} ({bad['n']} records are not valid)")
    return rows
