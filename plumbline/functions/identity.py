"""Canonical JSON and the identities that are hashes of it.

``to_json`` can't give the canonical form (number format, nulls, key order), so texts of JSON go
through one Arrow-batched function; hashing and seeds are built-in functions again.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values that results depend on.
CANONICAL_JSON_VERSION = "part1-canonical-json-v1"
IDENTITY_VERSION = "part1-identity-v1"
SEED_ALGORITHM_VERSION = "part1-seed-v1"
PREFIX_VERSION = "part1-token-id-prefix-v1"


def _clean(value):
    """Line ends as LF in all strings and keys; numbers must be finite and keys stay apart."""
    match value:
        case str():
            return value.replace("\r\n", "\n").replace("\r", "\n")
        case float() if not math.isfinite(value):
            raise ValueError("numbers must be finite")
        case dict():
            out = {_clean(k): _clean(v) for k, v in value.items()}
            if len(out) < len(value):
                raise ValueError("keys differ in line ends only")
            return out
        case list():
            return [_clean(v) for v in value]
        case _:
            return value


def canonical(value) -> str:
    """The canonical text of a value in its versioned envelope."""
    wrapped = {"serialization_version": CANONICAL_JSON_VERSION, "value": _clean(value)}
    return json.dumps(wrapped, ensure_ascii=False, allow_nan=False, sort_keys=True, separators=(",", ":"))


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Canonical form of texts of JSON; null stays null."""
    return texts.map(lambda t: canonical(json.loads(t)), na_action="ignore")


def json_of(**fields: Column) -> Column:
    """A JSON text of named columns, nulls kept."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def identity(kind: str, **payload: Column) -> Column:
    """SHA-256 over the typed envelope of a payload."""
    return digest(canonical_json(json_of(identity_type=F.lit(kind), identity_version=F.lit(IDENTITY_VERSION), payload=F.struct(*[c.alias(k) for k, c in payload.items()]))))


def seed(**payload: Column) -> Column:
    """The first eight digest bytes of a payload, big endian, without the sign bit."""
    hexes = digest(canonical_json(json_of(seed_algorithm_version=F.lit(SEED_ALGORITHM_VERSION), **payload)))
    # Two halves, so that no signed number overflows.
    high = F.conv(F.substring(hexes, 1, 8), 16, 10).cast("bigint").bitwiseAND(F.lit(0x7FFFFFFF))
    low = F.conv(F.substring(hexes, 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(low)


def prefix_hash(tokens: Column) -> Column:
    return digest(canonical_json(json_of(prefix_version=F.lit(PREFIX_VERSION), token_ids=tokens)))
