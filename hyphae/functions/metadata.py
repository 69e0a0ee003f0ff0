"""Equality on schemaless JSON metadata, with the equality of dynamic values."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(metadata: Column, key: str, kind: str) -> Column:
    return F.try_variant_get(F.try_parse_json(metadata), f"$[{json.dumps(key)}]", kind)


def equals(metadata: Column, key: str, value: Any) -> Column:
    """Does the top-level key have this value.

    1, 1.0 and true are equal, "1" is not; None equals a missing key, a JSON
    null and metadata that are null or no object.
    """
    kind = F.schema_of_variant(field(metadata, key, "variant"))
    if value is None:
        return F.coalesce(kind == "VOID", F.lit(True))
    if isinstance(value, str):
        same = (kind == "STRING") & (field(metadata, key, "string") == value)
    else:
        number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        same = number & (field(metadata, key, "double") == float(value))
        if float(value) in (0.0, 1.0):
            same = same | ((kind == "BOOLEAN") & (field(metadata, key, "boolean") == bool(value)))
    return F.coalesce(same, F.lit(False))


def matches(metadata: Column, filters: dict[str, Any] | None) -> Column:
    """All filters hold."""
    return reduce(lambda a, b: a & b, [equals(metadata, k, v) for k, v in (filters or {}).items()], F.lit(True))


def merged(old: str | None, new: dict[str, Any] | None) -> str:
    """JSON of the old metadata with the keys of the new ones put over them."""
    return json.dumps({**(json.loads(old) if old else {}), **(new or {})})
