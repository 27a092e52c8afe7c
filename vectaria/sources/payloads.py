"""Payloads from typed columns and from JSON."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import FIELD, I64_MAX, I64_MIN, VALUE, InvalidArgument

_TYPES = {"text": "string", "int": "bigint", "float": "double", "bool": "boolean"}


def tagged(column: Column, tag: str) -> Column:
    slots = [(F.when(F.lit(tag == t), column) if tag == t else F.lit(None)).cast(_TYPES[t]).alias(s) for t, s in (("text", "t"), ("int", "i"), ("float", "d"), ("bool", "b"))]
    return F.struct(F.lit(tag).alias("tag"), *slots).cast(VALUE)


def _list(column: Column, tag: str) -> Column:
    return F.transform(column, lambda x: tagged(x, tag))


def from_columns(fields: Mapping[str, tuple[Column, str]], present: Column | None = None) -> Column:
    """A payload map from columns: name to (column, tag or `[tag]`).  A null column is an absent key;
    where `present` is false the payload itself is absent."""
    parts: list[Column] = []
    for name, (column, kind) in fields.items():
        if kind.startswith("["):
            f = F.struct(F.lit(True).alias("is_array"), F.lit(None).cast(VALUE).alias("s"), _list(column, kind[1:-1]).alias("a"))
        else:
            f = F.struct(F.lit(False).alias("is_array"), tagged(column, kind).alias("s"), F.lit(None).cast(f"array<{VALUE}>").alias("a"))
        parts += [F.lit(name), F.when(column.isNotNull(), f.cast(FIELD))]
    out = F.map_filter(F.create_map(*parts), lambda _, v: v.isNotNull()) if parts else F.create_map().cast(f"map<string,{FIELD}>")
    return out if present is None else F.when(present, out)


def _number(text: str) -> int | float:
    """An integer if it is written as one and fits 64 bits, else a float."""
    try:
        n = int(text)
        if I64_MIN <= n <= I64_MAX:
            return n
    except ValueError:
        pass
    return float(text)


def from_json(text: str) -> dict[str, Any]:
    """Plain payload of a JSON object; null, nested lists and nested objects are errors."""
    try:
        x = json.loads(text, parse_int=_number, parse_float=float, parse_constant=_reject)
    except ValueError as e:
        raise InvalidArgument(f"not JSON: {e}") from None
    if not isinstance(x, dict):
        raise InvalidArgument("a payload is an object")
    for v in x.values():
        for y in v if isinstance(v, list) else [v]:
            if y is None or isinstance(y, (list, dict)):
                raise InvalidArgument("payload values are scalars or lists of scalars")
    return x


def _reject(name: str) -> None:
    raise InvalidArgument(f"{name} is not a payload value")
