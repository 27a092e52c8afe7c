"""Payload filters: an AST and its compiler to one total (never null) boolean column.

A missing field or a value of another type makes a leaf false, and `Not` turns that to true;
so every leaf is made total by itself.  Equality goes by type, order crosses integer and
float.  A point without payload matches no filter at all."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import InvalidArgument, Scalar, tag_of

SLOT = {"text": "t", "int": "i", "float": "d", "bool": "b"}


@dataclass(frozen=True)
class Leaf:
    field: str
    value: Any


class Eq(Leaf):
    pass


class Ne(Leaf):
    pass


class Lt(Leaf):
    pass


class Lte(Leaf):
    pass


class Gt(Leaf):
    pass


class Gte(Leaf):
    pass


class Contains(Leaf):
    pass


@dataclass(frozen=True)
class In:
    field: str
    values: Sequence[Scalar]


@dataclass(frozen=True)
class Exists:
    field: str


@dataclass(frozen=True)
class And:
    parts: Sequence[Any]


@dataclass(frozen=True)
class Or:
    parts: Sequence[Any]


@dataclass(frozen=True)
class Not:
    part: Any


class MapLayout:
    """Payload stored as a map of tagged values."""

    def __init__(self, column: Column) -> None:
        self.column = column

    def has_payload(self) -> Column:
        return self.column.isNotNull()

    def present(self, name: str) -> Column:
        return F.coalesce(F.map_contains_key(self.column, F.lit(name)), F.lit(False))

    def _field(self, name: str) -> Column:
        return F.try_element_at(self.column, F.lit(name))

    def is_scalar(self, name: str) -> Column:
        return F.coalesce(~self._field(name)["is_array"], F.lit(False))

    def scalar(self, name: str, tag: str) -> Column:
        """The field's value if it is a scalar of that type, else null."""
        s = self._field(name)["s"]
        return F.when(s["tag"] == tag, s[SLOT[tag]])

    def holds(self, name: str, v: Scalar) -> Column:
        tag = tag_of(v)
        return F.exists(self._field(name)["a"], lambda x: F.coalesce((x["tag"] == tag) & (x[SLOT[tag]] == F.lit(v)), F.lit(False)))


class ColumnLayout:
    """Payload with a fixed schema, in ordinary columns: leaves become plain predicates that reach the
    Parquet scan.  `fields` maps a name to (column, type), the type a tag or `[tag]`; null is absent."""

    def __init__(self, fields: Mapping[str, tuple[Column, str]], has_payload: Column | None = None) -> None:
        self.fields, self._has = dict(fields), F.lit(True) if has_payload is None else has_payload

    def has_payload(self) -> Column:
        return self._has

    def _get(self, name: str) -> tuple[Column, str]:
        return self.fields.get(name, (F.lit(None), "none"))

    def present(self, name: str) -> Column:
        return self._get(name)[0].isNotNull()

    def is_scalar(self, name: str) -> Column:
        column, kind = self._get(name)
        return F.lit(False) if kind.startswith("[") else column.isNotNull()

    def scalar(self, name: str, tag: str) -> Column:
        column, kind = self._get(name)
        return column if kind == tag else F.lit(None)

    def holds(self, name: str, v: Scalar) -> Column:
        column, kind = self._get(name)
        return F.array_contains(column, F.lit(v)) if kind == f"[{tag_of(v)}]" else F.lit(False)


Layout = MapLayout | ColumnLayout


def _total(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _equal(layout: Layout, name: str, v: Scalar) -> Column:
    tag = tag_of(v)
    if tag == "float" and math.isnan(v):
        return F.lit(False)
    return _total(layout.scalar(name, tag) == F.lit(v))


def _ordered(layout: Layout, leaf: Leaf, test: Any) -> Column:
    v, tag = leaf.value, tag_of(leaf.value)
    if tag == "bool" or (tag == "float" and math.isnan(v)):
        return F.lit(False)
    if tag == "text":
        return _total(test(layout.scalar(leaf.field, "text"), F.lit(v)))
    whole, real = layout.scalar(leaf.field, "int"), layout.scalar(leaf.field, "float")
    if tag == "int":
        return _total(test(whole, F.lit(v))) | _total(test(real, F.lit(float(v))))
    return _total(test(whole.cast("double"), F.lit(v))) | _total(test(real, F.lit(v)))


_ORDER = {
    Lt: lambda a, b: a < b,
    Lte: lambda a, b: a <= b,
    Gt: lambda a, b: a > b,
    Gte: lambda a, b: a >= b,
}


def _compile(node: Any, layout: Layout) -> Column:
    match node:
        case Eq(name, v):
            return _equal(layout, name, v)
        case Ne(name, v):
            return layout.is_scalar(name) & ~_equal(layout, name, v)
        case Lt() | Lte() | Gt() | Gte():
            return _ordered(layout, node, _ORDER[type(node)])
        case In(name, values):
            return reduce(lambda a, b: a | b, [_equal(layout, name, v) for v in values], F.lit(False))
        case Contains(_, v) if isinstance(v, float) and math.isnan(v):
            return F.lit(False)
        case Contains(name, v):
            return _total(layout.holds(name, v))
        case Exists(name):
            return layout.present(name)
        case And(parts):
            return reduce(lambda a, b: a & b, [_compile(p, layout) for p in parts], F.lit(True))
        case Or(parts):
            return reduce(lambda a, b: a | b, [_compile(p, layout) for p in parts], F.lit(False))
        case Not(part):
            return ~_compile(part, layout)
    raise InvalidArgument(f"not a filter: {node!r}")


def compile_filter(node: Any, layout: Layout) -> Column:
    """True for the points that match; never null."""
    return layout.has_payload() & _compile(node, layout)


def _implied(node: Any, layout: ColumnLayout) -> Column | None:
    """A plain predicate that is true wherever the filter is, or None."""
    match node:
        case And(parts):
            found = [p for p in (_implied(x, layout) for x in parts) if p is not None]
            return reduce(lambda a, b: a & b, found) if found else None
        case Or(parts):
            found = [_implied(x, layout) for x in parts]
            return reduce(lambda a, b: a | b, found) if found and all(p is not None for p in found) else None
        case Exists(name):
            return layout.present(name)
        case In(name, values) if values and all(tag_of(v) == layout.fields.get(name, (None, ""))[1] for v in values):
            return layout.fields[name][0].isin(list(values))
        case Eq() | Lt() | Lte() | Gt() | Gte():
            column, kind = layout.fields.get(node.field, (None, "none"))
            if column is not None and kind == tag_of(node.value) and kind != "bool" and node.value == node.value:
                return column == F.lit(node.value) if isinstance(node, Eq) else _ORDER[type(node)](column, F.lit(node.value))
    return None


def condition(node: Any, layout: Layout) -> Column:
    """The filter for use in `where` only: over columns it also carries plain predicates, which reach
    the scan as the total ones cannot.  It may be null where it is not true."""
    total = compile_filter(node, layout)
    plain = _implied(node, layout) if isinstance(layout, ColumnLayout) else None
    return total if plain is None else plain & total


_JSON = {"eq": Eq, "ne": Ne, "lt": Lt, "lte": Lte, "gt": Gt, "gte": Gte, "contains": Contains}


def parse_filter(x: Any) -> Any:
    """A filter from JSON: {"field": .., "eq": ..} and so on, {"and": [..]}, {"or": [..]}, {"not": ..}."""
    if not isinstance(x, Mapping):
        raise InvalidArgument("a filter is an object")
    if "field" in x:
        rest = [k for k in x if k != "field"]
        if not isinstance(x["field"], str) or len(rest) != 1:
            raise InvalidArgument("a field filter has a field and one test")
        op, v = rest[0], x[rest[0]]
        if op == "in":
            if not isinstance(v, list):
                raise InvalidArgument("`in` takes a list")
            [tag_of(y) for y in v]
            return In(x["field"], tuple(v))
        if op == "exists":
            return Exists(x["field"]) if v else Not(Exists(x["field"]))
        if op not in _JSON:
            raise InvalidArgument(f"unknown test {op!r}")
        tag_of(v)
        return _JSON[op](x["field"], v)
    if len(x) != 1:
        raise InvalidArgument("a filter has one kind")
    (op, v), = x.items()
    if op in ("and", "or") and isinstance(v, list):
        return (And if op == "and" else Or)(tuple(parse_filter(p) for p in v))
    if op == "not":
        return Not(parse_filter(v))
    raise InvalidArgument(f"unknown filter {op!r}")
