"""Points, payload values, requests and errors."""

from __future__ import annotations

import enum
import math
import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np

VALUE = "struct<tag:string,t:string,i:bigint,d:double,b:boolean>"
FIELD = f"struct<is_array:boolean,s:{VALUE},a:array<{VALUE}>>"
PAYLOAD = f"map<string,{FIELD}>"

I64_MIN, I64_MAX = -(1 << 63), (1 << 63) - 1


class VectariaError(Exception):
    """Base of all errors; `code` is the status a service would answer with."""

    code = "INTERNAL"


class InvalidArgument(VectariaError):
    code = "INVALID_ARGUMENT"


class NotFound(VectariaError):
    code = "NOT_FOUND"


class AlreadyExists(VectariaError):
    code = "ALREADY_EXISTS"


class DimensionMismatch(InvalidArgument):
    pass


class EmptyEmbedding(InvalidArgument):
    pass


class NonFiniteComponent(InvalidArgument):
    pass


class UnsupportedMetric(InvalidArgument):
    pass


class EmptyQuery(InvalidArgument):
    pass


class EmptyDocument(InvalidArgument):
    pass


class NonFiniteValue(InvalidArgument):
    pass


class DuplicateId(AlreadyExists):
    pass


class BadName(InvalidArgument):
    pass


class StorageError(VectariaError):
    pass


class Conflict(StorageError):
    """A writer that started from the same version committed first; nothing was written."""

    code = "ABORTED"


class FormatMismatch(StorageError):
    pass


class Metric(str, enum.Enum):
    COSINE = "cosine"
    DOT = "dot"
    EUCLIDEAN = "euclidean"

    @classmethod
    def of(cls, x: Metric | str) -> Metric:
        try:
            return cls(x)
        except ValueError:
            raise InvalidArgument(f"unknown metric {x!r}") from None


class IndexType(str, enum.Enum):
    FLAT = "flat"
    HNSW = "hnsw"

    @classmethod
    def of(cls, x: IndexType | str) -> IndexType:
        try:
            return cls(x)
        except ValueError:
            raise InvalidArgument(f"unknown index type {x!r}") from None


@dataclass(frozen=True)
class HnswConfig:
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 64
    seed: int = 0xDEADBEEFCAFE1234

    def __post_init__(self) -> None:
        if self.m < 2 or self.ef_construction < 1 or self.ef_search < 1:
            raise InvalidArgument("m must be 2 or more, ef_construction and ef_search 1 or more")

    @property
    def most_at_0(self) -> int:
        return 2 * self.m

    @property
    def level_scale(self) -> float:
        return 1 / math.log(self.m)


def check_vector(v: Sequence[float], dimension: int | None = None) -> np.ndarray:
    """A query vector as float32, or the error it deserves."""
    x = np.asarray(v, np.float32)
    if x.ndim != 1 or not len(x):
        raise EmptyEmbedding("a vector needs a component")
    if not np.isfinite(x).all():
        raise NonFiniteComponent("every component must be finite")
    if dimension is not None and len(x) != dimension:
        raise DimensionMismatch(f"{len(x)} components where {dimension} are expected")
    return x


def check_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", name):
        raise BadName(f"bad collection name {name!r}")
    return name


def point_id(text: str) -> str:
    """Canonical form of a UUID, whose text order is its byte order."""
    try:
        return str(uuid.UUID(text))
    except (ValueError, AttributeError, TypeError):
        raise InvalidArgument(f"not a UUID: {text!r}") from None


def derived_id(namespace: uuid.UUID, key: str) -> str:
    """Version-5 UUID for a native key."""
    return str(uuid.uuid5(namespace, key))


Scalar = str | int | float | bool


def tag_of(v: Scalar) -> str:
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        if not I64_MIN <= v <= I64_MAX:
            raise InvalidArgument("integers have 64 bits")
        return "int"
    if isinstance(v, float):
        return "float"
    if isinstance(v, str):
        return "text"
    raise InvalidArgument(f"not a payload value: {v!r}")


def value(v: Scalar) -> dict[str, Any]:
    """A tagged scalar as stored; floats must be finite."""
    tag = tag_of(v)
    if tag == "float" and not math.isfinite(v):
        raise NonFiniteValue("payload numbers must be finite")
    slots = dict.fromkeys(("t", "i", "d", "b"))
    slots[{"text": "t", "int": "i", "float": "d", "bool": "b"}[tag]] = v
    return {"tag": tag, **slots}


def payload(fields: Mapping[str, Scalar | Sequence[Scalar]] | None) -> dict[str, Any] | None:
    """A payload as stored.  None (absent) and {} (empty) differ."""
    if fields is None:
        return None
    out = {}
    for k, v in sorted(fields.items()):
        array = isinstance(v, (list, tuple))
        out[k] = {"is_array": array, "s": None if array else value(v), "a": [value(x) for x in v] if array else None}
    return out


def plain_value(v: Any) -> Scalar:
    return v[{"text": "t", "int": "i", "float": "d", "bool": "b"}[v["tag"]]]


def plain_payload(p: Any) -> dict[str, Any] | None:
    """The inverse of `payload`, for rows and dictionaries."""
    if p is None:
        return None
    return {k: [plain_value(x) for x in f["a"]] if f["is_array"] else plain_value(f["s"]) for k, f in sorted(p.items())}


@dataclass(frozen=True)
class SearchQuery:
    vector: Sequence[float]
    k: int
    metric: Metric | None = None
    filter: Any = None


@dataclass(frozen=True)
class HybridQuery:
    k: int
    vector: Sequence[float] | None = None
    text: str | None = None
    metric: Metric | None = None
    filter: Any = None
    rrf_k: float = 60.0
    overfetch: int = 4

    def checked(self) -> HybridQuery:
        """As taken from a caller: empty means none, numbers in range."""
        vector = self.vector if self.vector is not None and len(self.vector) else None
        text = self.text or None
        if not (math.isfinite(self.rrf_k) and self.rrf_k > 0):
            raise InvalidArgument("rrf_k must be finite and positive")
        if self.overfetch < 1:
            raise InvalidArgument("overfetch must be 1 or more")
        return HybridQuery(self.k, vector, text, self.metric, self.filter, self.rrf_k, self.overfetch)


@dataclass(frozen=True)
class CollectionMeta:
    name: str
    metric: Metric
    dimension: int
    index_type: IndexType = IndexType.FLAT
    hnsw: HnswConfig | None = field(default=None)

    def to_json(self) -> dict[str, Any]:
        h = self.hnsw
        return {
            "name": self.name, "metric": self.metric.value, "dimension": self.dimension, "index_type": self.index_type.value,
            "hnsw": h and {"m": h.m, "ef_construction": h.ef_construction, "ef_search": h.ef_search, "seed": h.seed},
        }

    @classmethod
    def from_json(cls, x: Mapping[str, Any]) -> CollectionMeta:
        h = x.get("hnsw")
        return cls(check_name(x["name"]), Metric.of(x["metric"]), int(x["dimension"]), IndexType.of(x["index_type"]), h and HnswConfig(**h))
