"""Named collections under one root, with the checks and error codes of a service."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..types import AlreadyExists, CollectionMeta, HnswConfig, HybridQuery, IndexType, InvalidArgument, Metric, NotFound, SearchQuery, VectariaError, check_name, check_vector
from .collection import Collection
from .files import Files

log = logging.getLogger(__name__)


class Database:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self.files.mkdirs(self.root)
        self.collections: dict[str, Collection] = {}
        for name in self.files.folders(self.root):
            if self.files.exists(f"{self.root}/{name}/_collection.json"):
                try:
                    self.collections[name] = Collection.open(spark, f"{self.root}/{name}")
                except (VectariaError, KeyError, TypeError) as e:
                    log.warning("collection %s left out: %s", name, e)

    def create_collection(
        self, name: str, metric: Metric | str | None, dimension: int, index_type: IndexType | str | None = IndexType.FLAT,
        hnsw: HnswConfig | Mapping[str, int] | None = None, id_type: str = "string",
    ) -> CollectionMeta:
        check_name(name)
        if metric is None or index_type is None:
            raise InvalidArgument("metric and index type must be given")
        index = IndexType.of(index_type)
        if isinstance(hnsw, Mapping):
            unknown = sorted(set(hnsw) - {f.name for f in fields(HnswConfig)})
            if unknown:
                raise InvalidArgument(f"unknown parameters {unknown}")
            hnsw = HnswConfig(**hnsw)
        meta = CollectionMeta(name, Metric.of(metric), int(dimension), index, (hnsw or HnswConfig()) if index is IndexType.HNSW else None)
        if meta.dimension < 1:
            raise InvalidArgument("a dimension is 1 or more")
        if name in self.collections or self.files.exists(f"{self.root}/{name}/_collection.json"):
            raise AlreadyExists(f"collection {name} exists")
        self.collections[name] = Collection.create(self.spark, f"{self.root}/{name}", meta, id_type)
        return meta

    def drop_collection(self, name: str) -> bool:
        """Whether it was there; dropping again is no error."""
        there = self.collections.pop(name, None)
        if there:
            self.files.delete(there.folder)
        return there is not None

    def get(self, name: str) -> Collection:
        if name not in self.collections:
            raise NotFound(f"no collection {name}")
        return self.collections[name]

    def list_collections(self) -> list[dict[str, Any]]:
        return [self.describe_collection(n) for n in sorted(self.collections)]

    def describe_collection(self, name: str) -> dict[str, Any]:
        c = self.get(name)
        return c.meta.to_json() | {"count": c.count()}

    def upsert(self, name: str, point: Mapping[str, Any] | None) -> None:
        c = self.get(name)
        if point is None:
            raise InvalidArgument("a point is needed")
        check_vector(point["vector"], c.meta.dimension)
        c.upsert([point])

    def batch_upsert(self, name: str, points: DataFrame | Iterable[Mapping[str, Any]]) -> int:
        return self.get(name).upsert(points)

    def bulk_upsert(self, chunks: Iterable[tuple[str, Sequence[Mapping[str, Any]]]]) -> int:
        """Chunks (collection, points).  The first names the collection; each is applied by itself, and
        an error leaves earlier ones applied."""
        c: Collection | None = None
        n = 0
        for name, points in chunks:
            if c is None:
                c = self.get(name)
            elif name and name != c.meta.name:
                raise InvalidArgument("a bulk upsert goes to one collection")
            n += c.upsert(points) if points else 0
        if c is None:
            raise InvalidArgument("an empty stream")
        return n

    def delete(self, name: str, key: Any) -> bool:
        return self.get(name).delete(key)

    def delete_by_filter(self, name: str, node: Any) -> int:
        if node is None:
            raise InvalidArgument("a filter is needed")
        return self.get(name).delete_by_filter(node)

    def bulk_insert(self, name: str, points: DataFrame | Iterable[Mapping[str, Any]]) -> int:
        """All or nothing; an id that is taken is an error.  The indexes are built anew at the end."""
        n = self.get(name).insert(points)
        self.build_indexes(name)
        return n

    def build_indexes(self, name: str, shards: int | None = None) -> None:
        """The postings, and for an HNSW collection the graph, of the points as they are."""
        c = self.get(name)
        c.build_postings()
        if c.meta.index_type is IndexType.HNSW:
            c.build_graph(shards)

    def compact(self, name: str) -> int:
        return self.get(name).compact()

    def search(self, name: str, q: SearchQuery) -> DataFrame:
        check_vector(q.vector)
        return self.get(name).search(q)

    def search_hybrid(self, name: str, q: HybridQuery) -> DataFrame:
        return self.get(name).search_hybrid(q.checked())


def guarded(call: Callable[[], Any]) -> dict[str, Any]:
    """The result, or the status code and message of an error, as a service would answer."""
    try:
        return {"ok": call()}
    except VectariaError as e:
        return {"error": e.code, "message": re.sub(r"\s+", " ", str(e))}
