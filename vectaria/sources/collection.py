"""A collection: points in Parquet under a manifest.

`base` folders hold live points, one row an id; `delta` folders hold later operations ('U' with a
whole point, 'D' with an id), each folder with its sequence number.  The live view is the base
without the ids that the delta mentions, and the delta's last word on each: the base is not
shuffled by key unless the delta is large.  A commit writes its folder first and then the
next numbered manifest, so an unlisted folder is never seen, readers keep the version they opened, and of
two writers that started from one version the second gets `Conflict`.

Graph and postings are of the points as they were when built.  What has changed since lies in the delta: its
ids are left out of the index and its live points are searched beside it, exactly, so a search reads
the index and the delta, not the collection.  `compact` builds the indexes there are anew.

An upsert replaces vector, document and payload together; what is absent is erased."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.metrics import finite
from ..functions.text import blank
from ..operators import filters, hnsw, knn, lexical
from ..operators.fusion import hybrid as hybrid_search
from ..types import (
    PAYLOAD, CollectionMeta, DimensionMismatch, DuplicateId, EmptyDocument, FormatMismatch, HybridQuery, IndexType, InvalidArgument,
    Metric, NonFiniteComponent, NonFiniteValue, SearchQuery, UnsupportedMetric, VectariaError, check_vector, payload,
)
from .files import Files

FORMAT = 1


def point_schema(id_type: str = "string") -> str:
    return f"id {id_type}, vector array<float>, document string, payload {PAYLOAD}"


def points_frame(spark: SparkSession, points: Iterable[Mapping[str, Any]], id_type: str = "string") -> DataFrame:
    """Points given as dictionaries: id, vector, document?, payload? (plain values)."""
    rows = [(p["id"], [float(x) for x in p["vector"]], p.get("document"), payload(p.get("payload"))) for p in points]
    return spark.createDataFrame(rows, point_schema(id_type))


class Collection:
    def __init__(self, spark: SparkSession, folder: str, meta: CollectionMeta) -> None:
        self.spark, self.folder, self.meta, self.files = spark, folder.rstrip("/"), meta, Files(spark)

    # -- storage

    @classmethod
    def create(cls, spark: SparkSession, folder: str, meta: CollectionMeta, id_type: str = "string") -> Collection:
        if meta.dimension < 1:
            raise InvalidArgument("a dimension is 1 or more")
        c = cls(spark, folder, meta)
        c.files.mkdirs(c.folder)
        c._commit({"format": FORMAT, "id_type": id_type, "version": 0, "seq": 0, "base": [], "delta": [], "batches": {}, "graph": None})
        c.files.write_json(f"{c.folder}/_collection.json", meta.to_json())
        return c

    @classmethod
    def open(cls, spark: SparkSession, folder: str, expect: CollectionMeta | None = None) -> Collection:
        files = Files(spark)
        meta = CollectionMeta.from_json(files.read_json(f"{folder.rstrip('/')}/_collection.json"))
        if expect and (meta.dimension, meta.metric) != (expect.dimension, expect.metric):
            raise FormatMismatch("dimension or metric differ from the stored ones")
        c = cls(spark, folder, meta)
        if c.manifest()["format"] != FORMAT:
            raise FormatMismatch("another storage format")
        return c

    def manifest(self) -> dict[str, Any]:
        return self.files.read_json(f"{self.folder}/_manifest/{self.files.names(f'{self.folder}/_manifest')[-1]}")

    def _commit(self, m: dict[str, Any]) -> None:
        """`m` as it was read, with changes: its number must still be the last."""
        m["version"] += 1
        self.files.mkdirs(f"{self.folder}/_manifest")
        self.files.write_json(f"{self.folder}/_manifest/{m['version']:012d}.json", m, once=True)

    def _read(self, folders: Sequence[str], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{x}" for x in folders])

    def _ops(self, m: dict[str, Any]) -> DataFrame:
        return self._read(m["delta"], f"seq long, pos long, op string, {point_schema(m['id_type'])}")

    def live(self) -> DataFrame:
        """The live points: id, vector, document, payload."""
        m = self.manifest()
        base = self._read(m["base"], point_schema(m["id_type"]))
        if not m["delta"]:
            return base
        ops = self._ops(m)
        last = self._last(ops)
        if not m["base"]:
            return last
        return base.join(ops.select("id").distinct(), "id", "left_anti").unionByName(last)

    def count(self) -> int:
        return self.live().count()

    # -- writes

    def _shaped(self, points: DataFrame) -> DataFrame:
        have = dict(points.dtypes)
        return points.select(
            "id", F.col("vector").cast("array<float>").alias("vector"),
            (F.col("document") if "document" in have else F.lit(None).cast("string")).alias("document"),
            (F.col("payload") if "payload" in have else F.lit(None)).cast(PAYLOAD).alias("payload"),
        )

    def _check(self, p: DataFrame) -> int:
        """How many points these are, or the error that the first bad kind among them deserves."""
        bad = lambda v: F.coalesce(v["tag"] == "float", F.lit(False)) & (F.isnan(v["d"]) | (F.abs(v["d"]) == F.lit(float("inf"))))
        field_bad = F.exists(F.map_values("payload"), lambda f: F.coalesce(bad(f["s"]), F.lit(False)) | F.coalesce(F.exists(f["a"], bad), F.lit(False)))
        some = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int"))
        found = p.agg(
            F.count(F.lit(1)).alias("n"), some(F.col("id").isNull()).alias("id"), some(F.col("vector").isNull() | (F.size("vector") != self.meta.dimension)).alias("dim"),
            some(~finite(F.col("vector"))).alias("finite"), some(blank(F.col("document"))).alias("blank"), some(field_bad).alias("value"),
        ).first()
        for hit, error in ((found.id, InvalidArgument("a point needs an id")), (found.dim, DimensionMismatch(f"vectors have {self.meta.dimension} components")), (found.finite, NonFiniteComponent("components must be finite")), (found.blank, EmptyDocument("a document needs a visible character")), (found.value, NonFiniteValue("payload numbers must be finite"))):
            if hit:
                raise error
        return found.n

    def _append(self, ops: DataFrame, batch: str | None = None) -> int:
        """Write operations, check the points among them as they were written, and commit.  The input is
        evaluated once.  Returns how many operations there are, a batch that is run again included."""
        m = self.manifest()
        if batch is not None and batch in m["batches"]:
            return ops.count()
        seq, folder = m["seq"] + 1, f"ops-{m['seq'] + 1:08d}-{uuid.uuid4().hex}"
        ops.withColumn("seq", F.lit(seq).cast("long")).write.parquet(f"{self.folder}/{folder}")
        stored = self._read([folder], f"op string, {point_schema(m['id_type'])}")
        try:
            n = self._check(stored.where("op = 'U'"))
        except VectariaError:
            self.files.delete(f"{self.folder}/{folder}")
            raise
        m["seq"], m["delta"] = seq, [*m["delta"], folder]
        if batch is not None:
            stream, _, number = batch.rpartition("/")
            m["batches"] = {b: s for b, s in m["batches"].items() if not b.startswith(stream + "/") or int(b.rpartition("/")[2]) > int(number) - 100} | {batch: seq}
        self._commit(m)
        return n

    def upsert(self, points: DataFrame | Iterable[Mapping[str, Any]], batch: str | None = None) -> int:
        """All or nothing.  Within one call later rows win.  A `batch` name seen before is left out."""
        if not isinstance(points, DataFrame):
            points = points_frame(self.spark, points, self.manifest()["id_type"])
        p = self._shaped(points)
        return self._append(p.withColumns({"pos": F.monotonically_increasing_id(), "op": F.lit("U")}), batch)

    def insert(self, points: DataFrame | Iterable[Mapping[str, Any]]) -> int:
        """Like upsert, but an id that occurs twice or is live already is an error."""
        if not isinstance(points, DataFrame):
            points = points_frame(self.spark, points, self.manifest()["id_type"])
        ids = points.select("id")
        if not ids.groupBy("id").count().where("count > 1").isEmpty() or not ids.join(self.live().select("id"), "id", "left_semi").isEmpty():
            raise DuplicateId("an id is taken")
        return self.upsert(points)

    def delete_many(self, ids: DataFrame) -> int:
        """Delete the ids of a frame; returns how many were there."""
        gone = self.live().select("id").join(ids.select("id").distinct(), "id", "left_semi")
        n = gone.count()
        if n:
            empty = [F.lit(None).cast(t).alias(c) for c, t in (("vector", "array<float>"), ("document", "string"), ("payload", PAYLOAD))]
            self._append(gone.select("id", *empty, F.lit(0).cast("long").alias("pos"), F.lit("D").alias("op")))
        return n

    def delete(self, key: Any) -> bool:
        """Whether the point was there."""
        return self.delete_many(self.spark.createDataFrame([(key,)], f"id {self.manifest()['id_type']}")) > 0

    def delete_by_filter(self, node: Any) -> int:
        if node is None:
            raise InvalidArgument("a filter is needed")
        return self.delete_many(self.live().where(self._where(node)).select("id"))

    def compact(self) -> int:
        """Rewrite the live points as the only folder.  Older folders stay for open readers."""
        m = self.manifest()
        folder = f"base-{m['seq']:08d}-{uuid.uuid4().hex}"
        self.live().write.parquet(f"{self.folder}/{folder}")
        had = {k: m.pop(k, None) for k in ("graph", "postings")}
        self._commit(m | {"base": [folder], "delta": []})
        if had["graph"]:
            self.build_graph()
        if had["postings"]:
            self.build_postings()
        return self._read([folder], point_schema(m["id_type"])).count()

    def vacuum(self) -> int:
        """Delete the folders that no manifest names."""
        m = self.manifest()
        keep = {*m["base"], *m["delta"], *(m[k]["folder"] for k in ("graph", "postings") if m.get(k))}
        keep |= {"_manifest", (m.get("postings") or {}).get("lengths")}
        gone = [f for f in self.files.folders(self.folder) if f not in keep]
        for name in self.files.names(f"{self.folder}/_manifest")[:-1]:
            self.files.delete(f"{self.folder}/_manifest/{name}")
        for f in gone:
            self.files.delete(f"{self.folder}/{f}")
        return len(gone)

    def snapshot(self, dest: str) -> Collection:
        """A consistent copy that opens by itself."""
        c = Collection.create(self.spark, dest, self.meta, self.manifest()["id_type"])
        m = c.manifest()
        self.live().write.parquet(f"{c.folder}/base-0")
        c._commit(m | {"base": ["base-0"]})
        return c

    # -- index tables

    def build_postings(self) -> None:
        """The inverted table, sorted by term so that a term filter skips most row groups."""
        m = self.manifest()
        folder = f"postings-{m['seq']:08d}-{uuid.uuid4().hex}"
        p = lexical.term_frequencies(self.live(), unique=True)
        p.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{self.folder}/{folder}")
        lengths = lexical.document_lengths(self.live())
        lengths.write.parquet(f"{self.folder}/{folder}-lengths")
        row = self.spark.read.parquet(f"{self.folder}/{folder}-lengths").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")).first()
        self._commit(m | {"postings": {"folder": folder, "lengths": f"{folder}-lengths", "seq": m["seq"], "n": row.n, "total": row.total}})

    def build_graph(self, shards: int | None = None) -> None:
        m = self.manifest()
        folder = f"graph-{m['seq']:08d}-{uuid.uuid4().hex}"
        hnsw.build(self.live(), self.meta.metric, self.meta.hnsw or hnsw.HnswConfig(), shards).write.parquet(f"{self.folder}/{folder}")
        self._commit(m | {"graph": {"folder": folder, "seq": m["seq"]}})

    def _changed(self, m: dict[str, Any], seq: int) -> tuple[DataFrame, DataFrame] | None:
        """Ids that operations after `seq` mention, and the live points among them; None without any."""
        later = [f for f in m["delta"] if int(f.split("-")[1]) > seq]
        if not later:
            return None
        ids = self._read(later, f"id {m['id_type']}").distinct()
        return ids, self._last(self._read(later, f"seq long, pos long, op string, {point_schema(m['id_type'])}"))

    @staticmethod
    def _last(ops: DataFrame) -> DataFrame:
        """The last word on each id, where it is a point."""
        w = Window.partitionBy("id").orderBy(F.desc("seq"), F.desc("pos"))
        return ops.withColumn("__r", F.row_number().over(w)).where("__r = 1 and op = 'U'").select("id", "vector", "document", "payload")

    # -- reads

    def _where(self, node: Any) -> Column | None:
        return None if node is None else filters.compile_filter(node, filters.MapLayout(F.col("payload")))

    def _metric(self, metric: Metric | None) -> Metric:
        chosen = metric or self.meta.metric
        if self.meta.index_type is IndexType.HNSW and chosen is not self.meta.metric:
            raise UnsupportedMetric(f"the index is built for {self.meta.metric.value}")
        return chosen

    def dense(self, vector: Sequence[float], k: int, metric: Metric, node: Any = None) -> DataFrame:
        """(id, score).  By graph if the collection has one, with what has changed since searched exactly;
        all exactly otherwise."""
        check_vector(vector, self.meta.dimension)
        m = self.manifest()
        graph = m.get("graph")
        if self.meta.index_type is IndexType.HNSW and graph:
            nodes = self.spark.read.parquet(f"{self.folder}/{graph['folder']}")
            admitted = None if node is None else self.live().where(self._where(node)).select("id")
            changed = self._changed(m, graph["seq"])
            if changed:
                admitted = (nodes.select("id") if admitted is None else admitted).join(changed[0], "id", "left_anti")
            found = hnsw.search(nodes, [(0, list(map(float, vector)))], k, metric, self.meta.hnsw or hnsw.HnswConfig(), None, admitted).select("id", "score")
            if changed:
                found = found.unionByName(knn.top_k(changed[1], vector, k, metric, self._where(node)))
            return knn.best(found, k)
        return knn.top_k(self.live(), vector, k, metric, self._where(node))

    def lexical(self, text: str, k: int, node: Any = None) -> DataFrame:
        """(id, score) by BM25, from the postings table if there is one and the documents changed since."""
        m = self.manifest()
        p = m.get("postings")
        if p:
            admitted = None if node is None else self.live().where(self._where(node)).select("id")
            postings, n, total = self.spark.read.parquet(f"{self.folder}/{p['folder']}"), p["n"], p["total"]
            changed = self._changed(m, p["seq"])
            if changed:
                ids, points = changed
                sums = lambda x: x.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("t")).first()
                out = sums(self.spark.read.parquet(f"{self.folder}/{p['lengths']}").join(ids, "id", "left_semi"))
                new = sums(lexical.document_lengths(points))
                n, total = n - out.n + new.n, total - out.t + new.t
                postings = postings.join(ids, "id", "left_anti").unionByName(lexical.term_frequencies(points, unique=True))
            return lexical.search_postings(postings, lexical.CorpusStats(n, total), text, k, admitted)
        return lexical.search_text(self.live(), text, k, self._where(node))

    def search(self, q: SearchQuery) -> DataFrame:
        """(id, score, payload), best first."""
        check_vector(q.vector, self.meta.dimension)
        hits = self.dense(q.vector, q.k, self._metric(q.metric), q.filter)
        return knn.hydrate(hits, self.live(), ["payload"], q.k).select("id", "score", "payload").orderBy(F.desc("score"), "id")

    def search_hybrid(self, q: HybridQuery) -> DataFrame:
        """(id, score, payload), best first."""
        if q.vector is not None:
            check_vector(q.vector, self.meta.dimension)
            metric = self._metric(q.metric)
        hits = hybrid_search(q, lambda d: self.dense(q.vector, d, metric, q.filter), lambda d: self.lexical(q.text, d, q.filter))
        return knn.hydrate(hits, self.live(), ["payload"], q.k).orderBy("rank").select("id", "score", "payload")

    def get(self, key: Any) -> DataFrame:
        return self.live().where(F.col("id") == key)

