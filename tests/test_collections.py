import json
import uuid

import pytest
from pyspark.sql import functions as F

from vectaria import cli
from vectaria.operators.filters import Eq, Exists, Not
from vectaria.sources import synthetic
from vectaria.sources.collection import Collection, points_frame
from vectaria.sources.database import Database, guarded
from vectaria.streaming.ingest import bulk_upsert_stream
from vectaria.types import (
    AlreadyExists, BadName, CollectionMeta, DimensionMismatch, DuplicateId, EmptyDocument, FormatMismatch, HnswConfig, HybridQuery, IndexType,
    InvalidArgument, Metric, NonFiniteComponent, NotFound, SearchQuery, UnsupportedMetric, derived_id, plain_payload, point_id,
)

META = CollectionMeta("c", Metric.COSINE, 2)


def point(key, v=(1.0, 0.0), **more):
    return {"id": key, "vector": v, **more}


@pytest.fixture
def c(spark, tmp_path):
    return Collection.create(spark, str(tmp_path / "c"), META)


def live(c):
    return {r.id: (r.vector, r.document, plain_payload(r.payload)) for r in c.live().collect()}


def test_upsert_replaces_whole_points(c):
    c.upsert([point("a", document="fox", payload={"k": 1}), point("b", payload={})])
    c.upsert([point("a", (0.0, 1.0))])
    assert live(c) == {"a": ([0.0, 1.0], None, None), "b": ([1.0, 0.0], None, {})}
    assert c.upsert([point("z", (0.0, 2.0)), point("z", (0.0, 3.0))]) == 2
    assert live(c)["z"][0] == [0.0, 3.0] and c.count() == 3


def test_delete_compact_snapshot_reopen(spark, c, tmp_path):
    c.upsert([point(k, payload={"n": i}) for i, k in enumerate("abcd")])
    assert c.delete("b") and not c.delete("b") and not c.delete("zz")
    assert c.delete_by_filter(Eq("n", 3)) == 1
    with pytest.raises(InvalidArgument):
        c.delete_by_filter(None)
    before = live(c)
    assert set(before) == {"a", "c"} and c.compact() == 2
    assert live(c) == live(Collection.open(spark, c.folder)) == live(c.snapshot(str(tmp_path / "copy"))) == before
    c.upsert([point("b")])
    c.delete("a")
    assert set(live(c)) == {"b", "c"} and c.vacuum() > 0 and set(live(c)) == {"b", "c"}
    with pytest.raises(FormatMismatch):
        Collection.open(spark, c.folder, CollectionMeta("c", Metric.DOT, 2))


def test_unlisted_folders_are_not_seen(c):
    c.upsert([point("a")])
    points_frame(c.spark, [point("ghost")]).write.parquet(f"{c.folder}/ops-99999999-orphan")
    assert set(live(c)) == {"a"}


def test_bad_points_change_nothing(c):
    for bad, error in (
        (point("x", (1.0,)), DimensionMismatch), (point("x", (1.0, float("nan"))), NonFiniteComponent), (point("x", document=" \n　"), EmptyDocument), (point(None), InvalidArgument),
    ):
        with pytest.raises(error):
            c.upsert([point("ok"), bad])
    assert c.count() == 0
    c.insert([point("a")])
    for again in ([point("a")], [point("b"), point("b")]):
        with pytest.raises(DuplicateId):
            c.insert(again)
    c.upsert([point("t", document="---")])
    assert c.count() == 2


def test_search_and_hybrid(c):
    c.upsert([point("a", document="fox", payload={"s": "w"}), point("b", (0.9, 0.1), document="dog", payload={"s": "v"}), point("d", (-1.0, 0.0), document="fox tale")])
    hits = c.search(SearchQuery([1.0, 0.0], 2)).collect()
    assert [h.id for h in hits] == ["a", "b"] and plain_payload(hits[0].payload) == {"s": "w"}
    assert [h.id for h in c.search(SearchQuery([1.0, 0.0], 5, Metric.DOT, Not(Exists("q")))).collect()] == ["a", "b"]
    for _ in range(2):  # from the texts, then from postings
        got = c.search_hybrid(HybridQuery(3, [1.0, 0.0], "fox")).collect()
        assert [h.id for h in got] == ["a", "d", "b"] and got[0].score == pytest.approx(2 / 61)
        assert [h.id for h in c.search_hybrid(HybridQuery(3, None, "fox", None, Eq("s", "w"))).collect()] == ["a"]
        c.build_postings()


def test_graph_index(spark, tmp_path):
    c = Collection.create(spark, str(tmp_path / "g"), CollectionMeta("g", Metric.DOT, 8, IndexType.HNSW, HnswConfig(ef_search=100)), "bigint")
    c.upsert(synthetic.uniform(spark, 80, 8))
    q = SearchQuery([1.0] * 8, 5)
    want = [(h.id, pytest.approx(h.score, abs=1e-5)) for h in c.search(q).collect()]
    c.build_graph(2)
    assert [(h.id, h.score) for h in c.search(q).collect()] == want
    with pytest.raises(UnsupportedMetric):
        c.search(SearchQuery([1.0] * 8, 5, Metric.COSINE))
    c.upsert([{"id": 1000, "vector": [9.0] * 8}])
    assert c.search(q).first().id == 1000


def test_stream_is_replay_safe(spark, tmp_path, c):
    for k in range(3):
        points_frame(spark, [point("a", (float(k + 1), 0.0)), point(f"p{k}")]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(c.live().schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    bulk_upsert_stream(stream, c, str(tmp_path / "check")).awaitTermination()
    assert set(live(c)) == {"a", "p0", "p1", "p2"}
    seq = c.manifest()["seq"]
    assert seq == 3 and c.upsert([point("late")], batch="bulk/2") == 1
    assert c.manifest()["seq"] == seq and "late" not in live(c)


def test_database(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    db.create_collection("one", "cosine", 2)
    db.create_collection("two", Metric.DOT, 3, "hnsw", {"m": 8})
    for call, error in (
        (lambda: db.create_collection("one", "cosine", 2), AlreadyExists), (lambda: db.create_collection("a b", "cosine", 2), BadName), (lambda: db.create_collection("x", None, 2), InvalidArgument),
        (lambda: db.create_collection("x", "manhattan", 2), InvalidArgument), (lambda: db.create_collection("x", "dot", 0), InvalidArgument), (lambda: db.get("zz"), NotFound),
        (lambda: db.create_collection("x", "dot", 2, "hnsw", {"m": 0}), InvalidArgument), (lambda: db.bulk_upsert([]), InvalidArgument), (lambda: db.upsert("one", None), InvalidArgument),
        (lambda: db.search("zz", SearchQuery([], 1)), InvalidArgument), (lambda: db.search("one", SearchQuery([1.0], 1)), DimensionMismatch),
    ):
        with pytest.raises(error):
            call()
    assert guarded(lambda: db.get("zz"))["error"] == "NOT_FOUND"
    db.upsert("one", point("a"))
    assert db.bulk_upsert([("one", [point("b")]), ("", [point("c")])]) == 2
    with pytest.raises(InvalidArgument):
        db.bulk_upsert([("one", [point("d")]), ("two", [point("e")])])
    again = Database(spark, db.root)
    assert [(x["name"], x["count"]) for x in again.list_collections()] == [("one", 4), ("two", 0)]
    assert again.describe_collection("two")["hnsw"]["m"] == 8
    assert again.drop_collection("two") and not again.drop_collection("two")
    assert list(Database(spark, db.root).collections) == ["one"]


def test_cli(spark, tmp_path, capsys):
    def call(*args):
        code = cli.main(["--root", str(tmp_path / "cli"), *args], spark)
        out = capsys.readouterr()
        return json.loads(out.out) if not code else json.loads(out.err)["error"]

    a, b = derived_id(uuid.NAMESPACE_URL, "a"), derived_id(uuid.NAMESPACE_URL, "b")
    assert call("create-collection", "c", "--metric", "cosine", "--dimension", "2")["dimension"] == 2
    assert call("create-collection", "c", "--metric", "cosine", "--dimension", "2") == "ALREADY_EXISTS"
    assert call("upsert", "c", "--id", a.upper(), "--vector", "1, 0", "--document", "red fox", "--payload", '{"n": 1, "f": 1.5, "t": ["x"]}') == {"upserted": 1}
    call("upsert", "c", "--id", b, "--vector", "0,1")
    assert call("upsert", "c", "--id", "nope", "--vector", "0,1") == "INVALID_ARGUMENT"
    assert call("list")[0]["count"] == call("describe", "c")["count"] == 2
    hits = call("search", "c", "--vector", "1,0", "-k", "1")
    assert hits == [{"id": a, "score": 1.0, "payload": {"n": 1, "f": 1.5, "t": ["x"]}}]
    assert [h["id"] for h in call("search-hybrid", "c", "--text", "fox", "--vector", "0,1", "--filter", '{"field": "n", "eq": 1}')] == [a]
    assert call("compact", "c") == {"points": 2}
    assert call("delete", "c", "--id", b) == {"existed": True}
    assert call("delete", "c", "--filter", '{"field": "n", "eq": 1}') == {"deleted": 1}
    assert call("drop", "c") == {"existed": True} and call("describe", "c") == "NOT_FOUND"


def test_ids_and_synthetic(spark):
    x = str(uuid.uuid4())
    assert point_id(x.upper()) == point_id(x.replace("-", "")) == x
    with pytest.raises(InvalidArgument):
        point_id("12")
    u = synthetic.uniform(spark, 50, 4)
    rows = u.collect()
    assert rows == synthetic.uniform(spark, 50, 4).repartition(7).orderBy("id").collect()
    assert all(-1 <= c < 1 for r in rows for c in r.vector) and u.select(F.countDistinct("vector")).first()[0] == 50
