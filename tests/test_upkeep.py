import pytest
from pyspark.sql import functions as F

from vectaria.operators import knn, lexical
from vectaria.sources import synthetic
from vectaria.sources.collection import Collection
from vectaria.sources.database import Database
from vectaria.types import CollectionMeta, Conflict, HybridQuery, InvalidArgument, Metric, NonFiniteComponent, SearchQuery


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_winners_are_joined_by_broadcast(spark, tmp_path):
    synthetic.uniform(spark, 200, 4).withColumn("wide", F.lit("x")).write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    out = knn.hydrate(knn.top_k(p, [1.0] * 4, 5), p, ["wide"], 5)
    text = plan(out)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "hashpartitioning" not in text
    assert out.count() == 5


def test_a_scoring_pass_tokenises_a_text_once(spark, tmp_path):
    spark.createDataFrame([(1, "red fox"), (2, "a dog"), (3, "foxes")], "id long, document string").write.parquet(str(tmp_path / "d"))
    found = lexical.search_text(spark.read.parquet(str(tmp_path / "d")), "fox", 5)
    assert plan(found).count("split(") == 1
    assert [r.id for r in found.collect()] == [1]


def test_second_writer_of_a_version_is_refused(spark, tmp_path):
    one = Collection.create(spark, str(tmp_path / "c"), CollectionMeta("c", Metric.DOT, 2), "bigint")
    two, stale = Collection.open(spark, one.folder), one.manifest()
    one.upsert([{"id": 1, "vector": [1.0, 0.0]}])
    two.manifest = lambda: {**stale, "delta": list(stale["delta"]), "batches": dict(stale["batches"])}
    with pytest.raises(Conflict):
        two.upsert([{"id": 2, "vector": [1.0, 0.0]}])
    assert [r.id for r in Collection.open(spark, one.folder).live().collect()] == [1]
    with pytest.raises(NonFiniteComponent):
        one.upsert([{"id": 3, "vector": [float("nan"), 0.0]}])
    assert one.count() == 1
    one.vacuum()
    assert Collection.open(spark, one.folder).count() == 1


def test_indexes_serve_and_are_maintained(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    with pytest.raises(InvalidArgument):
        db.create_collection("bad", "cosine", 2, "hnsw", {"m": 8, "depth": 3})
    db.create_collection("c", "cosine", 2, "hnsw", {"m": 4}, id_type="bigint")
    db.bulk_insert("c", [{"id": i, "vector": [1.0, i / 20], "document": f"fox number {i}"} for i in range(40)])
    c = db.get("c")
    db.delete("c", 0)
    c.upsert([{"id": 1, "vector": [-1.0, 0.0], "document": "dog"}, {"id": 99, "vector": [1.0, 0.001], "document": "fox fox"}, {"id": 100, "vector": [0.0, 1.0], "document": "---"}])
    near, text = SearchQuery([1.0, 0.0], 3), "fox 2"
    for _ in range(2):
        assert [r.id for r in db.search("c", near).collect()] == [99, 2, 3]
        got = [(r.id, round(r.score, 9)) for r in c.lexical(text, 50).collect()]
        assert got == [(r.id, round(r.score, 9)) for r in lexical.search_text(c.live(), text, 50).collect()] and len(got) == 39
        assert db.search_hybrid("c", HybridQuery(3, [1.0, 0.0], text)).count() == 3
        db.compact("c")
        m = c.manifest()
        assert m["graph"]["seq"] == m["postings"]["seq"] == m["seq"] and not m["delta"]
