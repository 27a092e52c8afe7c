import numpy as np
import pytest

from vectaria.operators import hnsw
from vectaria.plans import catalogue
from vectaria.types import DimensionMismatch, DuplicateId, HnswConfig, Metric


def test_bulk_insertion_walks_nowhere(monkeypatch):
    """A walk for each point made a shard's build last for minutes."""
    monkeypatch.setattr(hnsw.Graph, "_beam", None)
    g = hnsw.Graph(Metric.COSINE)
    g.bulk_insert(enumerate(np.random.default_rng(1).normal(size=(700, 8)).astype(np.float32)))
    assert len(g) == 700 and all(g.links[n][0] for n in range(700))
    assert all(max(map(len, links)) <= g.config.most_at_0 and all(len(x) <= g.config.m for x in links[1:]) for links in g.links)


@pytest.mark.parametrize("metric", list(Metric))
@pytest.mark.parametrize("far", [0, 1000])
def test_recall_in_bulk(metric, far, monkeypatch):
    monkeypatch.setattr(hnsw, "BULK_NUMBERS", 1 << 16)
    if metric is not Metric.EUCLIDEAN and far:
        return
    r = np.random.default_rng(2)
    vectors, queries = (r.uniform(-1, 1, (n, 16)).astype(np.float32) + np.float32(far) for n in (1500, 40))
    g = hnsw.Graph(metric)
    g.bulk_insert(enumerate(vectors))
    s = np.array([g.scores(q, range(1500)) for q in queries])
    truth = [np.lexsort((np.arange(1500), -x))[:10].tolist() for x in s]
    assert hnsw.recall_at_k(truth, [[i for i, _ in g.search(q, 10)] for q in queries]) >= 0.95


def test_every_node_is_reached_among_copies():
    v = np.repeat(np.random.default_rng(3).normal(size=(40, 8)).astype(np.float32), 30, axis=0)
    g = hnsw.Graph(Metric.COSINE, HnswConfig(m=4))
    g.bulk_insert(enumerate(v))
    g.connect()
    assert all({i for i, _ in g.search(q, 1200, ef=10_000)} == set(range(1200)) for q in v[::200])


def test_an_error_leaves_the_points_before_it():
    for bad, error in (((0, [1.0, 2.0]), DuplicateId), ((9, [1.0]), DimensionMismatch)):
        g = hnsw.Graph(Metric.DOT)
        with pytest.raises(error):
            g.bulk_insert([(0, [1.0, 0.0]), (1, [0.0, 1.0]), bad, (5, [1.0, 1.0])])
        assert sorted(i for i, _ in g.search([1.0, 1.0], 5)) == [0, 1]


def test_shards_grow_with_the_table(spark, tmp_path, monkeypatch):
    rows = [(i, x.tolist(), 0) for i, x in enumerate(np.random.default_rng(4).normal(size=(300, 8)).astype(np.float32))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(hnsw, "POINTS_PER_SHARD", 60)
    assert catalogue._graph(spark, str(tmp_path), 2).select("shard").distinct().count() == 5
    monkeypatch.setattr(hnsw, "POINTS_PER_SHARD", 1000)
    assert catalogue._graph(spark, str(tmp_path), 2).select("shard").distinct().count() == 2
