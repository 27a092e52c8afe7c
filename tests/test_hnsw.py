import random

import numpy as np
import pytest

from vectaria.measure import main, run
from vectaria.operators import hnsw
from vectaria.types import DimensionMismatch, DuplicateId, HnswConfig, InvalidArgument, Metric, UnsupportedMetric


def exact(metric, vectors, q, k, ids=None):
    v, q = np.asarray(vectors, np.float32), np.asarray(q, np.float32)
    s = v @ q
    if metric is Metric.COSINE:
        s = s / (np.linalg.norm(v, axis=1) * np.linalg.norm(q))
    elif metric is Metric.EUCLIDEAN:
        s = -np.linalg.norm(v - q, axis=1)
    ids = range(len(v)) if ids is None else ids
    return [i for i in sorted(ids, key=lambda i: (-s[i], i))][:k]


def test_generator():
    r = hnsw.SplitMix64(0)
    assert [r.next() for _ in range(2)] == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4]
    assert all(0 <= hnsw.SplitMix64(s).level(0.36) <= hnsw.TOP_LEVEL for s in range(50))


@pytest.mark.parametrize("metric", list(Metric))
def test_recall_floor(metric):
    r = np.random.default_rng(1)
    vectors, queries = r.uniform(-1, 1, (500, 16)).astype(np.float32), r.uniform(-1, 1, (50, 16)).astype(np.float32)
    g = hnsw.Graph(metric, HnswConfig(seed=1))
    g.bulk_insert(enumerate(vectors))
    report = run(lambda q: [i for i, _ in g.search(q, 10)], lambda q: exact(metric, vectors, q, 10), queries)
    assert report.recall >= 0.90 and report.p50_ms <= report.p99_ms


def test_filter_removal_and_compaction():
    r = random.Random(2)
    vectors = [[r.uniform(-1, 1) for _ in range(4)] for _ in range(60)]
    g = hnsw.Graph(Metric.COSINE, HnswConfig(m=4, ef_construction=40, ef_search=60, seed=0))
    g.bulk_insert(enumerate(vectors))
    even = lambda i: i % 2 == 0
    assert [i for i, _ in g.search(vectors[7], 5, admit=even)] == exact(Metric.COSINE, vectors, vectors[7], 5, range(0, 60, 2))
    for i in range(0, 60, 3):
        assert g.remove(i) and not g.remove(i)
    live = [i for i in range(60) if i % 3]
    for graph in (g, g.compact()):
        found = [i for i, _ in graph.search(vectors[7], 10)]
        assert found == exact(Metric.COSINE, vectors, vectors[7], 10, live) and len(graph) == 40
    g.insert(0, vectors[0])
    assert g.search(vectors[0], 1)[0][0] == 0


def test_determinism_and_snapshot():
    r = np.random.default_rng(3)
    vectors = r.normal(size=(120, 6)).astype(np.float32)
    graphs = [hnsw.Graph(Metric.DOT, HnswConfig(seed=9)) for _ in range(2)]
    for g in graphs:
        g.bulk_insert(enumerate(vectors[:100]))
    assert graphs[0].snapshot() == graphs[1].snapshot()
    again = hnsw.Graph.from_snapshot(Metric.DOT, HnswConfig(seed=9), graphs[0].snapshot())
    for g in (again, graphs[0]):
        g.bulk_insert((100 + i, v) for i, v in enumerate(vectors[100:]))
    assert again.snapshot() == graphs[0].snapshot()


def test_errors():
    g = hnsw.Graph(Metric.COSINE)
    assert g.search([1.0], 3) == []
    g.insert(1, [1.0, 0.0])
    with pytest.raises(DuplicateId):
        g.insert(1, [1.0, 0.0])
    with pytest.raises(DimensionMismatch):
        g.insert(2, [1.0])
    with pytest.raises(UnsupportedMetric):
        g.search([1.0, 0.0], 1, Metric.DOT)
    for bad in ({"m": 1}, {"ef_construction": 0}, {"ef_search": 0}):
        with pytest.raises(InvalidArgument):
            HnswConfig(**bad)


def test_sharded_build_and_search(spark):
    r = np.random.default_rng(4)
    vectors = r.normal(size=(90, 8)).astype(np.float32)
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<float>")
    graphs = hnsw.build(p, Metric.COSINE, shards=3).cache()
    q = [(k, vectors[k].tolist()) for k in (3, 50)]
    got = hnsw.search(graphs, q, 5, Metric.COSINE, ef=200).collect()
    odd = hnsw.search(graphs, q, 5, Metric.COSINE, ef=200, admitted=p.where("id % 2 = 1")).collect()
    for k, v in q:
        mine = lambda rows: [x.id for x in sorted(rows, key=lambda x: x["rank"]) if x.query_id == k]  # noqa: B023, E731
        assert mine(got) == exact(Metric.COSINE, vectors, v, 5)
        assert mine(odd) == exact(Metric.COSINE, vectors, v, 5, range(1, 90, 2))


def test_statistics():
    assert hnsw.recall_at_k([[1, 2], []], [[2, 3], [5]]) == 0.75
    assert hnsw.nearest_rank([3, 1, 2, 4], 0.5) == 2 and hnsw.nearest_rank([1.0], 0.99) == 1
    with pytest.raises(InvalidArgument):
        hnsw.nearest_rank([], 0.5)


@pytest.mark.parametrize("backend, least", [("flat", 1.0), ("stored", 1.0), ("graph", 0.9)])
def test_harness(spark, backend, least):
    report = main(["--backend", backend, "--metric", "euclidean", "--dimension", "8", "--points", "200", "--queries", "5"], spark)
    assert report.recall >= least and report.queries == 5
