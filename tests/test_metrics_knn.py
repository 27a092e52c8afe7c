import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectaria.functions import metrics
from vectaria.operators import knn
from vectaria.types import DimensionMismatch, EmptyEmbedding, InvalidArgument, Metric, NonFiniteComponent


def frame(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vector array<float>")


def brute(metric, a, b):
    a, b, s = np.asarray(a, np.float32), np.asarray(b, np.float32), np.float32(0)
    if metric is Metric.EUCLIDEAN:
        for x, y in zip(a, b):
            s = np.float32(s + (x - y) * (x - y))
        return -float(np.float32(np.sqrt(np.float64(s))))
    for x, y in zip(a, b):
        s = np.float32(s + x * y)
    if metric is Metric.DOT:
        return float(s)
    na, nb = metrics.literal_norm(a), metrics.literal_norm(b)
    return 0.0 if not na or not nb else float(np.float32(np.float64(s) / np.float64(np.float32(na) * np.float32(nb))))


@pytest.mark.parametrize("metric", list(Metric))
def test_scores_are_sequential_single_precision(spark, metric):
    r = random.Random(3)
    vectors = [[r.uniform(-10, 10) for _ in range(5)] for _ in range(40)] + [[0.0] * 5]
    q = [r.uniform(-1, 1) for _ in range(5)]
    got = {x.id: x.score for x in knn.top_k(frame(spark, vectors), q, 100, metric).collect()}
    assert got == {i: brute(metric, v, q) for i, v in enumerate(vectors)}


def test_values(spark):
    p = frame(spark, [[1, 2, 3]])
    one = lambda m, q: knn.top_k(p, q, 1, m).first().score
    assert one(Metric.DOT, [4, 5, 6]) == 32
    assert one(Metric.EUCLIDEAN, [1, 2, 3]) == 0
    assert one(Metric.COSINE, [0, 0, 0]) == 0


@pytest.mark.parametrize("metric", list(Metric))
def test_order_ties_and_k(spark, metric):
    p = frame(spark, [[1, 0], [-1, 0], [1, 0], [0, 1]])
    ids = lambda k: [x.id for x in knn.top_k(p, [1, 0], k, metric).collect()]
    assert ids(2) == [0, 2]
    assert ids(0) == []
    assert ids(9) == ids(200_000) == [0, 2, 3, 1]
    with pytest.raises(InvalidArgument):
        ids(-1)


def test_filter_runs_first_and_plan_is_bounded(spark):
    p = frame(spark, [[i, 1] for i in range(20)])
    df = knn.top_k(p, [1, 0], 3, Metric.DOT, F.col("id") % 5 == 1)
    assert [x.id for x in df.collect()] == [16, 11, 6]
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().executedPlan().toString()


def test_batch_equals_single(spark):
    r = random.Random(5)
    p = frame(spark, [[r.gauss(0, 1) for _ in range(4)] for _ in range(60)])
    queries = [(k, [r.gauss(0, 1) for _ in range(4)]) for k in range(5)]
    got = knn.batch_top_k(p, queries, 4).collect()
    for k, q in queries:
        mine = [(x.id, x.score) for x in sorted(got, key=lambda x: x["rank"]) if x.query_id == k]
        assert mine == [(x.id, x.score) for x in knn.top_k(p, q, 4).collect()]


def test_bad_queries(spark):
    p = frame(spark, [[1, 2]])
    with pytest.raises(EmptyEmbedding):
        knn.top_k(p, [], 1)
    with pytest.raises(NonFiniteComponent):
        knn.top_k(p, [float("nan"), 1], 1)
    with pytest.raises(DimensionMismatch):
        knn.top_k(p, [1], 1, dimension=2)
