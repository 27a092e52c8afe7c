import random
from functools import reduce

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vectaria.functions import metrics
from vectaria.operators import knn
from vectaria.types import Metric

NAN, INF = float("nan"), float("inf")


def by_columns(points, queries, k, metric):
    """The same by column expressions, a query at a time."""
    w = Window.orderBy(F.desc("score"), "id")
    parts = []
    for n, q in queries:
        scored = points.select("id", metrics.score_to(metric, F.col("vector"), q).alias("score"))
        parts.append(scored.select(F.lit(n).cast("long").alias("query_id"), F.row_number().over(w).alias("rank"), "id", "score").where(F.col("rank") <= k))
    return reduce(lambda a, b: a.unionByName(b), parts)


@pytest.mark.parametrize("metric", list(Metric))
@pytest.mark.parametrize("kind", ["long", "string"])
def test_scores_and_odd_rows_to_the_bit(spark, metric, kind, monkeypatch):
    monkeypatch.setattr(knn, "QUERIES_AT_ONCE", 3)
    monkeypatch.setattr(knn, "TILE", 7)
    r = random.Random(5)
    rows = [[r.uniform(-1, 1) for _ in range(6)] for _ in range(60)]
    rows += rows[:9] + [None, [], [1.0] * 5, [0.0] * 7, [0.0] * 6, [1.0, None, 1.0, 1.0, 1.0, 1.0], [NAN] * 6, [3e38] * 6, [-3e38] * 6, [INF] + [1.0] * 5]
    name = (lambda i: i) if kind == "long" else (lambda i: f"é{i}")
    p = spark.createDataFrame([(name(i) if i != 5 else None, v) for i, v in enumerate(rows)], f"id {kind}, vector array<float>").repartition(3)
    queries = [(i, rows[i]) for i in (0, 3, 8, 20)] + [(70, [0.0] * 6), (71, [1.0] * 4)]
    for k in (0, 4, 200):
        want = sorted(map(repr, by_columns(p, queries, k, metric).collect()))
        assert sorted(map(repr, knn.batch_top_k(p, queries, k, metric).collect())) == want


def test_points_are_not_multiplied_by_queries(spark):
    """A row a point and query, each folded by itself, made exact neighbours last for minutes."""
    p = spark.createDataFrame([(1, [1.0, 2.0])], "id long, vector array<float>")
    assert "Generate" not in knn.batch_top_k(p, [(0, [1.0, 0.0])], 1)._jdf.queryExecution().toString()
