import random

from vectaria.plans import catalogue


def test_recall_has_no_row_cap(spark, tmp_path, monkeypatch):
    r = random.Random(1)
    rows = [(50 * i, [r.uniform(-1, 1) for _ in range(8)], 0) for i in range(60)] + [(1, [0.5] * 8, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(catalogue, "RECALL_BLOCK", 25)
    got = catalogue.hnsw_recall(spark, str(tmp_path)).collect()
    assert sorted(x.query_id for x in got) == [50 * i for i in range(60)]
    assert sum(x.recall for x in got) / 60 >= 0.9
