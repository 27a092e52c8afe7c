import pytest

from vectaria.plans import catalogue


@pytest.mark.parametrize("as_folder", [False, True])
def test_stream_reads_the_table_as_file_or_folder_and_no_other(spark, tmp_path, as_folder):
    frame = lambda ids: spark.createDataFrame([(i, [i / 8] * 64, 0) for i in ids], "vec_id long, embedding array<float>, label int")
    folder = tmp_path / "folder.parquet"
    frame(range(40)).repartition(3 if as_folder else 1).write.parquet(str(folder))
    table = tmp_path / "embeddings.parquet"
    folder.rename(table) if as_folder else next(folder.glob("part-*")).rename(table)
    frame([99]).coalesce(1).write.parquet(str(tmp_path / "other"))
    next((tmp_path / "other").glob("part-*")).rename(tmp_path / "embeddings_of_old.parquet")
    got = catalogue.stream_bulk_upsert(spark, str(tmp_path)).collect()
    assert sorted((r.id, r["first"]) for r in got) == [(i, i / 8) for i in range(40)]
