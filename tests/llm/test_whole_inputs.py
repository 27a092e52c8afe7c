import corpus_pipeline
from pyspark.sql import functions as F

from vectaria.llm import mixing as M
from vectaria.llm import toxicity as X


def test_language_stage_without_labels_keeps_texts_with_a_letter(spark):
    rows = [(1, "some clean text", None), (2, "12 34 !", None), (3, None, None), (4, "été", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.languages(spark, d, "").collect()) == [1, 4]


def test_rows_without_id_meet_their_targets(spark):
    source = F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))
    d = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"), source.alias("source"))
    want = {r.source: r["__target"] for r in M.mix(d).collect()}
    out = M.emit(d)
    got = {r.source: r.n for r in out.groupBy("source").agg((2 * F.count("text")).alias("n")).collect()}
    assert all(abs(got.get(s, 0) - t) < 0.1 * t for s, t in want.items())
    assert sorted(r.text for r in out.collect()) == sorted(r.text for r in M.emit(d.repartition(5)).collect())


def test_repeated_rows_do_not_push_toxic_ones_out_of_the_fit(spark):
    rows = [(i, f"calm w{i % 7} text") for i in range(30)] * 4 + [(i, "vile text") for i in range(30, 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 30)) for i in range(40)], "doc_id long, grade int")
    model = X.fit(d, labels, fit_rows=40)
    assert {r.doc_id for r in X.severity(d, model).where("toxic").collect()} == set(range(30, 40))
    assert model.weights == X.fit(d.distinct(), labels, fit_rows=40).weights
