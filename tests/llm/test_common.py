"""Cases that every operator defines: nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

from vectaria.llm import bpe, language_id, license_scan, mixing, quality_rules, simhash, token_counts, topk_search, toxicity, url_filter
from vectaria.llm.common import hot_join

LONG = "word and more text here. " * 20_000
DOCS = [
    (1, "Hello there, the world of text.", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (None, "no id at all in this text", "en", None), (5, LONG, "fr", "b"),
    (6, "Hello there, the world of text.", "en", "a"), (6, "Hello there, the world of text.", "en", "a"), (7, "\x00\x85 ​😀 'LL\r\n\t", "de", ""), (8, " \n\t ", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def docs(spark, rows=DOCS):
    """Columns beside the ones read, with names that results use."""
    d = spark.createDataFrame(rows, SCHEMA)
    return d.withColumns({c: F.lit(7) for c in ("n_words", "score", "size", "kept", "fp", "__n", "rank", "grade", "toxic", "n_tokens", "component_id")})


def runs(spark):
    labels = spark.createDataFrame([(1, 1), (6, 1), (5, 0), (None, 1), (2, None)], "doc_id long, quality int")
    graded = labels.select("doc_id", F.col("quality").alias("grade"))
    edits = lambda i, n: F.when(i != 6, token_counts.sample_edits(i, n))
    return {
        "language": lambda d: language_id.identify(d, language_id.train(d)),
        "licence": lambda d: license_scan.license_scan(license_scan.path_of(d)),
        "quality": lambda d: quality_rules.quality_rules(d, labels.where("quality = 1")),
        "tokens": lambda d: token_counts.with_edits(d, edits),
        "simhash": lambda d: simhash.near_duplicates(d),
        "toxicity": lambda d: toxicity.severity(d, toxicity.fit(d, graded)),
        "mixing": lambda d: mixing.mix(d),
        "bpe": lambda d: bpe.encode_decode(d),
    }


@pytest.mark.parametrize("name", ["language", "licence", "quality", "tokens", "simhash", "toxicity", "mixing", "bpe"])
def test_odd_rows(spark, name):
    run = runs(spark)[name]
    rows = run(docs(spark)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(x[0]) for x in DOCS)
    twice = [r for r in rows if r.doc_id == 6]
    assert twice[0] == twice[1]
    assert run(docs(spark, [])).collect() == []
    only = run(docs(spark, [(1, None, None, None)])).collect()
    assert len(only) == 1 and only[0].doc_id == 1


def test_odd_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "http://A.ORG"), (None, "x://b.org/"), (6, "http://b.org/" + "y" * 50_000), (6, "http://b.org/" + "y" * 50_000)]
    d = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("verdict", F.lit(2))
    got = {r.page_id: (r.host, r.path[:5], r.rule, r.verdict) for r in url_filter.url_filter(d).collect()}
    assert got[1] == got[2] == got[3] == got[4] == ("", "", None, "allow")
    assert got[5] == ("a.org", "", None, "allow") and got[None] == ("b.org", "/", "org/", "allow") and got[6] == ("b.org", "/yyyy", "org/", "allow")
    assert url_filter.url_filter(d.limit(0)).collect() == []


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.5]), (100, None), (200, [1.0, nan]), (300, [inf, 1.0]), (400, [1.0, None]), (None, [1.0, 1.0]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, [-0.0004, 3e38]), (500, []), (0, [1.0, 0.5])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(1))
    got = topk_search.top_k(d, F.col("vec_id") % 100 == 0, k=3).collect()
    mine = [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0]
    assert mine == [(1, 3, (1 << 63) - 1), (2, 1, 1024**2 + 512**2), (3, 2, 1024**2 + 512**2)]
    assert {r.query_id for r in got} == {0, 500}
    assert topk_search.top_k(d.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_hot_join_loses_nothing(spark):
    d = spark.range(500).select("id", F.when(F.col("id") < 300, 1).otherwise(F.col("id")).alias("k"))
    small = d.groupBy("k").agg(F.count(F.lit(1)).alias("__n"), F.min("id").alias("low"))
    out = hot_join(d, small, "k", share=10)
    assert out.count() == 500 and out.where("k = 1 and low = 0").count() == 300
