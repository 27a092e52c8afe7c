from collections import Counter

import pytest
from pyspark.sql import functions as F

from vectaria.functions.text import tokens
from vectaria.operators import lexical

DOCS = "id long, document string"


def by_sql(d):
    """All rows together, whatever their ids."""
    d.createOrReplaceTempView("term_docs")
    cut = r"filter(transform(split(document, '[^\\p{IsAlphabetic}\\p{N}]+'), x -> lower(translate(x, 'Σ', 'σ'))), x -> length(x) > 0)"
    listed = f"select id, size(t) as len, explode(t) as term from (select id, {cut} as t from term_docs where document is not null)"
    return Counter(map(tuple, d.sparkSession.sql(f"select term, id, count(*) as tf, len from ({listed}) group by term, id, len").collect()))


def test_a_text_is_counted_where_it_lies_and_tokenised_once(spark):
    d = spark.createDataFrame([(i, "a b a") for i in range(9)], DOCS)
    plan = lexical.term_frequencies(d)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("\\p{N}]+") <= 2  # of which one is for texts with a dotted I


@pytest.mark.parametrize("most", [0, 2, 100])
@pytest.mark.parametrize("size", [3, 1 << 20])
def test_repeated_ids_and_odd_texts(spark, monkeypatch, most, size):
    monkeypatch.setattr(lexical, "REPEATED_IDS", most)
    monkeypatch.setattr(lexical, "TOKENS_AT_ONCE", size)
    monkeypatch.setattr(lexical, "ROWS_AT_ONCE", 2)
    rows = [(1, "b a b"), (2, None), (2, "x"), (3, ""), (4, " ,; "), (5, "ΟΔΟΣ İx İ İstanbul Ⅳ"), (6, "One one ONE 1 two"), (7, "a b c d e f g")]
    again = [(1, "a c b"), (1, "a"), (None, "a"), (None, "b"), (None, "a"), (3, "z")]
    for docs in (rows, rows + again):
        d = spark.createDataFrame(docs, DOCS).repartition(2)
        assert Counter(map(tuple, lexical.term_frequencies(d).collect())) == by_sql(d)


def test_whole_text_lower_casing_gives_the_tokens_of_each_character(spark):
    d = spark.range(1, 0x110000).where("id < 55296 or id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    d = d.select(F.concat(F.lit("A"), "c", F.lit("B "), "c", F.lit(" C"), "c").alias("text"))
    own = F.filter(F.transform(F.split("text", r"[^\p{IsAlphabetic}\p{N}]+"), lambda x: F.lower(F.translate(x, "Σ", "σ"))), lambda x: F.length(x) > 0)
    assert d.where(~own.eqNullSafe(tokens(F.col("text")))).limit(5).collect() == []
    assert spark.createDataFrame([("İ",)], "t string").select(tokens(F.col("t"))).first()[0] == ["i̇"]
