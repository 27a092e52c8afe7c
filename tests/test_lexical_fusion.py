import math
import random
import re

import pytest
from pyspark.sql import functions as F

from vectaria.functions import text as T
from vectaria.operators import lexical
from vectaria.operators.fusion import by_rank, fuse_rrf, hybrid
from vectaria.types import EmptyQuery, HybridQuery, InvalidArgument


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, document string")


@pytest.mark.parametrize(
    "text, want",
    [
        ("Recupere l'Error-42", ["recupere", "l", "error", "42"]), ("  a , ; b  ", ["a", "b"]), ("Eté ÉCOLE", ["eté", "école"]), ("", []), ("---  ...", []),
        ("ΟΔΟΣ", ["οδοσ"]), ("İstanbul", ["i̇stanbul"]), ("x²½", ["x²½"]),
    ],
)
def test_tokens(spark, text, want):
    assert T.query_tokens(spark, text) == want


def brute(texts, query, k, admit=lambda i: True):
    toks = [None if t is None else re.findall(r"\w+", t.lower()) for t in texts]
    own = [t for t in toks if t is not None]
    n, avg = len(own), sum(map(len, own)) / len(own) if own else 0
    out = []
    for i, t in enumerate(toks):
        if t is None or not admit(i):
            continue
        s = 0.0
        for w in re.findall(r"\w+", query.lower()):
            f, df = t.count(w), sum(w in x for x in own)
            if f:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * (f * 2.2) / (f + 1.2 * (0.25 + 0.75 * len(t) / avg))
        if s > 0:
            out.append((i, s))
    return sorted(out, key=lambda x: (-x[1], x[0]))[:k]


def test_known_score(spark):
    r = lexical.search_text(docs(spark, ["the quick brown fox", "the lazy dog"]), "fox", 5).collect()
    assert [(x.id, round(x.score, 7)) for x in r] == [(0, 0.6548753)]


def test_random_corpora_and_postings(spark):
    r = random.Random(7)
    for _ in range(4):
        texts = [" ".join(r.choices(["fox", "dog", "quick", "lazy", "the", "river"], k=r.randint(1, 5))) for _ in range(r.randint(1, 11))] + ["---", None]
        query = " ".join(r.choices(["fox", "dog", "missing", "the", "fox"], k=3))
        d = docs(spark, texts)
        row = lexical.corpus_stats(d).first()
        stats = lexical.CorpusStats(row.n, row.total)
        p = lexical.term_frequencies(d)
        for where, admit in ((None, lambda i: True), (F.col("id") % 2 == 0, lambda i: i % 2 == 0)):
            want = brute(texts, query, 4, admit)
            admitted = None if where is None else d.where(where).select("id")
            for got in (lexical.search_text(d, query, 4, where), lexical.search_postings(p, stats, query, 4, admitted)):
                assert [(x.id, pytest.approx(x.score)) for x in got.collect()] == want


def test_empty_corpus_and_query(spark):
    assert lexical.search_text(docs(spark, [None]), "fox", 3).collect() == []
    assert lexical.search_text(docs(spark, ["fox"]), "...", 3).collect() == []


def test_rrf(spark):
    ch = lambda ids: spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "id string, rank int")
    got = fuse_rrf([ch("abc"), ch("ac")]).orderBy(F.desc("score"), "id").collect()
    assert [x.id for x in got] == ["a", "c", "b"] and got[0].score == pytest.approx(2 / 61)
    tie = fuse_rrf([ch("ab"), ch("ba")]).orderBy(F.desc("score"), "id").collect()
    assert [x.id for x in tie] == ["a", "b"] and tie[0].score == tie[1].score


def test_hybrid_channels(spark):
    hits = lambda rows: lambda depth: spark.createDataFrame(rows[:depth], "id string, score double")
    dense, text = hits([("a", 0.9), ("b", 0.8), ("d", -1.0)]), hits([("d", 3.0), ("a", 2.0)])
    both = hybrid(HybridQuery(3, [1.0], "x"), dense, text).collect()
    assert [x.id for x in both] == ["a", "d", "b"]
    assert [x.score for x in hybrid(HybridQuery(2, None, "x"), dense, text).collect()] == [3.0, 2.0]
    with pytest.raises(EmptyQuery):
        hybrid(HybridQuery(2), dense, text)
    assert [x["rank"] for x in by_rank(dense(3)).collect()] == [1, 2, 3]


def test_hybrid_query_checks():
    assert HybridQuery(1, [], "").checked() == HybridQuery(1)
    for bad in (HybridQuery(1, [1.0], rrf_k=0.0), HybridQuery(1, [1.0], rrf_k=math.inf), HybridQuery(1, [1.0], overfetch=0)):
        with pytest.raises(InvalidArgument):
            bad.checked()
