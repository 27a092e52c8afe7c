import random

import numpy as np
import pytest

import corpus_pipeline
from vectaria.llm import near_copies as N

SF = "/root/testdata/sf0.001"


def grams(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def rows_with_copies(seed):
    r = random.Random(seed)
    vocabulary, rows = [f"w{k}" for k in range(300)], []
    boiler = r.choices(vocabulary, k=40)
    for i in range(60):
        rows.append((i, " ".join(r.choices(vocabulary, k=r.choice([3, 30, 90, 200])) + boiler * (i % 2))))
    for i in range(60, 160):
        w = r.choice(rows)[1].split()
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    return rows + [(160, None), (161, ""), (162, "\t"), (163, "One"), (164, "ONE")]


@pytest.mark.parametrize("least", [8, 1])
def test_groups_equal_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(N, "LEAST", least)  # of 1: nearly every sampled shingle is common
    rows = rows_with_copies(least)
    g = [grams(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if g[i] == g[j] or len(g[i] & g[j]) >= 0.8 * len(g[i] | g[j]) > 0:
                root = [root[j] if x == root[i] else x for x in root]
    got = {r.doc_id: r.root for r in N.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    groups = lambda names: {frozenset(i for i in range(len(rows)) if names[i] == x) for x in set(names)}
    assert groups([got[i] for i, _ in rows]) == groups(root) and len(set(root)) < 120


def test_near_copies_share_a_place_in_the_prefix():
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 300):
        for _ in range(40):
            a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
            cut = int(0.2 * len(a))
            b = np.sort(r.permutation(a)[cut:])
            common = np.sort(r.permutation(a)[: len(a) // 2])
            assert set(N.prefix(a, common, 0.8).tolist()) & set(N.prefix(b, common, 0.8).tolist())


def test_stage_links_near_copies_that_simhash_puts_far_apart(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id in (1, 177, 6, 145, 2)")  # 7 and 11 bits apart
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, d, SF).collect()) == [1, 2, 6]


def test_stage_keeps_unrelated_texts_of_one_id(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(5, one, "en", "a", 1), (5, two, "en", "z", 2), (5, two, "en", "b", 2), (5, one, "en", "a", 1), (7, one, "en", "a", 1), (8, two, "en", "a", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 5):
        out = corpus_pipeline.near_duplicates(spark, d.repartition(parts), SF)
        assert sorted((r.doc_id, r.text, r.source) for r in out.collect()) == [(5, one, "a"), (5, two, "b")]
