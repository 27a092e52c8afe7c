import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectaria.llm import license_scan as L
from vectaria.llm import token_counts as C
from vectaria.llm import topk_search as K
from vectaria.llm import toxicity as X
from vectaria.llm import url_filter as U

# -- URL filters ---------------------------------------------------------------------------------


def as_regex(glob):
    out = re.sub(r"\*\*|\*|\?|[^*?]", lambda m: {"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}.get(m[0], re.escape(m[0])), glob)
    return re.compile(out)


GLOBS = ["*.ab/**", "a?b", "**", "", "*", "?*", "a**b", "a*b*", "*.x/y/**z", "**/q", "ab" * 40, "**" + "ba" * 35 + "*"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab./xyqzé", max_size=12), max_size=6))
def test_automaton_equals_regular_expressions(texts):
    texts = [*texts, "ab" * 40, "x" + "ba" * 35, "x/" + "ba" * 35]
    got = U.ShiftAnd(GLOBS).run(texts)
    assert got.tolist() == [[bool(as_regex(g).fullmatch(t)) for g in GLOBS] for t in texts]


def test_long_texts_cross_blocks():
    text = "a/" + "b" * 1500 + "q"
    assert U.ShiftAnd(["a/**q", "a/*", "a/**z"]).run([text, "a/q"]).tolist() == [[True, True, False]] * 2


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("https://Sub.Example.ORG/en/12?x#y", "sub.example.org", "/en/12", "example.org/en/1", "block"),
        ("https://example.org/es/", "example.org", "/es/", "example.org/es/", "block"),
        ("https://notexample.org/es/a", "notexample.org", "/es/a", "org/", "allow"),
        ("http://a.com/de/b/fr/", "a.com", "/de/b/fr/", "com/de/", "block"),
        ("http://a.com.evil.net/x.com/de/", "a.com.evil.net", "/x.com/de/", None, "allow"),
        ("http://foo.net?u=http://b.com/de/", "foo.net", "", None, "allow"),
        ("http://casino-win.example.net/x", "casino-win.example.net", "/x", None, "block"),
        ("http://casino-win.example.org/x", "casino-win.example.org", "/x", "org/", "allow"),
        ("http://example.org", "example.org", "", None, "allow"),
        ("://B.com/fr/É?", "b.com", "/fr/É", "com/fr/", "allow"),
    ],
)
def test_rules(url, host, path, rule, verdict):
    rules = list(U.HOST_RULES + U.GLOB_RULES)
    assert U.judge([url], rules, U.ShiftAnd([r.glob for r in rules]), "allow") == [(host, path, rule, verdict)]


# -- Edit-aware token counts ---------------------------------------------------------------------

COUNT = C.counter(C.default_file())
edit = st.tuples(st.integers(0, 200), st.integers(0, 40), st.text(" \n\tab'sé1.", max_size=12))


@settings(max_examples=300, deadline=None)
@given(st.text(" \n\xa0ab'st1.,é日\u3002\x1cɐ𝒜", max_size=150), st.lists(edit, max_size=6), st.sampled_from([1, 3, 10, 512]))
def test_counts_equal_encoding_anew(text, edits, leaf):
    old, C.LEAF = C.LEAF, leaf
    try:
        tree = C.TokenTree(text, COUNT)
        assert tree.total == COUNT(text) and tree.text == text
        for at, cut, put in edits:
            text = text[:at] + put + text[at + cut :]
            assert tree.edit(at, cut, put) == COUNT(text) and tree.text == text and tree.chars[1] == len(text)
    finally:
        C.LEAF = old


@pytest.mark.parametrize(
    "text",
    [
        "some words in a long text, and more. " * 2000, "line\n" * 4000 + "some words in a long text, and more. " * 1000, "日本語、テキスト。" * 5000,
        "a1" * 20_000, "x,y;" * 9000, "日本語、" * 9000 + "plain words follow " * 900,
    ],
)
def test_only_touched_leaves_are_encoded_again(text):
    """Texts without spaces too; a tree that was kept is not encoded anew."""
    tree = C.TokenTree(text, COUNT)
    tree = C.TokenTree.stored(tree.texts, tree.chars, tree.tokens, COUNT)
    assert tree.total == COUNT(text) and tree.encoded == 0
    for at in (0, 1000, len(text) // 3, len(text) // 2, len(text)):
        tree.encoded = 0
        text = text[:at] + "new words" + text[at + 3 :]
        assert tree.edit(at, 3, "new words") == COUNT(text)
        assert tree.encoded < 5 * C.LEAF
    tree.encoded = 0
    text = text[:5000] + "mid words " * 3000 + text[5000:]
    assert tree.edit(5000, 0, "mid words " * 3000) == COUNT(text) and tree.encoded < 30_000 + 5 * C.LEAF
    assert max(map(len, tree.texts)) < 3 * C.LEAF


def test_edits_of_frames_equal_encoding_anew(spark):
    """Two batches, the second from the trees that the first left."""
    r = random.Random(9)
    texts = ["".join(r.choices("ab c.é\n1", k=r.choice([0, 3, 700, 4000]))) for _ in range(40)] + [None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("tokens", F.lit("x"))
    now = {i: t or "" for i, t in enumerate(texts)}
    trees = C.plant(d)
    for batch in range(2):
        edits = {i: [(r.randrange(5000), r.randrange(300), "".join(r.choices("xy z", k=r.randrange(9)))) for _ in range(r.randrange(4))] for i in now}
        e = spark.createDataFrame([(i, x or None) for i, x in edits.items()], "doc_id long, edits array<struct<at:int,cut:int,put:string>>")
        trees = C.edit(trees.join(e, "doc_id"))
        for i, x in edits.items():
            for at, cut, put in x:
                now[i] = now[i][: min(at, len(now[i]))] + put + now[i][min(at, len(now[i])) + cut :]
        rows = trees.select("doc_id", "texts", C.root(trees).alias("n"), C.root(trees, "chars").alias("c"), "n_reencoded").collect()
        assert len(rows) == len(now)
        for x in rows:
            assert ("".join(x.texts), x.n, x.c) == (now[x.doc_id], COUNT(now[x.doc_id]), len(now[x.doc_id]))
            assert x.n_reencoded <= 3 * (4 * C.LEAF + 9)


# -- Exact top-k ---------------------------------------------------------------------------------


def test_top_k_equals_brute_force(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.where(r.random(7) < 0.6, 0, np.round(r.normal(size=7), 1))]) for i in range(450)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    q = {i: np.floor(np.array(v, np.float32).astype(float) * 1024).astype(np.int64) for i, v in rows}
    for block, at_once, size in ((K.BLOCK, K.QUERY_BLOCK, K.QUERY_BYTES), (50, 2, K.QUERY_BYTES), (50, 100, 48 * 7)):
        monkeypatch.setattr(K, "QUERY_BYTES", size)
        monkeypatch.setattr(K, "BLOCK", block)
        monkeypatch.setattr(K, "QUERY_BLOCK", at_once)
        got = K.top_k(d, F.col("vec_id") % 100 == 0, k=6).collect()
        for i in range(0, 450, 100):
            best = sorted(((-int(q[i] @ q[j]), j) for j in q if j != i))[:6]
            assert [(x["rank"], x.vec_id, x.score) for x in sorted(got, key=lambda x: x["rank"]) if x.query_id == i] == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
        assert len(got) == 30


# -- Toxicity ------------------------------------------------------------------------------------


def test_ordinal_gradient():
    r = np.random.default_rng(2)
    s, b, y = r.normal(size=30), np.array([-0.5, 0.3, 1.1]), r.integers(0, 4, 30)

    def loss(s, b):
        p = np.hstack([np.ones((len(s), 1)), 1 / (1 + np.exp(b - s[:, None])), np.zeros((len(s), 1))])
        at = np.arange(len(s))
        return -np.log(p[at, y] - p[at, y + 1]).sum()

    g_s, g_b = X.Ordinal._gradient(s, b, y)
    step = lambda x, i: np.where(np.arange(len(x)) == i, 1e-6, 0)
    assert np.allclose(g_s, [(loss(s + step(s, i), b) - loss(s - step(s, i), b)) / 2e-6 for i in range(30)], atol=1e-4)
    assert np.allclose(g_b, [(loss(s, b + step(b, i)) - loss(s, b - step(b, i))) / 2e-6 for i in range(3)], atol=1e-4)


def test_grades_on_held_out_texts(spark):
    r = random.Random(3)
    bad = {1: ["rude", "silly"], 2: ["nasty", "vile"], 3: ["horrid", "cruel"]}
    rows = []
    for i in range(900):
        g = r.choice([0, 0, 0, 1, 2, 3])
        w = [f"w{r.randrange(60)}" for _ in range(r.randint(5, 60))] + (r.sample(bad[g], 2) if g else [])
        r.shuffle(w)
        rows.append((i, " ".join(w), g))
    d = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = X.fit(d.where("doc_id < 600").select("doc_id", "text"), d.where("doc_id < 600").select("doc_id", "grade"))
    assert model.cuts == sorted(model.cuts) and len(model.cuts) == 3
    got = {x.doc_id: x for x in X.severity(d, model).where("doc_id >= 600").collect()}
    pairs = [(got[i], g) for i, _, g in rows if i >= 600]
    assert np.mean([p.toxic == (g > 0) for p, g in pairs]) > 0.97
    assert np.mean([abs(p.severity - g) for p, g in pairs]) < 0.5


def brute_severity(words, weights, cuts):
    s = sum(weights.get(w, 0.0) for w in words)
    return [1 / (1 + math.exp(c - s)) for c in cuts]


def test_severity_equals_brute_force(spark):
    """The whole query on a small table: sample, vocabulary and prediction one text at a time; the fit
    itself against the loss of moved weights (descent ends after a fixed number of rounds, within 1 % of the least)."""
    r = random.Random(7)
    rows = [(i, " ".join(r.choices([f"w{k}" for k in "abcdefgh"], k=r.randrange(12)) + ["vile"] * (i % 5 == 0) + ["Rude!"] * (i % 7 == 0)), int(i % 5 == 0) + int(i % 7 == 0)) for i in range(300)]
    rows += [(300, None, 2), (301, "", 1), (302, "vile", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = X.fit(d.select("doc_id", "text"), d.select("doc_id", "grade"))
    sample = [(X.features(t), g) for _, t, g in rows if g is not None]
    mean = np.mean([g for _, g in sample])
    spread = {w: sum(g - mean for f, g in sample if w in f) / math.sqrt(sum(w in f for f, _ in sample)) for w in {w for f, _ in sample for w in f}}
    assert set(model.weights) <= set(spread) and {"vile", "rude"} <= set(model.weights) and {max(spread, key=spread.get)} <= {"vile", "rude"}

    def loss(weights, cuts):
        total = 0.0
        for f, g in sample:
            p = [1.0, *brute_severity(f, weights, cuts), 0.0]
            total -= math.log(p[g] - p[g + 1])
        return total / len(sample) + 2e-4 * sum(map(abs, weights.values()))

    least = loss(model.weights, model.cuts)
    for w in model.weights:
        for step in (-0.05, 0.05):
            assert loss(model.weights | {w: model.weights[w] + step}, model.cuts) > 0.99 * least
    for j in range(2):
        for step in (-0.05, 0.05):
            assert loss(model.weights, [c + step * (i == j) for i, c in enumerate(model.cuts)]) > 0.99 * least
    got = {x.doc_id: x for x in X.severity(d, model).collect()}
    for i, t, _ in rows:
        p = brute_severity(X.features(t), model.weights, model.cuts)
        assert got[i].severity == pytest.approx(sum(p)) and got[i].grade == sum(x > 0.5 for x in p)
        assert got[i].toxic == (bool(t) and p[0] > X.FLAG)


def test_repeated_ids_lose_no_grade(spark):
    rows = [(i % 30, f"mild words {i}" if i % 30 else "foul words", 1 if i % 30 == 0 else 0) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = X.fit(d.select("doc_id", "text"), d.select("doc_id", "grade").distinct(), fit_rows=30)
    assert len(model.cuts) == 1


# -- Licence scans -------------------------------------------------------------------------------


def cosine(unit, template):
    idf, _, other = L.model()
    bag = lambda t: {x: (1 + math.log(L._terms(t).count(x))) * idf.get(x, other) for x in L._terms(t)}
    a, b = bag(unit), bag(template)
    return sum(x * b.get(t, 0) for t, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))


def test_licences_and_inheritance(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, "r/LICENSE", "x\n" + mit), (2, "r/a/b.txt", "no notice"), (3, "r/a/c/LICENSE.md", apache), (4, "r/a/c/d/e/f.py", "code"), (5, "r/a/g.py", "# " + mit.upper() + "\ncode"),
        (6, "q/h.py", "nothing"), (7, "top", "The licence of this is unclear and we talk about other things at length."), (8, None, None), (9, "/abs/x", ""), (10, "r/a/h.py", "license"),
        (11, "z/COPYING", "This work is licensed under the\nGNU General Public License, version 3."), (12, "z/y", None),
    ]
    got = {r.doc_id: (r.license, r.via, r.from_dir) for r in L.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {
        1: ("MIT", "own", None), 2: ("MIT", "inherited", "r"), 3: ("Apache-2.0", "own", None), 4: ("Apache-2.0", "inherited", "r/a/c"), 5: ("MIT", "own", None),
        6: (None, "none", None), 7: (None, "none", None), 8: (None, "none", None), 9: (None, "none", None), 10: ("MIT", "inherited", "r"),
        11: ("GPL-3.0", "own", None), 12: ("GPL-3.0", "inherited", "z"),
    }


def test_no_unit_without_a_mark_reaches_the_threshold():
    r = random.Random(6)
    for threshold in (0.3, L.THRESHOLD):
        marks = set(L.marks(threshold=threshold))
        for _, template in L.TEMPLATES:
            rest = [t for t in L._terms(template) if t not in marks]
            for n in (1, 3, len(rest)):
                unit = " ".join(r.sample(rest, min(n, len(rest))))
                assert not unit or max(cosine(unit, t) for _, t in L.TEMPLATES) < threshold


def test_whole_licences_and_shared_root(spark):
    """Licence files wrapped at 70 columns, one at the root, which is an ancestor of every directory."""
    import textwrap

    whole = {n: t for n, t in L.TEMPLATES if len(t) > 700}
    rows = [(i, f"LICENSE-{i}" if i == 0 else f"d{i}/LICENSE", "Some name\n\n" + textwrap.fill(t, 70)) for i, t in enumerate(whole.values())]
    rows += [(100 + i, f"e{i}/x/y.py", "code") for i in range(300)] + [(500, None, "code"), (None, "e1/LICENSE", rows[0][2]), (None, "e1/z.py", "code")]
    got = {(r.doc_id, r.via): r for r in L.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    for i, n in enumerate(whole):
        assert got[i, "own"].license == n and got[i, "own"].score > 0.9, n
    for i in range(300):
        assert (got[100 + i, "inherited"].license, got[100 + i, "inherited"].from_dir) == (list(whole)[0], "")
    assert got[500, "none"].license is None and got[None, "inherited"].from_dir == ""


def test_scores_equal_brute_force(spark):
    r = random.Random(5)
    words = "licensed under the MIT Apache License license version 2.0 GNU General Public of work free other words".split()
    units = ["license " + " ".join(r.choices(words, k=r.randrange(1, 12))) for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(units)), "doc_id long, text string")
    got = {x.doc_id: x.score for x in L.own_licences(d, threshold=0.3).collect()}
    want = {i: max(cosine(u, t) for _, t in L.TEMPLATES) for i, u in enumerate(units)}
    assert got == {i: pytest.approx(s, abs=2e-6) for i, s in want.items() if s >= 0.3}
