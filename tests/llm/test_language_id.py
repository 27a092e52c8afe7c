import os
import random
import subprocess
import sys
import zlib

import numpy as np
from pyspark.sql import functions as F

from vectaria.llm import language_id as L

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
WORDS = {"en": "the of and that with from this which there".split(), "fr": "le les des une que dans pour avec être".split(), "de": "der die das und nicht mit ein auch über".split()}


def text(lang, r, n):
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


def brute(t):
    """The vector of a text, one n-gram at a time."""
    cls, seq = L.letter_classes(), []
    for c in f" {t} ":
        k = int(cls[ord(c)])
        if k or not seq or seq[-1]:
            seq.append(k)
    v, out = L.letter_vectors(), np.zeros(L.DIM)
    for a, b, c in zip(seq, seq[1:], seq[2:]):
        out += v[0][a].astype(float) * v[1][b] * v[2][c]
    return out


def test_vectors_equal_brute_force_in_any_pieces(monkeypatch):
    r = random.Random(1)
    texts = [None, "", "a", "é", "...", "Ab  c", "日本"] + ["".join(r.choice("ab é.,  \n") for _ in range(r.randrange(40))) for _ in range(60)]
    want = np.array([brute(t or "") for t in texts])
    for piece, kept in ((L.PIECE, L.KEPT), (7, 20), (3, 0), (1, 5)):
        monkeypatch.setattr(L, "PIECE", piece)
        monkeypatch.setattr(L, "KEPT", kept)
        monkeypatch.setattr(L, "SLICE", max(1, piece))
        monkeypatch.setattr(L, "_cache", {})
        got, has = L.text_vectors(texts)
        assert np.array_equal(got, want)
        assert has.tolist() == [any(c.isalpha() for c in t or "") for t in texts]


def test_held_out_accuracy(spark):
    r = random.Random(2)
    rows = [(i, text(lang, r, r.randint(3, 30)), lang) for i, lang in enumerate(r.choices(list(WORDS), k=400))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = L.held_out(F.col("doc_id"))
    got = {x.doc_id: x for x in L.identify(d, L.train(d, ~held)).collect()}
    out = {x.doc_id for x in d.where(held).select("doc_id").collect()}
    assert 50 < len(out) < 150
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if i in out]) > 0.97
    assert all(0 <= x.score <= 1 for x in got.values())


def test_training_uses_whole_texts_and_only_training_rows(spark):
    rows = [(1, "the of and", "en"), (2, "der die das", "de"), (3, "x" * 10, None)]
    protos = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert list(protos) == ["de", "en"]
    v = brute("the of and")
    assert np.allclose(protos["en"], v / np.linalg.norm(v))


def test_keep_identified_keeps_columns(spark):
    d = spark.createDataFrame([(1, "the of and that", "en"), (2, "123 ...", "en"), (3, None, "fr")], "doc_id long, text string, lang string")
    kept = L.keep_identified(d, L.train(d), 0.2)
    assert kept.columns == d.columns and [x.doc_id for x in kept.collect()] == [1]


def test_memory_of_a_text_of_high_variety():
    """A million random letters of two alphabets, in a process of its own."""
    code = (
        "import random, resource\n"
        "from vectaria.llm import language_id as L\n"
        "r = random.Random(1)\n"
        "text = ''.join(r.choices('abcdefghijklmnopqrstuvwxyz\u0430\u0431\u0432\u0433\u0434\u0435\u0436\u0437\u0438\u0439\u043a\u043b\u043c\u043d ', k=1 << 20))\n"
        "v, has = L.text_vectors([text])\n"
        "assert has[0] and v.any()\n"
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)\n"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT)
    assert int(out.stdout) < 500


def test_predictions_equal_brute_force(spark):
    r = random.Random(5)
    rows = [(i, text(lang, r, r.randint(1, 20)), lang if i % 3 else None) for i, lang in enumerate(r.choices(list(WORDS), k=120))] + [(200, None, "en"), (201, "12", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    protos = {}
    for i, t, lang in rows:
        if lang and t and i not in held:
            protos[lang] = protos.get(lang, 0) + brute(t)
    protos = {k: v / np.linalg.norm(v) for k, v in sorted(protos.items())}
    got = L.identify(d, L.train(d, ~L.held_out(F.col("doc_id")))).withColumn("held", L.held_out(F.col("doc_id"))).collect()
    assert {x.doc_id for x in got if x.held} == held and len(got) == len(rows)
    for x in got:
        t = next(t for i, t, _ in rows if i == x.doc_id)
        v = brute(t or "")
        want = {k: float(v @ p / (np.linalg.norm(v) or 1)) for k, p in protos.items()}
        if t is None or not any(c.isalpha() for c in t):
            assert (x.lang_pred, x.score) == ("und", 0.0)
        else:
            best = max(want.values())
            assert want[x.lang_pred] > best - 1e-6 and abs(x.score - best) < 1e-5


def test_more_than_a_thousand_labels(spark):
    d = spark.range(1100).select(F.col("id").alias("doc_id"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("text"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("lang"))
    assert len(L.train(d)) == 1100
