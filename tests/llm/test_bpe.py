import hashlib
import random
from types import SimpleNamespace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vectaria.llm import bpe as B

LIB = Tokenizer.from_file(B.default_file())
BPE = B.Bpe(B.default_file())


def same(text):
    e = LIB.encode(text, add_special_tokens=False)
    decoded = LIB.decode(e.ids, skip_special_tokens=False)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert BPE.encode(text) == e.ids and BPE.decode(e.ids) == decoded, text
    assert BPE.digests(text) == (len(e.ids), sha(" ".join(map(str, e.ids))), sha(decoded))


@pytest.mark.parametrize(
    "text",
    ["", "<|endoftext|>x", "a<|startoftext|> World's", "<|endoftext|", "İstanbul ΟΔΟΣ ﬁ é １２", "\x1c\x1d a\xa0b\x85c", "日本語 😀👍🏽 x²½", "\x00 don't 'S a'sb 'll", "ſ ŉ ǅ ẞ", "rrrara ofhehehesh aaaaaaaaa", "é ño"],
)
def test_like_the_library(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text("abehinorst' .,0é\n<|>", max_size=60)))
def test_like_the_library_on_any_text(text):
    same(text.encode("utf-8", "replace").decode())


def test_small_tables_change_nothing(monkeypatch):
    r = random.Random(1)
    texts = [" ".join("".join(r.choices("abcdefghinorstu", k=r.randrange(1, 14))) for _ in range(40)) for _ in range(40)]
    monkeypatch.setattr(B, "TABLE_BYTES", 5000)
    monkeypatch.setattr(B, "WORD_BYTES", 20_000)
    for t in texts:
        same(t)
        assert BPE.auto.size < 40_000 and BPE.known_size <= 10_000


def test_every_word_comes_from_the_table():
    """Tokens of the vocabulary too: each symbol of a new word is one transition."""
    one = B.Bpe(B.default_file())
    words = ["the", "world", "zzqx", "don", "a", "internationalization"]
    asked = []
    spell = one.auto.spell
    one.auto.spell = lambda w: asked.append(w) or spell(w)
    for w in words * 2:
        assert one.encode(w) == LIB.encode(w, add_special_tokens=False).ids
    assert asked == words
    rows = len(one.auto.rows)
    one.known.clear()
    table = dict(one.auto.table)
    for w in words:
        assert one.encode(w) == LIB.encode(w, add_special_tokens=False).ids
    assert one.auto.table == table and len(one.auto.rows) == rows  # nothing is compiled twice


def test_automaton_of_few_merges_equals_merging():
    """All words over two letters against merging by rank."""
    r = random.Random(2)
    for _ in range(30):
        tokens, merges = ["a", "b"], []
        while len(merges) < 8:
            m = (r.choice(tokens), r.choice(tokens))
            if m[0] + m[1] not in tokens:
                merges.append(m), tokens.append(m[0] + m[1])
        auto = B.Automaton(["a", "b"], merges)
        for n in range(1, 9):
            for k in range(1 << n):
                word = "".join("ab"[k >> i & 1] for i in range(n))
                parts = list(word)
                while True:
                    ranks = [(merges.index((x, y)), i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if (x, y) in merges]
                    if not ranks:
                        break
                    _, i = min(ranks)
                    parts[i : i + 2] = [parts[i] + parts[i + 1]]
                assert [auto.labels[t] for t in auto.encode(word)] == parts, (merges, word)


def test_frames(spark):
    d = spark.createDataFrame([(1, "Hello World"), (2, None), (3, "")], "doc_id long, text string")
    ids = B.encode(d)
    assert {r.doc_id: r.ids for r in ids.collect()}[2] == [] and {r.doc_id: r.text for r in B.decode(ids).collect()}[1] == "hello</w> world</w>"
    got = {r.doc_id: r for r in B.encode_decode(d).collect()}
    assert got[2].n_tokens == 0 and got[2].ids_sha256 == got[3].decoded_sha256 == hashlib.sha256(b"").hexdigest()


def test_memory_of_ever_new_words():
    """Two million letters without repetition: the tables stay within their bytes."""
    r = random.Random(8)
    one = B.Bpe(B.default_file())
    for _ in range(40):
        one.digests(" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=10)) for _ in range(5000)))
        assert one.auto.size < 1.1 * B.TABLE_BYTES and one.known_size < B.WORD_BYTES
    t = "x" * 200_000
    assert one.encode(t) == LIB.encode(t, add_special_tokens=False).ids


def _invented(seed, n):
    r = random.Random(seed)
    return ["".join(r.choices(["en", "the", "ia", "queo", "sch", "r", "é", "ti", "on"], k=r.randrange(2, 6))) for _ in range(n)]


def test_rows_do_not_grow_with_the_words():
    """Ever new words enter no more rows than there are beginnings of tokens they are made of."""
    one = B.Bpe(B.default_file())
    one.encode(" ".join(_invented(1, 4000)))
    rows = len(one.auto.rows)
    one.encode(" ".join(_invented(2, 4000)))
    assert len(one.auto.rows) < 1.1 * rows and len(one.auto.rows) < 1000


@pytest.mark.parametrize("group, table, together", [(4 << 20, 96 << 20, 8192), (200, 5000, 3)])
def test_many_texts_at_once_like_the_library(monkeypatch, group, table, together):
    monkeypatch.setattr(B, "GROUP", group)
    monkeypatch.setattr(B, "TABLE_BYTES", table)
    monkeypatch.setattr(B, "TOGETHER", together)
    one = B.Bpe(B.default_file())
    odd = ["", None, "<|endoftext|>x<|startoftext|>", "日本語 😀 x²½ é", "\x00 don't 'S ſ ŉ", "x" * 64 + " " + "é" * 40 + " " + "ab" * 500, "the the <|endoftext|", " ", "a"]
    texts = odd + [" ".join(_invented(s, 30)) for s in range(20)] + odd
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = list(one.digests_of(texts))
    assert len(got) == len(texts) and list(one.digests_of([])) == []
    for text, found in zip(texts, got):
        e = LIB.encode(text or "", add_special_tokens=False)
        assert found == (len(e.ids), sha(" ".join(map(str, e.ids))), sha(LIB.decode(e.ids, skip_special_tokens=False))), text


def test_the_library_splits_only_words_with_other_characters():
    """One such character does not send the rest of its text through the library."""
    one = B.Bpe(B.default_file())
    asked = []
    normalize = LIB.normalizer.normalize_str
    one.library = SimpleNamespace(pre_tokenizer=LIB.pre_tokenizer, normalizer=SimpleNamespace(normalize_str=lambda s: asked.append(s) or normalize(s)))
    plain = " ".join(_invented(3, 500))
    for odd in ("“odd”", "ΟΔΟΣ", "é", "́", "日本語 x 本", " a　", "İ", "x" * 300_000 + "😀"):
        for text in (f"{plain} {odd} {plain}", f"{odd}\n{plain}", f"{plain}\t{odd}", f"{odd} {plain} {odd}", "y" * 300_000 + f" {odd}"):
            asked.clear()
            assert one.encode(text) == LIB.encode(text, add_special_tokens=False).ids, odd
            assert sum(map(len, asked)) < 3 * len(odd) + 60, odd
