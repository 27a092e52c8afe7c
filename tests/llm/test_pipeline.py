import hashlib
import random
import re

from tokenizers import Tokenizer

import corpus_pipeline
from vectaria.llm import bpe, language_id, mixing, quality_rules

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def grams(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def groups(rows):
    """The smallest id of each group, by comparing all pairs."""
    g = [grams(r.text) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if g[i] == g[j] or len(g[i] & g[j]) >= 0.8 * len(g[i] | g[j]) > 0:
                root = [root[j] if x == root[i] else x for x in root]
    return {min(rows[i].doc_id for i in range(len(rows)) if root[i] == x) for x in set(root)}


def test_every_stage_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, found[-1], SF).write.parquet(str(tmp_path / str(k)))
        found.append(spark.read.parquet(str(tmp_path / str(k))))
    rows = [f.collect() for f in found]
    ids = [sorted(r.doc_id for r in x) for x in rows]
    for f in found[1:-1]:
        assert f.columns == docs.columns
    trusted = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    ratios = quality_rules.fit(docs, trusted)
    judged = {r.doc_id: r for r in quality_rules.judge(docs, ratios).collect()}
    for r in rows[0]:
        w = re.findall(r"[^ \t-\r]+", r.text or "")
        marked, windows = set(), {}
        for i in range(len(w) - 2):
            windows.setdefault(tuple(w[i : i + 3]), []).append(i)
        for at in windows.values():
            marked |= {i + k for i in at for k in range(3)} if len(at) > 1 else set()
        failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
        assert judged[r.doc_id].base_failed == failed
        assert (r.doc_id in ids[1]) == (not failed and judged[r.doc_id].llr >= quality_rules.THRESHOLD)
    langs, matrix = language_id.as_matrix(language_id.train(found[1]))
    said = {r.doc_id: language_id.classify([r.text], langs, matrix) for r in rows[1]}
    assert ids[2] == sorted(i for i, (p, s) in said.items() if p[0] != "und" and s[0] >= corpus_pipeline.LEAST_COSINE)
    assert ids[3] == sorted(groups(rows[2])) and len(ids[3]) < len(ids[2])
    size, at_most = {}, {r.doc_id: r for r in rows[3]}
    for r in rows[3]:
        size[r.source] = size.get(r.source, 0) + len((r.text or "").split())
    target = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(size.items()), "source string, source_size long")).collect()}
    times = {}
    for i, r in at_most.items():
        rate = min(target[r.source] / size[r.source], mixing.CAP) if size[r.source] else 0
        draw = int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) / 16**13
        times[i] = int(rate) + (draw < rate - int(rate))
    assert ids[4] == sorted(i for i, n in times.items() for _ in range(n))
    library = Tokenizer.from_file(bpe.default_file())
    texts = {r.doc_id: r.text for r in rows[4]}
    assert ids[5] == ids[4]
    for r in rows[5]:
        e = library.encode(texts[r.doc_id], add_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(e.ids), hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest())


def test_columns_of_any_name_and_repeated_ids(spark):
    """Each stage with the names it uses inside as further columns, and one id on two unrelated texts."""
    r = random.Random(4)
    vocabulary = [f"{a}{b}" for a in "the of and that with".split() for b in "abcdefghij"]
    texts = [" ".join(r.sample(vocabulary, 50) + r.sample(vocabulary, 20)) for _ in range(4)]
    rows = [(1, texts[0], "en", "a", 1), (1, texts[1], "en", "a", 1), (None, texts[2], "en", "b", 1), (None, texts[3], None, None, 1), (3, None, "en", "a", 0), (4, "", "en", "a", 0)]
    names = ("id", "hash", "row", "size", "copies", "col", "kept", "llr", "n", "digest", "root", "text_hash", "__id", "__row", "__text", "__size", "__w", "__n", "__copies", "lang_pred", "target")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names)
    d = spark.createDataFrame([(*x, *(f"{c} {i}" for c in names)) for i, x in enumerate(rows)], schema)
    asked = {r.text: r for r in d.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d.repartition(3), SF)
        assert out.columns == d.columns, name
        got = out.collect()
        assert all(x == asked[x.text] for x in got), name
        if name == "SimHash near-dedup":
            assert {x.text for x in got if x.text} == set(texts) and len(got) == 5  # the two empty texts are one group
        if name == "language ID":
            assert {x.text for x in got} == set(texts)
        assert stage(spark, d.limit(0), SF).collect() == []
    assert STAGES["BPE"](spark, d, SF).count() == len(rows)
