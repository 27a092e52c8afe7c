import math
import random
import re

import xxhash

from vectaria.llm import quality_rules as Q


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def base(t):
    w = split(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if split(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(again)


def bucket(parts, buckets):
    """Spark hashes a struct's fields in turn, each with the hash so far as seed; a null leaves it."""
    h = 42
    for x in parts:
        if x is not None:
            h = xxhash.xxh64_intdigest(x.encode(), h)
    return h % buckets


def grams(t, buckets):
    w = split(t)
    return [bucket([x], buckets) for x in w] + [bucket(p, buckets) for p in zip(w, [*w[1:], None])]


def corpus():
    r = random.Random(4)
    out = []
    for i in range(60):
        words = r.choices(["red", "blue", "|", "###", "éà", "one", "two"] if i % 3 else ["good", "fine", "text", "of", "words"] + [f"w{k}" for k in range(30)], k=r.randrange(120))
        out.append((i, "".join(w + r.choice([" ", " ", "\n", "\t\x0b ", " "]) for w in words)))
    return [*out, (60, "a b c a b c"), (61, "a a a a"), (62, "same line\nsame line\n \n \nsame line"), (63, None), (64, "")]


def test_base_statistics_and_ratio_equal_brute_force(spark):
    rows = corpus()
    d = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in range(0, 60, 3)], "doc_id long")
    buckets = 256
    got = {r.doc_id: r for r in Q.quality_rules(d, trusted, threshold=-0.05, buckets=buckets).collect()}
    raw, target = [0] * buckets, [0] * buckets
    for i, t in rows:
        for b in grams(t, buckets):
            raw[b] += 1
            target[b] += i < 60 and i % 3 == 0
    p = [(x + 1) / (sum(raw) + buckets) for x in raw]
    ratio = [math.log((t + buckets * q) / (sum(target) + buckets) / q) for t, q in zip(target, p)]
    for i, t in rows:
        r, g = got[i], grams(t, buckets)
        n, chars, symbols, dup, again = base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, again), t
        assert r.base_failed == (n < 50 or 100 * again > 50 * n)
        llr = sum(ratio[b] for b in g) / len(g) if g else 0.0
        assert abs(r.llr - llr) < 1e-9
        assert r.kept == (not r.base_failed and r.llr >= -0.05)
    assert any(r.kept for r in got.values()) and any(not r.base_failed and not r.kept for r in got.values())


def test_without_trusted_rows_nothing_is_rejected_for_its_words(spark):
    d = spark.createDataFrame([(1, " ".join(f"x{i}" for i in range(60)))], "doc_id long, text string")
    r = Q.quality_rules(d, d.select("doc_id").limit(0)).first()
    assert r.llr == 0 and r.kept


def test_filters_on_the_result_stay_above_it(spark):
    d = spark.createDataFrame(corpus(), "doc_id long, text string")
    j = Q.judge(d, [0.0] * 16, carry=True).where("kept").select("__row.*")
    assert j.columns == d.columns and j.count() == sum(base(t)[0] >= 50 and 100 * base(t)[4] <= 50 * base(t)[0] for _, t in corpus())
