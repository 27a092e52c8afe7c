import random

import numpy as np
import pytest
import xxhash

from vectaria.llm import simhash as S
from vectaria.llm.components import connected_components


def brute_fp(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    g = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint(monkeypatch):
    r = random.Random(1)
    texts = [None, "", " \n", "One", "One TWO", "É a b c É a b c\x1ca"] + [" ".join(r.choices("ab Cd éf gh".split(), k=r.randrange(1, 30))) for _ in range(50)]
    for piece in (S.PIECE, 3, 1):
        monkeypatch.setattr(S, "PIECE", piece)
        assert [S.fingerprint(t) for t in texts] == [brute_fp(t) for t in texts]


def near(r, n, spread):
    out = [r.getrandbits(64) for _ in range(n // 4 + 1)]
    while len(out) < n:
        x = r.choice(out)
        for _ in range(r.randint(1, spread)):
            x ^= 1 << r.randrange(64)
        out.append(x)
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_planes_equal_popcounts(radius, monkeypatch):
    r = random.Random(radius)
    groups = [near(r, n, 3) for n in (1, 2, 2, 63, 3, 64, 200, 2, 65, 1)]
    fps, ends = np.concatenate(groups), np.repeat(np.cumsum([len(g) for g in groups]), [len(g) for g in groups])
    far = np.bitwise_count(fps[:, None] ^ fps[None, :])
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, int(ends[i])) if far[i, j] <= radius}
    for blocks in (S.BLOCKS, 7):
        monkeypatch.setattr(S, "BLOCKS", blocks)
        planes = S.BitPlanes(fps, ends)
        got = [(int(a), int(b)) for i, j in planes.pairs(radius) for a, b in zip(i, j)]
        assert len(got) == len(set(got)) and set(got) == want
        assert 0 < planes.abandoned < planes.blocks
    assert list(S.BitPlanes(np.zeros(0, np.uint64), np.zeros(0, np.int64)).pairs(radius)) == []


@pytest.mark.parametrize("n", [3, 70, 700, 5000])
def test_forest_equals_brute_force(n):
    fps = near(random.Random(n), n, 3)
    n = len(fps)
    edges = [(i, j) for i in range(n) for j in i + 1 + np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 2)]
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    tree = [(at[a], at[b]) for a, b in S.forest([fps.view(np.int64)])]
    assert len(tree) < n and components(n, tree) == components(n, edges)
    one = S.forest([fps[:2].view(np.int64), fps.view(np.int64), fps[:1].view(np.int64), fps[2:].view(np.int64)])
    assert components(n, [(at[a], at[b]) for a, b in one]) == components(n, edges)


def test_real_texts_are_compared_in_bit_planes(spark):
    """Real texts and variants of them: all links come from blocks of the bit planes, some abandoned."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 1500").limit(150).collect()]
    texts += [" ".join([*t.split()[:-k], "other"]) for t in texts for k in (1, 2, 5)]
    fps = np.unique(np.array([S.fingerprint(t) for t in texts], np.uint64))
    files, seen = {}, [0, 0]
    for k, m in enumerate(S.masks(2)):
        for x in fps.tolist():
            files.setdefault((k, x & m), []).append(x)
    tree = S.forest([np.array(f, np.uint64).view(np.int64) for f in files.values()], seen=seen)
    assert 0 < seen[1] < seen[0] and len(tree) > 50
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    close = [(i, j) for i in range(len(fps)) for j in i + 1 + np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 2)]
    assert components(len(fps), [(at[a], at[b]) for a, b in tree]) == components(len(fps), close)


@pytest.mark.parametrize("radius", [0, 2, 3, 4])
def test_every_pair_within_the_radius_shares_a_file(radius):
    r = random.Random(2)
    masks = S.masks(radius)
    assert len(S.masks(2)) == 15 and all(m.bit_count() >= 42 for m in S.masks(2))
    for _ in range(300):
        d = sum(1 << b for b in r.sample(range(64), radius))
        assert any(not d & m for m in masks)


def test_connected_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(70)] + [(300, 300), (5, 4), (5, 4)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components(301, edges)
    assert got == {i: want[i] for i in {x for e in edges if e[0] != e[1] for x in e}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(r.choices(vocabulary, k=r.choice([2, 5, 80])))) for i in range(40)]
    for i in range(40, 140):
        w = r.choice(rows)[1].split()
        if r.random() < 0.6 and w:
            w[r.randrange(len(w))] = "X"
        rows.append((i, " ".join(w)))
    rows += [(140, None), (141, ""), (139 + 10, "\t")]
    fps = [brute_fp(t) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = components(len(rows), edges)
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {rows[i][0]: (f"{fps[i]:016x}", rows[want[i]][0]) for i in range(len(rows))}
    assert len(set(want)) < 100
