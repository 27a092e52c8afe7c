"""Near copies by word shingles: the wide form of `simhash`, for near-duplicates that lie further
apart than a few bits.  Texts whose sets of `shingle`-word shingles have a Jaccard similarity of
`similarity` or more are linked, and no others; the result is their connected components.

First the fingerprints of the sets are compared bit-sliced as in `simhash`, and each text with the one
it shares most files with (below): at most a few pairs a text, checked exactly by the whole
sets of 64-bit hashes.  That joins most groups of many copies, and pairs within a component need
no further look.  Then a complete search adds every link between different components.  Under any order of all
shingles, two such sets share one of the first n - ceil(similarity * n) + 1 shingles of each (n: its
size), so a text is filed under those.  The order is by hash, but shingles that a sample of the texts
has often come last, which keeps files small; the sample moves work only, never a result.  Inside a
file, pairs that sizes or positions rule out are dropped; then those that share too few of the first
shingles, as what follows these can't make up for it; the others are checked exactly.

Texts with equal sets collapse to one before they are compared.  Words are as in `simhash`; a text of
fewer words than a shingle has one shingle, null and empty texts share the empty set.  A text's set
is held whole in one task, 8 bytes a word; of a file a task holds the texts of like size.  There is no
cap on texts, files or pairs.  Null ids are carried through; repeated rows get the same root; an empty table
gives an empty result; columns but doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, prepare, written
from .components import connected_components
from .simhash import links as fingerprint_links

SHINGLE = 5
SIMILARITY = 0.8
#: One text in so many is counted to find common shingles; at most so many are sent last.
SAMPLE, COMMON = 8, 1_000_000
#: Occurrences in the sample from which a shingle can be common.
LEAST = 8
#: Bits by which fingerprints of the first comparison differ at most.
RADIUS = 2
#: Shingles whose bits are counted at a time.
PIECE = 1 << 16


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    n = max(1, len(w) - shingle + 1)
    acc = np.full(n, min(len(w), shingle), np.uint64)
    for k in range(min(len(w), shingle)):
        acc = (acc ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
        acc *= np.uint64(0xBF58476D1CE4E5B9)
        acc ^= acc >> np.uint64(32)
    return np.unique(acc)


def digest(s: np.ndarray) -> int:
    """Of a whole set, as a signed long."""
    x = xxhash.xxh64_intdigest(s.astype("<u8").tobytes(), 1)
    return x - (1 << 64) if x >> 63 else x


def fingerprint(s: np.ndarray) -> int:
    """SimHash of a set of hashes, as a signed long: a bit is set if over half of them have it."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(s), PIECE):
        counts += np.unpackbits(s[at : at + PIECE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(s), bitorder="little").view("<i8")[0])


def least_overlap(a: np.ndarray | int, b: np.ndarray | int, similarity: float) -> np.ndarray:
    """Shingles that sets of a and b must share at least; the margin is for rounding."""
    return np.ceil(similarity / (1 + similarity) * (a + b) - 1e-6)


def filed_under(n: np.ndarray | int, similarity: float) -> np.ndarray:
    """Shingles under which a set of n is filed."""
    return np.minimum(n, n - np.ceil(similarity * n - 1e-6) + 1)


def prefix(s: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles under which a set is filed, in order."""
    length = int(filed_under(len(s), similarity))
    if len(common):
        late = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
        s = np.concatenate([s[~late], s[late]])
    return s[:length]


def sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_hash, and digest and fingerprint of its set for every row."""

    def run(batches: Iterable[dict]) -> Iterator[dict]:
        for b in batches:
            s = [shingles(t, shingle) for t in b["text"]]
            yield {"doc_id": b["doc_id"], "text_hash": b["text_hash"], "digest": [digest(x) for x in s], "fp": [fingerprint(x) for x in s]}

    return map_rows(docs, run, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, digest long, fp long")


def common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """Sorted hashes of the shingles that the sampled texts have most often."""

    def run(batches: Iterable[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"key": np.concatenate([shingles(t, shingle) for t in b["text"]] or [np.zeros(0, np.uint64)]).view(np.int64)}

    one = docs.where(F.pmod("text_hash", F.lit(SAMPLE)) == 0).dropDuplicates(["text_hash"]).select("text")
    n = written(map_rows(one, run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST), "common")
    total = n.agg(F.sum("n")).first()[0] or 0
    rows = n.where(F.col("n") > total // COMMON).select("key").toArrow()["key"].to_numpy()
    return np.sort(rows.astype(np.int64).view(np.uint64))


FILED = "key long, digest long, size int, place int"


def files(docs: DataFrame, shingle: int, similarity: float, common: np.ndarray) -> DataFrame:
    """The rows (key, digest, size, place) of all files with two sets or more, and digest and size of each
    file's largest set as `pivot` and `most`."""

    def file(batches: Iterable[dict]) -> Iterator[dict]:
        seen: set[int] = set()  # a text that a task has often is filed once; emptied when large, as that costs rows only
        for b in batches:
            keys, own, size, place = [np.zeros(0, np.uint64)], [], [], []
            for t in b["text"]:
                s = shingles(t, shingle)
                if len(s) and (d := digest(s)) not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(d)
                    keys.append(prefix(s, common, similarity))
                    n = len(keys[-1])
                    own.append(np.full(n, d, np.int64))
                    size.append(np.full(n, len(s), np.int32))
                    place.append(np.arange(n, dtype=np.int32))
            none = [np.zeros(0, np.int64)]
            yield {"key": np.concatenate(keys).view(np.int64)} | {k: np.concatenate(v or none) for k, v in (("digest", own), ("size", size), ("place", place))}

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.zeros((0, 4), np.int64)  # the open file's largest set
        last, waits = None, False  # the row before; whether `first` has not been handed on yet
        for b in batches:
            r = np.array([c.to_numpy() for c in b.columns], np.int64).T
            if not len(r):
                continue
            before = r[:-1] if last is None else np.concatenate([last, r[:-1]])
            same = (r[len(r) - len(before) :, :2] == before[:, :2]).all(1)
            last = r[-1:]
            r = r[~np.r_[np.zeros(len(r) - len(before), bool), same]]  # copies from other tasks
            rows = np.concatenate([first, r])
            if not len(rows):
                continue
            start = np.r_[True, rows[1:, 0] != rows[:-1, 0]]
            at = np.cumsum(start) - 1
            begins = np.flatnonzero(start)
            n = np.bincount(at)
            give = n[at] > 1
            if len(first):
                give[0] &= waits
            out = np.column_stack([rows, rows[begins[at], 1:3]])[give]
            waits = bool(n[-1] == 1 and (waits or len(n) > 1 or not len(first)))
            first = rows[begins[-1] :][:1]
            if len(out):
                kinds = (np.int64, np.int64, np.int32, np.int32, np.int64, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(out[:, k].astype(t)) for k, t in enumerate(kinds)], ["key", "digest", "size", "place", "pivot", "most"])

    filed = map_rows(docs.select("text"), file, FILED)
    return filed.repartition("key").sortWithinPartitions("key", F.desc("size"), "digest").mapInArrow(shared, FILED + ", pivot long, most int")


def first_pairs(prints: DataFrame, filed: DataFrame, similarity: float) -> DataFrame:
    """(a, b) digests: sets whose fingerprints are close or equal, and each set with the pivot that it meets most
    often, if that is of like size and met in half as many files as a near copy shares.  A forest of
    the fingerprints and at most one pair a set."""
    one = written(prints.groupBy("fp").agg(F.min("digest").alias("low")), "prints")
    equal = prints.select("fp", "digest").distinct().join(one, "fp").where("digest <> low").select(F.col("digest").alias("a"), F.col("low").alias("b"))
    close = fingerprint_links(one.select("fp"), RADIUS)
    close = close.join(one.select(F.col("fp").alias("a"), F.col("low").alias("x")), "a").join(one.select(F.col("fp").alias("b"), F.col("low").alias("y")), "b").select("x", "y")
    met = filed.where((F.col("digest") != F.col("pivot")) & (F.col("size") >= F.col("most") * F.lit(similarity))).groupBy("digest", "pivot", "size", "most").agg(F.count(F.lit(1)).alias("n"))
    # As `least_overlap` and `filed_under`: what may lie behind the first shingles of both.
    behind = lambda n: F.ceil(F.col(n) * F.lit(similarity) - F.lit(1e-6)) - 1
    need = F.ceil((F.col("size") + F.col("most")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6)) - F.greatest(behind("size"), behind("most"))
    most = met.where(F.col("n") * 2 >= need).groupBy("digest").agg(F.max(F.struct("n", "pivot")).alias("m")).select("digest", "m.pivot")
    pairs = equal.union(close).union(most).toDF("a", "b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def other_pairs(filed: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(a, b) digests, a < b, of all pairs of sets of different components that may be similar enough.

    Whatever two sets share lies among the first shingles of both, or behind those of one: so they share
    at least `need` of the first ones, the least overlap less the longer remainder."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 5), np.int64)
        for b in batches:
            rows = np.concatenate([held, np.array([c.to_numpy() for c in b.columns], np.int64).T])
            yield from of(rows, len(held))
            if len(rows):  # of the open file, the sets that are not too large for those to come
                key, _, size = rows[-1, :3]
                held = rows[(rows[:, 0] == key) & (rows[:, 2] * similarity <= size + 1e-6)]

    def of(rows: np.ndarray, fresh: int) -> Iterator[pa.RecordBatch]:
        key, own, size, place, comp = rows.T
        behind = size - filed_under(size, similarity)
        i, k = np.arange(fresh, len(rows)), 1
        while True:  # each row with the one k places before it; sizes fall within a file
            i = i[i >= k]
            j = i - k
            i = i[(key[j] == key[i]) & (size[j] * similarity <= size[i] + 1e-6)]
            if not len(i):
                return
            j = i - k
            least = least_overlap(size[i], size[j], similarity)
            at_most = np.minimum(size[i] - place[i], size[j] - place[j]) + np.minimum(place[i], place[j])
            ok = (comp[i] != comp[j]) & (np.minimum(at_most, size[i]) >= least)
            if ok.any():
                a, b, need = own[i][ok], own[j][ok], (least - np.maximum(behind[i], behind[j]))[ok].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(need)], ["a", "b", "need"])
            k += 1

    known = filed.join(roots.select(F.col("node").alias("digest"), "root"), "digest", "left").select("key", "digest", "size", "place", F.coalesce("root", "digest").alias("comp"))
    known = known.repartition("key").sortWithinPartitions("key", F.desc("size"), "digest")
    shared = known.mapInArrow(pairs, "a long, b long, need long").groupBy("a", "b", "need").agg(F.count(F.lit(1)).alias("n"))
    return shared.where("n >= need").select("a", "b")


def links(docs: DataFrame, found: DataFrame, prints: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The candidates that are similar enough, by their whole sets."""

    def run(batches: Iterable[dict]) -> Iterator[dict]:
        for b in batches:
            s = [shingles(t, shingle) for t in b["text"]]
            yield {"digest": [digest(x) for x in s], "set": [x.view(np.int64) for x in s]}

    wanted = found.select(F.col("a").alias("digest")).union(found.select(F.col("b").alias("digest"))).distinct()
    one = prints.join(wanted, "digest").groupBy("digest").agg(F.min("text_hash").alias("text_hash")).select("text_hash")
    texts = docs.join(one, "text_hash", "left_semi").dropDuplicates(["text_hash"]).select("text")
    whole = written(map_rows(texts, run, "digest long, set array<long>").dropDuplicates(["digest"]), "sets")
    both = found.join(whole.select(F.col("digest").alias("a"), F.col("set").alias("s")), "a").join(whole.select(F.col("digest").alias("b"), F.col("set").alias("t")), "b")
    shared = F.size(F.array_intersect("s", "t"))
    return both.where(shared >= F.lit(similarity) * (F.size("s") + F.size("t") - shared) - F.lit(1e-6)).select("a", "b")


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, text_hash (XXH64 of its text), root (the digest that names its
    connected component)."""
    prepare(docs.sparkSession)
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    prints = written(sets(d, shingle), "sets-of-rows")
    filed = written(files(d, shingle, similarity, common_shingles(d, shingle)), "files")
    first = written(first_pairs(prints.select("digest", "fp"), filed, similarity), "candidates")
    linked = written(links(d, first, prints, shingle, similarity), "links")
    rest = written(other_pairs(filed, connected_components(linked), similarity), "candidates")
    roots = connected_components(linked.union(links(d, rest, prints, shingle, similarity))).withColumnRenamed("node", "digest")
    return prints.join(roots, "digest", "left").select("doc_id", "text_hash", F.coalesce("root", "digest").alias("root"))
