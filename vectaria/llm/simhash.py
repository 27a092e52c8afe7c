"""SimHash near-duplicates with bit-sliced comparison.

A document's fingerprint has a bit set if it is set in over half of the 64-bit hashes of its
word shingles.  Documents link if their fingerprints differ in at most `RADIUS` bits, and
each takes the smallest doc_id of its connected component.

Documents with equal fingerprints collapse first (counted before anything is shuffled whole),
so copies never make pairs.  Two fingerprints at most two bits apart agree on at least four
of six blocks of bits; each distinct fingerprint is filed under its 15 choices of four
blocks.  A file agrees on 42 bits or more, so it holds at most 2^22 fingerprints of 8 bytes,
however many documents there are: a proven bound, without any cap.  Every comparison is
bit-sliced: the files of a batch, small ones too, stand one behind the other in 64 vertical bit
planes, in which carry-save counters update the distances of 64 pairs a block and many blocks at
once, and a block is abandoned once all its distances exceed the radius.  A file gives at most
one link for each of its members (a forest).

Null and empty texts have no shingle: fingerprint zero, linked like any other.  Null doc_id:
the row has a fingerprint and a component, but is never a component's name unless all ids there
are null.  Repeated rows stay repeated rows.  An empty table gives an empty result.  Columns but
doc_id and text are not read.  A text is hashed in pieces, so its length does not matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, map_rows, prepare, written
from .components import connected_components

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Blocks (64 pairs each) that one pass compares.
BLOCKS = 8192
#: Members that a group has at most before it is split by further bits.
WHOLE = 2000
#: Shingles hashed at a time.
PIECE = 1 << 16


def masks(radius: int) -> list[int]:
    """Each choice of four of radius + 4 even blocks of bits; two fingerprints within the radius
    agree on one."""
    n = radius + 4
    bounds = [64 * i // n for i in range(n + 1)]
    return [sum((1 << bounds[i + 1]) - (1 << bounds[i]) for i in c) for c in combinations(range(n), 4)]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint.  bytes.lower and bytes.split treat ASCII only: A-Z and the
    six white-space characters, none of which occurs inside a multi-byte character."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n, counts = max(1, len(w) - shingle + 1), np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        part = w[at : min(at + PIECE, n) + shingle - 1]
        grams = zip(*(part[k:] for k in range(shingle))) if len(w) >= shingle else [w]
        h = np.fromiter((digest(join(g), SEED) for g in grams), np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint as a signed long `fp`."""
    prepare(docs.sparkSession)

    def run(batches: Iterable[dict]) -> Iterator[dict]:
        for b in batches:
            h = np.array([fingerprint(t, shingle) for t in b["text"]], np.uint64).view(np.int64)
            yield {"doc_id": b["doc_id"], "fp": h.tolist()}

    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


class BitPlanes:
    """Fingerprints stored vertically: plane b holds bit b of all of them, 64 to a lane.

    Groups stand one behind the other, however small: `ends[i]` is one past the last member of
    i's group.  A block compares the 64 rows of a lane with the rows `offset` places on; all blocks
    of a pass move in step, plane by plane, and one is abandoned once its distances all exceed the
    radius.  Pairs that leave their group count as too far from the start."""

    def __init__(self, fps: np.ndarray, ends: np.ndarray) -> None:
        self.n, self.lanes = len(fps), -(-len(fps) // 64)
        bits = np.zeros((self.lanes * 64 + 64, 64), np.uint8)
        bits[: self.n] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")  # (64, lanes + 1)
        self.ends = np.zeros(self.lanes * 64, np.int64)
        self.ends[: self.n] = ends
        self.blocks = self.abandoned = 0

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (i, j), i < j, of one group whose distance is `radius` or less, pass by pass."""
        reach = (self.ends - 1 - np.arange(len(self.ends))).reshape(-1, 64).max(axis=1, initial=0)
        until = np.cumsum(reach)
        for lo in range(0, int(until[-1]) if len(until) else 0, BLOCKS):
            t = np.arange(lo, min(lo + BLOCKS, int(until[-1])))
            lane = np.searchsorted(until, t, side="right")
            yield self._compare(lane, t - until[lane] + reach[lane] + 1, radius)

    def _compare(self, lane: np.ndarray, offset: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        rows = lane[:, None] * 64 + np.arange(64)
        over = ~np.packbits(rows + offset[:, None] < self.ends[rows], axis=1, bitorder="little").view("<u8")[:, 0]
        word, bit = lane + offset // 64, (offset % 64).astype(np.uint64)
        counter = np.zeros((max(1, radius.bit_length()), len(lane)), np.uint64)
        one, last = np.uint64(1), np.uint64(63)
        self.blocks += len(lane)
        for b in range(64):
            p = self.planes[b]
            carry = p[lane] ^ (p[word] >> bit | p[word + 1] << one << last - bit)
            for c in counter:  # counter += carry, in all lanes at once
                full = c & carry
                c ^= carry
                carry = full
            over |= carry | self._exceeds(counter, radius)
            if b % 8 == 7:
                live = np.flatnonzero(~over)
                if len(live) < len(lane):
                    self.abandoned += (len(lane) - len(live)) * (b < 63)
                    lane, offset, over, word, bit, counter = lane[live], offset[live], over[live], word[live], bit[live], counter[:, live]
        block, at = np.nonzero(np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        i = lane[block] * 64 + at
        return i, i + offset[block]

    @staticmethod
    def _exceeds(counter: np.ndarray, radius: int) -> np.ndarray:
        more, equal = np.uint64(0), ~np.uint64(0)
        for k in reversed(range(len(counter))):
            if radius >> k & 1:
                equal = equal & counter[k]
            else:
                more = more | (equal & counter[k])
                equal = equal & ~counter[k]
        return more


def _groups(u: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """Places of `u` in groups that hold every pair within the radius together.  More than `WHOLE`
    members split by further bits: of radius + 1 parts of the bits in which they differ, such a
    pair agrees on one."""
    todo = [np.arange(len(u))]
    while todo:
        at = todo.pop()
        free = [b for b in range(64) if ((u[at] ^ u[at[0]]) >> np.uint64(b) & np.uint64(1)).any()] if len(at) > WHOLE else []
        if len(free) <= radius:
            yield at
            continue
        for part in np.array_split(np.array(free, np.uint64), radius + 1):
            key = u[at] & np.bitwise_or.reduce(np.uint64(1) << part)
            order = np.argsort(key, kind="stable")
            todo += [at[g] for g in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(g) > 1]


def forest(files: list[np.ndarray], radius: int = RADIUS, seen: list[int] | None = None) -> list[tuple[int, int]]:
    """Links among the distinct signed fingerprints of each file that join exactly the linked ones:
    (larger, smaller) of each tree edge.  All files are compared in common bit planes.  `seen`
    takes the numbers of blocks compared and abandoned."""
    u = [np.sort(f.astype(np.int64)).view(np.uint64) for f in files]
    starts = np.cumsum([0, *map(len, u)])
    groups = [g + s for f, s in zip(u, starts) if len(f) > 1 for g in _groups(f, radius)]
    if not groups:
        return []
    every, at = np.concatenate(u), np.concatenate(groups)
    planes = BitPlanes(every[at], np.repeat(np.cumsum([len(g) for g in groups]), [len(g) for g in groups]))
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while (up := parent.get(i, i)) != i:
            parent[i] = i = parent.get(up, up)
        return i

    for i, j in planes.pairs(radius):
        for a, b in zip(at[i].tolist(), at[j].tolist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if seen is not None:
        seen[0] += planes.blocks
        seen[1] += planes.abandoned
    s = every.view(np.int64)
    return [(int(s[i]), int(s[root(i)])) for i in sorted(parent) if root(i) != i]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) links between distinct fingerprints `fp` that join all pairs within the radius."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(radius)]
    keys = F.array(*[F.struct(F.lit(k).cast("int").alias("k"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("v")) for k, m in enumerate(signed)])
    files = distinct.select("fp", F.explode(keys).alias("key")).groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    def run(batches: Iterable[dict]) -> Iterator[dict]:
        for b in batches:
            found = forest([np.array(f, np.int64) for f in b["fps"]], radius)
            yield {"a": [x for x, _ in found], "b": [y for _, y in found]}

    return map_rows(files.select("fps"), run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("__n"))  # copies meet as one row
    distinct = written(distinct, "distinct")
    roots = connected_components(links(distinct.select("fp"), radius))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "root").select("fp", "component_id", "__n")
    out = hot_join(prints, written(named, "named"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
