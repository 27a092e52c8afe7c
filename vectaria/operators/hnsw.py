"""Approximate k nearest neighbours: one navigable small-world graph per shard.

Shards are built in parallel, one Python worker each, and stored as rows; a search walks every
shard's graph and a bounded top-k merges their hits.  Building is deterministic: levels come
from a seeded generator, ties go to smaller ids."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable, Sequence
from itertools import batched
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..types import DimensionMismatch, DuplicateId, HnswConfig, InvalidArgument, Metric, UnsupportedMetric, check_vector

TOP_LEVEL = 64
#: At one ef recall falls as a shard grows (README), and shards are what runs in parallel.
POINTS_PER_SHARD = 8_000
#: Points that bulk insertion links at a time, and numbers that one of its arrays holds at most.
BULK, BULK_NUMBERS = 256, 1 << 22
_M64 = (1 << 64) - 1


class SplitMix64:
    def __init__(self, seed: int) -> None:
        self.state = seed & _M64

    def next(self) -> int:
        self.state = (self.state + 0x9E3779B97F4A7C15) & _M64
        z = self.state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _M64
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _M64
        return z ^ (z >> 31)

    def level(self, scale: float) -> int:
        u = ((self.next() + 1) & _M64) / 2.0**64
        x = -math.log(u) * scale if u > 0 else math.inf
        return min(int(x), TOP_LEVEL) if math.isfinite(x) else TOP_LEVEL


class Graph:
    """Nodes are numbered as they come; a removed node stays to be walked through."""

    def __init__(self, metric: Metric, config: HnswConfig = HnswConfig()) -> None:
        self.metric, self.config, self.rng = metric, config, SplitMix64(config.seed)
        self.ids: list[Any] = []
        self.levels: list[int] = []
        self.dead: list[bool] = []
        self.links: list[list[list[int]]] = []
        self.vectors = np.zeros((0, 0), np.float32)
        self.norms = np.zeros(0, np.float32)
        self.node: dict[Any, int] = {}
        self.entry = -1

    def __len__(self) -> int:
        return len(self.node)

    def scores(self, query: np.ndarray, nodes: Sequence[int]) -> np.ndarray:
        v = self.vectors[np.asarray(nodes, np.int64)]
        if self.metric is Metric.EUCLIDEAN:
            d = v - query
            return -np.sqrt((d * d).sum(1, dtype=np.float32))
        s = v @ query
        if self.metric is Metric.DOT:
            return s
        both = self.norms[np.asarray(nodes, np.int64)] * np.float32(np.sqrt((query * query).sum(dtype=np.float32)))
        return np.divide(s, both, out=np.zeros_like(s), where=both > 0)

    def _key(self, score: float, node: int) -> tuple[float, Any]:
        """Orders best first: higher score, then smaller id."""
        return (-float(score), self.ids[node])

    def _descend(self, query: np.ndarray, node: int, score: float, top: int, bottom: int) -> tuple[int, float]:
        for layer in range(top, bottom - 1, -1):
            moved = True
            while moved:
                moved = False
                near = self.links[node][layer] if layer < len(self.links[node]) else []
                if near:
                    s = self.scores(query, near)
                    for n, x in zip(near, s):
                        if self._key(x, n) < self._key(score, node):
                            node, score, moved = n, float(x), True
        return node, score

    def _beam(self, query: np.ndarray, start: list[tuple[float, int]], ef: int, layer: int, admit: Callable[[Any], bool] | None = None) -> list[tuple[float, int]]:
        """Up to ef best live, admitted nodes as (score, node), best first.  Every node leads on."""
        seen = {n for _, n in start}
        ok = lambda n: not self.dead[n] and (admit is None or admit(self.ids[n]))
        frontier = [(*self._key(s, n), n) for s, n in start]
        heapq.heapify(frontier)
        found = [(*self._key(s, n), n) for s, n in start if ok(n)]
        found.sort()
        while frontier:
            best = heapq.heappop(frontier)
            if len(found) >= ef and best[0] > found[-1][0]:
                break
            links = self.links[best[2]]
            near = [n for n in (links[layer] if layer < len(links) else ()) if n not in seen]
            if not near:
                continue
            seen.update(near)
            for n, s in zip(near, self.scores(query, near)):
                item = (*self._key(s, n), n)
                if len(found) < ef or item[0] <= found[-1][0]:
                    heapq.heappush(frontier, item)
                    if ok(n):
                        self._insert_sorted(found, item, ef)
        return [(-s, n) for s, _, n in found]

    @staticmethod
    def _insert_sorted(found: list, item: tuple, ef: int) -> None:
        lo, hi = 0, len(found)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if found[mid] < item else (lo, mid)
        found.insert(lo, item)
        if len(found) > ef:
            found.pop()

    def _select(self, base: int, candidates: list[tuple[float, int]], most: int) -> list[int]:
        """Diverse neighbours: one closer to a chosen neighbour than to the base is left out."""
        chosen: list[int] = []
        for s, n in sorted(candidates, key=lambda c: self._key(c[0], c[1])):
            if len(chosen) >= most:
                break
            if n != base and not (chosen and (self.scores(self.vectors[n], chosen) > np.float32(s)).any()):
                chosen.append(n)
        return chosen

    def _add_node(self, key: Any, vector: np.ndarray, level: int) -> int:
        n = len(self.ids)
        if n >= len(self.vectors):
            grown = np.zeros((max(64, 2 * n), len(vector)), np.float32)
            norms = np.zeros(len(grown), np.float32)
            if n:
                grown[:n], norms[:n] = self.vectors[:n], self.norms[:n]
            self.vectors, self.norms = grown, norms
        self.vectors[n], self.norms[n] = vector, np.float32(np.sqrt((vector * vector).sum(dtype=np.float32)))
        self.ids.append(key), self.levels.append(level), self.dead.append(False)
        self.links.append([[] for _ in range(level + 1)])
        self.node[key] = n
        return n

    def insert(self, key: Any, vector: Sequence[float]) -> set[int]:
        """Add a point; returns the numbers of the nodes whose rows changed."""
        v = check_vector(vector)
        if key in self.node:
            raise DuplicateId(str(key))
        if len(self.ids) and len(v) != self.vectors.shape[1]:
            raise DimensionMismatch(f"{len(v)} components where {self.vectors.shape[1]} are expected")
        level = self.rng.level(self.config.level_scale)
        n = self._add_node(key, v, level)
        changed = {n}
        if self.entry < 0:
            self.entry = n
            return changed
        top = self.levels[self.entry]
        node, score = self._descend(v, self.entry, float(self.scores(v, [self.entry])[0]), top, level + 1)
        start = [(score, node)]
        for layer in range(min(top, level), -1, -1):
            found = self._beam(v, start, self.config.ef_construction, layer)
            most = self.config.most_at_0 if layer == 0 else self.config.m
            for other in self._select(n, found, self.config.m):
                self.links[n][layer].append(other)
                back = self.links[other][layer]
                back.append(n)
                changed.add(other)
                if len(back) > most:
                    s = self.scores(self.vectors[other], back)
                    self.links[other][layer] = self._select(other, list(zip(map(float, s), back)), most)
            start = found or start
        if level > top:
            self.entry = n
        return changed

    def bulk_insert(self, points: Iterable[tuple[Any, Sequence[float]]]) -> None:
        """The same rules as `insert`, in blocks of array operations: the candidates of a point are the best
        live nodes before it, found exactly by products of matrices and not by a walk, and a node whose
        links grew too many chooses once a block."""
        for block in batched(points, BULK):
            first = len(self.ids)
            try:
                for key, vector in block:
                    v = check_vector(vector)
                    if key in self.node:
                        raise DuplicateId(str(key))
                    if len(self.ids) and len(v) != self.vectors.shape[1]:
                        raise DimensionMismatch(f"{len(v)} components where {self.vectors.shape[1]} are expected")
                    self._add_node(key, v, self.rng.level(self.config.level_scale))
            finally:  # an error leaves the points before it inserted
                self._link(first)

    def _link(self, first: int) -> None:
        """Links for the nodes from `first` on, which have none."""
        levels, live = np.array(self.levels, np.int64), ~np.array(self.dead, bool)
        for layer in range(int(levels[first:].max(initial=-1)) + 1):
            nodes = np.flatnonzero(live & (levels >= layer))
            mine = first + np.flatnonzero(levels[first:] >= layer)
            most = self.config.most_at_0 if layer == 0 else self.config.m
            size = min(self.config.ef_construction, len(nodes))
            step = max(1, BULK_NUMBERS // max(len(nodes), size * max(size, self.vectors.shape[1])))
            vectors = self._centred(nodes)
            for at in range(0, len(mine), step):
                part = mine[at : at + step]
                rough = self._products(vectors[np.searchsorted(nodes, part)], vectors, self.norms[part], self.norms[nodes])
                rough[nodes >= part[:, None]] = -np.inf
                best = np.argpartition(rough, len(nodes) - size, axis=1)[:, len(nodes) - size :]
                for n, chosen in zip(part.tolist(), self._chosen(part, nodes[best], nodes[best] < part[:, None], self.config.m)):
                    self.links[n][layer] = chosen
            grown = set()
            for n in mine.tolist():
                for other in self.links[n][layer]:
                    self.links[other][layer].append(n)
                    grown.add(other)
            full = sorted((o for o in grown if len(self.links[o][layer]) > most), key=lambda o: (-len(self.links[o][layer]), o))
            while full:
                width = len(self.links[full[0]][layer])
                step = max(1, BULK_NUMBERS // (width * max(width, self.vectors.shape[1])))
                part, full = full[:step], full[step:]
                lists = [self.links[o][layer] for o in part]
                there = np.arange(width) < np.array([len(x) for x in lists])[:, None]
                padded = np.array([x + [0] * (width - len(x)) for x in lists], np.int64)
                for o, chosen in zip(part, self._chosen(np.array(part), padded, there, most)):
                    self.links[o][layer] = chosen
        for n in range(first, len(self.ids)):
            if self.entry < 0 or self.levels[n] > self.levels[self.entry]:
                self.entry = n

    def _centred(self, nodes: np.ndarray) -> np.ndarray:
        """Vectors whose distances by products lose no digits to a common offset."""
        v = self.vectors[nodes]
        return v - v.mean(0) if self.metric is Metric.EUCLIDEAN and len(v) else v

    def _products(self, a: np.ndarray, b: np.ndarray, norms_a: np.ndarray, norms_b: np.ndarray) -> np.ndarray:
        """Scores of each row of a (or of each matrix in a) with each row of b."""
        s = a @ np.swapaxes(b, -1, -2)
        if self.metric is Metric.EUCLIDEAN:
            squares = (a * a).sum(-1)[..., :, None] + (b * b).sum(-1)[..., None, :]
            return -np.sqrt(np.maximum(squares - 2 * s, 0))
        if self.metric is Metric.DOT:
            return s
        both = norms_a[..., :, None] * norms_b[..., None, :]
        return np.divide(s, both, out=np.zeros_like(s), where=both > 0)

    def _chosen(self, bases: np.ndarray, nodes: np.ndarray, there: np.ndarray, most: int) -> list[list[int]]:
        """`_select` for many bases, a row of candidates each; ties go to smaller numbers."""
        v, base = self.vectors[nodes], self.vectors[bases][:, None, :]
        if self.metric is Metric.EUCLIDEAN:
            v = v - base  # distances stay, and digits too
            s = -np.sqrt((v * v).sum(2))
        else:
            s = self._products(base, v, self.norms[bases][:, None], self.norms[nodes])[:, 0]
        order = np.lexsort((nodes, -s, ~there), axis=-1)
        rows = np.arange(len(bases))
        nodes, s, alive = (np.take_along_axis(x, order, 1) for x in (nodes, s, there))
        v, norms = v[rows[:, None], order], self.norms[nodes]
        between, taken, alive = self._products(v, v, norms, norms), np.zeros(nodes.shape, bool), alive & (nodes != bases[:, None])
        for _ in range(most):
            at = alive.argmax(1)
            some = alive[rows, at]
            if not some.any():
                break
            taken[rows[some], at[some]] = True
            alive &= ~(between[rows, at] > s)
            alive[rows, at] = False
        return [n[t].tolist() for n, t in zip(nodes, taken)]

    def connect(self) -> None:
        """Links that let every node of layer 0 be reached from every other, where choosing has cut the ways:
        from and to the best node that has them.  A node may get more links than the configuration says."""
        out = [links[0] for links in self.links]
        back: list[list[int]] = [[] for _ in out]
        for n, links in enumerate(out):
            for other in links:
                back[other].append(n)
        for near in (out, back) if self.entry >= 0 else ():
            seen = np.zeros(len(out), bool)
            for n in (self.entry, *range(len(out))):
                if seen[n]:
                    continue
                if n != self.entry:
                    known = np.flatnonzero(seen)
                    best = int(known[self.scores(self.vectors[n], known).argmax()])
                    a, b = (best, n) if near is out else (n, best)
                    out[a].append(b), back[b].append(a)
                seen[n], todo = True, [n]
                while todo:
                    for other in near[todo.pop()]:
                        if not seen[other]:
                            seen[other] = True
                            todo.append(other)

    def remove(self, key: Any) -> bool:
        n = self.node.pop(key, None)
        if n is None:
            return False
        self.dead[n] = True
        if n == self.entry:
            live = self.node.values()
            self.entry = max(live, key=lambda i: (self.levels[i], i)) if live else -1
        return True

    def search(self, query: Sequence[float], k: int, metric: Metric | None = None, admit: Callable[[Any], bool] | None = None, ef: int | None = None) -> list[tuple[Any, float]]:
        if metric is not None and metric is not self.metric:
            raise UnsupportedMetric(f"the graph is built for {self.metric.value}")
        q = check_vector(query, self.vectors.shape[1] if self.ids else None)
        if self.entry < 0 or k == 0:
            return []
        ef = max(ef or self.config.ef_search, k)
        node, score = self._descend(q, self.entry, float(self.scores(q, [self.entry])[0]), self.levels[self.entry], 1)
        return [(self.ids[n], s) for s, n in self._beam(q, [(score, node)], ef, 0, admit)[:k]]

    def compact(self) -> Graph:
        """Rebuilt from the live nodes in their order, with the generator set back."""
        g = Graph(self.metric, self.config)
        g.bulk_insert((self.ids[n], self.vectors[n]) for n in range(len(self.ids)) if not self.dead[n])
        return g

    def snapshot(self) -> dict[str, Any]:
        return {
            "ids": list(self.ids), "levels": list(self.levels), "dead": list(self.dead), "links": [[list(x) for x in n] for n in self.links],
            "vectors": self.vectors[: len(self.ids)].tolist(), "entry": self.entry, "rng": self.rng.state,
        }

    @classmethod
    def from_snapshot(cls, metric: Metric, config: HnswConfig, s: dict[str, Any]) -> Graph:
        g = cls(metric, config)
        if len({len(s[k]) for k in ("ids", "levels", "dead", "links", "vectors")}) > 1:
            raise InvalidArgument("the snapshot's lists differ in length")
        for key, v, level, dead, links in zip(s["ids"], s["vectors"], s["levels"], s["dead"], s["links"]):
            n = g._add_node(key, np.asarray(v, np.float32), level)
            g.dead[n], g.links[n] = dead, [list(x) for x in links]
            if dead:
                g.node.pop(key)
        g.entry, g.rng.state = s["entry"], s["rng"]
        return g


def build(points: DataFrame, metric: Metric, config: HnswConfig = HnswConfig(), shards: int | None = None, id_column: str = "id", vector: str = "vector", least: int = 1) -> DataFrame:
    """The graphs as rows: shard, node, id, level, dead, vector, links, entry, rng.  A shard's nodes
    are numbered in id order.  A shard is held whole by one worker; by default there are as many as
    give each some POINTS_PER_SHARD points, `least` or more."""
    shards = shards or max(least, -(-points.count() // POINTS_PER_SHARD))
    kind = dict(points.dtypes)[id_column]
    schema = f"shard int, node long, id {kind}, level int, dead boolean, vector array<float>, links array<array<long>>, entry long, rng string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = Graph(metric, config)
        pdf = pdf.sort_values("id")
        g.bulk_insert(zip(pdf["id"], pdf["vector"]))
        g.connect()
        s = g.snapshot()
        return pd.DataFrame({
            "shard": int(pdf["shard"].iloc[0]), "node": range(len(s["ids"])), "id": s["ids"], "level": s["levels"], "dead": s["dead"],
            "vector": s["vectors"], "links": s["links"], "entry": s["entry"], "rng": str(s["rng"]),
        })

    p = points.select(F.col(id_column).alias("id"), F.col(vector).alias("vector"), F.pmod(F.xxhash64(id_column), F.lit(shards)).cast("int").alias("shard"))
    return p.groupBy("shard").applyInPandas(run, schema)


def _load(pdf: pd.DataFrame, metric: Metric, config: HnswConfig) -> Graph:
    pdf = pdf.sort_values("node")
    return Graph.from_snapshot(metric, config, {
        "ids": pdf["id"].tolist(), "levels": pdf["level"].tolist(), "dead": pdf["dead"].tolist(), "links": [[list(map(int, x)) for x in n] for n in pdf["links"]],
        "vectors": pdf["vector"].tolist(), "entry": int(pdf["entry"].iloc[0]), "rng": int(pdf["rng"].iloc[0]),
    })


def search(
    graphs: DataFrame, queries: Sequence[tuple[Any, Sequence[float]]], k: int, metric: Metric, config: HnswConfig = HnswConfig(),
    ef: int | None = None, admitted: DataFrame | None = None,
) -> DataFrame:
    """(query_id, rank, id, score).  `admitted` has the ids a payload filter lets through: their flag
    joins the graph rows, so that the walk passes other nodes without returning them."""
    kind = dict(graphs.dtypes)["id"]
    qkind = "long" if queries and isinstance(queries[0][0], int) else "string"
    flagged = graphs.withColumn("ok", F.lit(True)) if admitted is None else graphs.join(admitted.select("id", F.lit(True).alias("ok")).distinct(), "id", "left")

    everything = admitted is None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = _load(pdf, metric, config)
        ok = None if everything else set(pdf.loc[pdf["ok"].notna(), "id"])
        rows = [(q, key, float(s)) for q, v in queries for key, s in g.search(v, k, None, None if ok is None else ok.__contains__, ef)]
        return pd.DataFrame(rows, columns=["query_id", "id", "score"])

    found = flagged.groupBy("shard").applyInPandas(run, f"query_id {qkind}, id {kind}, score float")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def recall_at_k(truth: Iterable[Sequence[Any]], found: Iterable[Sequence[Any]]) -> float:
    """Mean share of the true neighbours that were found; an empty truth counts as found."""
    shares = [len(set(t) & set(f)) / len(t) if t else 1.0 for t, f in zip(truth, found)]
    return sum(shares) / len(shares) if shares else 1.0


def nearest_rank(values: Sequence[float], q: float) -> float:
    """The smallest value with a share q of all at or below it."""
    if not values:
        raise InvalidArgument("no values")
    s = sorted(values)
    return s[min(len(s) - 1, max(0, math.ceil(q * len(s)) - 1))]

