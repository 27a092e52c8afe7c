"""Exact top-k by exhaustive term-at-a-time accumulation.

Vectors are quantised to integers, floor(scale * x).  Candidates are read in blocks that keep,
for every dimension, a posting list of (row, weight).  A query row visits its non-zero
dimensions one at a time and scatters weight x weight into a dense score array of the block;
partition selection keeps the block's best, which are merged into the task's, and a window over
(query, partial results) merges the tasks'.

Queries are stated rows against all rows, in blocks: at most `QUERY_BLOCK` queries and `QUERY_BYTES`
are sent to the executors at a time (a proven bound), and each further block is another pass over the
candidates whose result is written to the shared folder.  A task's memory is one block of
candidates and k results a query.

A vector that is null or holds null or non-finite components takes no part.  Vectors of another
length than a query's count as padded with zeros.  Ties go to the smaller vec_id.  Rows that
repeat a query's vec_id are the query itself; a repeated query row gives its result once
(smallest vector).  Null vec_id: neither query nor candidate.  An empty table gives no rows.
Scores beyond a long are cut to its range.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, prepare, written

SCALE = 1024
K = 10
#: Queries of a pass at most, and the bytes they may take on the driver at DRIVER_BYTES a component.
QUERY_BLOCK, QUERY_BYTES, DRIVER_BYTES = 32_768, 128 << 20, 48
#: Candidates whose postings a task holds at a time.
BLOCK = 8192
LONG = (1 << 63) - 1
SCHEMA = "query_id long, vec_id long, score long"


def valid(v: Column) -> Column:
    return v.isNotNull() & F.coalesce(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), F.lit(False))


def quantise(vectors: list[list[float]], scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as int64, or as Python integers where a product sum might not fit."""
    width = max(map(len, vectors), default=0)
    x = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    x = np.floor(x * scale)
    if not x.size or (np.abs(x).max() < 2.0**26 and width <= 1024):  # 2^10 products under 2^52 fit a long
        return x.astype(np.int64)
    return np.array([[int(c) for c in r] for r in x], object).reshape(x.shape)


class Postings:
    """One block of candidates, by dimension."""

    def __init__(self, ids: np.ndarray, q: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, q = ids[order], q[order]
        self.n, self.lists = len(ids), []
        for d in range(q.shape[1]):
            col = np.ascontiguousarray(q[:, d])
            rows = np.flatnonzero(col)
            self.lists.append((None, col) if len(rows) * 2 > self.n else (rows, col[rows]))
        self.wide = q.dtype == object

    def scores(self, query: np.ndarray) -> np.ndarray:
        acc = np.zeros(self.n, object if self.wide or query.dtype == object else np.int64)
        for d in np.flatnonzero(query):
            if d >= len(self.lists):
                break
            rows, w = self.lists[d]
            if rows is None:
                acc += query[d] * w
            else:
                acc[rows] += query[d] * w
        if acc.dtype == object:
            acc = np.array([max(-LONG - 1, min(LONG, int(s))) for s in acc], np.int64)
        return acc

    def best(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best but `own`, by score, then id.  Rows stand in id order."""
        s = self.scores(query)
        other = self.ids != own
        ids, s = self.ids[other], s[other]
        if len(s) > k > 0:
            bar = np.partition(s, len(s) - k)[len(s) - k]
            above = np.flatnonzero(s > bar)
            level = np.flatnonzero(s == bar)[: k - len(above)]
            keep = np.concatenate([above, level])
            ids, s = ids[keep], s[keep]
        at = np.lexsort((ids, -s))[:k] if len(s) and s.min() > -LONG - 1 else np.array(sorted(range(len(s)), key=lambda i: (-int(s[i]), ids[i]))[:k], int)
        return ids[at], s[at]


def _merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    ids, s = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    at = np.array(sorted(range(len(s)), key=lambda i: (-int(s[i]), ids[i]))[:k], int)
    return ids[at], s[at]


def _search(candidates: DataFrame, qids: list[int], qs: np.ndarray, k: int, scale: int) -> DataFrame:
    sent = candidates.sparkSession.sparkContext.broadcast((qids, qs))

    def run(batches: Iterable[dict]) -> Iterator[dict]:
        ids_q, queries = sent.value
        best: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids_q)
        ids: list[int] = []
        vectors: list[list[float]] = []

        def flush() -> None:
            block = Postings(np.array(ids, np.int64), quantise(vectors, scale))
            for i, (own, q) in enumerate(zip(ids_q, queries)):
                best[i] = _merge(best[i], block.best(own, q, k), k)
            ids.clear(), vectors.clear()

        for b in batches:
            ids += b["vec_id"]
            vectors += b["embedding"]
            if len(ids) >= BLOCK:
                flush()
        if ids:
            flush()
        for i in range(0, len(ids_q), 1000):
            part = [(ids_q[j], int(v), int(s)) for j in range(i, min(i + 1000, len(ids_q))) for v, s in zip(*best[j])]
            yield {"query_id": [x[0] for x in part], "vec_id": [x[1] for x in part], "score": [x[2] for x in part]}

    found = map_rows(candidates, run, SCHEMA)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def top_k(points: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k best other rows."""
    spark = points.sparkSession
    prepare(spark)
    p = points.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    queries = p.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width")).first()
    block = max(1, min(QUERY_BLOCK, QUERY_BYTES // (DRIVER_BYTES * max(1, size.width or 0))))
    chunks = max(1, -(-size.n * 5 // (block * 4))) if size.n > block else 1
    parts = []
    for c in range(chunks):
        mine = queries if chunks == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c)
        rows = mine.orderBy("vec_id").collect()  # `block` rows or, by the hash's spread, few more
        qs = quantise([r.embedding for r in rows], scale)
        found = _search(p, [r.vec_id for r in rows], qs, k, scale)
        parts.append(found if chunks == 1 else written(found, "topk"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
