"""Exact k nearest neighbours: filter, score, bounded top-k."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..session import share_code
from ..types import InvalidArgument, Metric, check_vector

#: Query vectors that one pass over the points answers at most.
QUERIES_AT_ONCE = 1024
#: Points and queries whose scores are folded together, so that they stay in the processor's cache.
TILE = 256
#: Above this k the rows are counted first.
LARGE_K = 100_000
#: Hits of so many rows at most (id, score, rank) are broadcast.
BROADCAST_HITS = 10_000


def check_k(k: int) -> int:
    if k < 0:
        raise InvalidArgument("k must not be negative")
    return k


def top_k(
    points: DataFrame, query: Sequence[float], k: int, metric: Metric = Metric.COSINE, where: Column | None = None,
    id_column: str = "id", vector: str = "vector", extra: Sequence[str] = (), dimension: int | None = None,
) -> DataFrame:
    """(id, score, extra...) of the k best, by score and then ascending id.  The filter runs before
    any score; order and limit plan as one bounded operator, so no full sort and no shuffle of
    the points."""
    q = check_vector(query, dimension)
    admitted = points if where is None else points.where(where)
    scored = admitted.select(F.col(id_column).alias("id"), metrics.score_to(metric, F.col(vector), q).alias("score"), *extra)
    return best(scored, k)


def best(scored: DataFrame, k: int) -> DataFrame:
    """The k rows with the highest score, ties to the smaller id.  The bounded operator sets room for
    k rows aside in every task, so a k that exceeds the rows there are becomes a plain sort."""
    ordered = scored.orderBy(F.desc("score"), "id")
    if check_k(k) > LARGE_K and scored.count() <= k:
        return ordered
    return ordered.limit(k)


def batch_top_k(
    points: DataFrame, queries: Sequence[tuple[int | str, Sequence[float]]], k: int, metric: Metric = Metric.COSINE,
    where: Column | None = None, id_column: str = "id", vector: str = "vector",
) -> DataFrame:
    """(query_id, rank, id, score) for a stated list of queries.  Each pass scans the points once beside a
    bounded block of queries; a task scores them as arrays, by the same fold as `metrics.score`, and
    hands on its k best rows a query."""
    if not queries:
        raise InvalidArgument("no queries")
    share_code(points.sparkSession)
    admitted = (points if where is None else points.where(where)).select(F.col(id_column).alias("id"), F.col(vector).alias("v"))
    schema = f"query_id {'long' if isinstance(queries[0][0], int) else 'string'}, id {dict(admitted.dtypes)['id']}, score float"
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    sized: dict[int, list] = {}
    for name, v in queries:
        q = check_vector(v)
        sized.setdefault(len(q), []).append((name, q))
    out = None
    for same in sized.values():
        for at in range(0, len(same), QUERIES_AT_ONCE):
            block = same[at : at + QUERIES_AT_ONCE]
            found = admitted.mapInArrow(_Best([n for n, _ in block], np.array([q for _, q in block]), check_k(k), metric), schema)
            best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
            out = best if out is None else out.unionByName(best)
    return out


def fold_scores(metric: Metric, v: np.ndarray, q: np.ndarray, norm_v: np.ndarray, norm_q: np.ndarray) -> np.ndarray:
    """`metrics.score` of each row of v with each row of q, to the bit: single precision, from left to right."""
    s = np.zeros((len(v), len(q)), np.float32)
    term = np.empty_like(s)
    for a, b in zip(np.ascontiguousarray(v.T), np.ascontiguousarray(q.T)):
        if metric is Metric.EUCLIDEAN:
            np.subtract(a[:, None], b, out=term)
            np.multiply(term, term, out=term)
        else:
            np.multiply(a[:, None], b, out=term)
        np.add(s, term, out=s)
    if metric is Metric.EUCLIDEAN:
        return -np.sqrt(s.astype(np.float64)).astype(np.float32)
    if metric is Metric.COSINE:
        s = (s.astype(np.float64) / (norm_v[:, None] * norm_q).astype(np.float64)).astype(np.float32)
        s[norm_v == 0] = 0
        s[:, norm_q == 0] = 0
    return s


def fold_norms(v: np.ndarray) -> np.ndarray:
    s = np.zeros(len(v), np.float32)
    for a in v.T:
        s += a * a
    return np.sqrt(s.astype(np.float64)).astype(np.float32)


class _Best:
    """The k best rows a query of a task.  Scores go by keys: a NaN first, null last, as Spark sorts them."""

    def __init__(self, names: list, q: np.ndarray, k: int, metric: Metric) -> None:
        self.names, self.q, self.k, self.metric = names, q, k, metric

    def _tiles(self, ids: pa.Array, v: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """Ids, scores and whether a score is null, for some rows at a time."""
        dimension, norm_q = self.q.shape[1], fold_norms(self.q)
        if v.null_count or v.flatten().null_count or (np.asarray(v.value_lengths()) != dimension).any():
            rows = v.to_pylist()
            whole = np.array([x is not None and len(x) == dimension and None not in x for x in rows])
            odd = np.flatnonzero(~whole)
            # Their products are null; a cosine is 0 nevertheless where a norm is.
            zero = np.array([rows[i] is not None and None not in rows[i] and not fold_norms(np.array([rows[i]], np.float32))[0] for i in odd], bool)
            null = np.ones((len(odd), len(self.q)), bool) if self.metric is not Metric.COSINE else ~(zero[:, None] | (norm_q == 0))
            if len(odd):
                yield ids.take(pa.array(odd)), np.zeros(null.shape, np.float32), null
            ids, v = ids.filter(pa.array(whole)), v.filter(pa.array(whole))
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
        for at in range(0, len(x), TILE):
            part = x[at : at + TILE]
            norms = fold_norms(part)
            s = [fold_scores(self.metric, part, self.q[i : i + TILE], norms, norm_q[i : i + TILE]) for i in range(0, len(self.q), TILE)]
            yield ids.slice(at, TILE), np.concatenate(s, axis=1), np.zeros((1, 1), bool)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, floor = None, np.full(len(self.q), -np.inf)
        with np.errstate(all="ignore"):
            for batch in batches:
                for ids, s, null in self._tiles(batch.column(0), batch.column(1)) if self.k else ():
                    key = s.astype(np.float64)
                    if null.any() or not np.isfinite(s).all():
                        key = np.where(null, -np.inf, np.where(np.isnan(s), np.inf, np.clip(key, -1e300, 1e300)))
                    at, q = np.nonzero(key >= floor)
                    if len(at):
                        best, floor = self._merged(best, ids, at, q, key[at, q])
        if best is not None:
            q, key, ids = best
            score = np.where(key == np.inf, np.nan, np.where(np.abs(key) == 1e300, np.sign(key) * np.inf, key)).astype(np.float32)
            # kept in pieces, as Arrow batches are bounded elsewhere too
            for i in range(0, len(q), 10_000):
                part = slice(i, i + 10_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([self.names[j] for j in q[part]]), ids.slice(i, 10_000), pa.array(score[part], mask=key[part] == -np.inf, from_pandas=False)],
                    ["query_id", "id", "score"],
                )

    def _merged(self, best: tuple | None, ids: pa.Array, at: np.ndarray, q: np.ndarray, key: np.ndarray) -> tuple[tuple, np.ndarray]:
        ids = ids.take(pa.array(at))
        if best is not None:
            q, key, ids = np.concatenate([best[0], q]), np.concatenate([best[1], key]), pa.concat_arrays([best[2], ids])
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        plain = ids.fill_null("" if pa.types.is_string(ids.type) or pa.types.is_large_string(ids.type) else 0).to_numpy(zero_copy_only=False)
        if plain.dtype == object:
            plain = np.unique(plain, return_inverse=True)[1]
        order = np.lexsort((plain, known, -key, q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        order, q = order[rank < self.k], q[rank < self.k]
        key, ids = key[order], ids.take(pa.array(order))
        floor = np.full(len(self.q), -np.inf)
        last = rank[rank < self.k] == self.k - 1
        floor[q[last]] = key[last]
        return (q, key, ids), floor


def hydrate(hits: DataFrame, points: DataFrame, columns: Sequence[str], k: int, id_column: str = "id") -> DataFrame:
    """Wide columns only for the winners, which must be among the points.  The hits, k rows at most, are
    broadcast against the points as long as k is small, so the points are scanned and not moved."""
    wide = points.select(F.col(id_column).alias("id"), *columns)
    return wide.join(F.broadcast(hits) if k <= BROADCAST_HITS else hits, "id")
