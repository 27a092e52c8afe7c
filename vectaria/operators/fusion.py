"""Reciprocal rank fusion and hybrid retrieval."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..types import EmptyQuery, HybridQuery

RRF_K, OVERFETCH = 60.0, 4


def fuse_rrf(channels: Sequence[DataFrame], rrf_k: float = RRF_K) -> DataFrame:
    """(id, score) with score = sum over channels of 1 / (k + rank), in channel order.  A channel is
    a list of hits (id, rank) cut to its depth."""
    parts = [c.select("id", F.lit(i).alias("channel"), (F.lit(1.0) / (F.lit(float(rrf_k)) + F.col("rank"))).alias("part")) for i, c in enumerate(channels)]
    both = reduce(DataFrame.unionByName, parts)
    fused = both.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("channel", "part"))).alias("p"))  # a row a channel
    return fused.select("id", F.aggregate("p", F.lit(0.0), lambda a, x: a + x["part"]).alias("score"))


def by_rank(hits: DataFrame) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def hybrid(query: HybridQuery, dense: Callable[[int], DataFrame], lexical: Callable[[int], DataFrame]) -> DataFrame:
    """(id, score) of the k best.  `dense` and `lexical` give a channel's (id, score) to a depth.

    With both channels each is cut to k x overfetch and the fused score is returned; with one,
    that channel's own score.  Ranking is by double, the score returned is single."""
    if query.vector is None and query.text is None:
        raise EmptyQuery("a hybrid query needs a vector or a text")
    depth = min(query.k * query.overfetch, (1 << 31) - 1)
    channels = [c(depth).select("id", F.col("score").cast("double").alias("score")) for c, x in ((dense, query.vector), (lexical, query.text)) if x is not None]
    out = fuse_rrf([by_rank(c) for c in channels], query.rrf_k) if len(channels) == 2 else channels[0]
    top = by_rank(out.orderBy(F.desc("score"), "id").limit(query.k))
    return top.select("id", F.col("score").cast("float").alias("score"), "rank")
