"""Connected components of an edge table by alternating large-star and small-star steps
(Kiveris et al. 2014): every step is a shuffle on the node, so no component is ever held by
one task beyond the sorted run of one node's neighbours, and nothing goes to the driver but
counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MAX_ROUNDS = 60


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); root is the component's smallest node.

    Self-loops and repeated edges do no harm; an empty table gives an empty table."""
    edges = written(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        edges = written(_small(_large(edges)), "star")
        stars = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h"), F.countDistinct("a").alias("k")).first()
        now = (stars.n, stars.h)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
