"""Seeded random points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(spark: SparkSession, n: int, dimension: int, seed: int = 42) -> DataFrame:
    """(id, vector): n vectors uniform in [-1, 1), each component a hash of (seed, id, place), so
    the same whatever the partitioning."""
    part = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(1 << 24)) / F.lit(float(1 << 23)) - F.lit(1.0)
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: part(i).cast("float")).alias("vector"))
