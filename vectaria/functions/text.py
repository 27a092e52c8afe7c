"""Tokens and BM25 as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Characters that may be no part of a run while their small forms are (or the other way round): the dotted I,
#: whose small form is two characters, and scripts of which Java and Spark's case tables may know other
#: versions.  For all other texts, lower-casing the whole before the split is the same and far cheaper.
OWN_CASE = r"[\x{130}\x{530}-\x{1FFF}\x{2070}-\x{2FFF}\x{A000}-\x{10FFFF}]"


def tokens(text: Column) -> Column:
    """Runs of alphabetic or numeric characters, each character lower-cased on its own: the split
    comes first, and a final sigma gets no special form."""
    own, low = text.rlike(OWN_CASE), lambda x: F.lower(F.translate(x, "Σ", "σ"))
    runs = F.split(F.when(own, text).otherwise(low(text)), r"[^\p{IsAlphabetic}\p{N}]+")
    # An array of one array gives the runs a name, so that they are cut once.
    named = F.transform(F.array(runs), lambda r: F.when(own, F.transform(r, low)).otherwise(r))
    return F.array_remove(F.get(named, F.lit(0)), "")


def query_tokens(spark: SparkSession, text: str) -> list[str]:
    """The same for a query text, by the same expression."""
    return list(spark.range(1).select(tokens(F.lit(text)).alias("t")).first().t)


def blank(text: Column) -> Column:
    return ~text.rlike(r"[^\p{IsWhite_Space}]")


def idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def term_score(idf_value: float, tf: Column, length: Column, avgdl: float) -> Column:
    if avgdl == 0:
        return F.lit(0.0)
    f, size = tf.cast("double"), length.cast("double")
    return F.lit(idf_value) * (f * F.lit(K1 + 1)) / (f + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * size / F.lit(avgdl)))
