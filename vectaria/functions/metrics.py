"""Similarity scores as column expressions.  Higher is closer for every metric.

All arithmetic is single precision from left to right, so scores are the same in every plan:
a fold is used, not a shuffled sum."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import Metric


def single(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("float")


def vector_literal(v: Sequence[float]) -> Column:
    """An array of floats.  One string that the optimizer folds, as thousands of literals would slow
    the planning of wide vectors; the digits are enough to give each float back exactly."""
    return F.split(F.lit(",".join(repr(float(x)) for x in np.asarray(v, np.float32))), ",").cast("array<float>")


def _fold(terms: Column) -> Column:
    return F.aggregate(terms, single(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return single(F.sqrt(_fold(F.transform(a, lambda x: x * x))))


def literal_norm(v: Sequence[float]) -> float:
    """The same fold on the driver, so a query's norm is computed once."""
    s = np.float32(0)
    for x in np.asarray(v, np.float32):
        s = np.float32(s + x * x)
    return float(np.float32(np.sqrt(np.float64(s))))


def cosine(a: Column, b: Column, norm_b: Column | None = None) -> Column:
    """0 where either norm is 0."""
    na, nb = norm(a), norm(b) if norm_b is None else norm_b
    both = na * nb
    return F.when((na == single(0.0)) | (nb == single(0.0)), single(0.0)).otherwise(single(dot(a, b) / both))


def euclidean(a: Column, b: Column) -> Column:
    """The negated distance."""
    return -single(F.sqrt(_fold(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))))


def score(metric: Metric, a: Column, b: Column, norm_b: Column | None = None) -> Column:
    if metric is Metric.COSINE:
        return cosine(a, b, norm_b)
    return dot(a, b) if metric is Metric.DOT else euclidean(a, b)


def score_to(metric: Metric, a: Column, query: Sequence[float]) -> Column:
    """Score against one query vector."""
    hoisted = single(literal_norm(query)) if metric is Metric.COSINE else None
    return score(metric, a, vector_literal(query), hoisted)


def finite(v: Column) -> Column:
    """Whether a stored vector is legal: not empty, all components there and finite."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
