"""Column functions on ARRAY<DOUBLE> vectors. A null or empty vector, or vectors of unlike lengths, give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(F.when(dot(a, b).isNotNull(), 0.0))


def euclidean_similarity(a: Column, b: Column) -> Column:
    """1 / (1 + distance)."""
    return F.when(F.size(a) == F.size(b), 1 / (1 + F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))))


def max_sim(query: Column, doc: Column) -> Column:
    """Late interaction: for each query token the best cosine among the document's tokens, summed."""
    return _sum(F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: cosine(q, d)))))


METRICS = {"cosine": cosine, "dot": dot, "euclidean": euclidean_similarity}


def similarity(metric: str, a: Column, b: Column) -> Column:
    """An unknown metric is taken as cosine."""
    return METRICS.get(metric, cosine)(a, b)


def quantise(a: Column, low: Column, high: Column) -> Column:
    """Scalar quantisation to -128..127 between two bounds."""
    return F.transform(a, lambda x: F.least(F.lit(127), F.greatest(F.lit(-128), F.round((x - low) / (high - low) * 255 - 128))).cast("tinyint"))
