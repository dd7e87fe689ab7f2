"""Vectors as arrays of numbers. Higher-order functions; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan.functions.text import bind


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(1e-8))


def unit(a: Column) -> Column:
    """The vector over its length; a zero vector stays zero."""
    return bind(norm(a), lambda n: F.transform(a, lambda x: F.when(n > 0, F.try_divide(x.cast("double"), n)).otherwise(0.0)))


def max_sim(query: Column, patches: Column) -> Column:
    """Late interaction: for each query vector the largest cosine over the patches, summed."""
    def best(units: Column) -> Column:
        return F.transform(F.transform(query, unit), lambda q: F.array_max(F.transform(units, lambda p: dot(q, p))))

    return F.aggregate(bind(F.transform(patches, unit), best), F.lit(0.0), lambda s, x: s + x)


def mean_pool(vectors: Column, mask: Column) -> Column:
    """The mean of the vectors whose mask is 1; its denominator is at least 1e-9."""
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m.cast("double")), F.lit(1e-9))
    held = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m.cast("double")))
    first = F.transform(F.element_at(vectors, 1), lambda x: F.lit(0.0))
    total = F.aggregate(held, first, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / n)


def generative_confidence(steps: Column) -> Column:
    """The product of each step's largest chance, without the last step's."""
    return F.aggregate(F.slice(steps, 1, F.greatest(F.size(steps) - 1, F.lit(0))), F.lit(1.0), lambda s, x: s * x)


def likeliest(scores: Column) -> Column:
    """The largest of the chances that scores before their softmax stand for."""
    return bind(F.array_max(scores).cast("double"), lambda top: 1 / F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top)))


def extractive_confidence(starts: Column, ends: Column) -> Column:
    """The chance of the likeliest start times that of the likeliest end; both are scores before their softmax."""
    return likeliest(starts) * likeliest(ends)
