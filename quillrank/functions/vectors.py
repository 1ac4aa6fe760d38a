"""Vector expressions: double accumulation, zero norms give 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    both = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(both == 0, F.lit(0.0)).otherwise(dot(a, b) / both)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def argmax(scores: Column) -> Column:
    """Index from 0 of the highest score, the first on ties; 0 if empty."""
    return F.greatest(F.coalesce(F.array_position(scores, F.array_max(scores)), F.lit(1)) - 1, F.lit(0)).cast("int")


def pooled(mean: Column, top: Column, kind: str) -> Column:
    """Ways to turn fragment scores into one, from their mean and the best of
    them, best first: mean, max, top2, top3, or a blend such as 'mean70' (70 %
    mean and 30 % max)."""
    if kind == "max":
        return F.get(top, F.lit(0))
    if kind.startswith("top"):
        best = F.slice(top, 1, int(kind[3:]))
        return F.aggregate(best, F.lit(0.0), lambda s, x: s + x, lambda s: s / F.size(best))
    share = int(kind[4:] or 100) / 100
    return mean if share == 1 else mean * share + F.get(top, F.lit(0)) * (1 - share)
