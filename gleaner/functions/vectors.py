"""Similarity of embedding arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Cosine similarity; the norms are floored at ``eps``, so a zero vector gives 0."""
    def norm(v: Column) -> Column:
        return F.greatest(F.sqrt(dot(v, v)), F.lit(eps))
    return dot(a, b) / (norm(a) * norm(b))


def semantic_gate(new: Column, original: Column, similarity: Column, threshold: float = 0.85) -> Column:
    """The new text where it stays close enough to the original, else the original."""
    return F.when(similarity >= threshold, new).otherwise(original)
