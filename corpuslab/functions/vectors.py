"""Column functions for dense vectors held as array<double>."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either vector has no length."""
    lengths = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / lengths)


def mean_vector(vec: Column, weight: Column | None = None) -> Column:
    """Element-wise mean as an aggregate with map-side combine: rows are never exploded
    per dimension."""
    packed = array_to_vector(doubles(vec))
    mean = Summarizer.mean(packed) if weight is None else Summarizer.mean(packed, weight)
    return vector_to_array(mean)


def first_max(scores: Column) -> Column:
    """0-based index of the greatest element, the lowest index on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def entailment(contradiction: Column, neutral: Column, entails: Column) -> Column:
    """Entailment share against contradiction; null when neutral is the largest logit."""
    is_neutral = (neutral > contradiction) & (neutral >= entails)
    return F.when(~is_neutral, F.lit(1.0) / (F.lit(1.0) + F.exp(contradiction - entails)))
