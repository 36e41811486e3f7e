"""Scores of a tool for an objective."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = 6


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, rounded; null if either vector is null or lengths differ."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.round(F.aggregate(product, F.lit(0.0), lambda s, x: s + x), PLACES))


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens, split at blanks; none for null."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), " "), lambda t: t != ""))


def jaccard(both: Column, a: Column, b: Column) -> Column:
    """Similarity of two sets from the sizes of their intersection and of each."""
    return F.round(both.cast("double") / (a + b - both), PLACES)


def readiness(state: Column, prereqs: Column) -> Column:
    """Whether all prerequisites are among the facts; a null array is empty."""
    none = F.array().cast("array<string>")
    return F.size(F.array_except(F.coalesce(prereqs, none), F.coalesce(state, none))) == 0
