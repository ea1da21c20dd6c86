"""Log-space arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def log_add(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def log_sum(values: Column) -> Column:
    """log(sum(exp(v))) over an array column; NULL for an empty array."""
    peak = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.exp(v - peak))
    return peak + F.log(total)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def mixture(kept: Column, replaced: Column) -> Column:
    """Score of a pair that is either inherited or replaced; both already hold their prior."""
    return log_add(kept, replaced)


def responsibility(kept: Column, replaced: Column) -> Column:
    """Posterior that the pair is a replacement."""
    return sigmoid(replaced - kept)
