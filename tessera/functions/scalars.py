"""Scalar expressions of scoring and of the study's categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def sim01(cosine: Column) -> Column:
    """F8: a cosine as a number from 0 to 1."""
    return clip01((cosine + 1) / 2)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    c = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), p))
    return F.log(c / (1 - c))


def scaled_count(n: Column, scale: float) -> Column:
    """log-scaled count, within 0 and 1."""
    return clip01(F.log1p(n.cast("double")) / F.log1p(F.lit(float(scale))))


def array_mean(xs: Column) -> Column:
    """F8: mean of an array, 0 for an empty one."""
    return F.coalesce(F.try_divide(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), F.size(xs)), F.lit(0.0))


def array_std(xs: Column) -> Column:
    """F8: population deviation, 0 under two values."""
    mean = array_mean(xs)
    return F.when(F.size(xs) < 2, 0.0).otherwise(F.sqrt(F.try_divide(F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)), F.size(xs))))


def strength_class(value: Column, strong: float = 0.20, moderate: float = 0.08) -> Column:
    """Strong, moderate or weak."""
    return F.when(value >= strong, "strong").when(value >= moderate, "moderate").otherwise("weak")


def lead_class(lead: Column, clear: float = 0.1, slight: float = 0.02) -> Column:
    """How far a candidate leads the next; null for the last."""
    return F.when(lead.isNull(), "last").when(lead >= clear, "clear").when(lead >= slight, "slight").otherwise("close")


def bridge_strength(importance: Column, mass: Column) -> Column:
    """An edge's strength from its importance and the mean importance of its items."""
    return importance * (0.5 + 0.5 * mass)


def edge_level(kind: Column, rank: Column) -> Column:
    """1 context, 2 core, 3 supporting, 4 optional."""
    return F.when(kind == "context", 1).when(rank <= 1, 2).when(rank <= 3, 3).otherwise(4)


def halton(index: int, base: int) -> float:
    """a point of the van der Corput sequence."""
    value, scale = 0.0, 1.0
    while index:
        scale /= base
        index, digit = divmod(index, base)
        value += digit * scale
    return value
