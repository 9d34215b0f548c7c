"""Vector arithmetic on array columns, all in double precision and inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_smoothed(a: Column, b: Column, epsilon: float = 1e-6) -> Column:
    """Cosine with epsilon in the denominator: 0 where a vector is zero."""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(epsilon))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


def usable(v: Column, dim: int) -> Column:
    """Not null, of the length, finite and not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0)


def midpoint(a: Column, b: Column) -> Column:
    """Running overwrite of a stored vector: half old, half new."""
    return F.zip_with(doubles(a), doubles(b), lambda x, y: (x + y) / 2)


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def unit_direction(a: Column, b: Column) -> Column:
    """Unit vector from a to b; zeros where they coincide."""
    d = euclid(a, b)
    return F.when(d > 0, F.zip_with(doubles(a), doubles(b), lambda x, y: F.try_divide(y - x, d))).otherwise(F.transform(a, lambda _: F.lit(0.0)))


def margin(lo: Column, hi: Column, share: float = 0.1) -> tuple[Column, Column]:
    """A range widened on both sides by a share of its width."""
    return lo - (hi - lo) * share, hi + (hi - lo) * share


def range_union(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> tuple[Column, Column]:
    return F.least(lo1, lo2), F.greatest(hi1, hi2)


def into_unit(values: Column) -> Column:
    """All numbers of an array moved, then scaled, as little as needed to lie in [0, 1]."""
    low = F.array_min(values)
    moved = F.transform(values, lambda x: x - F.least(low, F.lit(0.0)))
    top = F.array_max(moved)
    return F.transform(moved, lambda x: x / F.greatest(top, F.lit(1.0)))


def normalise(values: Column, lo: Column, hi: Column) -> Column:
    return into_unit(F.transform(values, lambda x: F.try_divide(x - lo, hi - lo)))


def clip_unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def box_volume(size: Column) -> Column:
    return size["x"] * size["y"] * size["z"]


def distance_score(d: Column, touching: float = 1e-3) -> Column:
    """exp(-2 d), and 0 for a distance that is no more than touching."""
    return F.when(d > touching, F.exp(-2 * d)).otherwise(0.0)
