"""Radius joins over a grid of cells, voxel thinning and cloud overlap.

Points are hashed to cells, one side is repeated over the neighbouring cells, and the join is an equi-join on scope and
cell. Cells hold few points where points spread; a crowded cell is one join key, which adaptive execution may split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def _cells(df: DataFrame, size: float, offsets: Sequence[tuple[int, int, int]]) -> DataFrame:
    own = [cell(F.col(c), size) for c in ("x", "y", "z")]
    around = F.array(*[F.struct(*[(own[i] + F.lit(o[i])).alias(f"_c{i}") for i in range(3)]) for o in offsets])
    return df.withColumn("_cell", F.explode(around)).select(*df.columns, "_cell.*")


_ALL = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
_HALF = [o for o in _ALL if o >= (0, 0, 0)]


def _apart(a: str, b: str) -> Column:
    return F.sqrt(sum(((F.col(f"{a}{c}") - F.col(f"{b}{c}")) ** 2 for c in "yz"), (F.col(f"{a}x") - F.col(f"{b}x")) ** 2))


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select("scope", F.col("id").alias(f"{prefix}id"), *[F.col(c).alias(f"{prefix}{c}") for c in "xyz"], *[c for c in df.columns if c.startswith("_c")])


def radius_pairs(points: DataFrame, radius: float, ordered: bool = False) -> DataFrame:
    """scope, id1, id2, dist of points of one scope nearer than the radius: id1 < id2, or both orders. points: scope, id, x, y, z.

    Only half of the neighbouring cells are visited, so each pair is found once.
    """
    points = points.select("scope", "id", "x", "y", "z")
    a = _renamed(_cells(points, radius, _HALF), "a_")
    b = _renamed(_cells(points, radius, [(0, 0, 0)]), "b_")
    near = a.join(b, ["scope", "_c0", "_c1", "_c2"])
    same = F.lit(True)
    for i, c in enumerate("xyz"):
        same = same & (cell(F.col(f"a_{c}"), radius) == F.col(f"_c{i}"))
    near = near.where(~same | (F.col("a_id") < F.col("b_id"))).withColumn("dist", _apart("a_", "b_")).where(F.col("dist") < radius)
    pairs = near.select("scope", F.least("a_id", "b_id").alias("id1"), F.greatest("a_id", "b_id").alias("id2"), "dist").where("id1 <> id2")
    return pairs.unionByName(pairs.select("scope", F.col("id2").alias("id1"), F.col("id1").alias("id2"), "dist")) if ordered else pairs


def radius_join(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """scope, id1 (left), id2 (right), dist nearer than the radius."""
    a = _renamed(_cells(left.select("scope", "id", "x", "y", "z"), radius, _ALL), "a_")
    b = _renamed(_cells(right.select("scope", "id", "x", "y", "z"), radius, [(0, 0, 0)]), "b_")
    near = a.join(b, ["scope", "_c0", "_c1", "_c2"]).withColumn("dist", _apart("a_", "b_")).where(F.col("dist") < radius)
    return near.select("scope", F.col("a_id").alias("id1"), F.col("b_id").alias("id2"), "dist")


def cloud_overlap(points: DataFrame, pairs: DataFrame, radius: float) -> DataFrame:
    """a, b, n_a, n_b, hit_a, hit_b, iou of each pair (a, b) of clouds: points with a point of the other cloud nearer than the radius.

    points: cloud, id, x, y, z. A semi-join in either direction; the overlap is the matched share of all points.
    """
    sizes = points.groupBy("cloud").agg(F.count("*").alias("n"))

    def hits(own: str, other: str) -> DataFrame:
        scope = F.struct(pairs["a"], pairs["b"])
        mine = pairs.join(points, pairs[own] == points["cloud"]).select(scope.alias("scope"), "id", "x", "y", "z")
        theirs = pairs.join(points, pairs[other] == points["cloud"]).select(scope.alias("scope"), "id", "x", "y", "z")
        found = radius_join(mine, theirs, radius).select("scope", "id1").distinct().groupBy("scope").agg(F.count("*").alias(f"hit_{own}"))
        return found.select(F.col("scope.a").alias("a"), F.col("scope.b").alias("b"), f"hit_{own}")

    out = pairs.join(sizes.select(F.col("cloud").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("cloud").alias("b"), F.col("n").alias("n_b")), "b")
    out = out.join(hits("a", "b"), ["a", "b"], "left").join(hits("b", "a"), ["a", "b"], "left").na.fill(0, ["hit_a", "hit_b"])
    both = F.col("hit_a") + F.col("hit_b")
    return out.withColumn("iou", both / (F.col("n_a") + F.col("n_b")))


def legacy_cloud_overlap(n1: Column, n2: Column, m1: Column, m2: Column) -> Column:
    """The older measure kept for comparison: 0 for clouds that overlap wholly, may exceed 1."""
    return F.coalesce(F.try_divide((m1 + m2).cast("double"), F.nullif(n1 + n2 - m1 - m2, F.lit(0))), F.lit(0.0))


def voxel_downsample(points: DataFrame, leaf: float, keys: Sequence[str] = ("scope",)) -> DataFrame:
    """Centroid and count of the points of each cell, apart by keys."""
    by = [*keys, *[cell(F.col(c), leaf).alias(f"v{c}") for c in "xyz"]]
    return points.groupBy(*by).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.count("*").alias("n"))


def finite(*cols: str) -> Column:
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf")))
    return ok


def mahalanobis_filter(points: DataFrame, limit: float = 1.2, keys: Sequence[str] = ("scope",)) -> DataFrame:
    """Points whose Mahalanobis distance to their group is at most the limit, with `mahalanobis`; groups that lie in a plane or less stay whole, with null."""
    stats = points.groupBy(*keys).agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"], *[F.covar_pop(a, b).alias(f"s{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")])
    a, b, c, d, e, f = (F.col(f"s{p}") for p in ("xx", "xy", "xz", "yy", "yz", "zz"))
    det = a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)
    dx, dy, dz = (F.col(p) - F.col(f"m{p}") for p in "xyz")
    form = dx * dx * (d * f - e * e) + dy * dy * (a * f - c * c) + dz * dz * (a * d - b * b) + 2 * (dx * dy * (c * e - b * f) + dx * dz * (b * e - c * d) + dy * dz * (b * c - a * e))
    out = points.join(stats, list(keys)).withColumn("mahalanobis", F.when(det > 1e-6 * a * d * f, F.sqrt(F.greatest(form / det, F.lit(0.0)))))
    return out.where(F.col("mahalanobis").isNull() | (F.col("mahalanobis") <= limit)).select(*points.columns, "mahalanobis")
