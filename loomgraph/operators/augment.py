"""Noise, loss and displacement of objects, and random scenes; drawn by hash, so a run repeats exactly wherever it is computed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) from keys."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)


def normal(seed: int, *keys: str) -> Column:
    """A number of the normal distribution from keys."""
    return F.sqrt(-2 * F.log(1 - uniform(seed, *keys))) * F.cos(2 * F.pi() * uniform(seed + 1, *keys))


def augment(objects: DataFrame, keys: Sequence[str], group: Sequence[str], moved: float = 0.2, lost: float = 0.2, sigma: float = 1.5, least: int = 2, seed: int = 42) -> DataFrame:
    """objects with x, y, z in [0, 1] of which a share is displaced and a share of the rest is left out, with `fate`; groups left with too few objects go.

    size: the largest side of an object's box, the unit of the displacement.
    """
    fate = F.when(uniform(seed, *keys) < moved, "moved").when(uniform(seed + 10, *keys) < lost, "lost").otherwise("kept")
    out = objects.withColumn("fate", fate).where("fate <> 'lost'")
    shift = lambda c, i: F.when(F.col("fate") == "moved", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) + normal(seed + 20 + 2 * i, *keys) * sigma * F.col("size")))).otherwise(F.col(c))
    out = out.withColumns({c: shift(c, i) for i, c in enumerate("xyz")})
    enough = out.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(*group)
    return out.join(enough, list(group), "left_semi")


def percent_noise(value: Column, seed: int, *keys: str, share: float = 0.1) -> Column:
    return value + normal(seed, *keys) * F.abs(value) * share


def corner_shift(points: Column, seed: int, *keys: str, sigma: float = 0.01) -> Column:
    """Points (array of arrays) moved so that the least coordinates are a little above 0."""
    low = [F.array_min(F.transform(points, lambda p, i=i: p[i])) for i in range(3)]
    noise = [F.abs(normal(seed + 2 * i, *keys)) * sigma for i in range(3)]
    return F.transform(points, lambda p: F.array(*[p[i] - low[i] + noise[i] for i in range(3)]))


#: Relation of two object sizes.
RELATIONS = {("big", "big"): "next to", ("big", "small"): "supports", ("small", "big"): "on", ("small", "small"): "near"}


def random_scenes(spark, scenes: int, big: int = 10, small: int = 5, width: float = 20.0, depth: float = 10.0, seed: int = 7) -> DataFrame:
    """scene, id, kind, x, y, z, radius of made-up rooms whose objects do not overlap; one room per group of a kernel."""
    import numpy as np
    import pandas as pd

    from loomgraph.operators.kernels import per_group, place_circles

    def room(pdf: pd.DataFrame) -> pd.DataFrame:
        scene = int(pdf["scene"].iloc[0])
        rng = np.random.default_rng([seed, scene])
        radii = np.concatenate([rng.uniform(0.4, 1.0, big), rng.uniform(0.1, 0.3, small)])
        at = place_circles(radii, width, depth, seed=seed + scene)
        out = pd.DataFrame({"scene": scene, "id": np.arange(big + small), "kind": ["big"] * big + ["small"] * small, "x": at[:, 0], "y": at[:, 1], "z": rng.uniform(0, 1, big + small), "radius": radii})
        return out[~np.isnan(out["x"])]

    return per_group(spark.range(scenes).withColumnRenamed("id", "scene"), ["scene"], room, "scene long, id long, kind string, x double, y double, z double, radius double")


def relations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (scope, id1, id2) with a description by the kinds of their ends."""
    kinds = nodes.select("scope", "id", "kind")
    out = edges.join(kinds.select("scope", F.col("id").alias("id1"), F.col("kind").alias("k1")), ["scope", "id1"]).join(kinds.select("scope", F.col("id").alias("id2"), F.col("kind").alias("k2")), ["scope", "id2"])
    text = F.lit("near")
    for (a, b), t in RELATIONS.items():
        text = F.when((F.col("k1") == a) & (F.col("k2") == b), t).otherwise(text)
    return out.withColumn("description", text).drop("k1", "k2")
