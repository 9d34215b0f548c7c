"""Components, fixpoints and clusters of graphs, all as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.spatial import radius_pairs
from loomgraph.session import cut_lineage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (smallest node) for the nodes of edges that join two different nodes."""
    links = cut_lineage(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    if links.isEmpty():
        return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        links = cut_lineage(small)
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def resolve(merges: DataFrame, key: str = "id", target: str = "target") -> DataFrame:
    """key, root: where each id ends when its target is followed to the last; pointers are doubled, so long chains take few rounds.

    A target of -1, or one that is merged no further, ends a chain. Chains must not run in circles.
    """
    links = cut_lineage(merges.select(F.col(key).alias("k"), F.col(target).alias("t")))
    while True:
        step = links.alias("a").join(links.alias("b"), F.col("a.t") == F.col("b.k"), "left").select("a.k", F.coalesce("b.t", "a.t").alias("t"), F.col("b.t").isNotNull().alias("moved"))
        step = cut_lineage(step)
        if not step.where("moved").limit(1).count():
            return step.select(F.col("k").alias(key), F.col("t").alias("root"))
        links = step.select("k", "t")


def dbscan(points: DataFrame, radius: float, least: int) -> DataFrame:
    """scope, id, cluster: density clusters of the points of each scope, named by their smallest core point; noise has none.

    Core points have at least so many points (themselves included) nearer than the radius; a border point goes to the
    smallest cluster it touches. points: scope, id (whole numbers), x, y, z.
    """
    pairs = cut_lineage(radius_pairs(points, radius, ordered=True))
    core = cut_lineage(pairs.groupBy("scope", F.col("id1").alias("id")).agg((F.count("*") + 1).alias("n")).where(F.col("n") >= least).select("scope", "id"))
    if least <= 1:
        core = points.select("scope", "id")
    a, b = core.withColumnRenamed("id", "id1"), core.withColumnRenamed("id", "id2")
    numbered = points.select("scope", "id", F.xxhash64("scope", "id").alias("_n"))
    links = pairs.join(a, ["scope", "id1"]).join(b, ["scope", "id2"]).where("id1 < id2").select(F.xxhash64("scope", "id1").alias("a"), F.xxhash64("scope", "id2").alias("b"))
    component = connected_components(links)
    of_core = core.join(numbered, ["scope", "id"]).join(component.select(F.col("node").alias("_n"), "component"), "_n", "left").withColumn("component", F.coalesce("component", "_n"))
    names = of_core.groupBy("component").agg(F.min("id").alias("cluster"))
    of_core = of_core.join(names, "component").select("scope", "id", "cluster")
    border = pairs.join(core.withColumnRenamed("id", "id1"), ["scope", "id1"], "left_anti").join(of_core.select("scope", F.col("id").alias("id2"), "cluster"), ["scope", "id2"]).groupBy("scope", F.col("id1").alias("id")).agg(F.min("cluster").alias("cluster"))
    return points.select("scope", "id").join(of_core.unionByName(border), ["scope", "id"], "left")


def largest_cluster(clustered: DataFrame) -> DataFrame:
    """scope, id of the points of the largest cluster of each scope, the smallest name of several; without any cluster all points stay."""
    sizes = clustered.where("cluster is not null").groupBy("scope", "cluster").agg(F.count("*").alias("n"))
    best = sizes.groupBy("scope").agg(F.max_by("cluster", F.struct("n", (-F.col("cluster")).alias("c"))).alias("best"))
    return clustered.join(best, "scope", "left").where("best is null or cluster = best").select("scope", "id")


def clusters_of_half(clustered: DataFrame, least: int) -> DataFrame:
    """scope, id of the points whose cluster has at least so many points and half of the largest cluster's."""
    sizes = clustered.where("cluster is not null").groupBy("scope", "cluster").agg(F.count("*").alias("n"))
    top = sizes.groupBy("scope").agg(F.max("n").alias("top"))
    keep = sizes.join(top, "scope").where((F.col("n") >= F.floor(F.col("top") / 2)) & (F.col("n") >= least)).select("scope", "cluster")
    return clustered.join(keep, ["scope", "cluster"], "left_semi").select("scope", "id")
