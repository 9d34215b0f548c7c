"""The three jobs of the pipeline as plans: maps out of observations, training rows out of frames and maps, alignment of rescans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.vectors import zeros
from loomgraph.operators import aggregates, relational, spatial
from loomgraph.operators.filters import named
from loomgraph.session import cut_lineage
from loomgraph.sources import sinks


def build_nodes(observations: DataFrame, least: int = 2, dim: int = 64) -> DataFrame:
    """scan_id, id, name, feature, x, y, z, occurrences of the instances seen at least so often: most frequent name, mean vector, mean center.

    observations: scan_id, instance_id, object_name, feature, center. One shuffle on (scan, instance) serves all aggregates.
    """
    keys = ["scan_id", "instance_id"]
    o = observations.where("instance_id >= 0").select(*keys, "object_name", "feature", *[F.col(f"center.{c}").alias(c) for c in "xyz"])
    seen = o.groupBy(*keys).agg(F.count("*").alias("occurrences"), F.mode(F.when(named(F.col("object_name")), F.col("object_name")), True).alias("name"), *[F.avg(F.when(spatial.finite("x", "y", "z"), F.col(c))).alias(c) for c in "xyz"]).where(F.col("occurrences") >= least)
    mean = aggregates.mean_vectors(o, keys, "feature", dim).drop("occurance")
    out = relational.lookup(seen, mean, keys, {"name": F.lit("unknown"), "feature": zeros(dim)})
    return out.where("x is not null").withColumnRenamed("instance_id", "id")


def build_edges(nodes: DataFrame, radius: float = 2.0) -> DataFrame:
    return spatial.radius_pairs(nodes.select(F.col("scan_id").alias("scope"), "id", "x", "y", "z"), radius).withColumnRenamed("scope", "scan_id")


def build_maps(observations: DataFrame, radius: float = 2.0, least: int = 2) -> DataFrame:
    """scan_id, part, json: the graph document of each scan, in parts where it is large.

    The nodes are kept once: means summed up again in another order differ in the last digit, which would put a node into
    another cell on one side of the join, and so find a pair twice or not at all.
    """
    n = build_nodes(observations, least).withColumn("feature", F.col("feature").cast("array<float>"))
    n = cut_lineage(n.select("scan_id", "id", "name", "feature", "x", "y", "z"))
    e = build_edges(n, radius).select("scan_id", F.lit("default").alias("hypothesis_id"), F.lit(1.0).cast("float").alias("confidence"), F.col("id1").cast("string").alias("source_id"), F.col("id2").cast("string").alias("target_id"), F.col("dist").cast("float").alias("distance"), F.lit(None).cast("array<float>").alias("direction"), F.lit("").alias("description"))
    node = n.select("scan_id", F.col("id").cast("string").alias("id"), "name", F.col("feature").alias("visual_embedding"), F.lit(None).cast("array<float>").alias("text_embedding"), F.lit(None).cast("struct<radius:float>").alias("shape"), F.array("x", "y", "z").cast("array<float>").alias("position"))
    return sinks.graph_documents(node, e, "scan_id")


def summary(rows: DataFrame) -> DataFrame:
    """line: a readable report of matcher rows."""
    rate = aggregates.match_rate(F.col("matches0"))
    s = rows.select(rate.alias("rate"), aggregates.doubled_matches(F.col("matches0")).alias("doubled")).agg(F.count("*").alias("n"), F.avg("rate").alias("mean"), F.median("rate").alias("median"), F.count_if(F.col("doubled") > 0).alias("many"))
    return s.select(F.explode(F.array(F.format_string("rows: %d", "n"), F.format_string("mean match rate: %.4f", "mean"), F.format_string("median match rate: %.4f", "median"), F.format_string("rows with doubled matches: %d", "many"))).alias("line"))
