"""Splits that keep related records together.

Connected components (alternating large and small stars, each a min aggregation and an equi-join) give the groups. Their
sizes are balanced by largest differencing: the extremes of the two most uneven partial solutions are combined until one
set of many near-equal bins is left, and whole bins go to the splits by target proportion.

Defined cases. A row naming no scene belongs to no group and gets no split. Repeated rows with one match_id count once.
A group is never cut, so one with more rows than a split's share goes where the most is wanting. Ties go to the smaller
group, then to the earlier split. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scan_ids import scene_number
from loomgraph.operators.graphs import connected_components
from loomgraph.session import cut_lineage

#: Weights handed to the balancer: groups of more than total / PARCELS rows by themselves, the rest pooled by hash into
#: PARCELS parcels; at most 2 * PARCELS in all, whatever the input.
PARCELS = 2048
BINS = 40
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: A node table up to this many rows (16 bytes each) is broadcast.
BROADCAST_ROWS = 500_000


def _join_small(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Left join with a table of one row per key: broadcast under a checked size, else shuffled, where adaptive execution splits hot keys."""
    return rows.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, key, "left")


def scene_groups(rows: DataFrame, key: str = "match_id", fields: Sequence[str] = ("scene_graph_id", "frame_scene")) -> DataFrame:
    """key, group_scene: the smallest scene number in the group of each row that names a scene."""
    named = rows.select(key, *[scene_number(F.col(f)).alias(f"_s{i}") for i, f in enumerate(fields)]).dropDuplicates([key])
    scenes = [f"_s{i}" for i in range(len(fields))]
    first = F.coalesce(*scenes)
    named = named.where(first.isNotNull()).withColumn("_scene", first)
    pairs = named.select(F.explode(F.array(*[F.struct(F.col("_scene").alias("a"), F.col(s).alias("b")) for s in scenes])).alias("p")).select("p.a", "p.b").where("a is not null and b is not null and a <> b").distinct()
    component = cut_lineage(connected_components(pairs).withColumnRenamed("node", "_scene"))
    return _join_small(named, component, "_scene").select(key, F.coalesce("component", "_scene").cast("int").alias("group_scene"))


def largest_differencing(weights: Sequence[tuple[int, object]], bins: int) -> list[tuple[int, list]]:
    """(sum, members) of bins near-equal sets of the weighted members."""
    heap, n = [], 0
    for w, x in sorted(weights, key=lambda p: (-p[0], str(p[1]))):
        heapq.heappush(heap, (-w, n, [(0, [])] * (bins - 1) + [(w, [x])]))
        n += 1
    while len(heap) > 1:
        (_, _, left), (_, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        both = sorted(((p[0] + q[0], p[1] + q[1]) for p, q in zip(left, reversed(right))), key=lambda s: s[0])
        heapq.heappush(heap, (both[0][0] - both[-1][0], n, both))
        n += 1
    return heap[0][2] if heap else []


def allocate(bins: Sequence[tuple[int, list]], shares: Mapping[str, float]) -> dict[object, str]:
    """Split of every member: heaviest bin first, to the split that lacks the most of its share."""
    total = sum(w for w, _ in bins)
    lacking = {s: p * total for s, p in shares.items()}
    out = {}
    for w, members in sorted(bins, key=lambda b: -b[0]):
        to = max(lacking, key=lambda s: lacking[s])
        lacking[to] -= w
        out |= dict.fromkeys(members, to)
    return out


def assign_splits(groups: DataFrame, shares: Mapping[str, float] = SHARES, group: str = "group_scene", bins: int = BINS) -> DataFrame:
    """groups with `split`; all rows of a group get the same."""
    spark = groups.sparkSession
    sizes = cut_lineage(groups.groupBy(group).agg(F.count("*").alias("w")))
    total = sizes.agg(F.sum("w")).first()[0] or 0
    parcel = F.when(F.col("w") * PARCELS > total, F.concat(F.lit("g"), F.col(group))).otherwise(F.concat(F.lit("p"), F.pmod(F.xxhash64(group), F.lit(PARCELS))))
    parcels = sizes.withColumn("parcel", parcel)
    weights = [(r["w"], r["parcel"]) for r in parcels.groupBy("parcel").agg(F.sum("w").alias("w")).collect()]  # at most 2 * PARCELS rows
    split = allocate(largest_differencing(weights, bins), shares)
    names = spark.createDataFrame(list(split.items()), "parcel string, split string")
    of = cut_lineage(parcels.join(F.broadcast(names), "parcel").select(group, "split"))
    return _join_small(groups, of, group)


def share_report(assigned: DataFrame, shares: Mapping[str, float] = SHARES, group: str = "group_scene", bins: int = BINS) -> DataFrame:
    """split, target, groups_cut, fits of each split of assign_splits.

    groups_cut: groups with rows here and in another split. fits: the rows differ from the target by no more than the
    largest group or the weight of a bin, whichever is more, for no group is cut and bins go as wholes.
    """
    spark = assigned.sparkSession
    sizes = cut_lineage(assigned.groupBy(group, "split").agg(F.count("*").alias("w")))
    per = sizes.groupBy(group).agg(F.sum("w").alias("w"), F.countDistinct("split").alias("splits"))
    total, largest = per.agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.max("w"), F.lit(0))).first()
    cut = sizes.join(per.where("splits > 1").select(group), group).groupBy("split").agg(F.count("*").alias("groups_cut"))
    rows = sizes.groupBy("split").agg(F.sum("w").alias("rows"))
    wanted = spark.createDataFrame(sorted(shares.items()), "split string, target double")
    out = wanted.join(rows, "split", "left").join(cut, "split", "left")
    fits = F.abs(F.coalesce("rows", F.lit(0)) - F.col("target") * total) <= max(largest, total / bins)
    return out.select("split", "target", F.coalesce("groups_cut", F.lit(0)).cast("int").alias("groups_cut"), fits.alias("fits"))
