"""Queries of iterative operators, clusters, matching and streams, and their SQL where it can express them."""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.scan_ids import first_scan_id
from loomgraph.functions import embeddings, vectors
from loomgraph.operators import filters, graphs, kernels, matching, relational
from loomgraph.plans import pipelines
from loomgraph.plans.registry import registry
from loomgraph.plans.scene_queries import BASE, correspondence, matcher_rows, nodes, observations, placed_nodes
from loomgraph.session import cut_lineage, long_rows
from loomgraph.streaming import sync
from loomgraph.tables import table

QUERIES, SQL, query = registry()


def _node_points(spark: SparkSession, folder: str) -> DataFrame:
    return placed_nodes(spark, folder, "scan_id").select(F.col("scan_id").alias("scope"), F.col("node_key").alias("id"), "x", "y", "z")


def _clouds(spark: SparkSession, folder: str) -> DataFrame:
    """scan_id, instance_id, obs, points: the observed centers of each instance."""
    o = observations(spark, folder, "scan_id", "instance_id", "center").where("center is not null and instance_id >= 0")
    fine = F.array(*[F.col(f"center.{c}") for c in "xyz"])
    o = o.withColumn("p", fine).where(~F.exists("p", lambda v: v.isNull() | F.isnan(v)))
    return o.groupBy("scan_id", "instance_id").agg(F.sort_array(F.collect_list(F.struct("obs_id", "p"))).alias("s")).select("scan_id", "instance_id", F.col("s.obs_id").alias("obs"), F.col("s.p").alias("points"))


_NEAR = BASE + ", n as (select a.node_key as a, b.node_key as b from pla a join pla b on a.scan_id = b.scan_id and a.node_key <> b.node_key where sqrt((a.y - b.y)^2 + (a.z - b.z)^2 + (a.x - b.x)^2) < 1.0), core as (select a as id from n group by a having count(*) + 1 >= 3)"


_CLUSTERS = (
    "with recursive "
    + _NEAR.strip().removeprefix("with ")
    + """, l as (select n.a, n.b from n join core x on x.id = n.a join core y on y.id = n.b union select id, id from core), r as (select a, b from l union select r.a, l.b from r join l on l.a = r.b),
c as (select a as id, min(b) as cluster from r group by a), d as (select n.a as id, min(c.cluster) as cluster from n join c on c.id = n.b where n.a not in (select id from core) group by n.a),
k as (select p.scan_id as scope, p.node_key as id, coalesce(c.cluster, d.cluster) as cluster from pla p left join c on c.id = p.node_key left join d on d.id = p.node_key),
size as (select scope, cluster, count(*) as n from k where cluster is not null group by all)
"""
)
_EVERY_CORE = _CLUSTERS.replace("core as (select a as id from n group by a having count(*) + 1 >= 3)", "core as (select node_key as id from pla)")


@query(_CLUSTERS + "select id, coalesce(cluster, -1) as cluster from k")
def density_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """IT6: density clusters of the nodes of each scan, -1 for noise."""
    return graphs.dbscan(_node_points(spark, folder), 1.0, 3).select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


@query(_CLUSTERS + ", best as (select scope, arg_max(cluster, {'n': n, 'c': -cluster}) as best from size group by scope) select k.scope, k.id from k left join best using (scope) where best is null or cluster = best")
def largest_cluster(spark: SparkSession, folder: str) -> DataFrame:
    """IT6 IT14: the nodes of the largest cluster of each scan."""
    return graphs.largest_cluster(graphs.dbscan(_node_points(spark, folder), 1.0, 3))


@query(_EVERY_CORE + ", keep as (select scope, cluster from size where n >= 2 and n >= (select max(n) // 2 from size s where s.scope = size.scope)) select k.scope, k.id from k join keep using (scope, cluster)")
def euclidean_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """IT7: nodes of clusters of at least half the largest."""
    return graphs.clusters_of_half(graphs.dbscan(_node_points(spark, folder), 1.0, 1), 2)


_CLOUD = BASE + ", pt as (select scan_id, instance_id, obs_id, center.x as x, center.y as y, center.z as z, count(*) over (partition by scan_id, instance_id) as n from obs where instance_id >= 0 and center.x is not null and center.y is not null and center.z is not null and not isnan(center.x) and not isnan(center.y) and not isnan(center.z))"


@query(
    _CLOUD
    + """, d as (select a.scan_id, a.instance_id, a.obs_id, a.n, sqrt((a.x - b.x)^2 + (a.y - b.y)^2 + (a.z - b.z)^2) as d, row_number() over (partition by a.obs_id order by (a.x - b.x)^2 + (a.y - b.y)^2 + (a.z - b.z)^2) as k
  from pt a join pt b on a.scan_id = b.scan_id and a.instance_id = b.instance_id and a.obs_id <> b.obs_id where a.n > 2),
m as (select scan_id, instance_id, obs_id, avg(d) as m from d where k <= least(20, n - 1) group by all),
s as (select scan_id, instance_id, avg(m) as mean, stddev_samp(m) as dev from m group by all)
select obs_id from pt where n <= 2 union all select obs_id from m join s using (scan_id, instance_id) where m <= mean + 2 * dev + 1e-12"""
)
def outlier_removal(spark: SparkSession, folder: str) -> DataFrame:
    """IT5: observations of an instance that are no statistical outliers of its cloud."""

    def run(batches):
        for pdf in batches:
            stay = [np.asarray(o)[kernels.statistical_inliers(np.vstack(p), 20, 2.0)] for o, p in zip(pdf["obs"], pdf["points"])]
            yield pd.DataFrame({"obs_id": np.concatenate(stay) if stay else np.zeros(0, np.int64)})

    return _clouds(spark, folder).select("obs", "points").mapInPandas(run, "obs_id long")


@query()
def principal_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """AG23 FN-G6 IT14: oriented box of each instance's cloud."""

    def run(batches):
        for pdf in batches:
            boxes = [kernels.principal_box(np.vstack(p)) for p in pdf["points"]]
            yield pd.DataFrame({"scan_id": pdf["scan_id"], "instance_id": pdf["instance_id"], "center": [b[0].tolist() for b in boxes], "size": [b[1].tolist() for b in boxes]})

    return _clouds(spark, folder).mapInPandas(run, "scan_id string, instance_id int, center array<double>, size array<double>")


@query()
def entity_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """IT1 IT2 IT4 AG6: detections of a scan resolved to instances in the order of frames, then merged; one scan is one sequence."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame_id", "obs_id"])
        rows = zip(pdf["frame_id"], pdf["obs_id"], pdf["p"], pdf["feature"], pdf["object_name"])
        frames = ([(int(o), np.array([p]), np.array(f, float), n) for _, o, p, f, n in g] for _, g in groupby(rows, itemgetter(0)))
        of, instances = kernels.resolve_entities(frames, alike=0.8, overlap=0.3, radius=0.5)
        into = kernels.merge_instances(instances, apart=2.0, radius=0.5)

        def last(i: int) -> int:
            while i in into:
                i = into[i]
            return i

        return pd.DataFrame({"obs_id": list(of), "entity": [last(i) for i in of.values()], "scan_id": pdf["scan_id"].iloc[0]})

    from loomgraph.functions.vectors import usable

    o = observations(spark, folder, "scan_id", "frame_id", "instance_id", "feature", "object_name", "center")
    o = o.where(usable(F.col("feature"), 64) & F.col("center").isNotNull() & F.col("frame_id").isNotNull() & F.col("instance_id").isNotNull()).withColumn("p", F.array(*[F.col(f"center.{c}") for c in "xyz"])).where(~F.exists("p", lambda v: v.isNull() | F.isnan(v)))
    return kernels.per_group(o.select("scan_id", "frame_id", "obs_id", "feature", "object_name", "p"), ["scan_id"], run, "obs_id long, entity int, scan_id string")


def _matched(spark: SparkSession, folder: str, feature: str, where: str, similar: float | None = None) -> DataFrame:
    n = placed_nodes(spark, folder, "scan_id", "name", feature).where(where)
    n = n.select(first_scan_id(F.col("scan_id")).alias("scene"), "scan_id", F.col("node_key").alias("id"), "node_id", "name", F.col(feature).alias("feature"), "x", "y", "z")
    c = _clouds(spark, folder).withColumnRenamed("instance_id", "node_id")
    clouds = n.join(c, ["scan_id", "node_id"]).select("id", "points")
    pairs = matching.candidates(n.where("scan_id = scene"), n.where("scan_id <> scene"), apart=3.0, similar=similar)
    if similar is not None:
        pairs = cut_lineage(pairs)  # they are used twice, and all near pairs of a scene are compared to find them
    return matching.best_matches(pairs, matching.overlaps(pairs, clouds, 1.0), final_gap=3.0)  # scans are not aligned here


@query()
def instance_matching(spark: SparkSession, folder: str) -> DataFrame:
    """JN13 JN15 FL5 FL6 FN-V4: instances of rescans matched to the first scan by name, center and cloud."""
    return _matched(spark, folder, "visual_embedding", "name is not null and lower(trim(name)) <> 'unknown'")


@query()
def embedding_matching(spark: SparkSession, folder: str) -> DataFrame:
    """JN12 JN14 JN15 FL5 FL6 FN-V4: the same by the embedding of the name instead of the name itself, so that spellings and aliases match."""
    return _matched(spark, folder, "text_embedding", "coalesce(lower(trim(name)), '') <> 'unknown'", 0.4)


ALIGNED = "scan_id string, pairs int, agreeing int, t array<double>"


def _aligned(pdf: pd.DataFrame) -> pd.DataFrame:
    """Transform of one scan out of its pairs of points."""
    pdf = pdf.sort_values(["node_id"])
    a, b = np.vstack(pdf["a"]), np.vstack(pdf["b"])
    good, t = kernels.ransac_fit(a, b, 0.3)
    t = kernels.icp(a, b, 0.3, start=t)
    return pd.DataFrame({"scan_id": [pdf["scan_id"].iloc[0]], "pairs": [len(a)], "agreeing": [int(good.sum())], "t": [t.ravel().tolist()]})


@query()
def registration(spark: SparkSession, folder: str) -> DataFrame:
    """IT9 IT10 SK11: transform of each rescan onto its first scan, from the corresponding nodes, by consensus, then refined."""
    at = placed_nodes(spark, folder, "scan_id").select("scan_id", "node_id", F.array("x", "y", "z").alias("p"))
    c = correspondence(spark, folder).where("instance_id_in_00 <> -1").select("scan_id", "first_scan", F.col("instance_id").alias("node_id"), "instance_id_in_00")
    both = c.join(at.withColumnRenamed("p", "a"), ["scan_id", "node_id"]).join(at.select(F.col("scan_id").alias("first_scan"), F.col("node_id").alias("instance_id_in_00"), F.col("p").alias("b")), ["first_scan", "instance_id_in_00"])

    return kernels.per_group(both.select("scan_id", "node_id", "a", "b"), ["scan_id"], _aligned, ALIGNED)


@query()
def box_suppression(spark: SparkSession, folder: str) -> DataFrame:
    """IT12: boxes of a frame that no better one overlaps."""

    def run(batches):
        for pdf in batches:
            stay = [[own[i]["obs_id"] for i in kernels.suppress(np.array([[r[c] for c in ("x0", "y0", "x1", "y1")] for r in own]), np.array([r["confidence"] for r in own]))] for own in pdf["boxes"]]
            yield pd.DataFrame({"obs_id": np.array([i for s in stay for i in s], np.int64)})

    o = observations(spark, folder, "scan_id", "frame_id", "confidence", "center", "bbox_size").where("frame_id is not null and center.x is not null and center.y is not null and bbox_size.x is not null and bbox_size.y is not null")
    box = [F.col(f"center.{c}") + s * F.col(f"bbox_size.{c}") / 2 for s in (-1, 1) for c in "xy"]
    o = o.select("scan_id", "frame_id", "obs_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), *[b.alias(n) for b, n in zip(box, ("x0", "y0", "x1", "y1"))])
    frames = o.groupBy("scan_id", "frame_id").agg(F.sort_array(F.collect_list(F.struct("obs_id", "confidence", "x0", "y0", "x1", "y1"))).alias("boxes"))  # the boxes of one image
    return frames.select("boxes").mapInPandas(run, "obs_id long")


_PIXELS = BASE + ", px as (select match_id as frame, generate_subscripts(keypoints0, 1) % 3 as id, floor(unnest(keypoints0)[1] * 5)::int as pixel from mat), m as (select distinct * from px where pixel is not null)"


def _pixels(spark: SparkSession, folder: str) -> DataFrame:
    k = matcher_rows(spark, folder).select(F.col("match_id").alias("frame"), F.posexplode("keypoints0").alias("pos", "p"))
    return k.select("frame", ((F.col("pos") + 1) % 3).alias("id"), F.floor(F.col("p")[0] * 5).cast("int").alias("pixel")).where("pixel is not null").distinct()


@query(_PIXELS + ", s as (select frame, id, count(*) as n from m group by all), r as (select *, row_number() over (partition by frame order by n desc, id) as label from s) select frame, pixel, max(label)::int as label from m join r using (frame, id) group by frame, pixel")
def painted_masks(spark: SparkSession, folder: str) -> DataFrame:
    """IT13 WN4: smaller masks over larger ones."""
    return matching.painted(_pixels(spark, folder))


@query(
    _PIXELS
    + """, a as (select * from m where id = 0), b as (select * from m where id <> 0), na as (select frame, id, count(*) as n from a group by all), nb as (select frame, id, count(*) as n from b group by all),
i as (select a.frame, a.id as mask, b.id as instance, count(*) as s from a join b using (frame, pixel) group by all), u as (select i.frame, mask, instance, s / (na.n + nb.n - s) as iou from i join na on na.frame = i.frame and na.id = mask join nb on nb.frame = i.frame and nb.id = instance),
r as (select *, row_number() over (partition by frame, mask order by iou desc, instance) as k from u where iou > 0.1)
select na.frame, na.id::int as mask, coalesce(r.instance, 0)::int as instance, round(coalesce(r.iou, 0), 6) as iou from na left join r on r.frame = na.frame and r.mask = na.id and r.k = 1"""
)
def mask_matching(spark: SparkSession, folder: str) -> DataFrame:
    """JN24: masks with the instance they overlap most."""
    m = _pixels(spark, folder)
    return matching.mask_overlap(m.where("id = 0"), m.where("id <> 0")).withColumn("iou", F.round("iou", 6))


def _training(spark: SparkSession, folder: str, **shape: bool) -> DataFrame:
    """Rows of rescans' frames against the map of the first scan."""
    long_rows(spark)
    o = table(spark, folder, "instance_info", "obs_id", "scan_id", "frame_id", "instance_id", "center", "bbox_size", "feature", "bert_embedding")
    o = relational.once(o.where("instance_id >= 0 and frame_id is not null and center is not null and bbox_size is not null and not scan_id like '%\\_00'"), "obs_id")
    first = first_scan_id(F.col("scan_id"))
    source = o.select(F.concat_ws("/", "scan_id", F.col("frame_id").cast("string")).alias("frame"), first.alias("map"), F.concat_ws("/", "scan_id", F.col("instance_id").cast("string")).alias("id"), *[F.col(f"center.{c}").alias(c) for c in "xyz"], F.col("bbox_size.y").alias("h"), F.col("bbox_size.x").alias("w"), F.col("bbox_size.z").alias("l"), "feature", F.col("bert_embedding").alias("text"))
    n = placed_nodes(spark, folder, "scan_id", "name", "shape", "visual_embedding", "text_embedding").where("scan_id like '%\\_00' and name is not null and lower(trim(name)) <> 'unknown'")
    target = n.select(F.col("scan_id").alias("map"), F.col("node_key").alias("ord"), F.concat_ws("/", "scan_id", F.col("node_id").cast("string")).alias("id"), "x", "y", "z", F.col("shape.height").cast("double").alias("h"), F.col("shape.width").cast("double").alias("w"), F.col("shape.length").cast("double").alias("l"), F.col("visual_embedding").alias("feature"), F.col("text_embedding").alias("text"))
    c = correspondence(spark, folder).where("instance_id_in_00 <> -1")
    truth = c.select(F.col("first_scan").alias("map"), F.concat_ws("/", "scan_id", F.col("instance_id").cast("string")).alias("id"), F.concat_ws("/", "first_scan", F.col("instance_id_in_00").cast("string")).alias("target_id")).distinct()
    return matching.matcher_rows(source, target, truth, **shape)


@query()
def training_rows(spark: SparkSession, folder: str) -> DataFrame:
    """JN4 PR1 PR2 PR7 FN-V7 FN-V8 FN-V9: keypoints, descriptors and boxes, in one joint range."""
    return _training(spark, folder)


@query()
def training_texts(spark: SparkSession, folder: str) -> DataFrame:
    """PR7: the full row, with the embeddings of the names, the scene and the map."""
    return _training(spark, folder, texts=True)


_SIZES = """, src as (select scan_id || '/' || frame_id as frame, scan_id, regexp_extract(scan_id, '(scene\\d+)_', 1) || '_00' as map, scan_id || '/' || instance_id as id, center.x as x, center.y as y, center.z as z from obs
  where instance_id >= 0 and frame_id is not null and center is not null and bbox_size is not null and not scan_id like '%\\_00' escape '\\'),
tgt as (select scan_id as map, row_number() over (partition by scan_id order by node_key) - 1 as pos, scan_id || '/' || node_id as id, x, y, z from pla where scan_id like '%\\_00' escape '\\' and name is not null and lower(trim(name)) <> 'unknown'),
allp as (select map, unnest([x, y, z]) as v, [x, y, z] as p from src union all select map, unnest([x, y, z]), [x, y, z] from tgt),
bound as (select map, min(v) as lo, max(v) as hi from allp group by map),
tru as (select distinct first_scan as map, scan_id || '/' || instance_id as id, first_scan || '/' || instance_id_in_00 as target_id from cor where instance_id_in_00 <> -1),
hop as (select tru.map, tru.id, min(pos) as match from tru join tgt on tgt.map = tru.map and tgt.id = tru.target_id group by all),
rows as (select src.map, src.frame, count(*) as objects, round(sum((x - (lo - 0.1 * (hi - lo))) / (1.2 * (hi - lo))), 5) as x_sum, sum(coalesce(match, -1))::bigint as match_sum from src join bound using (map) left join hop on hop.map = src.map and hop.id = src.id group by all having count(*) >= 2),
maps as (select map, count(*) as nodes from tgt group by map)
select frame as frame_id, map as scene_graph_id, objects::int as objects, nodes::int as nodes, x_sum, match_sum from rows join maps using (map)"""


@query(BASE + _SIZES)
def training_points(spark: SparkSession, folder: str) -> DataFrame:
    """PR7: the shape without boxes; of each row its objects, the nodes of its map, and the sums of first coordinates and of matches."""
    t = _training(spark, folder, boxes=False)
    plus = lambda c, f: F.aggregate(c, F.lit(0.0), lambda a, v: a + f(v))
    return t.select("frame_id", "scene_graph_id", F.size("keypoints0").alias("objects"), F.size("keypoints1").alias("nodes"), F.round(plus("keypoints0", lambda p: p[0]), 5).alias("x_sum"), plus("matches0", lambda m: m).cast("long").alias("match_sum"))


# streams


_TOPICS = "with c as (select user_id as key, event_id as id, ts from events where event_type = 'click'), v as (select user_id as key, event_id as id, ts from events where event_type = 'view')"


@query(_TOPICS + " select c.key, c.id as a, v.id as b from c join v on c.key = v.key and v.ts between c.ts - interval 1 hour and c.ts + interval 1 hour")
def stream_sync(spark: SparkSession, folder: str) -> DataFrame:
    """JN25 SM1 SC27: two topics joined within a slop, as streams with watermarks."""
    e = sync.as_stream(spark, folder, "events")
    topic = lambda t: e.where(F.col("event_type") == t).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts")
    return sync.run_to_end(sync.interval_pairs(topic("click"), topic("view"), "1 hour")).select("key", "a", "b")


@query()
def stream_queue_one(spark: SparkSession, folder: str) -> DataFrame:
    """SM1: one-to-one pairs with a queue of one per topic."""
    e = sync.as_stream(spark, folder, "events").where("event_type in ('click', 'view')")
    both = e.select(F.col("user_id").alias("key"), F.when(F.col("event_type") == "click", "left").otherwise("right").alias("topic"), F.col("event_id").alias("id"), "ts")
    return sync.run_to_end(sync.latest_pairs(both, 3600.0))


@query("select user_id, max(ts) as ts, arg_max(value, {'t': ts, 'v': value}) as value from events where value is not null group by user_id")
def stream_latest(spark: SparkSession, folder: str) -> DataFrame:
    """SM2: last value of each user, as a stream."""
    e = sync.as_stream(spark, folder, "events").where("value is not null").select("user_id", "value", "ts")
    return sync.run_to_end(sync.latest(e, "user_id", "value", "ts"), "complete")


@query("select label::bigint as scope, floor(embedding[1]::double / 0.2)::bigint as vx, floor(embedding[2]::double / 0.2)::bigint as vy, floor(embedding[3]::double / 0.2)::bigint as vz, round(sum(embedding[1]::double), 5) as sx, count(*) as n from embeddings group by 1, 2, 3, 4")
def stream_compaction(spark: SparkSession, folder: str) -> DataFrame:
    """SM4 ST4: running voxel sums of a growing cloud."""
    e = sync.as_stream(spark, folder, "embeddings")
    p = e.select(F.col("label").cast("long").alias("scope"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    return sync.run_to_end(sync.compacted(p, 0.2), "complete").select("scope", "vx", "vy", "vz", F.round("sx", 5).alias("sx"), "n")


# whole jobs


@query(
    BASE
    + """, s as (select scan_id, instance_id, count(*) as n, avg(center.x) filter (isfinite(center.x) and isfinite(center.y) and isfinite(center.z)) as x, avg(center.y) filter (isfinite(center.x) and isfinite(center.y) and isfinite(center.z)) as y, avg(center.z) filter (isfinite(center.x) and isfinite(center.y) and isfinite(center.z)) as z from obs where instance_id >= 0 group by all having count(*) >= 2),
k as (select * from s where x is not null),
e as (select a.scan_id, count(*) as edges from k a join k b on a.scan_id = b.scan_id and a.instance_id < b.instance_id where sqrt((a.y - b.y)^2 + (a.z - b.z)^2 + (a.x - b.x)^2) < 1.0 group by a.scan_id)
select k.scan_id, count(*) as nodes, coalesce(any_value(e.edges), 0) as edges from k left join e using (scan_id) group by k.scan_id"""
)
def map_construction(spark: SparkSession, folder: str) -> DataFrame:
    """JN2 JN8 AG1 AG2 AG18 FL7 PR8 SK1 SC1: observations to graph documents and back, nodes and edges per scan."""
    from loomgraph.sources import files

    docs = pipelines.build_maps(observations(spark, folder, "scan_id", "instance_id", "object_name", "feature", "center"), radius=1.0)
    g = files.parse_graph(docs.select(F.col("scan_id").alias("file_path"), F.col("json").alias("value")))
    sizes = files.graph_sizes(g).groupBy(F.col("file_path").alias("scan_id")).agg(F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges"))
    return sizes.where("nodes > 0")


@query(
    BASE
    + """select count(*) filter (object_name is not null and trim(object_name) <> '' and lower(trim(object_name)) <> 'unknown') as named, count(*) filter (confidence > 0.3 and not isnan(confidence)) as alike,
count(*) filter (bbox_size.x <= 3 and bbox_size.y <= 3 and bbox_size.z <= 3) as solid, count(*) filter (frame_id % 3 = 0) as sampled, count(*) filter (object_name is not null and not contains(object_name, 'chair') and not contains(object_name, 'Wall')) as clean,
count(*) filter (regexp_extract(scan_id, 'scene(\\d+)', 1)::int between 1 and 3) as ranged, count(*) filter (regexp_extract(scan_id, 'scene(\\d+)', 1)::int < 600) as training from obs"""
)
def filter_counts(spark: SparkSession, folder: str) -> DataFrame:
    """FL1 FL3 FL8 FL12 FL14 FL15: how many observations pass each predicate."""
    from loomgraph.functions.scan_ids import scene_number

    o = observations(spark, folder, "scan_id", "frame_id", "object_name", "confidence", "bbox_size")
    n = scene_number(F.col("scan_id"))
    return o.agg(
        F.count_if(filters.named(F.col("object_name"))).alias("named"),
        F.count_if(filters.alike(F.col("confidence"), 0.3)).alias("alike"),
        F.count_if(filters.solid(F.col("bbox_size"), F.lit(10))).alias("solid"),
        F.count_if(F.coalesce(filters.sampled(F.col("frame_id"), 3), F.lit(False))).alias("sampled"),
        F.count_if(filters.without_parts(F.col("object_name"), ["chair", "Wall"])).alias("clean"),
        F.count_if(filters.scenes_between(n, 1, 3)).alias("ranged"),
        F.count_if(filters.is_training(n)).alias("training"),
    )


@query(
    BASE
    + """, w as (select distinct scan_id, (frame_id // 300)::int as win, unnest(range(frame_id // 300 * 300, frame_id // 300 * 300 + 300, 3)) as f from obs where frame_id is not null), p as (select distinct scan_id, frame_id as f from obs where frame_id is not null)
select w.scan_id, w.win from w left join p on p.scan_id = w.scan_id and p.f = w.f group by all having avg((p.f is not null)::int) >= 0.5"""
)
def present_subscans(spark: SparkSession, folder: str) -> DataFrame:
    """FL18: subscans of 100 frames of which at least half are there."""
    o = observations(spark, folder, "scan_id", "frame_id").where("frame_id is not null").select("scan_id", "frame_id").distinct().withColumn("win", (F.col("frame_id") / 300).cast("int"))
    wanted = o.select("scan_id", "win").distinct().withColumn("frame_id", F.explode(F.sequence(F.col("win") * 300, F.col("win") * 300 + 297, F.lit(3))))
    return filters.present_enough(wanted, o, ["scan_id", "win"], "frame_id")


@query(BASE + ", c as (select scan_id, node_id from nod where node_id % 2 = 1) select obs_id from obs where exists (select 1 from c where c.scan_id = obs.scan_id and c.node_id = obs.instance_id) or instance_id = 0")
def points_by_valid_ids(spark: SparkSession, folder: str) -> DataFrame:
    """FL16 AG9: observations of valid ids, the background kept."""
    valid = nodes(spark, folder, "scan_id").where("node_id % 2 = 1").select("scan_id", F.col("node_id").alias("instance_id"))
    return filters.points_of(observations(spark, folder, "scan_id", "instance_id"), valid, ["scan_id"], "instance_id", keep_background=True).select("obs_id")


@query()
def text_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """UD1 UD2 FL13: hashed embedding of each distinct name and how like a denied name it is."""
    n = observations(spark, folder, "object_name").where("object_name is not null").select("object_name").distinct()
    n = n.repartition(spark.sparkContext.defaultParallelism, "object_name")  # few bytes, but much work per name
    v, wall = embeddings.hashed_embedding(F.col("object_name")), embeddings.hashed_embedding(F.lit("wall"))
    like = embeddings.let(v, lambda a: embeddings.let(wall, lambda b: F.coalesce(F.round(vectors.cosine(a, b), 6), F.lit(0.0))))
    return n.withColumn("like_wall", like).where(filters.allowed_tag(F.col("object_name"), F.col("like_wall"), 0.8)).select("object_name", "like_wall")


@query()
def matcher_summary(spark: SparkSession, folder: str) -> DataFrame:
    """SK15 SK16 AG14: report of the matcher rows."""
    return pipelines.summary(matcher_rows(spark, folder))
