"""Queries of the scene-graph operators and their SQL; each docstring names the inventory ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import geometry, text, vectors
from loomgraph.functions.scan_ids import first_scan_id, scan_id, scan_number, scene_number, subscan_range
from loomgraph.operators import aggregates, ranking, relational, spatial
from loomgraph.plans.registry import registry
from loomgraph.tables import table

QUERIES, SQL, query = registry()

# the base tables, each row once


def observations(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "instance_info", "obs_id", *[c for c in columns if c != "obs_id"]).dropDuplicates(["obs_id"])


def nodes(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    df = table(spark, folder, "object_node").select("node_key", *[F.col(c) for c in columns if c not in ("node_key", "node_id", "x", "y", "z")], F.col("id").try_cast("int").alias("node_id"), *[F.try_element_at("node_position", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz", 1)])
    return df.dropDuplicates(["node_key"])


def placed_nodes(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return nodes(spark, folder, *columns).where(spatial.finite("x", "y", "z"))


def correspondence(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "matched_instance_correspondence_to_00").dropDuplicates(["corr_id"])
    return df.select("corr_id", scan_id(F.col("scan_id")).alias("scan_id"), first_scan_id(F.col("scan_id")).alias("first_scan"), "instance_id", "instance_id_in_00", "matched_at")


def matcher_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "matcher_row").dropDuplicates(["match_id"])


BASE = r"""
with obs as (select distinct on (obs_id) * from instance_info),
nod as (select distinct on (node_key) *, try_cast(id as int) as node_id, node_position[1]::double as x, node_position[2]::double as y, node_position[3]::double as z from object_node),
pla as (select * from nod where isfinite(x) and isfinite(y) and isfinite(z)),
cor0 as (select distinct on (corr_id) *, regexp_extract(lower(scan_id), 'scene[\s_-]*(\d+)[\s_-]+(\d+)', 1) as a, regexp_extract(lower(scan_id), 'scene[\s_-]*(\d+)[\s_-]+(\d+)', 2) as b from matched_instance_correspondence_to_00),
cor as (select corr_id, 'scene' || lpad(a, 4, '0') || '_' || lpad(b, 2, '0') as scan_id, 'scene' || lpad(a, 4, '0') || '_00' as first_scan, instance_id, instance_id_in_00, matched_at from cor0),
mat as (select distinct on (match_id) * from matcher_row),
nam as (select distinct on (map_row_id) * from instance_name_map)
"""
VALID = "list_bool_and(list_transform({c}, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform({c}, lambda x: x <> 0)) and len({c}) = 64"


# vectors


@query(
    """with e as (select vec_id, embedding::double[] as v, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings),
p as (select q.vec_id as query_id, e.vec_id, round(list_dot_product(q.v, e.v) / (q.n * e.n), 6) as sim from e q join e on q.vec_id <> e.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by sim desc, vec_id) as rank from p where sim > 0.2)
select query_id, vec_id, sim, rank::int as rank from r where rank <= 5"""
)
def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """WN1 FN-V2 FL3: the 5 nearest of every vector whose id is divisible by 100, against all."""
    e = table(spark, folder, "embeddings", "vec_id", "embedding").withColumn("n", vectors.norm(F.col("embedding"))).where("n > 0")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("n").alias("qn"))
    sim = F.round(vectors.dot(F.col("q"), F.col("embedding")) / (F.col("qn") * F.col("n")), 6)
    pairs = relational.in_blocks(e, q, "vec_id").where("vec_id <> query_id").withColumn("sim", sim).where("sim > 0.2")
    return ranking.top_k(pairs, ["query_id"], 5, F.desc("sim"), "vec_id").select("query_id", "vec_id", "sim", F.col("rank").cast("int").alias("rank"))


@query(
    BASE
    + f"""select scan_id, instance_id, avg(feature[1]::double) as f1, avg(feature[32]::double) as f32, avg(feature[64]::double) as f64, count(*) as occurance
from obs where instance_id >= 0 and feature is not null and {VALID.format(c="feature")} group by scan_id, instance_id"""
)
def vector_mean_by_instance(spark: SparkSession, folder: str) -> DataFrame:
    """AG1 AG27 AG6: mean feature and occurrences of each instance."""
    m = aggregates.mean_vectors(observations(spark, folder, "scan_id", "instance_id", "feature").where("instance_id >= 0"), ["scan_id", "instance_id"], "feature", 64)
    return m.select("scan_id", "instance_id", *[F.col("feature")[i - 1].alias(f"f{i}") for i in (1, 32, 64)], "occurance")


@query(BASE + """select node_key, round((visual_embedding[1]::double + text_embedding[1]::double) / 2, 6) as first, greatest(len(visual_embedding), len(text_embedding))::int as size from nod where visual_embedding is not null and text_embedding is not null""")
def vector_midpoint(spark: SparkSession, folder: str) -> DataFrame:
    """PR10: stored vector overwritten by half old, half new."""
    n = nodes(spark, folder, "visual_embedding", "text_embedding").where("visual_embedding is not null and text_embedding is not null")
    mid = vectors.midpoint(F.col("visual_embedding"), F.col("text_embedding"))
    return n.select("node_key", F.round(F.try_element_at(mid, F.lit(1)), 6).alias("first"), F.size(mid).alias("size"))


@query(
    BASE
    + f"""select o.obs_id, round(list_dot_product(o.f, n.v) / (sqrt(list_dot_product(o.f, o.f)) * sqrt(list_dot_product(n.v, n.v)) + 1e-6), 5) as sim
from (select *, feature::double[] as f from obs where feature is not null and {VALID.format(c="feature")}) o
join (select *, visual_embedding::double[] as v from nod where visual_embedding is not null and {VALID.format(c="visual_embedding")}) n on n.scan_id = o.scan_id and n.node_id = o.instance_id"""
)
def observation_node_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """FN-V3 JN26: smoothed cosine of an observation with its node, joined by the id as text."""
    o = observations(spark, folder, "scan_id", "instance_id", "feature").where(vectors.usable(F.col("feature"), 64))
    n = nodes(spark, folder, "scan_id", "visual_embedding").where(vectors.usable(F.col("visual_embedding"), 64)).select("scan_id", F.col("node_id").alias("instance_id"), "visual_embedding")
    return o.join(n, ["scan_id", "instance_id"]).select("obs_id", F.round(vectors.cosine_smoothed(F.col("feature"), F.col("visual_embedding")), 5).alias("sim"))


@query(
    BASE
    + """, k as (select match_id, unnest(keypoints0) as p, generate_subscripts(keypoints0, 1) as pos from mat),
r as (select match_id, pos, p, min(p[1]) over (partition by match_id) as lo, max(p[1]) over (partition by match_id) as hi from k where p[1] is not null)
select match_id, (pos - 1)::int as pos, round(case when hi - lo > 0 then (p[1] - (lo - 0.1 * (hi - lo))) / (1.2 * (hi - lo)) end, 6) as nx from r"""
)
def minmax_normalise(spark: SparkSession, folder: str) -> DataFrame:
    """FN-V5 FN-V6 FN-V7: first coordinate in the widened range of its row."""
    k = matcher_rows(spark, folder).select("match_id", F.transform(F.filter("keypoints0", lambda p: p[0].isNotNull()), lambda p: p[0]).alias("xs"))
    lo, hi = vectors.margin(F.array_min("xs"), F.array_max("xs"))
    norm = vectors.normalise(F.col("xs"), lo, hi)
    return k.select("match_id", F.posexplode(norm).alias("pos", "nx")).select("match_id", "pos", F.round("nx", 6).alias("nx"))


@query(BASE + "select match_id, round(list_sum(list_transform(flatten(bbox0), lambda b: greatest(0.0, least(1.0, b / 0.8)))), 6) as total from mat where bbox0 is not null")
def bbox_clip(spark: SparkSession, folder: str) -> DataFrame:
    """FN-V8: box sides as shares of a width, clipped to [0, 1]."""
    sides = F.transform(F.flatten("bbox0"), lambda b: vectors.clip_unit(b / 0.8))
    return matcher_rows(spark, folder).where("bbox0 is not null").select("match_id", F.round(F.aggregate(sides, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


# joins


@query(
    BASE
    + """, m as (select scan_id, instance_id, arg_max(name, {'a': added_at, 'i': map_row_id}) as name from nam where removed_at is null group by scan_id, instance_id),
f as (select scan_id, instance_id, count(*) as n from obs where feature is not null group by scan_id, instance_id)
select nod.node_key, coalesce(m.name, 'unknown') as map_name, coalesce(f.n, 0) as features from nod left join m on m.scan_id = nod.scan_id and m.instance_id = nod.node_id left join f on f.scan_id = nod.scan_id and f.instance_id = nod.node_id"""
)
def lookup_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """JN2: node with its standing name and its vectors, or what stands for none."""
    n = nodes(spark, folder, "scan_id").withColumnRenamed("node_id", "instance_id")
    standing = table(spark, folder, "instance_name_map").dropDuplicates(["map_row_id"]).where("removed_at is null").select("scan_id", "instance_id", F.col("name").alias("map_name"), "added_at", "map_row_id")
    names = relational.last_per_key(standing, ["scan_id", "instance_id"], ["added_at", "map_row_id"]).select("scan_id", "instance_id", "map_name")
    f = observations(spark, folder, "scan_id", "instance_id", "feature").where("feature is not null").groupBy("scan_id", "instance_id").agg(F.count("*").alias("features"))
    out = relational.lookup(n, names, ["scan_id", "instance_id"], {"map_name": F.lit("unknown")})
    return relational.lookup(out, f, ["scan_id", "instance_id"], {"features": F.lit(0)}).select("node_key", "map_name", "features")


@query(
    BASE
    + """, b as (select scan_id, instance_id, arg_max({'s': bbox_size, 'o': obs_id}, obs_id) as r from obs where bbox_size is not null and instance_id >= 0 group by scan_id, instance_id)
select o.obs_id, b.r.o as box_obs, round(b.r.s.x * b.r.s.y * b.r.s.z, 6) as volume from obs o join b on b.scan_id = o.scan_id and b.instance_id = o.instance_id"""
)
def build_side_dedupe_join(spark: SparkSession, folder: str) -> DataFrame:
    """JN1 SC2 FN-V10: observations joined to boxes of which the last per key counts."""
    o = observations(spark, folder, "scan_id", "instance_id", "bbox_size")
    boxes = o.where("bbox_size is not null and instance_id >= 0").select("scan_id", "instance_id", F.col("obs_id").alias("box_obs"), "bbox_size")
    last = relational.last_per_key(boxes, ["scan_id", "instance_id"], ["box_obs"])
    return o.select("obs_id", "scan_id", "instance_id").join(last, ["scan_id", "instance_id"]).select("obs_id", "box_obs", F.round(vectors.box_volume(F.col("bbox_size")), 6).alias("volume"))


@query(BASE + "select node_key from nod semi join (select scan_id, instance_id from obs where bbox_size is not null) o on o.scan_id = nod.scan_id and o.instance_id = nod.node_id")
def nodes_with_box(spark: SparkSession, folder: str) -> DataFrame:
    """JN3: nodes of which some observation has a box."""
    o = observations(spark, folder, "scan_id", "instance_id", "bbox_size").where("bbox_size is not null").select("scan_id", F.col("instance_id").alias("node_id"))
    return nodes(spark, folder, "scan_id").join(o, ["scan_id", "node_id"], "left_semi").select("node_key")


_POSITIONS = ", pos as (select scan_id, node_id, row_number() over (partition by scan_id order by node_key) - 1 as p from nod where name is not null and lower(trim(name)) <> 'unknown')"


def _node_positions(spark: SparkSession, folder: str) -> DataFrame:
    n = nodes(spark, folder, "scan_id", "name").where("name is not null and lower(trim(name)) <> 'unknown'")
    return n.select("scan_id", "node_id", ranking.position(["scan_id"], "node_key").alias("p"))


@query(
    BASE
    + _POSITIONS
    + """, c as (select scan_id, first_scan, instance_id, min(instance_id_in_00) as target from cor where instance_id_in_00 <> -1 group by scan_id, first_scan, instance_id),
q as (select scan_id, node_id, min(p) as p from pos group by scan_id, node_id)
select o.obs_id, coalesce(q.p, -1)::int as match from obs o left join c on c.scan_id = o.scan_id and c.instance_id = o.instance_id left join q on q.scan_id = c.first_scan and q.node_id = c.target"""
)
def two_hop_correspondence(spark: SparkSession, folder: str) -> DataFrame:
    """JN4 WN2: observation -> instance of the first scan -> its position there; -1 for none."""
    o = observations(spark, folder, "scan_id", "instance_id")
    c = correspondence(spark, folder).where("instance_id_in_00 <> -1").groupBy("scan_id", "first_scan", "instance_id").agg(F.min("instance_id_in_00").alias("node_id"))
    at = _node_positions(spark, folder).groupBy("scan_id", "node_id").agg(F.min("p").alias("match")).withColumnRenamed("scan_id", "first_scan")
    return o.join(c, ["scan_id", "instance_id"], "left").join(at, ["first_scan", "node_id"], "left").select("obs_id", F.coalesce("match", F.lit(-1)).alias("match"))


@query(BASE + _POSITIONS + ", q as (select scan_id, node_id, min(p) as p from pos group by scan_id, node_id) select o.obs_id, coalesce(q.p, -1)::int as match from obs o left join q on q.scan_id = o.scan_id and q.node_id = o.instance_id")
def self_match(spark: SparkSession, folder: str) -> DataFrame:
    """JN5 JN6: observation -> first position of its own map with the same id; -1 for none."""
    at = _node_positions(spark, folder).groupBy("scan_id", "node_id").agg(F.min("p").alias("match")).withColumnRenamed("node_id", "instance_id")
    o = observations(spark, folder, "scan_id", "instance_id")
    return o.join(at, ["scan_id", "instance_id"], "left").select("obs_id", F.coalesce("match", F.lit(-1)).alias("match"))


@query(BASE + ", e as (select match_id, unnest(matches0) as t, generate_subscripts(matches0, 1) - 1 as s from mat) select match_id, t as target, max(s)::int as source from e where t <> -1 group by match_id, t")
def reverse_matches(spark: SparkSession, folder: str) -> DataFrame:
    """JN7: matches1 from matches0."""
    return aggregates.reversed_matches(matcher_rows(spark, folder), "match_id", "matches0")


@query(
    """with s as (select distinct scan_id, regexp_extract(scan_id, 'scene(\\d+)_(\\d+)', 1)::int as scene, regexp_extract(scan_id, 'scene(\\d+)_(\\d+)', 2)::int as no from object_node)
select a.scan_id as first_scan, b.scan_id as rescan from s a join s b on a.scene = b.scene and a.no = 0 and b.no <> 0"""
)
def scene_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """JN17 FL15 PR5: first scans with their rescans."""
    s = table(spark, folder, "object_node", "scan_id").distinct().select("scan_id", scene_number(F.col("scan_id")).alias("scene"), scan_number(F.col("scan_id")).alias("no"))
    a, b = s.where("no = 0").select("scene", F.col("scan_id").alias("first_scan")), s.where("no <> 0").select("scene", F.col("scan_id").alias("rescan"))
    return a.join(b, "scene").select("first_scan", "rescan")


_WINDOWS = BASE + ", w as (select scan_id, frame_id // 300 as win, list(distinct instance_id) as ids from obs where instance_id >= 0 and frame_id is not null group by scan_id, frame_id // 300)"


@query(
    _WINDOWS
    + """, s as (select *, regexp_extract(scan_id, 'scene(\\d+)_', 1) as scene from w),
t as (select s.scan_id, s.scene, s.win, list(distinct c.instance_id_in_00) as ids from s, unnest(s.ids) as u(i) join cor c on c.scan_id = s.scan_id and c.instance_id = u.i where c.instance_id_in_00 <> -1 group by s.scan_id, s.scene, s.win)
select a.scan_id as scan_a, a.win::int as win_a, b.scan_id as scan_b, b.win::int as win_b, round(len(list_intersect(a.ids, b.ids)) / least(len(a.ids), len(b.ids)), 6) as overlap
from s a join t b on a.scene = b.scene and a.scan_id like '%\\_00' escape '\\' where len(list_intersect(a.ids, b.ids)) > 0"""
)
def subscan_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """JN18 ST1 SK17 PR5: subscans of a first scan against those of its rescans, by overlap coefficient; pairs meet by a shared instance."""
    o = observations(spark, folder, "scan_id", "frame_id", "instance_id").where("instance_id >= 0 and frame_id is not null").withColumn("win", (F.col("frame_id") / 300).cast("int"))
    own = o.where(F.col("scan_id").endswith("_00")).select(F.col("scan_id").alias("first_scan"), "win", "instance_id").distinct()
    c = correspondence(spark, folder).where("instance_id_in_00 <> -1").select("scan_id", "first_scan", "instance_id", "instance_id_in_00")
    theirs = o.join(c, ["scan_id", "instance_id"]).select("scan_id", "first_scan", "win", F.col("instance_id_in_00").alias("instance_id")).distinct()
    a = own.select("first_scan", "instance_id", F.col("win").alias("win_a"))
    b = theirs.select("first_scan", "instance_id", "scan_id", F.col("win").alias("win_b"))
    n_a, n_b = a.groupBy("first_scan", "win_a").agg(F.count("*").alias("n_a")), b.groupBy("scan_id", "win_b").agg(F.count("*").alias("n_b"))
    met = a.join(b, ["first_scan", "instance_id"]).groupBy("first_scan", "win_a", "scan_id", "win_b").agg(F.count("*").alias("shared"))
    met = met.join(n_a, ["first_scan", "win_a"]).join(n_b, ["scan_id", "win_b"])
    return met.select(F.col("first_scan").alias("scan_a"), "win_a", F.col("scan_id").alias("scan_b"), "win_b", F.round(F.col("shared") / F.least("n_a", "n_b"), 6).alias("overlap"))


@query(BASE + ", c as (select distinct scan_id from cor) select distinct scan_id from obs where not scan_id like '%\\_00' escape '\\' and scan_id not in (select scan_id from c)")
def pending_scans(spark: SparkSession, folder: str) -> DataFrame:
    """JN19 SK25 IT15: rescans without any correspondence yet."""
    work = table(spark, folder, "instance_info", "scan_id").where(~F.col("scan_id").endswith("_00")).distinct()
    return relational.pending(work, correspondence(spark, folder), ["scan_id"])


_EDGES = BASE + ", e as (select a.scan_id, a.node_id as source_id, b.node_id as target_id, a.name as source_name, b.name as target_name, sqrt((a.y - b.y)^2 + (a.z - b.z)^2 + (a.x - b.x)^2) as dist, b.x - a.x as dx, b.y - a.y as dy, b.z - a.z as dz from pla a join pla b on a.scan_id = b.scan_id and a.node_id < b.node_id where sqrt((a.y - b.y)^2 + (a.z - b.z)^2 + (a.x - b.x)^2) < 1.0)"


def _edges(spark: SparkSession, folder: str, radius: float = 1.0) -> DataFrame:
    points = placed_nodes(spark, folder, "scan_id").select(F.col("scan_id").alias("scope"), F.col("node_id").alias("id"), "x", "y", "z")
    return spatial.radius_pairs(points, radius).select(F.col("scope").alias("scan_id"), F.col("id1").alias("source_id"), F.col("id2").alias("target_id"), "dist")


@query(_EDGES + "select scan_id, source_id, target_id, round(dist, 6) as dist from e")
def radius_self_join(spark: SparkSession, folder: str) -> DataFrame:
    """JN8: edges between the nodes of a scan nearer than a metre."""
    return _edges(spark, folder).select("scan_id", "source_id", "target_id", F.round("dist", 6).alias("dist"))


@query(_EDGES + "select scan_id, source_id as id1, target_id as id2, round(dist, 6) as dist from e union all select scan_id, target_id, source_id, round(dist, 6) from e")
def radius_ordered_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """JN9: the same in both orders."""
    points = placed_nodes(spark, folder, "scan_id").select(F.col("scan_id").alias("scope"), F.col("node_id").alias("id"), "x", "y", "z")
    return spatial.radius_pairs(points, 1.0, ordered=True).select(F.col("scope").alias("scan_id"), "id1", "id2", F.round("dist", 6).alias("dist"))


_KINDS = BASE + ", cy as (select * from pla where shape.radius is not null), bo as (select * from pla where shape is not null and shape.radius is null)"


def _kinds(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    n = placed_nodes(spark, folder, "scan_id", "shape").where("shape is not null").withColumn("kind", geometry.shape_kind(F.col("shape")))
    as_points = lambda k: n.where(F.col("kind") == k).select(F.col("scan_id").alias("scope"), F.col("node_key").alias("id"), "x", "y", "z", F.coalesce(F.col("shape.radius"), F.lit(0.0)).cast("double").alias("r"))
    return as_points("cylinder"), as_points("oriented_box")


@query(_KINDS + "select cy.node_key as cylinder, bo.node_key as box, round(sqrt((cy.y - bo.y)^2 + (cy.z - bo.z)^2 + (cy.x - bo.x)^2), 6) as dist from cy join bo on cy.scan_id = bo.scan_id where sqrt((cy.y - bo.y)^2 + (cy.z - bo.z)^2 + (cy.x - bo.x)^2) < 1.0")
def theta_cross_kind_join(spark: SparkSession, folder: str) -> DataFrame:
    """JN10: cylinders with the boxes nearer than a metre."""
    cy, bo = _kinds(spark, folder)
    return spatial.radius_join(cy, bo, 1.0).select(F.col("id1").alias("cylinder"), F.col("id2").alias("box"), F.round("dist", 6).alias("dist"))


@query(_KINDS + "select node_key from bo where not exists (select 1 from cy where cy.scan_id = bo.scan_id and sqrt((cy.x - bo.x)^2 + (cy.y - bo.y)^2) < cy.shape.radius::double + 0.2)")
def not_exists_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """JN11 FN-G7: boxes whose place (0.2 m) no cylinder of the scan overlaps in plan; the radius join bounds the candidates."""
    cy, bo = _kinds(spark, folder)
    widest = cy.agg(F.max("r")).first()[0] or 0.0
    flat = lambda d: d.select("scope", "id", "x", "y", F.lit(0.0).alias("z"))
    near = spatial.radius_join(flat(bo), flat(cy), widest + 0.25).join(cy.select(F.col("scope"), F.col("id").alias("id2"), "r"), ["scope", "id2"])
    hit = near.where(F.col("dist") < F.col("r") + 0.2).select(F.col("id1").alias("id"))
    return bo.join(hit, "id", "left_anti").select(F.col("id").alias("node_key"))


@query(
    """with p as (select label, vec_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings),
n as (select label, count(*) as n from p group by label),
h as (select a.label as la, b.label as lb, a.vec_id from p a join p b on b.label = a.label + 1 or b.label = a.label - 1 where sqrt((a.y - b.y)^2 + (a.z - b.z)^2 + (a.x - b.x)^2) < 0.08),
g as (select la, lb, count(distinct vec_id) as hits from h group by la, lb)
select na.label as a, nb.label as b, na.n as n_a, nb.n as n_b, coalesce(x.hits, 0) as hit_a, coalesce(y.hits, 0) as hit_b, round((coalesce(x.hits, 0) + coalesce(y.hits, 0)) / (na.n + nb.n), 6) as iou
from n na join n nb on nb.label = na.label + 1 left join g x on x.la = na.label and x.lb = nb.label left join g y on y.la = nb.label and y.lb = na.label"""
)
def cloud_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """JN16 T2: share of the points of two clouds with a point of the other within a radius."""
    p = table(spark, folder, "embeddings").select(F.col("label").alias("cloud"), F.col("vec_id").alias("id"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    labels = p.select("cloud").distinct()
    pairs = labels.select(F.col("cloud").alias("a"), (F.col("cloud") + 1).alias("b")).join(labels.select(F.col("cloud").alias("b")), "b", "left_semi")
    return spatial.cloud_overlap(p, pairs, 0.08).withColumn("iou", F.round("iou", 6))


@query(_EDGES + "select scan_id, source_id, target_id from e where not (source_name is null or lower(trim(source_name)) = 'unknown') and not (target_name is null or lower(trim(target_name)) = 'unknown')")
def cascade_edges(spark: SparkSession, folder: str) -> DataFrame:
    """JN20 FL1: edges left when the nodes without a name go."""
    gone = placed_nodes(spark, folder, "scan_id", "name").where("name is null or lower(trim(name)) = 'unknown'")
    return relational.without_nodes(_edges(spark, folder), gone, "scan_id", "node_id").select("scan_id", "source_id", "target_id")


@query(
    BASE
    + """, n as (select distinct scan_id, node_id from nod), c as (select corr_id, scan_id, instance_id as s, instance_id_in_00 as t, first_scan from cor where instance_id is not null and instance_id_in_00 <> -1)
select corr_id, x.node_id is null as source_missing, y.node_id is null as target_missing from c left join n x on x.scan_id = c.scan_id and x.node_id = c.s left join n y on y.scan_id = c.first_scan and y.node_id = c.t where x.node_id is null or y.node_id is null"""
)
def dangling_edges(spark: SparkSession, folder: str) -> DataFrame:
    """JN21: correspondences of which an end is no node."""
    n = nodes(spark, folder, "scan_id").select("scan_id", "node_id").distinct()
    c = correspondence(spark, folder).where("instance_id is not null and instance_id_in_00 <> -1")
    key = lambda s, i: F.struct(F.col(s).alias("s"), F.col(i).alias("i"))
    edges = c.select("corr_id", F.lit(0).alias("g"), key("scan_id", "instance_id").alias("source_id"), key("first_scan", "instance_id_in_00").alias("target_id"))
    return relational.dangling(edges, n.select(F.lit(0).alias("g"), key("scan_id", "node_id").alias("node")), "g", "node").select("corr_id", "source_missing", "target_missing")


@query(
    BASE
    + """, a as (select first_scan, scan_id, instance_id, min(instance_id_in_00) as t from cor where instance_id is not null and instance_id_in_00 <> -1 group by 1, 2, 3),
f as (select scan_id, name, min(node_id) as t from nod where name is not null and lower(trim(name)) <> 'unknown' group by scan_id, name),
b as (select n.scan_id, n.node_id as instance_id, min(f.t) as t from nod n join f on f.scan_id = regexp_replace(n.scan_id, '_\\d+$', '_00') and f.name = n.name where not n.scan_id like '%\\_00' escape '\\' group by 1, 2)
select coalesce(a.scan_id, b.scan_id) as scan_id, coalesce(a.instance_id, b.instance_id) as instance_id, case when b.t is not null and b.t is not distinct from a.t then 'TP' when b.t is not null then 'FP' else 'FN' end as outcome
from b full join a on a.scan_id = b.scan_id and a.instance_id = b.instance_id"""
)
def match_outcome(spark: SparkSession, folder: str) -> DataFrame:
    """JN23 JN13: matches by equal name held against the correspondences."""
    truth = correspondence(spark, folder).where("instance_id is not null and instance_id_in_00 <> -1").groupBy("scan_id", "instance_id").agg(F.min("instance_id_in_00").alias("t"))
    n = nodes(spark, folder, "scan_id", "name").where("name is not null and lower(trim(name)) <> 'unknown'").withColumn("first_scan", first_scan_id(F.col("scan_id")))
    first = n.where(F.col("scan_id").endswith("_00")).groupBy("first_scan", "name").agg(F.min("node_id").alias("t"))
    mine = n.where(~F.col("scan_id").endswith("_00")).join(first, ["first_scan", "name"]).groupBy("scan_id", F.col("node_id").alias("instance_id")).agg(F.min("t").alias("t"))
    return relational.match_outcome(mine, truth, ["scan_id", "instance_id"], "t").select("scan_id", "instance_id", "outcome")


@query(BASE + "select node_key, obs_id from nod join obs on obs.scan_id = nod.scan_id and obs.instance_id = try_cast(nod.id as int) where obs.confidence > 0.5")
def node_by_text_id(spark: SparkSession, folder: str) -> DataFrame:
    """JN26 FL14: nodes joined to confident observations, the id being text on one side."""
    o = observations(spark, folder, "scan_id", "instance_id", "confidence").where("confidence > 0.5").withColumnRenamed("instance_id", "node_id")
    return nodes(spark, folder, "scan_id").join(o, ["scan_id", "node_id"]).select("node_key", "obs_id")


@query(
    BASE
    + """select o.obs_id, coalesce(m.name, o.object_name) as name, m.map_row_id is not null as renamed from obs o left join
(select scan_id, instance_id, arg_max(name, {'a': added_at, 'i': map_row_id}) as name, max(map_row_id) as map_row_id from nam where name is not null group by scan_id, instance_id) m on m.scan_id = o.scan_id and m.instance_id = o.instance_id"""
)
def record_update(spark: SparkSession, folder: str) -> DataFrame:
    """PR3 PR11: observations with the name of the map where there is one."""
    o = observations(spark, folder, "scan_id", "instance_id", "object_name").withColumnRenamed("object_name", "name").withColumn("renamed", F.lit(False))
    m = table(spark, folder, "instance_name_map").dropDuplicates(["map_row_id"]).where("name is not null")
    changes = relational.last_per_key(m.select("scan_id", "instance_id", "name", "added_at", "map_row_id"), ["scan_id", "instance_id"], ["added_at", "map_row_id"]).select("scan_id", "instance_id", "name", F.lit(True).alias("renamed"))
    return relational.update_records(o, changes, ["scan_id", "instance_id"]).select("obs_id", "name", "renamed")


@query(BASE + "select first_scan, instance_id_in_00, arg_max(instance_id, corr_id) as instance_id from cor where instance_id_in_00 <> -1 and instance_id is not null group by first_scan, instance_id_in_00")
def reverse_map(spark: SparkSession, folder: str) -> DataFrame:
    """PR4: correspondence turned round, the last of several."""
    c = correspondence(spark, folder).where("instance_id_in_00 <> -1 and instance_id is not null")
    return relational.last_per_key(c.select("first_scan", "instance_id_in_00", "instance_id", "corr_id"), ["first_scan", "instance_id_in_00"], ["corr_id"]).select("first_scan", "instance_id_in_00", "instance_id")


# set operations


@query(
    BASE
    + """, m as (select scan_id, instance_id, min(instance_id_in_00) as t from cor where instance_id_in_00 <> -1 and instance_id is not null group by 1, 2),
a as (select distinct regexp_replace(o.scan_id, '_\\d+$', '_00') as first_scan, o.scan_id, coalesce(m.t::varchar, 'u:' || o.scan_id || ':' || o.instance_id) as token from obs o left join m on m.scan_id = o.scan_id and m.instance_id = o.instance_id where not o.scan_id like '%\\_00' escape '\\' and o.instance_id >= 0),
b as (select distinct p.scan_id, o.instance_id::varchar as token from (select distinct scan_id, first_scan from a) p join obs o on o.scan_id = p.first_scan where o.instance_id >= 0),
j as (select coalesce(a.scan_id, b.scan_id) as scan_id, count(a.token) as n_a, count(b.token) as n_b, count(*) filter (a.token is not null and b.token is not null) as shared, count(*) as n from a full join b on a.scan_id = b.scan_id and a.token = b.token group by 1)
select scan_id, n_a, n_b, shared, n as "union", round(shared / n, 6) as iou, round(case when n_a = 0 then 0 else shared / n_a end, 6) as recall, round(case when n_b = 0 then 0 else shared / n_b end, 6) as precision from j"""
)
def canonical_iou(spark: SparkSession, folder: str) -> DataFrame:
    """ST2: instances of a rescan, as those of the first scan where they correspond, against the first scan."""
    o = observations(spark, folder, "scan_id", "instance_id").where("instance_id >= 0").select("scan_id", "instance_id").distinct()
    m = correspondence(spark, folder).where("instance_id_in_00 <> -1 and instance_id is not null").groupBy("scan_id", "instance_id").agg(F.min("instance_id_in_00").alias("t"))
    token = F.coalesce(F.col("t").cast("string"), F.concat_ws(":", F.lit("u"), "scan_id", "instance_id"))
    a = o.where(~F.col("scan_id").endswith("_00")).join(m, ["scan_id", "instance_id"], "left").select("scan_id", token.alias("token"))
    pairs = a.select("scan_id").distinct().withColumn("first_scan", first_scan_id(F.col("scan_id")))
    b = pairs.join(o.select(F.col("scan_id").alias("first_scan"), F.col("instance_id").cast("string").alias("token")), "first_scan").select("scan_id", "token")
    return aggregates.overlap_metrics(a, b, ["scan_id"]).select("scan_id", "n_a", "n_b", "shared", "union", *[F.round(c, 6).alias(c) for c in ("iou", "recall", "precision")])


@query(
    BASE
    + """, a as (select distinct scan_id, node_id as id from nod where node_id is not null), b as (select distinct scan_id, instance_id as id from obs where instance_id >= 0)
select coalesce(a.scan_id, b.scan_id) as scan_id, coalesce(a.id, b.id) as id, case when b.id is null then 'left_only' else 'right_only' end as side from a full join b on a.scan_id = b.scan_id and a.id = b.id where a.id is null or b.id is null"""
)
def id_set_mismatch(spark: SparkSession, folder: str) -> DataFrame:
    """ST3: ids that only the map or only the observations have."""
    a = nodes(spark, folder, "scan_id").where("node_id is not null").select("scan_id", F.col("node_id").alias("id"))
    b = observations(spark, folder, "scan_id", "instance_id").where("instance_id >= 0").select("scan_id", F.col("instance_id").alias("id"))
    return relational.id_mismatch(a, b, ["scan_id", "id"])


@query(BASE + "select scan_id, count(*) as points, count(distinct id) as ids from (select scan_id, node_id as id from pla union all select scan_id, instance_id from obs where center is not null) group by scan_id")
def union_points(spark: SparkSession, folder: str) -> DataFrame:
    """ST4 ST5 AG8: node places and observation centers together."""
    a = placed_nodes(spark, folder, "scan_id").select("scan_id", F.col("node_id").alias("id"))
    b = observations(spark, folder, "scan_id", "instance_id", "center").where("center is not null").select("scan_id", F.col("instance_id").alias("id"))
    return a.unionByName(b).groupBy("scan_id").agg(F.count("*").alias("points"), F.countDistinct("id").alias("ids"))


@query(BASE + "select object_name, min(obs_id) as first_obs from obs where object_name is not null group by object_name")
def first_seen(spark: SparkSession, folder: str) -> DataFrame:
    """ST6 ST7: distinct names with where each was first seen."""
    return relational.first_per_key(observations(spark, folder, "object_name").where("object_name is not null"), ["object_name"], ["obs_id"]).select("object_name", F.col("obs_id").alias("first_obs"))


@query(BASE + "select frame_scene, list_sort(list_distinct(flatten(list(list_filter(matches0, lambda m: m <> -1)))))::varchar as matched from mat where matches0 is not null and frame_scene is not null group by frame_scene")
def matched_union(spark: SparkSession, folder: str) -> DataFrame:
    """ST8 SO10: targets matched in any frame of a scan."""
    each = matcher_rows(spark, folder).where("frame_scene is not null and matches0 is not null").select("frame_scene", F.explode_outer(F.filter("matches0", lambda m: m != -1)).alias("m"))
    return each.groupBy("frame_scene").agg(F.sort_array(F.collect_set("m")).alias("s")).select("frame_scene", F.format_string("[%s]", F.array_join(F.transform("s", lambda x: x.cast("string")), ", ")).alias("matched"))


# aggregation


@query(BASE + ", c as (select scan_id, instance_id, object_name, count(*) as n from obs where object_name is not null group by all), r as (select *, row_number() over (partition by scan_id, instance_id order by n desc, object_name) as r from c) select scan_id, instance_id, object_name from r where r = 1")
def name_mode(spark: SparkSession, folder: str) -> DataFrame:
    """AG2 AG3 T4: most frequent name of each instance."""
    return aggregates.mode(observations(spark, folder, "scan_id", "instance_id", "object_name").where("object_name is not null"), ["scan_id", "instance_id"], "object_name")


@query(
    BASE
    + """, v as (select *, bbox_size.x * bbox_size.y * bbox_size.z as vol from obs), r as (select *, row_number() over (partition by scan_id, instance_id order by vol desc, obs_id) as r, count(*) over (partition by scan_id, instance_id) as observations from v where vol is not null and not isnan(vol))
select scan_id, instance_id, obs_id, object_name, observations from r where r = 1"""
)
def argmax_representative(spark: SparkSession, folder: str) -> DataFrame:
    """AG4 AG5 WN3: the observation with the largest box of each instance."""
    o = observations(spark, folder, "scan_id", "instance_id", "object_name", "bbox_size")
    vol = vectors.box_volume(F.col("bbox_size"))
    o = o.withColumn("vol", F.when(~F.isnan(vol), vol)).withColumn("key", F.col("obs_id"))
    return aggregates.representative(o, ["scan_id", "instance_id"], ["obs_id", "object_name"], F.col("vol"), "key")


@query(BASE + ", k as (select scan_id, frame_id from obs where frame_id is not null group by all having count(distinct instance_id) >= 2) select obs_id from obs join k using (scan_id, frame_id)")
def frame_min_instances(spark: SparkSession, folder: str) -> DataFrame:
    """FL2 FL7: observations of frames with at least two instances."""
    return aggregates.at_least(observations(spark, folder, "scan_id", "frame_id", "instance_id").where("frame_id is not null"), ["scan_id", "frame_id"], "instance_id", 2).select("obs_id")


@query(BASE + ", s as (select coalesce(len(keypoints0), 0)::int as keypoints from mat) select keypoints, count(*) as n from s group by keypoints")
def count_of_counts(spark: SparkSession, folder: str) -> DataFrame:
    """AG11 AG7: rows by number of keypoints."""
    return aggregates.count_of_counts(matcher_rows(spark, folder).select(F.greatest(F.coalesce(F.size("keypoints0"), F.lit(0)), F.lit(0)).alias("keypoints")), "keypoints")


_RATES = BASE + ", r as (select match_id, len(list_filter(matches0, lambda m: m <> -1)) / len(matches0) as rate from mat where len(matches0) > 0)"


@query(
    _RATES
    + """, e as (select unnest([0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]::double[]) as lo, unnest([0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]::double[]) as hi, unnest(range(10)) as bin)
select bin::int as bin, count(*) as n from r join e on (rate >= lo and rate < hi) or (bin = 9 and rate = 1.0) group by bin"""
)
def rate_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """AG12 T11: match rates in ten bins."""
    r = matcher_rows(spark, folder).withColumn("bin", aggregates.rate_bin(aggregates.match_rate(F.col("matches0")))).where("bin is not null")
    return r.groupBy("bin").agg(F.count("*").alias("n"))


@query(_RATES + "select count(*) as n, round(avg(rate), 6) as mean, round(median(rate), 6) as median, round(min(rate), 6) as least, round(max(rate), 6) as most from r")
def rate_summary(spark: SparkSession, folder: str) -> DataFrame:
    """AG14 AG15: spread of the match rates."""
    r = matcher_rows(spark, folder).select(aggregates.match_rate(F.col("matches0")).alias("rate")).where("rate is not null")
    return aggregates.spread(r, [], "rate").select("n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "least", "most")])


@query(BASE + ", e as (select match_id, unnest(matches0) as m from mat), c as (select match_id, m from e where m <> -1 group by all having count(*) > 1) select match_id, count(*)::int as doubled from c group by match_id")
def many_to_one(spark: SparkSession, folder: str) -> DataFrame:
    """AG13: rows in which a target is matched more than once."""
    return matcher_rows(spark, folder).select("match_id", aggregates.doubled_matches(F.col("matches0")).alias("doubled")).where("doubled > 0")


@query(
    BASE
    + "select scan_id, count(*) as points, count(*) filter (not coalesce(isfinite(x) and isfinite(y) and isfinite(z), false)) as broken, round(least(min(x) filter (k), min(y) filter (k), min(z) filter (k)), 5) as low, round(greatest(max(x) filter (k), max(y) filter (k), max(z) filter (k)), 5) as high, round(avg(x) filter (k), 5) as mean_x from (select *, coalesce(isfinite(x) and isfinite(y) and isfinite(z), false) as k from nod) group by scan_id"
)
def cloud_stats(spark: SparkSession, folder: str) -> DataFrame:
    """AG16 AG17 AG18 FL10: extent, centroid and broken coordinates of the nodes of a scan."""
    return aggregates.cloud_stats(nodes(spark, folder, "scan_id"), ["scan_id"]).select("scan_id", "points", "broken", *[F.round(c, 5).alias(c) for c in ("low", "high", "mean_x")])


@query(BASE + "select scan_id, floor(x / 0.5)::bigint as vx, floor(y / 0.5)::bigint as vy, floor(z / 0.5)::bigint as vz, round(avg(x), 5) as x, round(avg(y), 5) as y, round(avg(z), 5) as z, count(*) as n from pla group by scan_id, floor(pla.x / 0.5), floor(pla.y / 0.5), floor(pla.z / 0.5)")
def voxel_downsample(spark: SparkSession, folder: str) -> DataFrame:
    """AG22 T12: one centroid for each half-metre cell of a scan."""
    return spatial.voxel_downsample(placed_nodes(spark, folder, "scan_id"), 0.5, ["scan_id"]).select("scan_id", "vx", "vy", "vz", *[F.round(c, 5).alias(c) for c in "xyz"], "n")


@query(BASE + "select object_name as name, count(*) as n from obs where object_name is not null group by 1 order by n desc, name limit 50")
def name_topn(spark: SparkSession, folder: str) -> DataFrame:
    """AG10 SO5 SO6 SK18: the 50 most frequent names."""
    return observations(spark, folder, "object_name").where("object_name is not null").groupBy(F.col("object_name").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(50)


@query(BASE + ", c as (select scan_id, count(*) filter (instance_id_in_00 <> -1) as m, count(*) as n from cor group by scan_id) select scan_id, round(m / (n + 1e-6), 6) as ratio from c order by ratio desc, scan_id limit 50")
def match_ratio_rank(spark: SparkSession, folder: str) -> DataFrame:
    """AG20 SO6 SO7 SO8: the 50 rescans with the highest share of matched instances."""
    c = correspondence(spark, folder).groupBy("scan_id").agg(F.count_if(F.coalesce(F.col("instance_id_in_00") != -1, F.lit(False))).alias("m"), F.count("*").alias("n"))
    return c.select("scan_id", F.round(F.col("m") / (F.col("n") + F.lit(1e-6)), 6).alias("ratio")).orderBy(F.desc("ratio"), "scan_id").limit(50)


@query("select regexp_extract(file_path, 'scene\\d+_\\d+') as scan_id, count(*) as files, sum(size_bytes)::bigint as bytes, max(regexp_extract(file_path, '(\\d+)_[^/]*$', 1)::int) as last_frame from (select distinct on (file_id) * from feature_file) group by 1")
def catalog_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """SC23 AG21 AG25 FN-S7: files, bytes and last frame of each scan of a catalog."""
    f = table(spark, folder, "feature_file", "file_id", "file_path", "size_bytes").dropDuplicates(["file_id"])
    frame = F.regexp_extract("file_path", r"(\d+)_[^/]*$", 1).try_cast("int")
    return f.groupBy(F.regexp_extract("file_path", r"scene\d+_\d+", 0).alias("scan_id")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.max(frame).alias("last_frame"))


@query(BASE + "select object_name is null as unnamed, count(*) filter (confidence > 0.5) as sure, count(*) filter (confidence is null) as silent, count(*) as n from obs group by 1")
def conditional_counts(spark: SparkSession, folder: str) -> DataFrame:
    """AG24 AG26: counters under conditions, partial and final."""
    o = observations(spark, folder, "object_name", "confidence").withColumn("unnamed", F.col("object_name").isNull())
    return o.groupBy("unnamed").agg(F.count_if(F.coalesce(F.col("confidence") > 0.5, F.lit(False))).alias("sure"), F.count_if(F.col("confidence").isNull()).alias("silent"), F.count("*").alias("n"))


@query(
    """with e as (select vec_id, label, embedding::double[] as v, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings),
p as (select q.label as scene, q.vec_id as query_id, e.label = q.label as hit, e.vec_id, round(list_dot_product(q.v, e.v) / (q.n * e.n), 6) as sim from e q join e on q.vec_id <> e.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by sim desc, vec_id) as rank from p),
f as (select scene, query_id, min(rank) filter (hit and rank <= 5) as f from r group by 1, 2)
select scene, round(avg((coalesce(f, 6) <= 1)::int), 6) as hits_1, round(avg((coalesce(f, 6) <= 5)::int), 6) as hits_5 from f group by scene"""
)
def hits_at_k(spark: SparkSession, folder: str) -> DataFrame:
    """AG19: how often the label is among the nearest, by label."""
    e = table(spark, folder, "embeddings").withColumn("n", vectors.norm(F.col("embedding"))).where("n > 0")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("scene"), F.col("embedding").alias("q"), F.col("n").alias("qn"))
    sim = F.round(vectors.dot(F.col("q"), F.col("embedding")) / (F.col("qn") * F.col("n")), 6)
    ranked = ranking.top_k(relational.in_blocks(e, q, "vec_id").where("vec_id <> query_id").withColumn("sim", sim), ["query_id"], 5, F.desc("sim"), "vec_id").withColumn("hit", F.col("label") == F.col("scene"))
    return aggregates.hits_at(ranked, "scene", "query_id", "hit", "rank", 5).select("scene", F.round("hits_1", 6).alias("hits_1"), F.round("hits_5", 6).alias("hits_5"))
