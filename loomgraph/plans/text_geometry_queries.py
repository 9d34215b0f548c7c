"""Queries of text, JSON, geometry and position operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import geometry, text, vectors
from loomgraph.operators import augment, graphs, ranking, relational, spatial
from loomgraph.plans.registry import registry
from loomgraph.plans.scene_queries import BASE, matcher_rows, nodes, observations, placed_nodes
from loomgraph.session import cut_lineage
from loomgraph.sources import files, sinks
from loomgraph.tables import table

QUERIES, SQL, query = registry()

_TITLE = "array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"


# texts


@query(BASE + "select map_row_id, replace(translate(name, ',()', ''), '/', ' or ') as name from nam where name is not null")
def csv_name_fix(spark: SparkSession, folder: str) -> DataFrame:
    """FN-S1: names that held the separators of their file."""
    return table(spark, folder, "instance_name_map", "map_row_id", "name").dropDuplicates(["map_row_id"]).where("name is not null").select("map_row_id", text.repair_csv_name(F.col("name")).alias("name"))


@query(
    "select p_partkey, "
    + _TITLE.format(x="trim(p_type)")
    + " as tag, "
    + _TITLE.format(x="trim(regexp_replace(regexp_replace(p_partkey || '. ' || p_type, '^\\d+\\s*[.)\\-_:]*\\s*', ''), '\\s+', ' ', 'g'))")
    + " as plain, trim(regexp_replace(translate(p_brand || '/(' || p_type || ')-x', '/-()', '    '), '\\s+', ' ', 'g')) as detected from part"
)
def tag_clean(spark: SparkSession, folder: str) -> DataFrame:
    """FN-S2 FN-S3 FN-S4 T10: tags and numbered names cleaned."""
    p = table(spark, folder, "part", "p_partkey", "p_type", "p_brand")
    return p.select("p_partkey", text.clean_tag(F.col("p_type")).alias("tag"), text.strip_numbering(F.concat(F.col("p_partkey").cast("string"), F.lit(". "), "p_type")).alias("plain"), text.detector_name(F.concat("p_brand", F.lit("/("), "p_type", F.lit(")-x"))).alias("detected"))


@query(
    BASE
    + """select obs_id, trim(string_split(object_name, ':')[1]) as name, trim(case when contains(object_name, ':') then object_name[position(':' in object_name) + 1:] else '' end) as description from obs where object_name is not null"""
)
def name_description(spark: SparkSession, folder: str) -> DataFrame:
    """FN-S5: name and description of `name: description`."""
    o = observations(spark, folder, "object_name").where("object_name is not null")
    return o.select("obs_id", text.name_and_description(F.col("object_name")).alias("s")).select("obs_id", "s.*")


@query("select p_partkey, unnest(string_split(p_type || ' | ' || p_brand, ' | ')) as tag from part")
def tag_list(spark: SparkSession, folder: str) -> DataFrame:
    """FN-S6: tags of a list, one per row."""
    p = table(spark, folder, "part", "p_partkey", "p_type", "p_brand")
    return p.select("p_partkey", F.explode(text.tags(F.concat_ws(" | ", "p_type", "p_brand"))).alias("tag"))


@query(BASE + "select obs_id from obs where object_name is not null and not regexp_matches(object_name, 'Floor|floor|Wall|wall|Ceiling|ceiling|Shadow|Carpet') and lower(trim(object_name)) not in ('object', 'unknown', '')")
def name_deny_list(spark: SparkSession, folder: str) -> DataFrame:
    """FL11 FL12 FL13 FL17: observations whose name is on no deny-list, exact or in part."""
    o = observations(spark, folder, "object_name").where("object_name is not null")
    return o.where(~F.col("object_name").rlike("Floor|floor|Wall|wall|Ceiling|ceiling|Shadow|Carpet") & ~F.lower(F.trim("object_name")).isin("object", "unknown", "")).select("obs_id")


@query(
    r"""with d as (select doc_id, case when regexp_matches(text, '(?s)```json\s*(.*?)\s*```') then regexp_extract(text, '(?s)```json\s*(.*?)\s*```', 1) else text end as body from documents where source = 'tagging_response' and text is not null),
v as (select doc_id, case when json_valid(body) and json_type(body) = 'OBJECT' and len(json_keys(body)) = 1 and not regexp_matches(body, ',\s*[}\]]') then json_extract(body, '$.objects') end as o from d)
select doc_id, coalesce(json_array_length(o), -1)::int as objects, o->0->>'name' as first_name from v where o is not null"""
)
def json_extract(spark: SparkSession, folder: str) -> DataFrame:
    """FN-J1 FN-J3 SC21: objects of fenced or bare answers that are valid as they stand."""
    d = table(spark, folder, "documents", "doc_id", "source", "text").where("source = 'tagging_response' and text is not null")
    body = d.select("doc_id", text.fenced(F.col("text")).alias("body"))
    valid = body.where(files.strict_json(F.col("body")).isNotNull() & F.col("body").rlike(r"^\s*\{"))
    o = valid.select("doc_id", text.normal_objects(F.col("body")).alias("o")).where("o is not null")
    return o.select("doc_id", F.size("o").alias("objects"), F.col("o")[0]["name"].alias("first_name"))


@query()
def json_repair(spark: SparkSession, folder: str) -> DataFrame:
    """FN-J2 FL17: objects of all answers, the broken ones repaired."""
    d = table(spark, folder, "documents", "doc_id", "source", "text").where("source = 'tagging_response' and text is not null")
    body = text.repair_json(text.fenced(F.col("text")))
    return d.select("doc_id", F.size(text.complete_objects(text.normal_objects(body))).alias("objects"))


#: Answers with one slip each, and the (name, description) that they mean.
_SLIPS = [
    ('[{"name": "a", "description": "b"}]', "a", "b"),
    ('[{"name": "a"; "description": "b"}]', "a", "b"),
    ('[{"name": "a", "description": "b",},]', "a", "b"),
    ("[{“name”: “a”, “description”: “b”}]", "a", "b"),
    ('[{"name": "a", "description": "b"});]', "a", "b"),
    ('[{"name": "a",\n"description": "b c\n}]', "a", "b c"),
    ('[{"name": "a\n"description": "b"}]', "a", "b"),
    ('[{"name": "a,\n"description": "b"}]', "a", "b"),
    ('[{"name": "a,"\n"description": "b"}]', "a", "b"),
    ('[{"name": "a", "description": "an old " chair"}]', "a", "an old chair"),
    ('[{"name": " a", "description": "b , c "}]', " a", "b , c "),
    ('{"objects": [ { "name" : "a" , "description" : "b" } ]}', "a", "b"),
    ('```json\n[{"name": "a", "description": "b"},]\n```', "a", "b"),
]


@query("select * from (values " + ", ".join(f"({i}, '{n}', '{d}')" for i, (_, n, d) in enumerate(_SLIPS)) + ") as t(slip, name, description)")
def json_slips(spark: SparkSession, folder: str) -> DataFrame:
    """FN-J2: every step of the repair on an answer with that slip."""
    d = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(_SLIPS)], "slip int, text string")
    o = text.normal_objects(text.repair_json(text.fenced(F.col("text"))))
    return d.select("slip", o.alias("o")).select("slip", F.col("o")[0]["name"].alias("name"), F.col("o")[0]["description"].alias("description"))


@query("select event_id, json_extract(props, '$.k')::int as k, lpad(event_id::varchar, 6, '0') as padded, base64(encode(event_type)) as b64 from events")
def json_field(spark: SparkSession, folder: str) -> DataFrame:
    """FN-J4 PR6: a field of a JSON text, padded numbers and base 64."""
    e = table(spark, folder, "events", "event_id", "event_type", "props")
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), text.padded_frame(F.col("event_id")).alias("padded"), F.base64("event_type").alias("b64"))


@query("select file_id, regexp_extract(file_path, '([^/]+)$', 1) as name, case when contains(regexp_extract(file_path, '(.*)/[^/]+$', 1), '/') then regexp_extract(file_path, '([^/]+)/[^/]+$', 1) else regexp_extract(file_path, '([^/]+)/[^/]+$', 1) end as folder, case when size_bytes >= 1024 then printf('%.1f KB', size_bytes / 1024.0::double) else printf('%.1f B', size_bytes::double) end as size from (select distinct on (file_id) * from feature_file)")
def path_parts(spark: SparkSession, folder: str) -> DataFrame:
    """FN-S7 FN-S8 FN-S10: parts of paths and readable sizes."""
    f = table(spark, folder, "feature_file", "file_id", "file_path", "size_bytes").dropDuplicates(["file_id"])
    return f.select("file_id", text.path_part(F.col("file_path"), 1).alias("name"), text.path_part(F.col("file_path"), 2).alias("folder"), text.human_bytes(F.col("size_bytes")).alias("size"))


# geometry and arithmetic


@query(BASE + "select node_key, (c.r)::int as r, (c.g)::int as g, (c.b)::int as b, (c.r + c.g * 255 + c.b * 65025)::int as id from (select node_key, {'r': node_id % 255, 'g': (node_id // 255) % 255, 'b': (node_id // 65025) % 255} as c from nod where node_id is not null)")
def id_codec(spark: SparkSession, folder: str) -> DataFrame:
    """FN-G8: colour of an instance id and back."""
    n = nodes(spark, folder).where("node_id is not null").withColumn("c", geometry.encode_id(F.col("node_id")))
    return n.select("node_key", "c.*", geometry.decode_id(F.col("c.r"), F.col("c.g"), F.col("c.b")).alias("id"))


_QUATERNION = BASE + """, q0 as (select node_key, shape.orientation.x::double as x, shape.orientation.y::double as y, shape.orientation.z::double as z, shape.orientation.w::double as w from nod where shape.orientation is not null),
q1 as (select *, sqrt(x * x + y * y + z * z + w * w) as n from q0 where x is not null and y is not null and z is not null and w is not null), q as (select node_key, x / n as x, y / n as y, z / n as z, w / n as w from q1 where n > 0)
"""


def _oriented(spark: SparkSession, folder: str) -> DataFrame:
    q = nodes(spark, folder, "scan_id", "shape").where("shape.orientation is not null")
    o = [F.col(f"shape.orientation.{c}").cast("double") for c in "xyzw"]
    fine = o[0] * o[0] + o[1] * o[1] + o[2] * o[2] + o[3] * o[3] > 0
    return q.where(fine).withColumn("m", geometry.matrix_from_quaternion(*o))


@query(_QUATERNION + "select node_key, round(1 - 2 * (y * y + z * z), 5) as m00, round(2 * (x * y + z * w), 5) as m10, round(abs(x), 5) as ax, round(abs(w), 5) as aw from q")
def quaternion_rotation(spark: SparkSession, folder: str) -> DataFrame:
    """FN-G3 FN-G4: quaternion to matrix and back (up to sign)."""
    q = _oriented(spark, folder).withColumn("q", geometry.quaternion_from_matrix(F.col("m")))
    r = lambda c: F.round(c, 5)
    return q.select("node_key", r(F.col("m")[0][0]).alias("m00"), r(F.col("m")[1][0]).alias("m10"), r(F.abs(F.col("q.x"))).alias("ax"), r(F.abs(F.col("q.w"))).alias("aw"))


@query(
    _QUATERNION
    + """, h as (select q.*, coalesce(2 * nod.shape.radius, nod.shape.length)::double / 2 as hx, coalesce(2 * nod.shape.radius, nod.shape.width)::double / 2 as hy, nod.shape.height::double / 2 as hz, nod.x as px, nod.y as py, nod.z as pz from q join nod using (node_key) where isfinite(nod.x) and isfinite(nod.y) and isfinite(nod.z))
select node_key, round(px + abs(1 - 2 * (y * y + z * z)) * hx + abs(2 * (x * y - z * w)) * hy + abs(2 * (x * z + y * w)) * hz, 4) as max_x from h where hx is not null and hy is not null and hz is not null"""
)
def box_corners(spark: SparkSession, folder: str) -> DataFrame:
    """FN-G5 FN-G11 PR1 PR8 PR9: corners of the oriented box of a node; the largest x of the eight."""
    n = _oriented(spark, folder).where(spatial.finite("x", "y", "z")).withColumn("half", geometry.shape_half(F.col("shape"))).where("half[0] is not null and half[1] is not null and half[2] is not null")
    corners = geometry.box_corners(F.array("x", "y", "z"), F.col("half"), F.col("m"))
    return n.select("node_key", F.round(F.array_max(F.transform(corners, lambda c: c[0])), 4).alias("max_x"))


@query(BASE + "select node_key, round(0.6 * x - 0.8 * y + 1.5, 6) as tx, round(0.8 * x + 0.6 * y - 2.0, 6) as ty, round(x, 6) as back from pla")
def rigid_transform(spark: SparkSession, folder: str) -> DataFrame:
    """FN-G2: points moved by a rigid transform and back by its inverse."""
    t = F.array(*[F.lit(float(v)) for v in (0.6, -0.8, 0, 1.5, 0.8, 0.6, 0, -2.0, 0, 0, 1, 0.25, 0, 0, 0, 1)])
    n = placed_nodes(spark, folder).withColumn("t", t).withColumn("p", geometry.transform_point(F.col("t"), F.array("x", "y", "z")))
    back = geometry.transform_point(geometry.invert_rigid(F.col("t")), F.col("p"))
    return n.select("node_key", F.round(F.col("p")[0], 6).alias("tx"), F.round(F.col("p")[1], 6).alias("ty"), F.round(back[0], 6).alias("back"))


@query("select event_id, round((event_id % 640 - 319.5) * value / 577.5, 5) as x, round((event_id // 640 % 480 - 239.5) * value / 578.7, 5) as y, case when value > 0 then (event_id % 640)::int end as u, least(greatest(floor(value * 1000 + 0), 0), 65535)::int as mm from events where value is not null and value > 0 and value <= 100 and event_id % 3 = 0")
def back_projection(spark: SparkSession, folder: str) -> DataFrame:
    """FN-G1 FL9 SM3: pixels with depth to points and back to pixels, every third pixel, up to a depth."""
    e = table(spark, folder, "events", "event_id", "value").where("value > 0 and value <= 100 and event_id % 3 = 0")
    u, v = (F.col("event_id") % 640).cast("double"), F.floor(F.col("event_id") / 640).cast("double") % 480
    k = [F.lit(x) for x in (577.5, 578.7, 319.5, 239.5)]
    e = e.withColumn("p", geometry.back_project(u, v, F.col("value"), *k))
    seen = geometry.project(F.transform("p", lambda x: x), k[0], k[1], k[2] + 1e-6, k[3] + 1e-6)
    return e.select("event_id", F.round(F.col("p")[0], 5).alias("x"), F.round(F.col("p")[1], 5).alias("y"), seen["u"].alias("u"), geometry.depth_millimetres(F.col("value")).alias("mm"))


@query(
    BASE
    + """, e as (select a.scan_id, a.node_id as s, b.node_id as t, sqrt((a.y - b.y)^2 + (a.z - b.z)^2 + (a.x - b.x)^2) as d, b.x - a.x as dx from pla a join pla b on a.scan_id = b.scan_id and a.node_id < b.node_id where sqrt((a.y - b.y)^2 + (a.z - b.z)^2 + (a.x - b.x)^2) < 1.0)
select scan_id, s as source_id, t as target_id, round(case when d > 0 then dx / d else 0 end, 5) as dir_x, round(case when d > 0.001 then exp(-2 * d) else 0 end, 5) as score from e"""
)
def edge_direction(spark: SparkSession, folder: str) -> DataFrame:
    """FN-V1 FN-V11 FN-V13 FL4: direction and nearness of edges."""
    p = placed_nodes(spark, folder, "scan_id").select(F.col("scan_id").alias("scope"), F.col("node_id").alias("id"), "x", "y", "z")
    at = lambda i: p.select("scope", F.col("id").alias(f"id{i}"), F.array("x", "y", "z").alias(f"p{i}"))
    e = spatial.radius_pairs(p, 1.0).join(at(1), ["scope", "id1"]).join(at(2), ["scope", "id2"])
    d = vectors.euclid(F.col("p1"), F.col("p2"))
    return e.select(F.col("scope").alias("scan_id"), F.col("id1").alias("source_id"), F.col("id2").alias("target_id"), F.round(vectors.unit_direction(F.col("p1"), F.col("p2"))[0], 5).alias("dir_x"), F.round(vectors.distance_score(d), 5).alias("score"))


@query(
    BASE
    + """, s as (select scan_id, avg(x) as mx, avg(y) as my, avg(z) as mz, covar_pop(x, x) as a, covar_pop(x, y) as b, covar_pop(x, z) as c, covar_pop(y, y) as d, covar_pop(y, z) as e, covar_pop(z, z) as f from pla group by scan_id),
m as (select node_key, x - mx as p, y - my as q, z - mz as r, s.* from pla join s using (scan_id)),
k as (select *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) as det from m)
select node_key, round(sqrt((p * p * (d * f - e * e) + q * q * (a * f - c * c) + r * r * (a * d - b * b) + 2 * (p * q * (c * e - b * f) + p * r * (b * e - c * d) + q * r * (b * c - a * e))) / det), 5) as distance from k
where det > 1e-6 * a * d * f and sqrt((p * p * (d * f - e * e) + q * q * (a * f - c * c) + r * r * (a * d - b * b) + 2 * (p * q * (c * e - b * f) + p * r * (b * e - c * d) + q * r * (b * c - a * e))) / det) <= 1.2"""
)
def mahalanobis(spark: SparkSession, folder: str) -> DataFrame:
    """IT8: nodes near the middle of their scan by Mahalanobis distance."""
    n = placed_nodes(spark, folder, "scan_id").select("node_key", "scan_id", "x", "y", "z")
    return spatial.mahalanobis_filter(n, 1.2, ["scan_id"]).where("mahalanobis is not null").select("node_key", F.round("mahalanobis", 5).alias("distance"))


# positions, batches, chains


@query(
    BASE
    + """, f as (select distinct scan_id, frame_id from obs where frame_id is not null), p as (select *, row_number() over (partition by scan_id order by frame_id) - 1 as p, count(*) over (partition by scan_id) as n from f),
s as (select scan_id, n, unnest(range(0, greatest(n - 20, 0) // 10 + 1)) as seq_no from (select distinct scan_id, n from p))
select s.scan_id, s.seq_no::int as seq_no, p.frame_id from s join p on p.scan_id = s.scan_id and p.p >= s.seq_no * 10 and p.p < s.seq_no * 10 + 20"""
)
def frame_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """WN5: windows of 20 present frames, one every 10."""
    f = observations(spark, folder, "scan_id", "frame_id").where("frame_id is not null")
    return ranking.frame_sequences(f, "scan_id", "frame_id", 20, 10)


@query()
def random_windows(spark: SparkSession, folder: str) -> DataFrame:
    """RN1: windows at places drawn by hash."""
    f = observations(spark, folder, "scan_id", "frame_id").where("frame_id is not null")
    return ranking.random_windows(f, "scan_id", "frame_id", 20, 0.1, 2, 10)


@query(BASE + ", s as (select scan_id, dense_rank() over (order by scan_id) - 1 as r from (select distinct scan_id from nod)) select node_key, (s.r // 5)::int as batch, (nod.node_id // 1000)::int as block from nod join s using (scan_id)")
def frame_batches(spark: SparkSession, folder: str) -> DataFrame:
    """WN6 WN7 SK12: batches of five scans, and blocks of a thousand numbers."""
    n = ranking.scene_batches(nodes(spark, folder, "scan_id"), "scan_id", 5)
    return n.select("node_key", "batch", F.floor(F.col("node_id") / 1000).cast("int").alias("block"))


@query(BASE + ", r as (select obs_id, scan_id, row_number() over (partition by scan_id order by frame_id nulls first, obs_id) - 1 as p from obs) select obs_id from r where p % 3 = 0")
def every_nth(spark: SparkSession, folder: str) -> DataFrame:
    """WN8 SM6 T14: every third observation of a scan."""
    o = observations(spark, folder, "scan_id", "frame_id")
    return ranking.every_nth(o, ["scan_id"], 3, F.floor(F.col("frame_id") / 100), F.asc_nulls_first("frame_id"), "obs_id").select("obs_id")


@query(BASE + "select node_key, scan_id || '/' || lpad(node_id::varchar, 12, '0') as ordered, (row_number() over (partition by scan_id order by node_id desc, node_key))::int as rank from nod where node_id is not null")
def natural_order(spark: SparkSession, folder: str) -> DataFrame:
    """SO1 SO2 SO3 SO4 WN4: numbers in texts ordered by value, and ranks by size."""
    n = nodes(spark, folder, "scan_id").where("node_id is not null").withColumn("t", F.col("node_id").cast("string"))
    key = F.concat_ws("/", "scan_id", relational.natural_order("t"))
    return n.select("node_key", key.alias("ordered"), (ranking.position(["scan_id"], F.desc("node_id"), "node_key") + 1).alias("rank"))


@query(BASE + "select obs_id, arg_min(n.node_id, {'d': (n.x - o.center.x)^2 + (n.y - o.center.y)^2 + (n.z - o.center.z)^2, 'i': n.node_key}) as nearest from obs o join pla n on n.scan_id = o.scan_id and n.node_id = o.instance_id where o.center is not null group by obs_id")
def nearest_node(spark: SparkSession, folder: str) -> DataFrame:
    """SO9: of the nodes of an observation's instance the nearest to it."""
    o = observations(spark, folder, "scan_id", "instance_id", "center").where("center is not null").withColumnRenamed("instance_id", "node_id")
    d = (F.col("x") - F.col("center.x")) ** 2 + (F.col("y") - F.col("center.y")) ** 2 + (F.col("z") - F.col("center.z")) ** 2
    n = placed_nodes(spark, folder, "scan_id").select("node_key", "scan_id", "node_id", "x", "y", "z")
    return o.join(n, ["scan_id", "node_id"]).groupBy("obs_id").agg(F.min_by("node_id", F.struct(d.alias("d"), "node_key")).alias("nearest"))


_MERGES = BASE + """, e as (select a.node_key as id, min(b.node_key) as target from pla a join pla b on a.scan_id = b.scan_id and b.node_key < a.node_key where sqrt((a.y - b.y)^2 + (a.z - b.z)^2 + (a.x - b.x)^2) < 1.0 group by a.node_key)"""


def _merges(spark: SparkSession, folder: str) -> DataFrame:
    p = placed_nodes(spark, folder, "scan_id").select(F.col("scan_id").alias("scope"), F.col("node_key").alias("id"), "x", "y", "z")
    return spatial.radius_pairs(p, 1.0).groupBy(F.col("id2").alias("id")).agg(F.min("id1").alias("target"))


@query("with recursive " + _MERGES.strip().removeprefix("with ") + ", r as (select id, target as root from e union all select r.id, e.target from r join e on e.id = r.root) select id, min(root) as root from r group by id")
def id_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """IT3: merged ids followed to the last."""
    return graphs.resolve(_merges(spark, folder))


@query(BASE + ", t as (select match_id, coalesce(try_cast(nullif(regexp_extract(frame_scene, 'frame_(\\d+)_to', 1), '') as int), -1) as first, coalesce(try_cast(nullif(regexp_extract(frame_scene, '_to_(\\d+)', 1), '') as int), -1) as last from mat where frame_scene is not null) select * from t")
def subscan_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """PR5 FL18: frames of a subscan by its name."""
    from loomgraph.functions.scan_ids import subscan_range

    m = matcher_rows(spark, folder).where("frame_scene is not null").withColumn("r", subscan_range(F.col("frame_scene")))
    return m.select("match_id", F.coalesce("r.first", F.lit(-1)).alias("first"), F.coalesce("r.last", F.lit(-1)).alias("last"))


# documents, samples


def _graph_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    n = placed_nodes(spark, folder, "scan_id", "name", "visual_embedding", "text_embedding", "shape", "id", "node_position").where("node_id is not null")
    n = relational.first_per_key(n.withColumnRenamed("node_position", "position"), ["scan_id", "id"], ["node_key"])
    n = cut_lineage(n.select("scan_id", "id", "name", "visual_embedding", "text_embedding", "shape", "position", "x", "y", "z"))  # read by both sides of the join and by the documents
    p = n.select(F.col("scan_id").alias("scope"), "id", "x", "y", "z")
    e = spatial.radius_pairs(p, 1.0).select(F.col("scope").alias("scan_id"), F.lit("default").alias("hypothesis_id"), F.lit(1.0).cast("float").alias("confidence"), F.col("id1").alias("source_id"), F.col("id2").alias("target_id"), F.col("dist").cast("float").alias("distance"), F.array(F.lit(0.0).cast("float")).alias("direction"), F.lit("").alias("description"))
    return n, e


@query(BASE + ", n as (select distinct scan_id, id from pla where try_cast(id as int) is not null) select scan_id as file_path, count(*) as nodes from n group by scan_id")
def graph_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """SC1 SK1 PR7: graph documents written and read again."""
    n, e = _graph_tables(spark, folder)
    docs = sinks.graph_documents(n, e, "scan_id").select(F.col("scan_id").alias("file_path"), F.col("json").alias("value"))
    return files.graph_nodes(files.parse_graph(docs)).groupBy("file_path").agg(F.count("*").alias("nodes"))


@query()
def augmented_objects(spark: SparkSession, folder: str) -> DataFrame:
    """RN2 RN3: keypoints displaced and left out by hash."""
    k = matcher_rows(spark, folder).select("match_id", F.posexplode("keypoints0").alias("pos", "p")).where("p[0] is not null")
    objects = k.select("match_id", "pos", *[F.col("p")[i].alias(c) for i, c in enumerate("xyz")], F.lit(0.1).alias("size"))
    return augment.augment(objects, ["match_id", "pos"], ["match_id"]).select("match_id", "pos", "fate", "x", "y", "z")


@query()
def random_scenes(spark: SparkSession, folder: str) -> DataFrame:
    """RN4 IT11: made-up rooms with their relations."""
    rooms = augment.random_scenes(spark, 20).withColumnRenamed("scene", "scope")
    return augment.relations(spatial.radius_pairs(rooms, 4.0), rooms)
