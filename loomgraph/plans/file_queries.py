"""Queries that write files in the formats of a scene pipeline, read them back, and are compared with the tables; each docstring names the inventory ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.vectors import usable
from loomgraph.plans.registry import registry
from loomgraph.plans.scene_queries import BASE, VALID, correspondence, nodes, observations, placed_nodes
from loomgraph.session import shared_folder
from loomgraph.sources import files, ply, sinks
from loomgraph.tables import table

QUERIES, SQL, query = registry()


def _lines(df: DataFrame, name: str, value: Column, header: str | None = None) -> DataFrame:
    """file_path, value of text lines written to the shared folder, a header among them."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    text = df.select(value.alias("value"))
    if header:
        text = text.unionByName(spark.createDataFrame([(h,) for h in header.split("|")], "value string"))
    text.write.text(path)
    return files.lines(spark, path)


_PLAIN = "regexp_replace(name, '[^A-Za-z0-9]', '', 'g')"


@query(BASE + f"select scan_id, instance_id, {_PLAIN} as name from nam where instance_id is not null and {_PLAIN} <> ''")
def file_name_maps(spark: SparkSession, folder: str) -> DataFrame:
    """SC6 SC7 SK6: name maps as one CSV per scan, written and read."""
    path = shared_folder(spark, "name-maps")
    n = table(spark, folder, "instance_name_map", "map_row_id", "scan_id", "instance_id", "name").dropDuplicates(["map_row_id"])
    sinks.write_name_map(n.withColumn("name", F.regexp_replace("name", "[^A-Za-z0-9]", "")).where("instance_id is not null and name <> ''"), path)
    back = files.parse_name_map(files.lines(spark, path, "*.csv"))
    return back.select(F.regexp_extract("file_path", "scan_id=([^/]+)", 1).alias("scan_id"), "instance_id", "name")


@query(BASE + "select instance_id, replace(name, chr(10), ' ') as name from nam where instance_id is not null and name is not null and not contains(name, chr(13))")
def file_first_commas(spark: SparkSession, folder: str) -> DataFrame:
    """SC6 FN-S1: name map lines whose names hold commas themselves, split at the first one, under a header."""
    n = table(spark, folder, "instance_name_map", "map_row_id", "instance_id", "name").dropDuplicates(["map_row_id"]).where("instance_id is not null and name is not null and not contains(name, '\\r')")
    value = F.concat_ws(",", F.col("instance_id").cast("string"), F.replace("name", F.lit("\n"), F.lit(" ")))
    return files.parse_name_map(_lines(n, "commas", value, "instance_id,name")).select("instance_id", "name")


@query(BASE + "select instance_id, instance_id_in_00, count(*) as n from cor where instance_id is not null and instance_id_in_00 is not null group by all")
def file_correspondences(spark: SparkSession, folder: str) -> DataFrame:
    """SC9 SC10 SC11 SK10: correspondences under a header, with remarks and rows without numbers between them."""
    value = F.concat_ws(",", F.coalesce(F.col("instance_id").cast("string"), F.lit("")), F.coalesce(F.col("instance_id_in_00").cast("string"), F.lit("")))
    back = files.parse_correspondences(_lines(correspondence(spark, folder), "correspondences", value, "instance_id,instance_id_in_00|# remark, 5|foo"))
    return back.groupBy("instance_id", "instance_id_in_00").agg(F.count("*").alias("n"))


@query(BASE + "select distinct instance_id from cor where instance_id is not null")
def file_id_sets(spark: SparkSession, folder: str) -> DataFrame:
    """SC8: a set of ids, once under a header and once without."""
    c = correspondence(spark, folder)
    value = F.concat_ws(",", F.coalesce(F.col("instance_id").cast("string"), F.lit("")), F.lit("x"))
    both = _lines(c, "ids", value, "instance_id,what").unionByName(_lines(c, "ids", value))
    return files.parse_ids(both).select("instance_id").distinct()


@query(BASE + "select distinct scan_id from obs where scan_id is not null")
def file_worklist(spark: SparkSession, folder: str) -> DataFrame:
    """SC12 SK19: a worklist of scans, written and read."""
    path = shared_folder(spark, "worklist")
    observations(spark, folder, "scan_id").where("scan_id is not null").select(F.concat(F.lit(" "), "scan_id", F.lit(" ")).alias("scan_id")).distinct().write.option("ignoreLeadingWhiteSpace", False).csv(path)
    return files.read_worklist(spark, path)


@query(
    BASE
    + f"""select scan_id, instance_id, arg_max(feature, obs_id)[1]::double as first, arg_max(feature, obs_id)[64]::double as last, case when instance_id % 2 = 0 then count(*)::int end as occurance
from obs where instance_id >= 0 and feature is not null and {VALID.format(c="feature")} group by scan_id, instance_id"""
)
def file_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """SC4 SC5 SK4 SK5: vectors of a scan as an array of records, and as an object from id to vector."""
    o = observations(spark, folder, "scan_id", "instance_id", "feature").where((F.col("instance_id") >= 0) & usable(F.col("feature"), 64))
    v = o.groupBy("scan_id", "instance_id").agg(F.max_by("feature", "obs_id").alias("feature"), F.count("*").cast("int").alias("occurance"))
    listed = v.where("instance_id % 2 = 0").groupBy("scan_id").agg(F.to_json(F.collect_list(F.struct("instance_id", "feature", "occurance"))).alias("value"))
    mapped = v.where("instance_id % 2 = 1").groupBy("scan_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("instance_id").cast("string"), "feature")))).alias("value"))
    path = shared_folder(spark, "vectors")
    listed.withColumn("kind", F.lit("list")).unionByName(mapped.withColumn("kind", F.lit("map"))).repartition("scan_id", "kind").write.partitionBy("scan_id", "kind").text(path)
    back = files.parse_vectors(files.whole_files(spark, path, "*.txt"))
    return back.select(F.regexp_extract("file_path", "scan_id=([^/]+)", 1).alias("scan_id"), "instance_id", F.col("feature")[0].cast("double").alias("first"), F.col("feature")[63].cast("double").alias("last"), "occurance")


@query(
    BASE
    + """, s as (select scan_id || '/' || frame_id as file_path, instance_id, obs_id, object_name, coalesce(confidence, 0) as confidence, coalesce(object_description, '') as d from obs where scan_id is not null and frame_id is not null and instance_id is not null and instance_id <> -1 and (confidence is null or not isnan(confidence))),
r as (select *, row_number() over (partition by file_path, instance_id order by obs_id desc) as k from s)
select file_path, instance_id, object_name, confidence, md5(d) as description from r where k = 1"""
)
def file_observations(spark: SparkSession, folder: str) -> DataFrame:
    """SC2 SC3 SK3 SK9: observations of a frame as one document whose records leave out what is null; the last of an instance counts."""
    o = observations(spark, folder, "scan_id", "frame_id", "instance_id", "object_name", "object_description", "confidence").where("scan_id is not null and frame_id is not null and instance_id <> -1 and (confidence is null or not isnan(confidence))")
    record = F.struct("obs_id", "instance_id", "object_name", "object_description", "confidence")
    documents = o.groupBy(F.concat_ws("/", "scan_id", F.col("frame_id").cast("string")).alias("file_path")).agg(F.to_json(F.sort_array(F.collect_list(record))).alias("value"))  # the records of one image
    broken = spark.createDataFrame([("x/1", ""), ("x/2", "null"), ("x/3", '[{"instance_id": 1')], "file_path string, value string")
    return files.parse_observations(documents.unionByName(broken)).select("file_path", "instance_id", "object_name", "confidence", F.md5("object_description").alias("description"))


@query(BASE + "select node_key, x, y, z, true as fine from pla")
def file_poses(spark: SparkSession, folder: str) -> DataFrame:
    """SC17 SK11 SK13: poses as lines of text and as matrices of 16 numbers."""
    one, none = F.lit(1.0), F.lit(0.0)
    n = placed_nodes(spark, folder, "scan_id").withColumn("pose", F.array(one, none, none, F.col("x"), none, one, none, F.col("y"), none, none, one, F.col("z"), none, none, none, one))
    poses = sinks.pose_lines(n.select(F.lit("m").alias("map_scene"), F.col("node_key").cast("string").alias("frame_scene"), F.lit(1).alias("frame_id"), "pose"))
    back = _lines(poses, "poses", F.col("value"))
    matrix = back.select(F.regexp_extract("value", r"^m (\d+) 000001 ", 1).alias("file_path"), F.regexp_replace("value", r"^m \d+ 000001 ", "").alias("value"))
    return files.parse_matrices(matrix).select(F.col("file_path").cast("long").alias("node_key"), F.col("m")[3].alias("x"), F.col("m")[7].alias("y"), F.col("m")[11].alias("z"), "fine")


@query("select id, category from label_table")
def file_labels(spark: SparkSession, folder: str) -> DataFrame:
    """SC13: the label table as tab-separated text under a header."""
    path = shared_folder(spark, "labels")
    labels = table(spark, folder, "label_table").select(F.concat_ws("\t", F.col("id").cast("string"), "category", F.coalesce("aliases", F.lit(""))).alias("value"))
    labels.unionByName(spark.createDataFrame([("id\tcategory\tmore",)], "value string")).write.text(path)
    return files.read_labels(spark, path)


@query(f"select {_PLAIN.replace('name', 'object_name')} as instance_name, count(*) as count from (select distinct on (obs_id) * from instance_info) where {_PLAIN.replace('name', 'object_name')} <> '' group by 1")
def file_counts(spark: SparkSession, folder: str) -> DataFrame:
    """SC14 SK15 SK18: counted names as a report in order, written and read."""
    path = shared_folder(spark, "counts")
    o = observations(spark, folder, "object_name").select(F.regexp_replace("object_name", "[^A-Za-z0-9]", "").alias("instance_name")).where("instance_name <> ''")
    sinks.write_csv(o.groupBy("instance_name").agg(F.count("*").alias("count")), path, F.desc("count"), "instance_name")
    return files.read_counts(spark, path)


@query(BASE + "select node_key, (node_id % 4000)::int as width, (node_key % 3000)::int as height, 1000 as depth_shift, x as fx, y as fy, z as cx, 0.5::double as cy from pla where node_id is not null")
def file_cameras(spark: SparkSession, folder: str) -> DataFrame:
    """SC18: settings of cameras as `key = value` texts."""
    n = placed_nodes(spark, folder).where("node_id is not null")
    text = lambda c: F.col(c).cast("string")
    value = F.concat(F.lit("m_sensorName = x\nm_depthWidth = "), (F.col("node_id") % 4000).cast("string"), F.lit("\nm_depthHeight = "), (F.col("node_key") % 3000).cast("string"), F.lit("\nm_depthShift = 1000\nm_calibrationDepthIntrinsic = "), text("x"), F.lit(" 0 "), text("z"), F.lit(" 0 0 "), text("y"), F.lit(" 0.5 0 0 0 1 0 0 0 0 1\n"))
    back = files.parse_cameras(n.select(text("node_key").alias("file_path"), value.alias("value")))
    return back.select(F.col("file_path").cast("long").alias("node_key"), "width", "height", "depth_shift", "fx", "fy", "cx", "cy")


@query("select 'd/' || coalesce(scan_id, 'scene') || '/' || doc_id || '.jpg' as custom_id, coalesce(scan_id, 'scene') as scene, doc_id::bigint as frame, md5(text) as content from documents where source = 'tagging_response' and text is not null")
def file_answers(spark: SparkSession, folder: str) -> DataFrame:
    """SC21 SC22 JN22: answers of a batch, joined with the manifest of their requests by id, not by place."""
    d = table(spark, folder, "documents", "doc_id", "scan_id", "source", "text").where("source = 'tagging_response' and text is not null")
    d = d.withColumn("custom_id", F.concat(F.lit("d/"), F.coalesce("scan_id", F.lit("scene")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jpg")))
    message = F.struct(F.struct(F.col("text").alias("content")).alias("message"))
    answer = F.to_json(F.struct("custom_id", F.struct(F.struct(F.array(message).alias("choices")).alias("body")).alias("response")))
    results = files.parse_batch_results(_lines(d, "answers", answer, "{broken"))
    manifest = files.parse_manifest(_lines(d.orderBy(F.desc("doc_id")), "manifest", F.concat(F.lit(" "), "custom_id")))
    return manifest.join(results, "custom_id").select("custom_id", "scene", F.col("frame").cast("long").alias("frame"), F.md5("content").alias("content"))


@query("select 'c' || doc_id as custom_id, 0 as file_no, md5(text) as content from documents where text is not null and text <> '' and source = 'tagging_response'")
def file_requests(spark: SparkSession, folder: str) -> DataFrame:
    """SK21: requests with their content in base 64, in files of a bounded size."""
    d = table(spark, folder, "documents", "doc_id", "source", "text").where("text is not null and text <> '' and source = 'tagging_response'")
    images = d.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("custom_id"), F.coalesce("source", F.lit("")).alias("scene"), F.col("text").cast("binary").alias("content"))
    url = F.get_json_object("value", "$.body.messages[0].content[1].image_url")
    return sinks.request_lines(images, "m", "p").select("custom_id", "file_no", F.md5(F.unbase64(F.substring_index(url, ",", -1))).alias("content"))


_PATH = "replace(file_path, '_instance.json', '_final_instance.json')"


@query(
    f"""select distinct {_PATH} as file_path, regexp_extract(file_path, '(scene\\d+_\\d+)', 1) || '/' || regexp_extract(file_path, '(\\d+)_[^/]*$', 1) || '.json' as archive_path
from feature_file where regexp_matches({_PATH}, '(^|/)\\d+_final_instance\\.json$') and regexp_matches(file_path, 'scene\\d+_\\d+') and not contains(file_path, '/per_frame/')"""
)
def file_package(spark: SparkSession, folder: str) -> DataFrame:
    """SC23 SK20: what goes into a package, final instance files under the number of their frame."""
    f = table(spark, folder, "feature_file", "file_path").select(F.replace("file_path", F.lit("_instance.json"), F.lit("_final_instance.json")).alias("file_path")).where("file_path is not null").distinct()
    return sinks.package_manifest(f.withColumn("name", F.substring_index("file_path", "/", -1)))


@query(BASE + "select count(*) as rows, 64 as feature_dim, [0.0::double, 1.0::double] as position_range, [0.0::double, 1.0::double] as bbox_range from mat")
def file_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """SK14: the description of a written set."""
    return sinks.metadata(table(spark, folder, "matcher_row", "match_id").dropDuplicates(["match_id"]), 64)


@query(BASE + "select x::float::double as x, y::float::double as y, z::float::double as z, (node_id % 16000000)::int as instance_id from pla where node_id >= 0")
def file_points(spark: SparkSession, folder: str) -> DataFrame:
    """SC15 SK7 FN-G8: points as PLY files, whose colours hold the instance ids, written and read."""
    ply.register(spark)
    path = shared_folder(spark, "points")
    n = placed_nodes(spark, folder).where("node_id >= 0").withColumn("i", F.col("node_id") % 16000000)
    colour = [(F.floor(F.col("i") / 255**k) % 255).cast("int") for k in range(3)]
    n.select(*[F.col(c).cast("float").alias(c) for c in "xyz"], *[c.alias(k) for c, k in zip(colour, ("red", "green", "blue"))]).write.format("ply").mode("append").save(path)
    return ply.read_points(spark, path).select(*[F.col(c).cast("double").alias(c) for c in "xyz"], "instance_id")


@query(BASE + "select node_key, scan_id, (node_id // 100)::int as batch from nod where node_id is not null")
def file_batches(spark: SparkSession, folder: str) -> DataFrame:
    """SK12: rows in one file per batch, written and read."""
    path = shared_folder(spark, "batches")
    sinks.write_in_batches(nodes(spark, folder, "scan_id").where("node_id is not null").select("node_key", "scan_id", F.floor(F.col("node_id") / 100).cast("int").alias("batch")), "batch", path)
    return spark.read.schema("node_key bigint, scan_id string, batch int").parquet(path)
