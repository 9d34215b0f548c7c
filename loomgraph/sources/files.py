"""Readers of the text, JSON and CSV files of a scene pipeline. Schemas are declared, never inferred; every reader keeps `file_path`."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as t
from loomgraph.functions.strict_json import strict_json
from loomgraph.operators.relational import last_per_key

#: The documents' schemas.
SHAPE = "struct<radius:float,height:float,length:float,width:float,orientation:struct<x:float,y:float,z:float,w:float>>"
NODE = f"struct<id:string,name:string,visual_embedding:array<float>,text_embedding:array<float>,shape:{SHAPE},position:array<float>>"
FREE = "struct<id:string,radius:float,position:array<float>>"
EDGE = "struct<source_id:string,target_id:string,distance:float,direction:array<float>,description:string>"
GRAPH = f"struct<object_nodes:struct<nodes:map<string,{NODE}>>,free_space_nodes:struct<nodes:map<string,{FREE}>>,edge_hypotheses:map<string,struct<id:string,confidence:float,edges:map<string,{EDGE}>>>>"
POINT = "struct<x:double,y:double,z:double>"
OBSERVATION = f"struct<instance_id:int,frame_instance_id:int,object_name:string,object_description:string,confidence:double,feature:array<float>,bert_embedding:array<float>,center:{POINT},bbox_size:{POINT},rotation:array<array<double>>>"
BOX = f"struct<instance_id:int,center:{POINT},bbox_size:{POINT},rotation:array<array<float>>>"


def whole_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """file_path, value: one row per file below the path."""
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), "value")


def named_files(paths: DataFrame, path: str = "file_path") -> DataFrame:
    """file_path, value of files by their full paths in a shared folder; also those whose names begin with `_`, which listings skip. Missing files give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(p, Path(p.removeprefix("file:"))) for p in pdf[path]]
            yield pd.DataFrame([(p, f.read_text(errors="replace")) for p, f in found if f.is_file()], columns=["file_path", "value"])

    return paths.select(path).mapInPandas(run, "file_path string, value string")


def lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """file_path, value: one row per line."""
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(F.col("_metadata.file_path").alias("file_path"), F.regexp_replace("value", r"\r$", "").alias("value"))


def catalog(spark: SparkSession, path: str, suffix: str = "", contains: str = "", without: str | None = None) -> DataFrame:
    """file_path, name, bytes, modified_at of the files below a path by suffix, part and exclusion; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file_path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified_at"))
    keep = F.col("file_path").endswith(suffix) & F.col("file_path").contains(contains)
    if without:
        keep = keep & ~F.col("file_path").contains(without)
    return files.where(keep).withColumn("name", t.path_part(F.col("file_path"), 1))


def parse_graph(files: DataFrame) -> DataFrame:
    """file_path and the sections of each graph document (`graph`), null where a section is null or absent."""
    return files.select("file_path", F.from_json("value", GRAPH).alias("graph"))


def graph_nodes(graphs: DataFrame) -> DataFrame:
    return graphs.select("file_path", F.explode("graph.object_nodes.nodes").alias("key", "n")).select("file_path", "key", "n.*")


def graph_free_nodes(graphs: DataFrame) -> DataFrame:
    return graphs.select("file_path", F.explode("graph.free_space_nodes.nodes").alias("key", "n")).select("file_path", "key", "n.*")


def graph_edges(graphs: DataFrame) -> DataFrame:
    """One row per edge of each hypothesis; hypotheses whose edges are null have none."""
    h = graphs.select("file_path", F.explode("graph.edge_hypotheses").alias("hypothesis_id", "h"))
    return h.select("file_path", "hypothesis_id", F.coalesce("h.confidence", F.lit(0.0)).alias("confidence"), F.explode("h.edges").alias("key", "e")).select("file_path", "hypothesis_id", "confidence", "e.*")


def graph_sizes(graphs: DataFrame) -> DataFrame:
    """file_path, nodes, edges of each graph document, or part of one: how many rows graph_nodes and graph_edges have of it."""
    many = lambda c: F.when(c.isNull(), 0).otherwise(F.size(c)).cast("long")
    edges = F.aggregate(F.map_values("graph.edge_hypotheses"), F.lit(0).cast("long"), lambda s, h: s + many(h["edges"]))
    return graphs.select("file_path", many(F.col("graph.object_nodes.nodes")).alias("nodes"), F.coalesce(edges, F.lit(0)).alias("edges"))


def read_graphs(spark: SparkSession, path: str, glob: str = "topology_map*.json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, free nodes, edges) of all graph documents below a path."""
    g = parse_graph(whole_files(spark, path, glob))
    return graph_nodes(g), graph_free_nodes(g), graph_edges(g)


def parse_observations(files: DataFrame, key: str | None = "instance_id") -> DataFrame:
    """One row per observation; blank, `null` and broken files have none. With a key, the last observation of each counts."""
    out = files.select("file_path", F.posexplode(F.from_json("value", f"array<{OBSERVATION}>")).alias("ordinal", "o")).where("o is not null").select("file_path", "ordinal", "o.*")
    out = out.withColumns({"confidence": F.coalesce("confidence", F.lit(0.0)), "object_description": F.coalesce("object_description", F.lit(""))})
    return last_per_key(out.where(F.col(key).isNotNull()), ["file_path", key], ["ordinal"]) if key else out


def read_observations(spark: SparkSession, path: str, suffix: str = "_final_instance.json", key: str | None = "instance_id") -> DataFrame:
    """Observations of the files with one suffix, so that the variants of a frame do not count several times."""
    return parse_observations(whole_files(spark, path, f"*{suffix}"), key)


def read_boxes(spark: SparkSession, path: str, glob: str = "*_instances.json") -> DataFrame:
    return whole_files(spark, path, glob).select("file_path", F.explode(F.from_json("value", f"array<{BOX}>")).alias("b")).select("file_path", "b.*")


def parse_vectors(files: DataFrame) -> DataFrame:
    """file_path, instance_id, feature, occurance: from an array of objects or from an object from id to vector, whichever the file holds."""
    v = files.withColumn("_v", strict_json(F.col("value")))
    listed = v.where(F.schema_of_variant("_v").startswith("ARRAY")).select("file_path", F.explode(F.from_json("value", "array<struct<instance_id:int,feature:array<float>,occurance:int>>")).alias("r")).select("file_path", "r.*")
    mapped = v.where(F.schema_of_variant("_v").startswith("OBJECT")).select("file_path", F.explode(F.from_json("value", "map<string,array<float>>")).alias("k", "feature"))
    mapped = mapped.select("file_path", F.trim("k").try_cast("int").alias("instance_id"), "feature", F.lit(None).cast("int").alias("occurance"))
    return listed.unionByName(mapped).where("instance_id is not null and feature is not null")


def parse_name_map(rows: DataFrame) -> DataFrame:
    """file_path, instance_id, name: split at the first comma, headers and other rows without an id dropped."""
    parts = t.split_first(F.col("value"))
    return rows.select("file_path", F.trim(parts[0]).try_cast("int").alias("instance_id"), F.get(parts, F.lit(1)).alias("name")).where("instance_id is not null")


def parse_ids(rows: DataFrame) -> DataFrame:
    """file_path, instance_id: distinct whole numbers of the first column, with or without a header."""
    return rows.select("file_path", F.trim(F.split("value", ",")[0]).try_cast("int").alias("instance_id")).where("instance_id is not null").distinct()


def parse_correspondences(rows: DataFrame) -> DataFrame:
    """file_path, instance_id, instance_id_in_00: headers and rows that are not whole numbers dropped."""
    p = F.split("value", ",")
    return rows.select("file_path", F.trim(p[0]).try_cast("int").alias("instance_id"), F.trim(F.get(p, F.lit(1))).try_cast("int").alias("instance_id_in_00")).where("instance_id is not null and instance_id_in_00 is not null")


def read_worklist(spark: SparkSession, path: str) -> DataFrame:
    """scan_id: one per line, no header."""
    return spark.read.schema("scan_id string").csv(path).select(F.trim("scan_id").alias("scan_id")).where("scan_id <> ''")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """id, category of a tab-separated label table with a header; further columns are ignored."""
    return lines(spark, path).select(F.split("value", "\t").alias("p")).select(F.trim(F.col("p")[0]).try_cast("int").alias("id"), F.get("p", F.lit(1)).alias("category")).where("id is not null")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("instance_name string, count long").option("header", True).csv(path)


def numbers(value: Column) -> Column:
    """Numbers of a text, split at white space."""
    return F.transform(F.split(F.regexp_replace(value, r"^\s+|\s+$", ""), r"\s+"), lambda x: x.try_cast("double"))


def parse_matrices(files: DataFrame) -> DataFrame:
    """file_path, m (16 numbers, row by row); `fine` is false for any other number of them."""
    m = files.select("file_path", numbers(F.col("value")).alias("m"))
    return m.withColumn("fine", (F.size("m") == 16) & ~F.exists("m", lambda x: x.isNull()))


def parse_cameras(files: DataFrame) -> DataFrame:
    """file_path, width, height, depth_shift, fx, fy, cx, cy of `key = value` files."""
    field = lambda k: F.regexp_extract("value", rf"(?m)^\s*{k}\s*=\s*(.*?)\s*$", 1)
    k = numbers(field("m_calibrationDepthIntrinsic"))
    whole = lambda n: field(n).try_cast("int")
    return files.select("file_path", whole("m_depthWidth").alias("width"), whole("m_depthHeight").alias("height"), whole("m_depthShift").alias("depth_shift"), *[F.get(k, F.lit(i)).alias(n) for n, i in (("fx", 0), ("fy", 5), ("cx", 2), ("cy", 6))])


def parse_batch_results(rows: DataFrame) -> DataFrame:
    """custom_id, content of the answers of a batch of requests; lines that are no JSON give nulls."""
    get = lambda p: F.get_json_object("value", p)
    return rows.select(get("$.custom_id").alias("custom_id"), get("$.response.body.choices[0].message.content").alias("content"))


def parse_manifest(rows: DataFrame) -> DataFrame:
    """custom_id, scene, frame of the requests, by the last parts of each path."""
    p = F.trim("value")
    return rows.where(p != "").select(p.alias("custom_id"), t.path_part(p, 2).alias("scene"), F.regexp_extract(t.path_part(p, 1), r"(\d+)", 1).try_cast("int").alias("frame"))


def decode_answers(results: DataFrame, manifest: DataFrame) -> DataFrame:
    """scene, frame, custom_id, objects of the answers, joined by custom_id and never by place; objects null where the answer cannot be read."""
    body = t.repair_json(t.fenced(F.col("content")))
    return manifest.join(results, "custom_id").select("custom_id", "scene", "frame", t.complete_objects(t.normal_objects(body)).alias("objects"))
