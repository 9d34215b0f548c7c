"""Scopes with far more rows than the rest: nothing of them is lost, and no value holds all of them."""

from pyspark.sql import functions as F

from loomgraph.operators import matching
from loomgraph.plans import pipelines
from loomgraph.sources import files, sinks


def test_document_of_many_nodes_comes_in_parts(spark):
    n = spark.range(400).select(F.when(F.col("id") < 397, "big").otherwise("small").alias("scan_id"), F.col("id").cast("string").alias("id"), F.lit("x").alias("name"), *[F.array(F.col("id").cast("float")).alias(c) for c in ("visual_embedding", "text_embedding", "position")], F.lit(None).cast("struct<radius:float>").alias("shape"))
    e = n.alias("a").join(n.alias("b"), F.expr("a.scan_id = b.scan_id and a.id < b.id")).select("a.scan_id", F.lit("default").alias("hypothesis_id"), F.lit(1.0).cast("float").alias("confidence"), F.col("a.id").alias("source_id"), F.col("b.id").alias("target_id"), F.lit(1.0).cast("float").alias("distance"), F.lit(None).cast("array<float>").alias("direction"), F.lit("").alias("description"))
    stray = e.limit(1).withColumn("scan_id", F.lit("no nodes"))
    docs = sinks.graph_documents(n, e.unionByName(stray), "scan_id").cache()
    assert {r["scan_id"]: r["count"] for r in docs.groupBy("scan_id").count().collect()} == {"big": 5, "small": 1}
    g = files.parse_graph(docs.select(F.col("scan_id").alias("file_path"), F.col("json").alias("value")))
    assert sorted(r["id"] for r in files.graph_nodes(g).collect()) == sorted(str(i) for i in range(400))
    found = files.graph_edges(g).select("file_path", "source_id", "target_id")
    assert found.count() == 397 * 396 // 2 + 3
    assert found.exceptAll(e.select("scan_id", "source_id", "target_id")).count() == 0
    docs.unpersist()


def test_maps_take_their_nodes_from_one_computation(spark):
    o = spark.range(600).select(F.lit("scene0000_00").alias("scan_id"), (F.col("id") % 200).cast("int").alias("instance_id"), F.lit("chair").alias("object_name"), F.array_repeat(F.lit(1.0).cast("float"), 64).alias("feature"), F.struct(*[((F.col("id") % 200) * 0.01 + F.col("id") * 1e-7).alias(c) for c in "xyz"]).alias("center"))
    docs = pipelines.build_maps(o, radius=1.0)
    assert "avg(" not in docs._jdf.queryExecution().toString()  # sums in two orders differ, and put a node into two cells
    g = files.parse_graph(docs.select(F.col("scan_id").alias("file_path"), F.col("json").alias("value")))
    edges = sum(3 * (0.01 * (b - a)) ** 2 < 1 for a in range(200) for b in range(a + 1, 200))
    assert files.graph_edges(g).count() == edges and files.graph_nodes(g).count() == 200
    total = files.graph_sizes(g).groupBy("file_path").agg(F.sum("nodes").alias("n"), F.sum("edges").alias("e"), F.count("*").alias("parts")).collect()
    assert [(r["n"], r["e"], r["parts"]) for r in total] == [(200, edges, 2)]


def test_sizes_of_documents_without_sections(spark):
    docs = spark.createDataFrame([("a", "null"), ("b", '{"object_nodes": null}'), ("c", '{"object_nodes": {"nodes": {"1": {"id": "1"}}}, "edge_hypotheses": {"h": {"edges": null}, "i": {"edges": {"k": {"source_id": "1"}}}}}')], "file_path string, value string")
    assert [(r["file_path"], r["nodes"], r["edges"]) for r in files.graph_sizes(files.parse_graph(docs)).orderBy("file_path").collect()] == [("a", 0, 0), ("b", 0, 0), ("c", 1, 1)]


def test_frames_of_one_map_are_spread(spark, monkeypatch):
    monkeypatch.setattr(matching, "SHARE_NODES", 100)
    box = [F.lit(1.0).alias(c) for c in "hwl"]
    at = lambda n: [(F.col("id") % n).cast("double").alias(c) for c in "xyz"] + [F.array(F.col("id").cast("float")).alias("feature")]
    source = spark.range(80).select(F.concat(F.lit("f"), (F.col("id") % 40).cast("string")).alias("frame"), F.lit("m").alias("map"), F.col("id").cast("string").alias("id"), *at(7), *box)
    stray = source.where("id in ('0', '40')").withColumns({"map": F.lit("no nodes"), "frame": F.lit("s")})
    target = spark.range(50).select(F.lit("m").alias("map"), (-F.col("id")).alias("ord"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("id"), *at(5), *box)
    unseen = target.limit(3).withColumn("map", F.lit("no frames"))
    truth = source.select("map", "id", F.concat(F.lit("t"), F.col("id")).alias("target_id")).where("cast(id as int) < 50")
    found = matching.matcher_rows(source.unionByName(stray), target.unionByName(unseen), truth).withColumn("part", F.spark_partition_id()).collect()
    assert sorted(r["frame_id"] for r in found) == sorted(f"f{i}" for i in range(40))
    assert len({r["part"] for r in found}) > 4
    for r in found:
        i = int(r["frame_id"][1:])
        assert [v[0] for v in r["descriptors1"]] == [float(49 - k) for k in range(50)] and len(r["keypoints1"]) == len(r["bbox1"]) == 50
        assert sorted(zip((v[0] for v in r["descriptors0"]), r["matches0"])) == [(i, 49 - i), (i + 40, 9 - i if i < 10 else -1)]


def test_full_rows_are_spread_and_do_not_wait_for_a_hundred_rows(spark, monkeypatch, tmp_path):
    from loomgraph.plans import kernel_queries

    monkeypatch.setattr(matching, "SHARE_NODES", 100)
    spark.conf.unset("parquet.page.size.row.check.min")
    shares = [kernel_queries.QUERIES["training_texts"](spark, "/root/testdata/sf0.001")]
    assert spark.conf.get("parquet.page.size.row.check.min") == "1"
    monkeypatch.setattr(matching, "SHARE_NODES", 1 << 40)
    monkeypatch.setattr(matching, "HOP_ROWS", 0)
    shares.append(kernel_queries.QUERIES["training_texts"](spark, "/root/testdata/sf0.001"))
    most = [df.groupBy(F.spark_partition_id(), "scene_graph_id").count().groupBy("scene_graph_id").count().agg(F.max("count")).first()[0] for df in shares]
    assert most[0] > 1 and most[1] == 1
    assert sorted(map(str, shares[0].collect())) == sorted(map(str, shares[1].collect()))


def test_copies_of_maps_are_few_however_many_are_large(spark, monkeypatch):
    monkeypatch.setattr(matching, "SHARE_NODES", 1)
    cores = spark.sparkContext.defaultParallelism
    own = [F.concat(F.lit("m"), (F.col("id") % 40).cast("string")).alias("map"), F.col("id").cast("string").alias("id"), *[F.col("id").cast("double").alias(c) for c in "xyz"], F.array(F.col("id")).alias("feature"), F.col("id").alias("text"), *[F.lit(1.0).alias(c) for c in "hwl"]]
    source = spark.range(4000).select(F.concat_ws("/", (F.col("id") % 40).cast("string"), (F.col("id") % 2000).cast("string")).alias("frame"), *own)
    target = spark.range(400).select(F.col("id").alias("ord"), *own)
    truth = source.select("map", "id", F.col("id").alias("target_id")).where("cast(id as int) < 400")
    found = matching.matcher_rows(source, target, truth, texts=True).withColumn("part", F.spark_partition_id()).cache()
    assert found.count() == 2000 and found.where("size(text_embedding1) = 10 and size(keypoints0) = 2").count() == 2000
    assert found.select(F.explode("matches0").alias("m")).where("m >= 0").count() == 400
    assert found.select("scene_graph_id", "part").distinct().count() <= 40 + 2 * cores
    found.unpersist()


def test_each_key_once_whatever_repeats(spark, monkeypatch):
    from loomgraph.operators import relational

    df = spark.createDataFrame([(1, "a", [1.0]), (1, "a", [1.0]), (2, "b", [2.0]), (None, "c", [3.0]), (None, "c", [3.0]), (3, "d", None), (4, "e", [5.0]), (4, "e", [5.0]), (4, "e", [5.0])], "k long, s string, v array<double>")
    rows = lambda d: sorted(map(str, d.collect()))
    for some in (df, df.where("k > 1"), df.where("k in (2, 3)"), df.where("k > 9")):
        assert rows(relational.once(some, "k")) == rows(some.dropDuplicates(["k"]))
    monkeypatch.setattr(relational, "REPEATED_KEYS", 1)
    assert rows(relational.once(df, "k")) == rows(df.dropDuplicates(["k"]))


def test_vectors_of_observations_are_shuffled_once(spark, tmp_path):
    from loomgraph.plans import kernel_queries

    for name in ("instance_info", "object_node", "matched_instance_correspondence_to_00"):
        t = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        t.dropDuplicates([t.columns[0]]).write.parquet(f"{tmp_path}/{name}.parquet")
    repeated, single = (kernel_queries.QUERIES["training_rows"](spark, folder) for folder in ("/root/testdata/sf0.001", str(tmp_path)))
    assert "first(feature" not in single._jdf.queryExecution().executedPlan().toString()  # not by obs_id, and then by frame
    assert sorted(map(str, repeated.collect())) == sorted(map(str, single.collect()))
