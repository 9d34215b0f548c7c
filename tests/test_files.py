"""Sources and sinks on hand-written files."""

import json
import pickle
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.sources import binary, files, ply, sinks


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_graph_documents(spark, tmp_path):
    node = {"id": "1", "name": "unknown", "visual_embedding": [0.0], "shape": {"radius": 1.0, "height": 2.0}, "position": [1, 2, 3]}
    box = {"id": "b", "name": "x", "shape": {"length": 1.0, "width": 1.0, "height": 2.0}, "position": None}
    edge = {"source_id": "1", "target_id": "9", "distance": 1.0, "direction": [1, 0, 0], "description": ""}
    (tmp_path / "topology_map.json").write_text(json.dumps({"object_nodes": {"nodes": {"1": node, "b": box}}, "free_space_nodes": None, "edge_hypotheses": {"h1": {"id": "h1", "confidence": 0.5, "edges": {"1_9": edge, "1-b": edge}}, "h2": {"id": "h2", "edges": None}}}))
    (tmp_path / "topology_map_2.json").write_text("null")
    n, free, e = files.read_graphs(spark, str(tmp_path))
    assert rows(n, "key", "name") == [("1", "unknown"), ("b", "x")]
    assert free.count() == 0 and rows(e, "hypothesis_id", "source_id", "target_id", "confidence") == [("h1", "1", "9", 0.5)] * 2


def test_observations(spark, tmp_path):
    (tmp_path / "1_final_instance.json").write_text('[{"instance_id": 1, "object_name": "a"}, {"instance_id": 1, "object_name": "b", "confidence": 0.5}]')
    (tmp_path / "2_final_instance.json").write_text("null")
    (tmp_path / "3_final_instance.json").write_text("")
    (tmp_path / "4_final_instance.json").write_text('[{"instance_id": 2')
    (tmp_path / "5_instance.json").write_text('[{"instance_id": 7}]')
    assert rows(files.read_observations(spark, str(tmp_path)), "instance_id", "object_name", "confidence") == [(1, "b", 0.5)]


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("instance_id,name\r\n1,chair, red (old)/new\r\n2,table\r\nx,bad\r\n")
    (tmp_path / "b.csv").write_text("1,5\n2,5\nfoo,1\n3,\n")
    (tmp_path / "w.csv").write_text("scene0001_01\n scene0002_01 \n\n")
    (tmp_path / "l.tsv").write_text("id\tcategory\tmore\n1\tchair\tx\n")
    line = lambda n: files.lines(spark, str(tmp_path / n))
    assert rows(files.parse_name_map(line("a.csv")), "instance_id", "name") == [(1, "chair, red (old)/new"), (2, "table")]
    assert rows(files.parse_ids(line("b.csv")), "instance_id") == [(1,), (2,), (3,)]
    assert rows(files.parse_correspondences(line("b.csv")), "instance_id", "instance_id_in_00") == [(1, 5), (2, 5)]
    assert rows(files.read_worklist(spark, str(tmp_path / "w.csv")), "scan_id") == [("scene0001_01",), ("scene0002_01",)]
    assert rows(files.read_labels(spark, str(tmp_path / "l.tsv")), "id", "category") == [(1, "chair")]
    assert rows(files.catalog(spark, str(tmp_path), ".csv", without="w.csv"), "name") == [("a.csv",), ("b.csv",)]


def test_vectors_cameras_poses(spark, tmp_path):
    (tmp_path / "f.json").write_text('[{"instance_id": 1, "feature": [0.5], "occurance": 3}]')
    (tmp_path / "b.json").write_text('{"2": [1.5], "x": [1]}')
    assert rows(files.parse_vectors(files.whole_files(spark, str(tmp_path), "*.json")), "instance_id", "feature", "occurance") == [(1, [0.5], 3), (2, [1.5], None)]
    (tmp_path / "p.txt").write_text("1 0 0 1\n0 1 0 2\n0 0 1 3\n0 0 0 1\n")
    (tmp_path / "_info.txt").write_text("m_depthWidth = 640\nm_depthHeight = 480\nm_depthShift = 1000\nm_calibrationDepthIntrinsic = 577.5 0 319.5 0 0 578.7 239.5 0 0 0 1 0 0 0 0 1\n")
    assert [r["fine"] for r in files.parse_matrices(files.whole_files(spark, str(tmp_path), "p.txt")).collect()] == [True]
    camera = files.parse_cameras(files.named_files(spark.createDataFrame([(str(tmp_path / "_info.txt"),), ("/nowhere",)], "file_path string"))).first()
    assert (camera["width"], camera["depth_shift"], camera["fx"], camera["fy"], camera["cx"], camera["cy"]) == (640, 1000, 577.5, 578.7, 319.5, 239.5)


def test_batches_join_by_id(spark, tmp_path):
    body = lambda i, c: json.dumps({"custom_id": i, "response": {"body": {"choices": [{"message": {"content": c}}]}}})
    (tmp_path / "r.jsonl").write_text("\n".join([body("d/scene0001_00/12.jpg", '```json\n[{"name": "a", "description": "b"}]\n```'), body("d/scene0001_00/7.jpg", "sorry"), "{broken"]))
    (tmp_path / "m.txt").write_text("d/scene0001_00/7.jpg\nd/scene0001_00/12.jpg\n")
    got = files.decode_answers(files.parse_batch_results(files.lines(spark, str(tmp_path / "r.jsonl"))), files.parse_manifest(files.lines(spark, str(tmp_path / "m.txt"))))
    assert {(r["scene"], r["frame"]): r["objects"] and r["objects"][0]["name"] for r in got.collect()} == {("scene0001_00", 12): "a", ("scene0001_00", 7): None}


def test_point_clouds(spark, tmp_path):
    ply.register(spark)
    n = 300
    points = spark.range(n).select(*[F.rand(i).cast("float").alias(c) for i, c in enumerate("xyz")], (F.col("id") % 255).cast("int").alias("red"), F.lit(1).alias("green"), F.lit(0).alias("blue"))
    points.repartition(2).write.format("ply").mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("ply").load(str(tmp_path / "out"))
    assert back.count() == n and rows(back, "instance_id") == sorted((i % 255 + 255,) for i in range(n))
    (tmp_path / "t.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n1 2 3 4 5 0\nnan 2 3 0 0 0\n")
    assert [r["instance_id"] for r in spark.read.format("ply").load(str(tmp_path / "t.ply")).collect()] == [4 + 5 * 255, 0]


def png(image, filters):
    step = 2 if image.dtype == np.dtype(">u2") else 1
    h, w = image.shape
    raw, last = b"", bytes(w * step)
    for y in range(h):
        line, f = image[y].tobytes(), filters[y % len(filters)]
        left = lambda x: line[x - step] if x >= step else 0
        corner = lambda x: last[x - step] if x >= step else 0

        def guess(x):
            a, b, c = left(x), last[x], corner(x)
            if f == 4:
                p = a + b - c
                return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            return (0, a, b, (a + b) // 2)[f]

        raw += bytes([f]) + bytes((line[x] - guess(x)) & 255 for x in range(len(line)))
        last = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8 * step, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", ["u1", ">u2"])
def test_images(spark, tmp_path, kind):
    image = np.random.default_rng(1).integers(0, 250, (9, 7)).astype(kind)
    assert np.array_equal(binary.png(png(image, [0, 1, 2, 3, 4])), image.astype(int))
    top = 255 if kind == "u1" else 65535
    (tmp_path / "d.pgm").write_bytes(f"P5\n# note\n7 9\n{top}\n".encode() + image.tobytes())
    (tmp_path / "m.png").write_bytes(png(image, [4]))
    (tmp_path / "broken.png").write_bytes(b"nothing")
    want = sorted((int(v), int(u), int(image[v, u])) for v, u in np.argwhere(image))
    assert rows(binary.read_depth(spark, str(tmp_path)), "v", "u", "value") == want == rows(binary.read_mask(spark, str(tmp_path)), "v", "u", "value")


def test_matrices_pickles_archives(spark, tmp_path):
    np.save(tmp_path / "t.npy", np.eye(4))
    np.save(tmp_path / "u.npy", np.eye(3))
    assert [r["t"][:2] for r in binary.read_transforms(spark, str(tmp_path)).collect()] == [[1.0, 0.0]]
    (tmp_path / "a.pkl").write_bytes(pickle.dumps([{"matches0": np.array([1, -1]), "frame_id": "3"}, 5]))
    (tmp_path / "evil.pkl").write_bytes(b"cos\nsystem\n(S'true'\ntR.")
    assert rows(binary.read_pickles(spark, str(tmp_path), "frame_id string, matches0 array<int>"), "frame_id", "matches0") == [("3", [1, -1])]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("s/a.json", "{}")
        z.writestr("../b.json", "{}")
    assert rows(binary.read_archives(spark, str(tmp_path)), "member") == [("s/a.json",)]


def test_sinks(spark, tmp_path):
    images = spark.createDataFrame([("s", f"c{i}", bytearray(b"x" * 10)) for i in range(3)], "scene string, custom_id string, content binary")
    lines = sinks.request_lines(images, "m", "p").collect()
    assert all(json.loads(r["value"])["custom_id"] == r["custom_id"] for r in lines) and {r["file_no"] for r in lines} == {0}
    catalog = spark.createDataFrame([("d/scene0001_00/12_final_instance.json", "12_final_instance.json"), ("d/scene0001_00/per_frame/1_final_instance.json", "1_final_instance.json"), ("d/scene0001_00/x.txt", "x.txt"), ("d/scene0001_00/topology_map.json", "topology_map.json")], "file_path string, name string")
    assert rows(sinks.package_manifest(catalog), "archive_path") == [("scene0001_00/12.json",), ("scene0001_00/topology_map.json",)]
    poses = spark.createDataFrame([("a", "b", 7, [1.0, 0.5])], "map_scene string, frame_scene string, frame_id int, pose array<double>")
    assert sinks.pose_lines(poses).first()[0] == "a b 000007 1.0 0.5"
    obs = spark.createDataFrame([("s", 1, 5), ("s", 1, -1)], "scan_id string, frame_id int, instance_id int")
    sinks.write_frames(obs, str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f")).count() == 1
    names = spark.createDataFrame([("s", 2, "b"), ("s", 1, "a,c")], "scan_id string, instance_id int, name string")
    sinks.write_name_map(names, str(tmp_path / "n"))
    assert rows(files.parse_name_map(files.lines(spark, str(tmp_path / "n"), "*.csv")), "instance_id") == [(1,), (2,)]
    sinks.write_csv(names, str(tmp_path / "c"), "instance_id")
    sinks.write_in_batches(names.withColumn("batch", F.lit(0)), "batch", str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2 and sinks.metadata(names, 64).first()["rows"] == 2
