"""Vectors, geometry, texts, spatial joins, graphs and ranks against brute force and identities."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import geometry, scan_ids, text, vectors
from loomgraph.operators import aggregates, graphs, kernels, ranking, relational, spatial


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def arr(xs, kind="double"):
    return F.array(*[F.lit(x) for x in xs]).cast(f"array<{kind}>")


def test_vectors(spark):
    a, b, z = arr([1.0, 2.0]), arr([2.0, 4.0]), arr([0.0, 0.0])
    r = one(spark, vectors.cosine(a, b), vectors.cosine(a, z), vectors.cosine_smoothed(a, z), vectors.euclid(a, b), vectors.midpoint(a, b), vectors.unit_direction(a, a), vectors.distance_score(F.lit(0.0005)), vectors.cosine_distance(a, b))
    assert r[0] == pytest.approx(1) and r[1] is None and r[2] == 0 and r[3] == pytest.approx(5**0.5) and r[4] == [1.5, 3.0] and r[5] == [0.0, 0.0] and r[6] == 0 and r[7] == pytest.approx(0)
    r = one(spark, vectors.into_unit(arr([-1.0, 3.0])), vectors.into_unit(arr([0.2, 0.4])), vectors.normalise(arr([1.0, 2.0]), F.lit(1.0), F.lit(1.0)), vectors.usable(arr([float("nan"), 1.0]), 2), vectors.usable(F.lit(None).cast("array<double>"), 2))
    assert r[0] == [0.0, 1.0] and r[1] == [0.2, 0.4] and r[2] == [None, None] and not r[3] and not r[4]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1, 1), min_size=4, max_size=4).filter(lambda q: sum(x * x for x in q) > 0.1))
def test_rotation_round_trip(spark, q):
    m = geometry.matrix_from_quaternion(*[F.lit(x) for x in q])
    r = one(spark, m.alias("m"), geometry.quaternion_from_matrix(m).alias("q"))
    m = np.array(r["m"])
    assert np.allclose(m @ m.T, np.eye(3), atol=1e-6)
    back, want = np.array([r["q"][c] for c in "xyzw"]), np.array(q) / np.linalg.norm(q)
    assert np.allclose(back, want, atol=1e-4) or np.allclose(back, -want, atol=1e-4)


@pytest.mark.parametrize("i", [0, 1, 254, 255, 256, 65024, 65025, 70000])
def test_id_codec(spark, i):
    c = geometry.encode_id(F.lit(i))
    assert one(spark, geometry.decode_id(c["r"], c["g"], c["b"]))[0] == i


def test_rigid_and_boxes(spark):
    t = arr([0.6, -0.8, 0, 1, 0.8, 0.6, 0, 2, 0, 0, 1, 3, 0, 0, 0, 1])
    r = one(spark, geometry.compose(t, geometry.invert_rigid(t)), geometry.box_corners(arr([0, 0, 0]), arr([1, 2, 3]), F.array(arr([1, 0, 0]), arr([0, 1, 0]), arr([0, 0, 1]))))
    assert np.allclose(np.array(r[0]).reshape(4, 4), np.eye(4)) and sorted(r[1]) == sorted([x, y, z] for x in (-1, 1) for y in (-2, 2) for z in (-3, 3))


def test_texts(spark):
    cases = {
        "scene73_00": "scene0073_00", "SCENE0001-02": "scene0001_02", "scene 0003 01": "scene0003_01", "./maps/Scene0005_00/": "scene0005_00", "scene12345_01/frame_3_to_9": "scene12345_01", "-1": None, "unknown": None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", scan_ids.scan_id(F.col("t")).alias("s"))
    assert {r["t"]: r["s"] for r in df.collect()} == cases
    r = one(spark, text.repair_csv_name(F.lit("a, b (c)/d")), text.clean_tag(F.lit(" table-top 3d ")), text.strip_numbering(F.lit("12)  office  chair")), text.human_bytes(F.lit(1536)), text.is_final_instance_file(F.lit("12_final_instance.json")), text.yes_no_class(F.lit("Yes, chair")))
    assert r[0] == "a b c or d" and r[1] == "Table-top 3d" and r[2] == "Office Chair" and r[3] == "1.5 KB" and r[4] and r[5]["yes"] and r[5]["class"] == "chair"


@pytest.mark.parametrize(
    "answer, names",
    [
        ('```json\n{"objects": [{"name": "a", "description": "b"}]}\n```', ["a"]),
        ('[{"name": "a", "description": "b"}, {"name": "", "description": "c"}]', ["a"]),
        ('{"x": [{"name": "a", "description": "b"}], "y": []}', None),
        ('{"objects": [{"name": “a”, "description": "b",}],}', ["a"]),
        ('{"objects": [{"name": "a"; "description": "b"}]}', ["a"]),
        ("no json", None),
        (None, None),
    ],
)
def test_answers(spark, answer, names):
    t = F.lit(answer).cast("string")
    got = one(spark, text.complete_objects(text.normal_objects(text.repair_json(text.fenced(t)))))[0]
    assert (None if got is None else [o["name"] for o in got]) == names


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), *[st.floats(-2, 2).map(lambda x: round(x, 3))] * 3), min_size=0, max_size=40))
def test_radius_pairs_equal_brute_force(spark, points):
    rows = [(f"s{p[0]}", i, *p[1:]) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "scope string, id long, x double, y double, z double")
    want = {(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and sum((p - q) ** 2 for p, q in zip(a[2:], b[2:])) ** 0.5 < 0.7}
    got = spatial.radius_pairs(df, 0.7).collect()
    assert {(r["id1"], r["id2"]) for r in got} == want and len(got) == len(want)


def test_clusters_chains_and_outliers(spark):
    line = [("s", i, i * 0.5, 0.0, 0.0) for i in range(10)] + [("s", 20, 50.0, 0.0, 0.0), ("s", 30, 60.0, 0.0, 0.0), ("s", 31, 60.2, 0.0, 0.0)]
    df = spark.createDataFrame(line, "scope string, id long, x double, y double, z double")
    got = {r["id"]: r["cluster"] for r in graphs.dbscan(df, 0.6, 3).collect()}
    assert {got[i] for i in range(10)} == {1} and got[20] is None and got[30] is None
    assert {r["id"] for r in graphs.largest_cluster(graphs.dbscan(df, 0.6, 3)).collect()} == set(range(10))
    assert {r["id"] for r in graphs.clusters_of_half(graphs.dbscan(df, 0.6, 1), 2).collect()} == set(range(10))
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 40)] + [(100, -1)], "id long, target long")
    got = {r["id"]: r["root"] for r in graphs.resolve(chain).collect()}
    assert all(got[i] == 0 for i in range(1, 40)) and got[100] == -1
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in graphs.connected_components(edges).collect()}
    assert {got[i] for i in range(51)} == {0} and got[101] == 100
    assert graphs.connected_components(edges.limit(0)).count() == 0


def test_kernels():
    rng = np.random.default_rng(0)
    cloud = rng.normal(size=(200, 3))
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    turn *= np.sign(np.linalg.det(turn))
    t = np.eye(4)
    t[:3, :3], t[:3, 3] = turn, [1, 2, 3]
    assert np.allclose(kernels.rigid_fit(cloud, kernels.move(t, cloud)), t)
    moved = kernels.move(t, cloud)
    moved[:40] += 5
    good, found = kernels.ransac_fit(cloud, moved)
    assert good.sum() == 160 and np.allclose(found, t, atol=1e-6)
    near = kernels.move(np.array([[1, -0.02, 0, 0.05], [0.02, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]), cloud)
    assert np.abs(kernels.move(kernels.icp(cloud, near), cloud) - near).max() < 1e-2
    assert not kernels.statistical_inliers(np.vstack([cloud, [[40, 40, 40]]]), 10)[-1]
    center, size, axes = kernels.principal_box(kernels.move(t, cloud * [5, 2, 1]))
    assert size[0] > size[1] > size[2] and np.isclose(np.linalg.det(axes), 1)
    boxes = np.array([[0, 0, 2, 2], [0, 0, 2, 1.9], [5, 5, 6, 6]], float)
    assert kernels.suppress(boxes, np.array([0.5, 0.9, 0.1])).tolist() == [1, 2]
    assert kernels.cloud_iou(cloud, cloud, 0.01) == 1.0 and kernels.overlap_score(cloud, cloud, 0.01)[:2] == (1.0, 1.0)
    placed = kernels.place_circles([1.0, 1.0, 0.5], 10, 10)
    assert all(np.linalg.norm(placed[i] - placed[j]) >= r for i, j, r in ((0, 1, 2), (0, 2, 1.5), (1, 2, 1.5)))


def test_entities_join_and_merge():
    at = lambda x: np.array([[x, 0.0, 0.0]])
    f, g = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    of, instances = kernels.resolve_entities([[(1, at(0), f, "a"), (2, at(9), g, "b")], [(3, at(0.01), f, "a")], [(4, at(0.5), f, "c")]])
    assert of[1] == of[3] != of[2] and of[4] not in (of[1], of[2])
    instances[2].points = at(0.0)
    assert kernels.merge_instances(instances) == {instances[2].number: instances[0].number}
    assert instances[0].count == 3


def _detections(rows, folder):
    """instance_info of (obs_id, scan_id, frame_id, place on x, axis of the feature)."""
    import pandas as pd

    f = lambda axis: np.eye(64, dtype=np.float32)[axis].tolist()
    pd.DataFrame([{"obs_id": o, "scan_id": s, "frame_id": t, "instance_id": 1, "object_name": "a", "feature": f(axis), "center": {"x": float(x), "y": 0.0, "z": 0.0}} for o, s, t, x, axis in rows]).to_parquet(f"{folder}/instance_info.parquet")


def test_entities_of_a_whole_scan(spark, tmp_path):
    from loomgraph.plans.kernel_queries import QUERIES

    _detections([(1, "s", 0, 0, 0), (2, "s", 600, 0.01, 0), (3, "s", 601, 9, 1), (4, "s", 1200, 9, 1), (5, "s", 1200, 20, 1)], tmp_path)
    got = {r["obs_id"]: r["entity"] for r in QUERIES["entity_resolution"](spark, str(tmp_path)).collect()}
    assert got[1] == got[2] and got[3] == got[4] and len({got[1], got[3], got[5]}) == 3


def test_entities_equal_trying_all_instances():
    def plain(frames, alike, overlap, radius):
        of, instances = {}, []
        for n, p, f, name in itertools.chain(*frames):
            scores = [(0.5 * s + 0.5 * o, -g.number) for g in instances if (s := kernels.similarity(g.feature, f)) >= alike and (o := kernels.cloud_iou(g.points, p, radius)) >= overlap]
            if scores:
                g = instances[-max(scores)[1]]
                g.add(p, f, name, len(p), 10_000)
            else:
                g = kernels.Instance(len(instances), p, f, name, len(p))
                instances.append(g)
            of[n] = g.number
        into = {}
        for a, b in itertools.combinations(instances, 2):
            if a.number in into or b.number in into or np.linalg.norm(a.points.mean(0) - b.points.mean(0)) > 2:
                continue
            o, s = kernels.cloud_iou(a.points, b.points, radius), kernels.similarity(a.feature, b.feature)
            if o > 0.7 or (s > 0.7 and (o > 0.3 or (kernels.nearest_distances(b.points, a.points)[:, 0] < radius).mean() > 0.8)):
                into[b.number] = a.number
                a.absorb(b)
        return of, into

    rng = np.random.default_rng(3)
    frames = [[(10 * t + d, rng.normal(rng.integers(-1, 2, 3), 0.15, (rng.integers(1, 6), 3)), np.eye(4)[rng.integers(0, 4)] + rng.normal(0, 0.2, 4), None) for d in range(5)] for t in range(30)]
    of, instances = kernels.resolve_entities(frames, 0.8, 0.3, 0.5)
    n = len(instances)
    into = kernels.merge_instances(instances, 2.0, 0.5)
    assert (of, into) == plain(frames, 0.8, 0.3, 0.5) and n < len(of) and into


def test_registration_finds_few_true_pairs(spark, tmp_path):
    import pandas as pd

    from loomgraph.plans.kernel_queries import QUERIES

    n, rng = 100, np.random.default_rng(0)
    a, b = rng.uniform(-20, 20, (n, 3)), rng.uniform(-20, 20, (n, 3))
    true = rng.choice(n, 8, replace=False)
    b[true] = a[true] + [1, 2, 3]
    nodes = [(s, str(i), p.tolist()) for s, c in (("scene0000_01", a), ("scene0000_00", b)) for i, p in enumerate(c)]
    pd.DataFrame([{"node_key": k, "scan_id": s, "id": i, "node_position": p} for k, (s, i, p) in enumerate(nodes)]).to_parquet(tmp_path / "object_node.parquet")
    pd.DataFrame([{"corr_id": i, "scan_id": "scene0000_01", "instance_id": i, "instance_id_in_00": i, "matched_at": None} for i in range(n)]).to_parquet(tmp_path / "matched_instance_correspondence_to_00.parquet")
    assert kernels.ransac_fit(a, b, 0.3, 200)[0].sum() < 8
    r = QUERIES["registration"](spark, str(tmp_path)).first()
    assert (r["pairs"], r["agreeing"]) == (n, 8)


def test_embedding_matching_equals_brute_force(spark, tmp_path):
    import pandas as pd

    from loomgraph.plans.kernel_queries import QUERIES

    rng, kinds = np.random.default_rng(6), np.eye(64)[:4]
    nodes, seen = [], []
    for s, spell in (("scene0000_00", "Chair"), ("scene0000_01", "chair "), ("scene0000_02", "seat"), ("scene0001_00", "Chair")):
        for i in range(12):
            at = rng.uniform(-2.5, 2.5, 3)
            e = kinds[i % 4] + rng.normal(0, 0.1, 64)
            nodes.append({"node_key": len(nodes), "scan_id": s, "id": str(i), "name": "unknown" if i == 11 else f"{spell}{i}", "text_embedding": e.astype(np.float32).tolist() if i != 10 else None, "node_position": at.astype(np.float32).tolist()})
            seen += [(s, i, at + rng.normal(0, 0.3, 3)) for _ in range(4)]
    pd.DataFrame(nodes).to_parquet(tmp_path / "object_node.parquet")
    pd.DataFrame([{"obs_id": k, "scan_id": s, "instance_id": i, "center": dict(zip("xyz", p.tolist()))} for k, (s, i, p) in enumerate(seen)]).to_parquet(tmp_path / "instance_info.parquet")
    cloud = lambda n: np.array([p for s, i, p in seen if (s, str(i)) == (n["scan_id"], n["id"])])
    want = {}
    for b in nodes:
        found = []
        for a in nodes:
            if a["scan_id"] != "scene0000_00" or b["scan_id"] not in ("scene0000_01", "scene0000_02") or "unknown" in (a["name"], b["name"]) or not (a["text_embedding"] and b["text_embedding"]):
                continue
            f, g = np.array(a["text_embedding"]), np.array(b["text_embedding"])
            gap, sim = np.linalg.norm(np.subtract(a["node_position"], b["node_position"])), f @ g / np.linalg.norm(f) / np.linalg.norm(g)
            ratio, iou, apart = kernels.overlap_score(cloud(a), cloud(b), 1.0)
            if gap < 3 and sim >= 0.4 and kernels.accepted(ratio, iou):
                found.append((-kernels.match_score(ratio, sim, iou, apart), a["node_key"]))
        if found:
            want[b["node_key"]] = (min(found)[1], round(-min(found)[0], 6))
    got = {r["b"]: (r["a"], round(r["score"], 6)) for r in QUERIES["embedding_matching"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) >= 5


def test_positions(spark):
    frames = spark.createDataFrame([("s", i * 3) for i in range(25)] + [("t", 1)], "scan string, frame int")
    got = ranking.frame_sequences(frames, "scan", "frame", 10, 5).groupBy("scan", "seq_no").agg(F.sort_array(F.collect_list("frame")).alias("f")).collect()
    assert {(r["scan"], r["seq_no"]): r["f"] for r in got} == {("s", k): [i * 3 for i in range(k * 5, k * 5 + 10)] for k in range(4)} | {("t", 0): [1]}
    rate = one(spark, *[aggregates.rate_bin(F.lit(x)) for x in (0.0, 0.3, 0.6, 0.7, 0.75, 1.0)])
    assert tuple(rate) == (0, 2, 5, 6, 7, 9)
    r = one(spark, relational.overlap_coefficient(arr([1, 2, 3], "int"), arr([2, 3], "int")), relational.overlap_coefficient(arr([1], "int"), F.array().cast("array<int>")))
    assert tuple(r) == (1.0, 0.0)
    kept = spark.createDataFrame([("a2",), ("a10",), ("a1",)], "t string").orderBy(relational.natural_order("t")).collect()
    assert [r["t"] for r in kept] == ["a1", "a2", "a10"]


def test_embeddings_and_filters(spark):
    from loomgraph.functions import embeddings
    from loomgraph.operators import filters

    r = one(spark, *[embeddings.hashed_embedding(F.lit(t).cast("string")) for t in ("Office chair", "office  CHAIR!", "", None)])
    assert r[0] == r[1] and np.isclose(np.linalg.norm(r[0]), 1) and set(r[2]) == {0.0} and r[3] is None
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, t string")
    got = {x["k"]: x["embedding"] for x in embeddings.embed(df, "k", "t", lambda: lambda texts: [[float(len(t))] for t in texts]).collect()}
    assert got == {1: [1.0], 2: None}
    nan, null = F.lit(float("nan")), F.lit(None).cast("double")
    r = one(spark, filters.alike(nan, 0.5), filters.alike(F.lit(0.5), 0.5), filters.near(nan, 1), filters.accepted(F.lit(0.21), F.lit(0.0)), filters.accepted(null, null), filters.measured(F.lit(0.0)), filters.foreground(F.lit(152), F.lit(223), F.lit(138)), filters.named(F.lit(" Unknown ")), filters.in_image(F.lit(640), F.lit(0), 640, 480), filters.picked(F.lit(0.5), F.lit(1.0)), filters.an_object(F.lit("Floor"), F.lit(500)), filters.detected(F.lit(0.4), F.lit(0.1), F.lit(3)))
    assert list(r) == [False, False, False, True, False, False, False, False, False, True, False, True]


def test_augmentation_repeats(spark):
    from loomgraph.operators import augment

    objects = spark.range(400).select((F.col("id") % 40).alias("g"), "id", *[F.lit(0.5).alias(c) for c in "xyz"], F.lit(0.1).alias("size"))
    first, again = (sorted(map(tuple, augment.augment(objects, ["g", "id"], ["g"]).collect())) for _ in range(2))
    assert first == again and 200 < len(first) < 400 and {r[-1] for r in first} == {"kept", "moved"}
    assert all(0 <= v <= 1 for r in first for v in r[2:5])


def test_training_rows(spark):
    from loomgraph.operators import matching

    source = spark.createDataFrame([("f", "m", "a", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), ("f", "m", "b", 1.0, 1.0, 1.0, 9.0, 1.0, 1.0), ("g", "m", "a", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], "frame string, map string, id string, x double, y double, z double, h double, w double, l double")
    target = spark.createDataFrame([("m", 5, "A", 0.5, 0.5, 0.5, 1.0, 1.0, 1.0), ("m", 2, "B", 1.0, 0.0, 0.0, 1.0, 1.0, 1.0)], "map string, ord int, id string, x double, y double, z double, h double, w double, l double")
    truth = spark.createDataFrame([("m", "a", "A"), ("m", "z", "B")], "map string, id string, target_id string")
    source, target = (df.withColumns({"feature": F.array(F.lit(1.0)), "text": F.array(F.col("x"))}) for df in (source, target))
    rows = matching.matcher_rows(source, target, truth).collect()
    assert "bbox0" not in matching.matcher_rows(source, target, truth, boxes=False).columns and "text_embedding0" not in rows[0]
    full = matching.matcher_rows(source, target, truth, texts=True).first()
    assert full["text_embedding0"] == [[0.0], [1.0]] and full["text_embedding1"] == [[1.0], [0.5]] and full["frame_scene"] == "f" and full["descriptors1"] == [[1.0]] * 2
    assert len(rows) == 1 and rows[0]["matches0"] == [1, -1] and rows[0]["bbox0"][1][0] == 1.0
    assert rows[0]["keypoints0"][0] == pytest.approx([1 / 12] * 3) and len(rows[0]["keypoints1"]) == 2


def test_masks(spark):
    from loomgraph.operators import matching

    left = spark.createDataFrame([("f", 1, p) for p in range(4)] + [("f", 2, 9)], "frame string, id int, pixel int")
    right = spark.createDataFrame([("f", 7, p) for p in range(3)] + [("f", 8, 3)], "frame string, id int, pixel int")
    assert {(r["mask"], r["instance"], round(r["iou"], 2)) for r in matching.mask_overlap(left, right).collect()} == {(1, 7, 0.75), (2, 0, 0.0)}
    over = spark.createDataFrame([("f", 1, p) for p in range(4)] + [("f", 2, 3)], "frame string, id int, pixel int")
    assert {(r["pixel"], r["label"]) for r in matching.painted(over).collect()} == {(0, 1), (1, 1), (2, 1), (3, 2)}
