"""Drift, compaction and orphan references on small fixtures with nulls, repeats, ties, clashing columns and empty tables."""

import datetime as dt
import json

import pytest

from loomgraph.operators import compaction, drift, orphans

RAW = "raw_id long, series string, file_name string, file_no int, line_no int, written_at timestamp_ntz, payload string, field string, kind string"
T = dt.datetime(2024, 1, 1)


def raw(spark, rows):
    return spark.createDataFrame([(i, s, f"{s}/{n}", n, 0, T, p, "clash", "clash") for i, s, n, p in rows], RAW)


def changes(spark, rows):
    return {tuple(r) for r in drift.schema_changes(drift.ingest(raw(spark, rows))).collect()}


def test_changes_between_files(spark):
    rows = [
        (1, "a", 0, '{"frame_id": 1, "bbox0": [[0.5, 1.0]], "matches0": [1]}'),
        (1, "a", 0, '{"frame_id": 1, "bbox0": [[0.5, 1.0]], "matches0": [1]}'),
        (2, "a", 1, '{"frameId": "1", "bbox0": [[1, 2]], "matches0": []}'),
        (3, "a", 1, None),
        (4, "a", 1, '{"bbox0": [[1'),
        (5, "a", 2, '{"frameId": "1", "bbox0": null, "num_frames": 3, "matches0": [2]}'),
        (6, "a", 4, '{"other": 1}'),
        (7, "b", 0, "[1, 2]"),
        (8, "b", 1, '{"frame_id": 1.0} trailing'),
    ]
    assert changes(spark, rows) == {
        ("a/1", "frame_id", "renamed"),
        ("a/1", "frame_id", "type_changed"),
        ("a/1", "bbox0", "type_changed"),
        ("a/2", "num_frames", "added"),
    }


def test_removed_and_fractional(spark):
    rows = [(1, "a", 0, '{"frame_id": 288, "overlap_ratio": 0.5}'), (2, "a", 1, '{"frame_id": 288.0}')]
    assert changes(spark, rows) == {("a/1", "frame_id", "type_changed"), ("a/1", "overlap_ratio", "removed")}


def test_no_rows(spark):
    assert changes(spark, []) == set()
    assert drift.ingest(raw(spark, [])).count() == 0


def test_ingest_types_and_rescue(spark):
    rows = [
        (1, "a", 0, '{"frame_no": "000717", "box0": "[[0.1, 0.2, 0.3]]", "text_emb0": "1.5,2;3,4", "overlapRatio": "0.25", "n_frames": "x", "mystery": {"k": 1}}'),
        (2, "a", 0, '{"frame_id": 288.0, "bbox0": [{"h": 1.5, "w": 2, "l": 3}], "text_embedding0": [[51, -29]]}'),
        (3, "a", 0, '{"bboxes0": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6], "text_embedding0": []}'),
        (4, "a", 0, None),
        (5, "a", 0, '{"bbox0": [0.1, 0.2]}'),
    ]
    out = {r["raw_id"]: r for r in drift.ingest(raw(spark, rows)).collect()}
    assert (out[1]["frame_id"], out[1]["bbox0"], out[1]["text_embedding0"], out[1]["overlap_ratio"], out[1]["num_frames"]) == (717, [[0.1, 0.2, 0.3]], [[1.5, 2.0], [3.0, 4.0]], 0.25, None)
    assert json.loads(out[1]["_rescued"]).keys() == {"n_frames", "mystery"}
    assert (out[2]["frame_id"], out[2]["bbox0"]) == (288, [[1.5, 2.0, 3.0]])
    assert out[2]["text_embedding0"][0] == pytest.approx([0.51, -0.29])
    assert out[3]["bbox0"] == [[0.1, 0.2, 0.3], [0.4, 0.5, 0.6]] and out[3]["text_embedding0"] == []
    assert not out[4]["_readable"] and out[4]["bbox0"] is None
    assert out[5]["bbox0"] is None and "bbox0" in out[5]["_rescued"]


FILES = "file_id long, file_path string, size_bytes int, modified_at timestamp_ntz, file_content string, scan_id string, bytes long"


def feature_files(spark, rows):
    return spark.createDataFrame([(i, p, 1, T + dt.timedelta(days=i), c, "clash", 7) for i, p, c in rows], FILES)


def test_records_of_all_layouts_once(spark):
    at = "scene0001_00/refined_instance/{}_instance.json"
    rows = [
        (1, at.format(3), '[{"instance_id": 1, "feature": [0.5]}, {"instance_id": "2", "feature": [1.5]}, {"instance_id": null}]'),
        (2, "backup/" + at.format(3), '{"1": [9.5], "7": [2.5]}'),
        (2, "backup/" + at.format(3), '{"1": [9.5], "7": [2.5]}'),
        (3, "retry_1/scene0001_00/refined_instance/000003_instance.json", '{"instance_id": 8, "feature": [1]}\n\n{"instance_id": 9, "feature": [1]}\n'),
        (4, at.format(4), '{"1": [0.1'),
        (5, at.format(4), '{"instance_id": 1, "feature": [1]}\n{"instance_id": 2, "feat'),
        (6, at.format(4), "null"),
        (7, at.format(4), None),
        (8, at.format(4), "  \n"),
        (9, at.format(4), '{"1": [0.5]} {"2": [0.5]}'),
        (10, None, "[]"),
        (11, at.format(5), "[" + ",".join(f'{{"instance_id": {i}, "feature": [0.5]}}' for i in range(20000)) + "]"),
    ]
    out = compaction.compact(feature_files(spark, rows), target_bytes=36 * 1000)
    got = {(r["scan_id"], r["frame_id"], r["instance_id"]): r for r in out.collect()}
    assert {k for k in got if k[1] < 5} == {("scene0001_00", 3, i) for i in (1, 2, 7, 8, 9)}
    assert len(got) == 20005 and out.count() == 20005
    assert got["scene0001_00", 3, 1]["feature"] == [0.5]  # the original place wins over the later copy
    groups = compaction.group_report(out).collect()
    assert sum(r["records"] for r in groups) == 20005
    assert sorted(r["group_no"] for r in groups) == list(range(len(groups)))
    assert max(r["bytes"] for r in groups) <= 37 * 1000


def test_rewrite_is_reconciled(spark, tmp_path):
    rows = [(i, f"scene0001_00/refined_instance/{i}_instance.json", '{"1": [0.5], "2": [0.5]}') for i in range(30)]
    assert compaction.write_compacted(feature_files(spark, rows), str(tmp_path / "out"), target_bytes=360) == 60
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60
    assert compaction.compact(feature_files(spark, [])).count() == 0


def test_orphans(spark):
    names = spark.createDataFrame(
        [(1, "scene0001_00", 5, "x", T, None), (1, "scene0001_00", 5, "x", T, None), (2, "scene0001_01", 6, "x", T, T + dt.timedelta(days=2)), (3, "scene0001_01", 7, None, T + dt.timedelta(days=9), None), (4, None, None, None, None, None)],
        "map_row_id long, scan_id string, instance_id int, name string, added_at timestamp_ntz, removed_at timestamp_ntz",
    )
    day = lambda n: T + dt.timedelta(days=n)
    corr = spark.createDataFrame(
        [(1, "SCENE0001_01", 6, 5, day(1), "c"), (1, "SCENE0001_01", 6, 5, day(1), "c"), (2, " scene0001-01\r", 6, 99, day(3), "c"), (3, "scene0001_01", 7, -1, day(1), "c"), (4, "scene0001_01", None, None, day(1), "c"), (5, None, 1, 1, day(1), "c"), (6, "scene0001_01", 6, 5, day(2), "c"), (7, "scene0001_01", 7, 5, None, "c")],
        "corr_id long, scan_id string, instance_id int, instance_id_in_00 int, matched_at timestamp_ntz, _scan string",
    )
    got = {(r["corr_id"], r["ref_column"], r["reason"]) for r in orphans.orphan_references(corr, names).collect()}
    assert got == {(2, "instance_id", "deleted"), (2, "instance_id_in_00", "missing"), (3, "instance_id", "late"), (6, "instance_id", "deleted")}
    assert orphans.orphan_references(corr.limit(0), names).count() == 0
    assert {r["reason"] for r in orphans.orphan_references(corr, names.limit(0)).collect()} == {"missing"}
    counts = orphans.orphan_counts(corr, names).collect()
    assert sum(r["orphans"] for r in counts) == 4


def test_filter_has_no_false_negative(spark):
    from pyspark.sql import functions as F

    parents = spark.range(20000).select(F.concat(F.lit("s"), F.col("id") % 7).alias("_scan"), F.col("id").cast("int").alias("_instance"))
    refs = parents.union(parents.select("_scan", F.col("_instance") + 1_000_000))
    got = orphans.probe(refs, parents, ["_scan", "_instance"]).groupBy((F.col("_instance") >= 1_000_000).alias("absent"), "_maybe").count().collect()
    n = {(r["absent"], r["_maybe"]): r["count"] for r in got}
    assert (False, False) not in n and n.get((True, True), 0) < 600


def test_long_ids_and_unread_files(spark):
    at = "scene0001_00/refined_instance/1_instance.json"
    rows = [(1, at, '{"3000000000": [0.5], "5": [0.5], "6.0": [1]}'), (2, at, '[{"instance_id": 7.0, "feature": [1]}, {"instance_id": "8.5"}]'), (3, "elsewhere.json", '{"1": [0.5]}'), (4, at, "[1"), (5, None, "[]")]
    files = feature_files(spark, rows)
    assert {r["instance_id"] for r in compaction.compact(files).collect()} == {3000000000, 5, 7}
    assert {tuple(r) for r in compaction.unread_files(files).collect()} == {(3, "no_place"), (4, "broken"), (5, "no_place")}


def test_rewrite_takes_the_place_of_the_old_target(spark, tmp_path):
    target = str(tmp_path / "out")
    one = [(1, "scene0001_00/refined_instance/1_instance.json", '{"1": [0.5], "2": null}')]
    assert compaction.write_compacted(feature_files(spark, one), target) == 2
    assert compaction.write_compacted(feature_files(spark, one * 2 + [(2, "scene0001_00/refined_instance/2_instance.json", '{"1": [0.5]}')]), target) == 3
    assert compaction.read_compacted(spark, target).count() == 3
    assert compaction.write_compacted(feature_files(spark, []), target) == 0
    assert compaction.read_compacted(spark, target).count() == 0
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_lost_or_repeated_records_are_noticed(spark):
    rows = spark.createDataFrame([("s", 1, 1, [0.5]), ("s", 1, 2, [0.5]), ("s", 1, 3, None)], "scan_id string, frame_id long, instance_id long, feature array<float>")
    want = compaction._totals(rows)
    assert want != compaction._totals(rows.where("instance_id <> 3").union(rows.where("instance_id = 2")))
    assert want == compaction._totals(rows.orderBy("instance_id", ascending=False))


def test_window_sums_stand_in_the_plan(spark):
    rows = [(i, f"scene0001_00/refined_instance/{i}_instance.json", '{"1": [0.5], "2": [0.5]}') for i in range(30)]
    plan = compaction.compact(feature_files(spark, rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "parse_json" not in plan


def test_fractions_and_large_numbers_are_rescued(spark):
    rows = [(1, "a", 0, '{"frame_id": 3.7, "num_frames": 2.5, "overlap_ratio": 1}'), (2, "a", 0, '{"frame_id": 3000000000, "num_frames": 4.0}')]
    out = {r["raw_id"]: r for r in drift.ingest(raw(spark, rows)).collect()}
    assert (out[1]["frame_id"], out[1]["num_frames"], out[1]["overlap_ratio"]) == (None, None, 1.0)
    assert json.loads(out[1]["_rescued"]) == {"frame_id": 3.7, "num_frames": 2.5}
    assert (out[2]["frame_id"], out[2]["num_frames"], out[2]["_replayed"]) == (None, 4, ["num_frames"])
    assert json.loads(out[2]["_rescued"]) == {"frame_id": 3000000000}


def test_quantisation_is_decided_per_file(spark):
    rows = [
        (1, "a", 0, '{"text_embedding0": [[0, 1, 0]]}'),
        (2, "a", 1, '{"text_embedding0": [[0, 1, 0]]}'),
        (3, "a", 1, '{"text_embedding0": [[51, -29, 0]]}'),
        (4, "a", 2, '{"text_embedding0": [[0.5, 1, 0]]}'),
        (5, "a", 2, '{"text_embedding0": [[2, 1, 0]]}'),
        (6, "a", 1, '{"text_embedding0": "0.5,1"}'),
    ]
    out = {r["raw_id"]: (r["text_embedding0"], r["_replayed"]) for r in drift.ingest(raw(spark, rows)).collect()}
    assert out[1] == ([[0, 1, 0]], []) and out[4] == ([[0.5, 1, 0]], []) and out[5] == ([[2, 1, 0]], [])
    assert out[2] == ([[0, 0.01, 0]], ["text_embedding0"]) and out[3][0][0] == pytest.approx([0.51, -0.29, 0])
    assert out[6] == ([[0.5, 1]], ["text_embedding0"])


def test_several_spellings_of_a_field(spark):
    rows = [(1, "a", 0, '{"frame_id": "x", "frameId": "7", "frame": 8, "box0": null}'), (2, "a", 0, '{"frame_id": "x", "frameId": "y"}')]
    out = {r["raw_id"]: r for r in drift.ingest(raw(spark, rows)).collect()}
    assert (out[1]["frame_id"], out[1]["_replayed"], json.loads(out[1]["_rescued"])) == (8, [], {"frame_id": "x"})
    assert (out[2]["frame_id"], json.loads(out[2]["_rescued"])) == (None, {"frame_id": "x", "frameId": "y"})


def test_changes_of_unknown_keys_and_of_files_without_known_ones(spark):
    rows = [(1, "a", 0, '{"frame_id": 1}'), (2, "a", 1, '{"mystery": 1}'), (3, "a", 2, '{"mystery": 1.5, "frame_id": 1}'), (4, "a", 3, "{}")]
    assert changes(spark, rows) == {("a/1", "frame_id", "removed"), ("a/2", "frame_id", "added"), ("a/3", "frame_id", "removed")}
    unknown = drift.schema_changes(drift.ingest(raw(spark, rows)), unknown=True).collect()
    assert {tuple(r) for r in unknown} == {("a/1", "mystery", "added"), ("a/2", "mystery", "type_changed"), ("a/3", "mystery", "removed")}


def test_a_filter_too_large_to_broadcast_is_joined(spark, monkeypatch):
    from pyspark.sql import functions as F

    parents = spark.range(20000).select(F.lit("s").alias("_scan"), F.col("id").cast("int").alias("_instance"))
    refs = parents.union(parents.select("_scan", F.col("_instance") + 1_000_000))
    small = orphans.probe(refs, parents, ["_scan", "_instance"])
    monkeypatch.setattr(orphans, "BROADCAST_BLOCKS", 0)
    large = orphans.probe(refs, parents, ["_scan", "_instance"])
    plan = large._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan and "broadcast" in small._jdf.queryExecution().optimizedPlan().toString()
    assert small.where("_maybe").count() == large.where("_maybe").count() >= 20000
