import json

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratavane.sources import formats, readers, writers
from stratavane.streaming import incremental


@given(st.lists(st.integers(0, 100_000), max_size=30))
def test_coco_round_trip(counts):
    assert formats.coco_decode_counts(formats.coco_encode_counts(counts)) == counts


def test_png_round_trip():
    for px in (np.arange(60, dtype=np.uint16).reshape(6, 10) * 1000, np.arange(90, dtype=np.uint8).reshape(5, 6, 3)):
        assert np.array_equal(formats.read_png(formats.write_png(px)), px)


def test_ply_ascii_with_faces():
    blob = b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 1 2\n3 4 5\n3 0 1 1\n"
    got = formats.read_ply(blob)
    assert got["vertex"]["y"].tolist() == [1, 4] and got["face"]["vertex_indices"][0].tolist() == [0, 1, 1]


def test_scene_scan(spark, tmp_path):
    root = tmp_path / "set"
    (root / "points").mkdir(parents=True)
    (root / "depth" / "sc1" / "d").mkdir(parents=True)
    (root / "pose").mkdir()
    pts = {k: np.array(v, "f4") for k, v in {"x": [0, 1], "y": [2, 3], "z": [4, 5]}.items()}
    (root / "points" / "sc1.ply").write_bytes(formats.write_ply(pts))
    for k in (10, 2):
        (root / "depth" / "sc1" / "d" / f"{k}.png").write_bytes(formats.write_png(np.array([[0, 1500], [2000, 0]], np.uint16)))
    (root / "pose" / "2.txt").write_text("1 0 0 0\n0 1 0 0\n0 0 1 0\n0 0 0 1\n")
    ds = readers.build_dataset(spark, "scannet", f"file://{root}")
    assert sorted((r.scene_id, r.point_id, r.y) for r in ds.points().collect()) == [("sc1", 0, 2.0), ("sc1", 1, 3.0)]
    assert [(r.frame_id, r.frame_ord) for r in ds.frames().orderBy("frame_ord").collect()] == [("2", 0), ("10", 1)]
    assert {(r.row, r.col, r.d) for r in ds.depth().where("frame_id = '2'").collect()} == {(0, 1, 1.5), (1, 0, 2.0)}
    assert ds.poses().first().pose[0] == 1.0
    with pytest.raises(ValueError):
        readers.build_dataset(spark, "nothing", "x")


def test_text_scans(spark, tmp_path):
    (tmp_path / "split.txt").write_text("b\na\n\n")
    assert [r.scene_id for r in readers.split_file(spark, f"file://{tmp_path}/split.txt").collect()] == ["a", "b"]
    (tmp_path / "t.traj").write_text("1.0004 0 0 0 1 2 3\n")
    r = readers.trajectory(spark, f"file://{tmp_path}/t.traj").first()
    assert r.ts == 1.0 and [r.pose[3], r.pose[7], r.pose[11]] == [-1, -2, -3]
    (tmp_path / "v_1.5.pincam").write_text("256 192 210 211 127 95\n")
    r = readers.pincams(spark, f"file://{tmp_path}/v_1.5.pincam").first()
    assert (r.ts, r.width, r.k[0], r.k[5]) == (1.5, 256, 210, 95)
    (tmp_path / "p.txt").write_text("pred/a.txt 3 0.5\n")
    assert readers.prediction_list(spark, f"file://{tmp_path}/p.txt").first().label_id == 3
    (tmp_path / "bad.txt").write_text("../a.txt 3 0.5\n")
    with pytest.raises(Exception, match="leaves the folder"):
        readers.prediction_list(spark, f"file://{tmp_path}/bad.txt").collect()
    (tmp_path / "m.csv").write_text("class,class id,ap,ap50,ap25\nchair,0.1,0.2,0.3\n")
    assert readers.metric_csv(spark, f"file://{tmp_path}/m.csv").first().ap25 == 0.3
    (tmp_path / "tags.txt").write_text("i1,cat,dog\n")
    assert [r.tag for r in readers.tag_lists(spark, f"file://{tmp_path}/tags.txt").orderBy("pos").collect()] == ["cat", "dog"]


def test_json_scans(spark, tmp_path):
    (tmp_path / "s1.segs.json").write_text(json.dumps({"segIndices": [5, 5, 7]}))
    (tmp_path / "s1.agg.json").write_text(json.dumps({"segGroups": [{"id": 1, "label": "chair", "segments": [5]}]}))
    seg = readers.segment_json(spark, f"file://{tmp_path}/s1.segs.json").withColumn("scene_id", F.lit("s1"))
    grp = readers.segment_groups(spark, f"file://{tmp_path}/s1.agg.json").withColumn("scene_id", F.lit("s1"))
    assert sorted((r.point_id, r.label) for r in readers.propagate_segments(seg, grp).collect()) == [(0, "chair"), (1, "chair")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "scene_id string, v int")
    writers.by_scene(df, f"file://{tmp_path}/t")
    writers.by_scene(df.where("v = 2").withColumn("v", F.lit(5)), f"file://{tmp_path}/t")
    assert sorted((r.scene_id, r.v) for r in spark.read.parquet(f"file://{tmp_path}/t").collect()) == [("a", 1), ("b", 5)]
    tags = spark.createDataFrame([("i", 1, "b"), ("i", 0, "a")], "image_id string, pos int, tag string")
    writers.tag_predictions(tags, f"file://{tmp_path}/tags")
    assert spark.read.text(f"file://{tmp_path}/tags").first().value == "i,a,b"


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("s", f"f{f}", p) for f in range(3) for p in range(4)], "scene_id string, frame_id string, point_id bigint")
    rows.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = incremental.running_visibility(stream).writeStream.format("memory").queryName("vis").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.awaitTermination(60)
    assert {r.point_id: r.visible for r in spark.table("vis").collect()} == dict.fromkeys(range(4), 3)
