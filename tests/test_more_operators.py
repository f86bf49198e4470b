"""Operators that no bound query reaches, and those whose queries have no SQL, against plain versions."""

import itertools
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavane import models, storage
from stratavane.functions import geometry as G
from stratavane.functions import text as X
from stratavane.operators import evaluation, labels, masks, matching, merge, spatial, suppression
from stratavane.sources import formats, readers
from stratavane.streaming import incremental


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def _greedy(boxes, threshold, plus, keep_equal):
    def iou(a, b):
        w, h = (max(min(a[k + 2], b[k + 2]) - max(a[k], b[k]) + plus, 0) for k in (0, 1))
        area = lambda x: (x[2] - x[0] + plus) * (x[3] - x[1] + plus)
        union = area(a) + area(b) - w * h
        return w * h / union if union > 0 else 0.0

    kept = []
    for _, i, b in sorted((-s, i, b) for i, s, b in boxes):
        if all((iou(b, o) <= threshold) if keep_equal else (iou(b, o) < threshold) for _, o in kept):
            kept.append((i, b))
    return {i for i, _ in kept}


@pytest.mark.parametrize(("plus", "keep_equal"), [(0.0, True), (1.0, False)])
def test_greedy_boxes_equal_brute_force(spark, plus, keep_equal):
    rng = np.random.default_rng(4)
    rows = [(int(f), i, float(rng.integers(0, 9)), *map(float, (x, y, x + w, y + h)), f"n{i}") for f in range(6) for i, (x, y, w, h) in enumerate(rng.integers(0, 12, (25, 4)))]
    df = spark.createDataFrame(rows, "f int, box_id int, score double, x1 double, y1 double, x2 double, y2 double, name string")
    got = suppression.greedy_box_nms(df, ["f"], 0.4, plus=plus, keep_equal=keep_equal)
    assert got.columns == df.columns
    found = got.collect()
    assert all(r.name == f"n{r.box_id}" for r in found)
    for f in range(6):
        assert {r.box_id for r in found if r.f == f} == _greedy([(i, s, b) for g, i, s, *b, _ in rows if g == f], 0.4, plus, keep_equal)
    odd = spark.createDataFrame([(1, 1, None, 0.0, 0.0, 5.0, 5.0), (1, 2, 1.0, 0.0, 0.0, 5.0, 5.0), (1, 3, float("nan"), None, 0.0, 5.0, 5.0)], "f int, box_id int, score double, x1 double, y1 double, x2 double, y2 double")
    assert {r.box_id for r in suppression.greedy_box_nms(odd, ["f"], 0.4).collect()} == {2, 3}
    assert suppression.greedy_box_nms(odd.limit(0), ["f"], 0.4).count() == 0


def test_detection_selection_suppresses(spark):
    rows = [("a", 1, 0.9, 0, 0, 10, 10), ("a", 2, 0.8, 1, 1, 11, 11), ("a", 3, 0.7, 50, 50, 60, 60), ("a", 4, 0.01, 80, 80, 90, 90)]
    df = spark.createDataFrame([(f, i, s, *map(float, b)) for f, i, s, *b in rows], "f string, box_id int, score double, x1 double, y1 double, x2 double, y2 double")
    assert {r.box_id for r in suppression.select_detections(df, ["f"]).collect()} == {1, 3}
    assert {r.box_id for r in suppression.select_detections(df, ["f"], keep=1).collect()} == {1}


def test_sampling(spark):
    df = spark.range(30).withColumnRenamed("id", "point_id")
    rounds = spatial.sample_uncovered(df, lambda s: s.select(F.explode(F.array("point_id", F.col("point_id") + 5)).alias("point_id")), [3, 2])
    assert sorted((r["round"], r.point_id) for r in rounds.collect()) == [(0, 0), (0, 1), (0, 2), (1, 3), (1, 4)]
    a = {r.point_id for r in spatial.subsample(df, 7, seed=1).collect()}
    assert len(a) == 7 and a == {r.point_id for r in spatial.subsample(df.repartition(5), 7, seed=1).collect()} != {r.point_id for r in spatial.subsample(df, 7, seed=2).collect()}


def test_crops_by_hand(spark):
    images = spark.createDataFrame([(100, 80)], "width int, height int")
    got = {(r.layer, r.x1, r.y1, r.x2, r.y2) for r in spatial.crop_boxes(images, 1, 0.25).collect()}
    # in layer 1 neighbours share a quarter of the shorter side: 20 pixels
    assert got == {(0, 0, 0, 100, 80), (1, 0, 0, 60, 50), (1, 40, 0, 100, 50), (1, 0, 30, 60, 80), (1, 40, 30, 100, 80)}


def test_rotated_pixels_and_cameras(spark):
    px = np.arange(12).reshape(3, 4)
    cells = spark.createDataFrame([(int(r), int(c), int(px[r, c])) for r in range(3) for c in range(4)], "r int, c int, v int")
    for k in range(5):
        row, col = G.rotate_pixel(F.col("r"), F.col("c"), 3, 4, k)
        turned = np.rot90(px, k)
        assert all(turned[x.row, x.col] == x.v for x in cells.select(row.alias("row"), col.alias("col"), "v").collect())
    same = one(spark, G.resized_camera(G.camera(5, 6, 7, 8), (64, 48), (64, 48)))
    assert same == [5, 0, 7, 0, 6, 8, 0, 0, 1]
    half = one(spark, G.resized_camera(G.camera(100, 100, 31.5, 23.5), (64, 48), (32, 24)))
    assert half[0] == 50 and half[4] == 50 and half[2] == pytest.approx(31.5 * 31 / 63) and half[5] == pytest.approx(23.5 * 23 / 47)


def test_sequential_merge(spark):
    sets = [{1: [1, 2, 3], 2: [9]}, {7: [2, 3, 4], 8: [20, 21]}, {3: [20, 21, 22]}]
    frames = [spark.createDataFrame([(m, p) for m, ps in f.items() for p in ps], "inst_id bigint, point_id bigint") for f in sets]
    out = {}
    for r in merge.sequential_merge(frames, 0.4).collect():
        out.setdefault(r.inst_id, set()).add(r.point_id)
    assert sorted(map(sorted, out.values())) == [[1, 2, 3, 4], [9], [20, 21, 22]]


def test_hierarchical_merge_follows_the_tree(spark):
    """Two halves of a scene's frames see the same object; it is one group only where they overlap enough."""
    frames = spark.createDataFrame([("s", 4)], "scene_id string, n int")
    sizes = spark.createDataFrame([("s", k, 10) for k in range(8)], "scene_id string, spp bigint, size bigint")
    seen = {0: [0, 1, 2], 1: [0, 1, 2], 2: [1, 2], 3: [6, 7]}
    leaves = spark.createDataFrame([("s", f, f, p, 1, 1.0) for f, ps in seen.items() for p in ps], "scene_id string, frame_ord int, grp bigint, spp bigint, cnt int, weight double")
    for visi, want in ((0.6, [[0, 1, 2], [6, 7]]), (0.9, [[0, 1, 2], [1, 2], [6, 7]])):
        got = {}
        for r in merge.hierarchical_merge(leaves, frames, sizes, visi=visi, simi=None).collect():
            got.setdefault(r.grp, set()).add(r.spp)
        assert sorted(map(sorted, got.values())) == want
    # a list of thresholds goes by depth, the root taking the first
    loose = merge.hierarchical_merge(leaves, frames, sizes, visi=[0.6, 0.9], simi=None)
    assert loose.select("grp").distinct().count() == 2


def test_column_major_runs(spark):
    px = np.zeros((3, 4), int)
    px[1, 0] = px[2, 0] = px[0, 1] = px[2, 3] = 1
    df = spark.createDataFrame([(1, int(r), int(c)) for r, c in zip(*np.nonzero(px), strict=True)], "m int, row int, col int")
    runs = masks.alternating_runs(masks.column_major(df, 3), ["m"], 12).first().counts
    flat = px.T.ravel()
    want = [len([*g]) for _, g in itertools.groupby(flat)]
    assert list(runs) == ([0] if flat[0] else []) + want


def test_more_scans(spark, tmp_path):
    (tmp_path / "Area_1").mkdir()
    (tmp_path / "Area_1" / "chair_2.txt").write_text("1 2 3 10 20 30\nbad line\n4 5 6 x 20 30\n")
    got = readers.annotation_text(spark, f"file://{tmp_path}/Area_1").orderBy("x").collect()
    assert [(r.object, r.label, r.x, r.r) for r in got] == [("chair_2", "chair", 1.0, 10.0), ("chair_2", "chair", 4.0, None)]
    (tmp_path / "b.csv").write_text("1,2,3,4,5,6,7,8\n")
    r = readers.blocks_csv(spark, f"file://{tmp_path}/b.csv").first()
    assert (r.x, r.b, r.sem, r.inst) == (1.0, 6.0, 7, 8)
    (tmp_path / "types.tsv").write_text("s1\tkitchen\n")
    assert readers.scene_types(spark, f"file://{tmp_path}/types.tsv").first().scene_type == "kitchen"


class Found:
    """Stands for a library's result object."""


def test_pickled_detections(spark, tmp_path):
    px = np.zeros((3, 4), int)
    px[1, 1] = px[2, 1] = px[0, 3] = 1
    counts = [len([*g]) for _, g in itertools.groupby(px.T.ravel())]
    found = Found()
    found._fields = {"scores": np.array([0.5, 0.25]), "pred_classes": np.array([3, 4]), "pred_masks_rle": [{"size": [3, 4], "counts": formats.coco_encode_counts(counts)}, {"size": [3, 4], "counts": [12]}]}
    (tmp_path / "f7.pkl").write_bytes(pickle.dumps(found))
    (tmp_path / "f8.pkl").write_bytes(pickle.dumps({"pred_masks_rle": []}))
    got = readers.detections(spark, f"file://{tmp_path}").collect()
    assert {(r.frame_id, r.mask_id, r.score, r.label_id, r.row, r.col) for r in got} == {("f7", 0, 0.5, 3, 1, 1), ("f7", 0, 0.5, 3, 2, 1), ("f7", 0, 0.5, 3, 0, 3)}

    class Evil:
        def __reduce__(self):
            return print, ("code ran",)

    assert "code ran" not in str(vars(formats._PlainUnpickler(__import__("io").BytesIO(pickle.dumps(Evil()))).load()))


def test_models(spark):
    images = spark.createDataFrame([("s", "f", bytearray(b"xy"))], "scene_id string, frame_id string, content binary")
    got = models.detector(images, ["cat", "dog"], lambda: lambda content, prompt: [(0.0, 0.0, float(len(content)), 2.0, 0.5, prompt)]).collect()
    assert [(r.box_id, r.x2, r.label) for r in got] == [(0, 2.0, "cat"), (1, 2.0, "dog")]
    boxes = spark.createDataFrame([("s", "f", 1, 0.0, 0.0, 4.0, 2.0)], "scene_id string, frame_id string, box_id int, x1 double, y1 double, x2 double, y2 double")
    want = {(r, c) for r in range(3) for c in range(5) if ((c - 2) / 2) ** 2 + (r - 1) ** 2 <= 1}
    assert {(r.row, r.col) for r in models.box_masks(boxes).collect()} == want


def test_phrases(spark):
    toks, logits = F.array(*map(F.lit, ["red", "chair", ".", "old"])), F.array(*map(F.lit, [0.9, 0.6, 0.99, 0.1]))
    assert one(spark, X.phrase_of(toks, logits, 0.5)) == "red chair"


def test_streams_of_frames_and_poses(spark, tmp_path):
    def stream(rows, name, schema):
        spark.createDataFrame(rows, schema).selectExpr("scene_id", "id", f"timestamp_millis(t) AS {name}_time").write.parquet(f"file://{tmp_path}/{name}")
        return spark.readStream.schema(spark.read.parquet(f"file://{tmp_path}/{name}").schema).parquet(f"file://{tmp_path}/{name}")

    frames = stream([("s", 1, 1000), ("s", 2, 5000)], "frame", "scene_id string, id int, t long").withColumnRenamed("id", "frame_id")
    poses = stream([("s", 10, 1200), ("s", 11, 1400), ("x", 12, 1000)], "pose", "scene_id string, id int, t long").withColumnRenamed("id", "pose_id")
    q = incremental.frame_poses(frames, poses).writeStream.format("memory").queryName("fp").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.awaitTermination(60)
    assert {(r.frame_id, r.pose_id) for r in spark.table("fp").collect()} == {(1, 10)}


def test_nearest_class_in_blocks_equals_all_at_once(spark):
    rng = np.random.default_rng(1)
    feats = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=4)]) for i in range(20)], "id int, feat array<double>")
    classes = spark.createDataFrame([(k, [float(v) for v in rng.normal(size=4)]) for k in range(9)], "class_id int, emb array<double>")
    got = [{(r.id, r.class_id) for r in labels.nearest_class(feats, classes, block=b).collect()} for b in (2, 100)]
    assert got[0] == got[1] and len(got[0]) == 20
    best = F.array_max(F.transform("scores", lambda s: F.struct(s["cosine"].alias("c"), (-s["class_id"]).alias("k"))))
    assert got[0] == {(r.id, -r.b.k) for r in labels.class_scores(feats, classes).withColumn("b", best).collect()}


def test_assignment_query_is_optimal(spark):
    rng = np.random.default_rng(8)
    rows = [(g, i, j, float(rng.integers(0, 9))) for g in range(4) for i in range(4) for j in range(3)]
    got = matching.optimal_assignment(spark.createDataFrame(rows, "g int, a int, b int, cost double"), ["g"]).collect()
    for g in range(4):
        cost = {(a, b): c for k, a, b, c in rows if k == g}
        best = min(sum(cost[a, b] for b, a in enumerate(p)) for p in itertools.permutations(range(4), 3))
        own = [r for r in got if r.g == g]
        assert sum(r.cost for r in own) == best and len({r.a for r in own}) == len({r.b for r in own}) == 3


def test_farthest_points_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    pts = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(i % 2, i, *map(float, p)) for i, p in enumerate(pts)], "k int, point_id bigint, x double, y double, z double")
    got = {(r.k, r["rank"]): r.point_id for r in spatial.farthest_points(df, ["k"], 6).collect()}
    for k in (0, 1):
        chosen = [k]
        for n in range(6):
            assert got[k, n] == chosen[n]
            chosen.append(max((i for i in range(k, 40, 2)), key=lambda i: (min(((pts[i] - pts[c]) ** 2).sum() for c in chosen), -i)))


def test_confusion_with_unknown(spark):
    rows = [(1, 1), (1, 2), (1, 99), (2, 2), (7, 1), (2, 1)]
    conf = evaluation.confusion(spark.createDataFrame(rows, "gt int, pred int"), valid=[1, 2])
    assert {(r.gt, r.pred): r.n for r in conf.collect()} == {(1, 1): 1, (1, 2): 1, (1, -1): 1, (2, 2): 1, (2, 1): 1}
    iou = {r.cls: r.iou for r in evaluation.class_iou(conf).collect()}
    assert iou[1] == pytest.approx(1 / 4) and iou[2] == pytest.approx(1 / 3)


def test_staged_tables_go_with_their_block(spark, monkeypatch):
    import os

    with storage.scratch(spark):
        df = storage.stage(spark.range(5).repartition(3), "t")
        path = df._staged_at.removeprefix("file://")
        assert os.path.isdir(path) and df.count() == 5
    assert not os.path.exists(path)
    assert spark.conf.get(storage._CLEANUP) == "false"
    keep = storage.stage(spark.range(2), "k")
    storage.release(spark.range(1))
    storage.release(keep)
    assert not os.path.exists(keep._staged_at.removeprefix("file://"))

    class Conf:
        def get(self, *_):
            return None

    class Far:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        storage.shared_dir(Far())


def _plain_ap(preds, gt, label, th, least):
    """AP and recall of one class from point sets. preds: scan -> id -> (label, conf, points); gt: scan -> point -> code."""
    truth, score, missed, any_gt, any_pred = [], [], 0, False, False
    for scan in gt:
        own = {i: (c, s) for i, (k, c, s) in sorted(preds[scan].items()) if k == label and len(s) >= least}
        sets = {}
        for p, code in gt[scan].items():
            sets.setdefault(code, set()).add(p)
        iou = lambda s, g: len(s & g) / len(s | g)
        same = {g: s for g, s in sets.items() if g // 1000 == label}
        big = {g: s for g, s in sorted(same.items()) if len(s) >= least}
        any_gt, any_pred, taken = any_gt or bool(big), any_pred or bool(own), set()
        for g in big.values():
            matched = None
            for i, (conf, s) in own.items():
                if i not in taken and iou(s, g) > th:
                    if matched is None:
                        matched = conf
                        taken.add(i)
                    else:
                        truth.append(0)
                        score.append(min(matched, conf))
                        matched = max(matched, conf)
            if matched is None:
                missed += 1
            else:
                truth.append(1)
                score.append(matched)
        for conf, s in own.values():
            if any(iou(s, g) > th for g in same.values()):
                continue
            ignored = sum(gt[scan][p] // 1000 not in (1, 2) for p in s) + sum(len(s & g) for g in same.values() if len(g) < least)
            if ignored / len(s) <= th:
                truth.append(0)
                score.append(conf)
    if not any_gt:
        return float("nan"), float("nan")
    if not truth:
        return 0.0, 0.0
    truth, score = np.array(truth), np.array(score)
    cuts = np.unique(score)
    hits = np.array([truth[score >= c].sum() for c in cuts])
    precision = np.append(hits / [(score >= c).sum() for c in cuts], 1.0)
    recall = np.append(hits / (truth.sum() + missed) if truth.sum() + missed else hits * 0.0, 0.0)
    steps = np.convolve(np.concatenate([recall[:1], recall, [0.0]]), [-0.5, 0, 0.5], "valid")
    return float(precision @ steps), float(recall.max())


def test_average_precision_equals_a_plain_version(spark):
    rng = np.random.default_rng(12)
    gt, preds = {}, {}
    for scan in ("a", "b"):
        inst = np.repeat(np.arange(12), rng.integers(2, 14, 12))
        gt[scan] = {p: int((k % 4) * 1000 + k + 1) if k % 4 < 3 else 0 for p, k in enumerate(inst)}
        preds[scan] = {}
        for i in range(14):
            base = np.flatnonzero(inst == i % 12)
            s = {int(p) for p in base if rng.random() < 0.8} | {int(p) for p in rng.integers(0, len(inst), 2)}
            preds[scan][i] = (int(i % 4), float(rng.integers(1, 5) / 5), s)
    df_gt = spark.createDataFrame([(s, p, c) for s, g in gt.items() for p, c in g.items()], "scan string, point_id bigint, code bigint")
    df_p = spark.createDataFrame([(s, i, k, c) for s, d in preds.items() for i, (k, c, _) in d.items()], "scan string, pred_id bigint, label_id int, conf double")
    df_pts = spark.createDataFrame([(s, i, p) for s, d in preds.items() for i, (_, _, ps) in d.items() for p in ps], "scan string, pred_id bigint, point_id bigint")
    for least in (1, 5):
        got = {(r.label_id, r.overlap): (r.ap, r.recall) for r in evaluation.evaluate(df_p, df_pts, df_gt, [1, 2], overlaps=[0.25, 0.5], min_points=least).collect()}
        for (label, th), (ap, recall) in got.items():
            assert (ap, recall) == pytest.approx(_plain_ap(preds, gt, label, th, least))
        assert set(got) == {(k, t) for k in (1, 2) for t in (0.25, 0.5)}


def test_class_probabilities_go_by_blocks(spark):
    rng = np.random.default_rng(5)
    f = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(9)], "id long, feat array<double>")
    c = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(17)], "class_id long, emb array<double>")
    want = {(r.id, s.class_id): s.p for r in labels.class_scores(f, c, scale=20.0).collect() for s in r.scores}
    for block in (100, 5):
        got = {(r.id, r.class_id): r.p for r in labels.class_probabilities(f, c, scale=20.0, block=block).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in want)
