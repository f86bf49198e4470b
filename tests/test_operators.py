"""Operators on hand-made scenes and against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavane.functions import geometry as G
from stratavane.functions import text as X
from stratavane.functions import vectors as V
from stratavane.operators import evaluation, graph, labels, masks, matching, merge, spatial, suppression
from stratavane.plans import scenes


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def long(spark, sets, name="inst_id"):
    return spark.createDataFrame([(m, p) for m, ps in sets.items() for p in ps], f"{name} bigint, point_id bigint")


def test_rle_round_trip_and_known_value(spark):
    sets = {1: [1, 2, 4], 2: [0], 3: [5, 6, 7]}
    enc = masks.rle_encode(long(spark, sets), ["inst_id"], length=8)
    assert {r.inst_id: list(r.rle.counts) for r in enc.collect()} == {1: [2, 2, 5, 1], 2: [1, 1], 3: [6, 3]}
    back = masks.rle_decode(enc.select("inst_id", F.col("rle.counts").alias("counts")))
    assert sorted(map(tuple, back.collect())) == sorted((m, p) for m, ps in sets.items() for p in ps)
    assert masks.rle_decode(spark.createDataFrame([(1, [])], "inst_id bigint, counts array<int>")).count() == 0


def test_overlap_is_exact_and_symmetric(spark):
    rng = random.Random(3)
    sets = {m: set(rng.sample(range(30), rng.randint(1, 12))) for m in range(12)}
    got = {(r.a, r.b): r for r in masks.overlaps(long(spark, sets)).collect()}
    for a, b in itertools.combinations(sets, 2):
        inter = len(sets[a] & sets[b])
        if not inter:
            assert (a, b) not in got
            continue
        r = got[a, b]
        assert r.inter == inter
        assert r.iou == pytest.approx(inter / (len(sets[a] | sets[b]) + 1e-6))
        assert r.recall == pytest.approx(inter / (len(sets[a]) + 1e-6))


def test_components_equal_union_find(spark):
    for seed in range(3):
        rng = random.Random(seed)
        nodes = list(range(60))
        edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(40)] + [(k, k + 1) for k in range(40, 55)]
        parent = dict(zip(nodes, nodes, strict=True))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        df = spark.createDataFrame(edges, "a bigint, b bigint")
        got = {r.node: r.component for r in graph.connected_components(df, vertices=spark.createDataFrame([(n,) for n in nodes], "n bigint")).collect()}
        assert got == {n: find(n) for n in nodes}


def test_components_of_nothing(spark):
    empty = spark.createDataFrame([], "a bigint, b bigint")
    assert graph.connected_components(empty).count() == 0
    assert graph.connected_components(spark.createDataFrame([(1, 1), (2, None)], "a bigint, b bigint")).collect() == [(1, 1)]


def test_rounding_and_projection(spark):
    assert [one(spark, F.rint(F.lit(v))) for v in (0.5, 1.5, 2.5)] == [0, 2, 2]
    pose = np.eye(4)
    pose[:3, :3] = [[0, -1, 0], [1, 0, 0], [0, 0, 1]]
    pose[:3, 3] = [1, 2, 3]
    inv = one(spark, G.rigid_inverse(F.array(*map(F.lit, pose.ravel().tolist()))))
    assert np.allclose(np.array(inv).reshape(4, 4), np.linalg.inv(pose))


def test_axis_angle_and_euler(spark):
    m = np.array(one(spark, G.axis_angle_pose(*[F.lit(v) for v in (0.3, -0.2, 0.5, 1.0, 2.0, 3.0)]))).reshape(4, 4)
    assert np.allclose(m[:3, :3] @ m[:3, :3].T, np.eye(3)) and np.isclose(np.linalg.det(m[:3, :3]), 1)
    assert np.isclose(np.trace(m[:3, :3]), 1 + 2 * math.cos(math.sqrt(0.38)))
    z = one(spark, G.euler_zyx(F.array(*map(F.lit, m[:3, :3].ravel().tolist()))))
    assert math.isclose(z[1], -math.asin(m[2, 0]), abs_tol=1e-9)
    still = one(spark, G.axis_angle_pose(*[F.lit(0.0)] * 6))
    assert np.allclose(np.array(still).reshape(4, 4), np.eye(4))


def test_multi_scale_crops(spark):
    c = one(spark, G.multi_scale(G.box(100, 100, 200, 200), 1000, 1000))
    assert [tuple(x) for x in c] == [(100, 100, 200, 200), (100, 100, 200, 200), (80, 80, 220, 220)]


def test_stride(spark):
    assert [one(spark, spatial.stride_of(F.lit(n))) for n in (399_999, 400_000, 600_000, 1_000_000, 1_000_001)] == [1, 2, 6, 6, 8]


def test_asof_ties_and_tolerance(spark):
    left = spark.createDataFrame([(1, 1000), (2, 5000)], "id bigint, t bigint")
    right = spark.createDataFrame([(10, 800), (11, 1200), (12, 5300), (13, 4000)], "id bigint, t bigint")
    got = {r.id: r.match_id for r in matching.asof_nearest(left, right, tolerance=300).collect()}
    assert got == {1: 11}


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in ((4, 4), (3, 5), (5, 3)):
        c = rng.integers(0, 20, (n, m)).astype(float)
        found = matching.solve_assignment(c)
        k = min(n, m)
        best = min(sum(c[i, j] for i, j in zip(rows, cols, strict=True)) for rows in itertools.permutations(range(n), k) for cols in itertools.combinations(range(m), k))
        assert len(found) == k and sum(c[i, j] for i, j in found) == best


def test_greedy_mask_suppression_and_merge(spark):
    sets = {1: range(0, 10), 2: range(1, 11), 3: range(20, 25), 4: range(9, 19)}
    info = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.7), (4, 0.6)], "inst_id bigint, score double")
    inst = long(spark, sets)
    assert sorted(r.inst_id for r in suppression.greedy_mask_nms(inst, info, 0.5).collect()) == [1, 3, 4]
    merged = suppression.nms_and_merge(inst, info, 0.5)
    assert sorted(r.point_id for r in merged.where("inst_id = 1").collect()) == list(range(0, 11))


def test_matrix_suppression_matches_the_dense_formula(spark):
    rng = random.Random(5)
    n = 12
    sets = {m: set(rng.sample(range(25), rng.randint(3, 12))) for m in range(n)}
    score, cls = {m: round(rng.random(), 6) for m in sets}, {m: m % 2 for m in sets}
    order = sorted(sets, key=lambda m: -score[m])
    iou = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if cls[a] == cls[b] else 0.0
    comp = {b: max([iou(a, b) for a in order[: order.index(b)]], default=0.0) for b in order}
    want = {b: score[b] * min([math.exp(-2 * (iou(a, b) ** 2 - comp[a] ** 2)) for a in order[: order.index(b)]] + [1.0]) for b in order}
    info = spark.createDataFrame([(m, score[m], cls[m]) for m in sets], "inst_id bigint, score double, class_id int")
    got = {r.inst_id: r.decayed for r in suppression.matrix_nms(long(spark, sets), info, least=0.0).collect()}
    assert got == pytest.approx(want)


def test_nearest_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    p = rng.random((80, 3))
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "point_id bigint, x double, y double, z double")
    near = spatial.nearest(df.withColumnRenamed("point_id", "query_id"), df, 3)
    got = {}
    for r in near.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.point_id))
    for q in range(80):
        d = ((p - p[q]) ** 2).sum(1)
        assert [i for _, i in sorted(got[q])] == np.lexsort((np.arange(80), d))[:3].tolist()


def test_farthest_points(spark):
    df = spark.createDataFrame([("s", i, float(x), 0.0, 0.0) for i, x in enumerate([0, 1, 2, 10, 5])], "scene string, point_id bigint, x double, y double, z double")
    assert [r.point_id for r in spatial.farthest_points(df, ["scene"], 3).orderBy("rank").collect()] == [0, 3, 4]


def test_average_precision_one_match(spark):
    flags = spark.createDataFrame([(1, 0, True, True)], "k int, hard_fn int, has_gt boolean, has_pred boolean")
    ev = spark.createDataFrame([(1, 0.7, 1)], "k int, score double, tp int")
    assert evaluation.average_precision(ev, flags, ["k"]).first().ap == 1.0
    none = spark.createDataFrame([(1, 0, False, True), (2, 3, True, False)], "k int, hard_fn int, has_gt boolean, has_pred boolean")
    got = {r.k: r.ap for r in evaluation.average_precision(ev.limit(0), none, ["k"]).collect()}
    assert math.isnan(got[1]) and got[2] == 0


def test_evaluate_perfect_and_equal_scores(spark):
    code = lambda c, i: c * 1000 + i
    gt = spark.createDataFrame([("s", p, code(1, 1) if p < 150 else code(1, 2) if p < 300 else 0) for p in range(400)], "scan string, point_id bigint, code bigint")
    pts = [("s", 0, p) for p in range(150)] + [("s", 1, p) for p in range(150, 300)] + [("s", 2, p) for p in range(300, 400)]
    pred_points = spark.createDataFrame(pts, "scan string, pred_id bigint, point_id bigint")
    preds = spark.createDataFrame([("s", k, 1, 1.0) for k in range(3)], "scan string, pred_id bigint, label_id int, conf double")
    aps = {r.overlap: (r.ap, r.recall) for r in evaluation.evaluate(preds, pred_points, gt, [1]).collect()}
    # the third prediction is all void, so it is ignored; with equal scores AP = R(1 + P) / 2
    assert set(aps.values()) == {(1.0, 1.0)}
    two = preds.where("pred_id < 1")
    aps = {r.overlap: r.ap for r in evaluation.evaluate(two, pred_points, gt, [1]).collect()}
    assert aps[0.5] == pytest.approx(0.5 * (1 + 1) / 2)
    avg = evaluation.averages(evaluation.evaluate(preds, pred_points, gt, [1])).first()
    assert (avg.ap, avg.ap50, avg.ap25) == (1.0, 1.0, 1.0)


def test_merge_tree_and_lift(spark):
    assert merge.tree(5) == [[(0, 4)], [(0, 2), (3, 4)], [(0, 1), (2, 2), (3, 3), (4, 4)], [(0, 0), (1, 1)]]
    # three frames see the same object of superpoints 0..2, the last frame also another one
    spp = spark.createDataFrame([("s", p, p // 10) for p in range(80)], "scene_id string, point_id bigint, spp bigint")
    mapping = spark.createDataFrame([("s", f"f{f}", p, 0, p) for f in range(3) for p in range(80)], "scene_id string, frame_id string, point_id bigint, row int, col int")
    px = [("s", f"f{f}", 0, 0, c) for f in range(3) for c in range(30)] + [("s", "f2", 1, 0, c) for c in range(50, 70)]
    pixels = spark.createDataFrame(px, "scene_id string, frame_id string, mask_id int, row int, col int")
    frames = spark.createDataFrame([("s", f"f{f}", f) for f in range(3)], "scene_id string, frame_id string, frame_ord int")
    inst, conf = scenes.lift(mapping, pixels, spp, frames, scenes.Settings(1, 80, visi=0.7, simi=0.0, valid_points=5))
    sets = {}
    for r in inst.collect():
        sets.setdefault(r.inst_id, set()).add(r.point_id)
    assert sorted(map(sorted, sets.values())) == [list(range(30)), list(range(50, 70))]
    assert {round(r.conf, 6) for r in conf.collect()} == {1.0, round(1 / 3, 6)}


def test_text_query(spark):
    from stratavane.models import hash_embedding, stub_encoder

    names = ["red chair", "table"]
    emb = hash_embedding(names)
    feats = spark.createDataFrame([("s", p, [float(v) for v in emb[p // 10]]) for p in range(20)], "scene_id string, point_id bigint, feat array<float>")
    inst = spark.createDataFrame([("s", p // 10, p) for p in range(20)], "scene_id string, inst_id bigint, point_id bigint")
    got = scenes.text_query(inst, feats, "red chair.lamp", stub_encoder(), scenes.Settings(1, 1, scale=50.0))
    assert [(r.inst_id, r.name) for r in got.collect()] == [(0, "red chair")]


def test_text_functions(spark):
    assert one(spark, X.caption(F.lit("  A Chair "))) == "a chair."
    assert one(spark, X.chunks(F.array(*map(F.lit, "abcdefg")), 3)) == ["a.b.c", "d.e.f", "g"]
    assert one(spark, X.query_classes(F.lit("a. b.")))[-1] == "others"
    assert one(spark, X.tags(F.lit("a | b c"))) == ["a", "b c"]
    assert one(spark, X.strip_affixes(F.lit("x_mid_y"), "x_", "_y")) == "mid"


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, V.norm(a)) == 5 and one(spark, V.cosine(a, b)) == 0
    assert sum(one(spark, V.softmax(a, 100.0))) == pytest.approx(1)


def test_interpolate_and_fill(spark):
    known = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 5), (1, 1.0, 0.0, 0.0, 7)], "point_id bigint, x double, y double, z double, label int")
    pts = spark.createDataFrame([(10, 0.1, 0.0, 0.0, None), (11, 0.9, 0.0, 0.0, None), (12, 5.0, 0.0, 0.0, 3)], "point_id bigint, x double, y double, z double, label int")
    assert {r.point_id: r.label for r in spatial.fill_labels(pts, known).collect()} == {10: 5, 11: 7, 12: 3}


def test_painter_and_holes(spark):
    inst = long(spark, {1: range(10), 2: range(5, 8)})
    owner = {r.point_id: r.inst_id for r in labels.painter(inst).collect()}
    assert [owner[p] for p in range(10)] == [1] * 5 + [2] * 3 + [1] * 2
    px = spark.createDataFrame([(1, r, c) for r in range(5) for c in range(5) if (r, c) != (2, 2)] + [(1, 9, 9)], "m int, row int, col int")
    assert labels.largest_region(px, ["m"], 3).count() == 24
    assert labels.largest_region(px, ["m"], 3, "holes", 10, 10).where("row = 2 AND col = 2").count() == 1


def test_results_do_not_depend_on_partitions(spark):
    inst = long(spark, {m: [(m * 7 + k * 3) % 40 for k in range(9)] for m in range(15)})
    out = set()
    for n in (1, 4, 50):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.add(str(sorted(map(tuple, masks.overlaps(inst).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(out) == 1


def test_nearest_far_from_all_points(spark):
    pts = [(k, float(k % 7), float(k // 7), 0.0, k % 2) for k in range(30)] + [(90, None, 0.0, 0.0, 0), (91, float("nan"), 0.0, 0.0, 0)]
    qs = [(0, 1.2, 1.1, 0.0, 0), (1, 5000.0, -3.0, 0.0, 0), (2, -800.0, 0.0, 9.0, 1), (3, 1.0, 1.0, 1.0, 5), (4, None, 0.0, 0.0, 0)]
    p = spark.createDataFrame(pts, "point_id long, x double, y double, z double, s int")
    q = spark.createDataFrame(qs, "query_id long, x double, y double, z double, s int")

    def want(k, scoped):
        out = set()
        for i, *at, s in qs[:4]:
            near = sorted((sum((a - b) ** 2 for a, b in zip(at, o, strict=True)), j) for j, *o, t in pts[:30] if t == s or not scoped)
            out |= {(i, j, n + 1) for n, (_, j) in enumerate(near[:k])}
        return out

    for k in (3, 40):
        for scope in ([], ["s"]):
            got = spatial.nearest(q, p, k, scope=scope).collect()
            assert len(got) == len({(r.query_id, r["rank"]) for r in got})
            assert {(r.query_id, r.point_id, r["rank"]) for r in got} == want(k, bool(scope))
    assert spatial.nearest(q, p.limit(0), 3).count() == 0
    known = p.where("point_id < 30").withColumn("label", F.col("point_id"))
    far = spark.createDataFrame([(500, 1e7, 0.0, 0.0)], "point_id long, x double, y double, z double").withColumn("label", F.lit(None).cast("long"))
    assert spatial.fill_labels(far, known.drop("s")).first().label == 6
