"""Joins and windows that many tasks share: nearest neighbours, boxes, ordered windows, suppression by rounds."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stratavane.operators import boxes, evaluation, masks, matching, ordered, runs, spatial, suppression

XYZ = "point_id long, x double, y double, z double"


@pytest.fixture
def parted(spark):
    """Small tables are cut into parts, too."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("shape", ["clusters", "one spot", "line"])
def test_nearest_neighbours_adapt_to_density(spark, shape):
    rng = np.random.default_rng(4)
    if shape == "clusters":
        p = np.concatenate([rng.normal(size=(150, 3)) * 1e-4, 50 + rng.normal(size=(120, 3)), [[1e6, 0, 0], [-1e5, 3, 9]], rng.random((60, 3)) * 100])
    elif shape == "one spot":
        p = np.concatenate([np.ones((200, 3)), rng.random((20, 3))])
    else:
        p = np.stack([np.arange(150.0) ** 2, np.zeros(150), np.ones(150)], 1)
    df = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(p)], XYZ)
    got = {}
    for r in spatial.nearest(df.withColumnRenamed("point_id", "query_id").repartition(3), df.repartition(5), 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.point_id))
    for q in range(len(p)):
        d = ((p[q] - p) ** 2).sum(1)
        assert [i for _, i in sorted(got[q])] == np.lexsort((np.arange(len(p)), d))[:4].tolist()


@pytest.mark.parametrize("few", [0, 1000])
def test_boxes_that_touch(spark, monkeypatch, few):
    monkeypatch.setattr(boxes, "FEW", few)
    r = random.Random(3)
    rows = []
    for k in range(260):
        x, y, w = r.choice([r.uniform(-50, 50), float(r.randrange(-5, 5))]), r.uniform(-50, 50), r.choice([0.0, 0.01, 1.0, 2.0, 7.3, 60.0])
        rows.append((k, k % 2, x, x + w, y, y + r.choice([w, 0.5])))
    rows += [(900, 0, None, 1.0, 0.0, 1.0), (901, 0, 2.0, 1.0, 0.0, 1.0), (902, 0, float("nan"), 1.0, 0.0, 1.0), (903, 0, float("-inf"), 1.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "i long, g int, x1 double, x2 double, y1 double, y2 double")
    side = lambda p: df.select("g", *[F.col(c).alias(p + c) for c in ("i", "x1", "x2", "y1", "y2")])
    ends = lambda p: [(p + "x1", p + "x2"), (p + "y1", p + "y2")]
    got = [(x.ai, x.bi) for x in boxes.touching(side("a"), side("b"), ["g"], ends("a"), ends("b"), same=True).collect()]
    want = {(a[0], b[0]) for a in rows[:260] for b in rows[:260] if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3] and a[4] <= b[5] and b[4] <= a[5]}
    assert len(got) == len(set(got)) and set(got) == want


def test_windows_of_one_key_go_through_many_parts(spark, parted):
    rows = spark.range(3000).select(F.lit(None).cast("string").alias("k"), (F.col("id") * 7919 % 3001).alias("t"), (F.col("id") % 13).alias("v")).unionByName(spark.createDataFrame([("a", k, k) for k in range(20)], "k string, t long, v long"))
    assert ordered.dealt(rows.repartition(6), ["k"], ["t"]).select("_part").distinct().count() > 1
    got = ordered.running(rows.repartition(6), ["k"], ["t"], {"s": F.col("v"), "n": F.lit(1)})
    w = Window.partitionBy("k").orderBy("t")
    want = rows.withColumn("s", F.sum("v").over(w)).withColumn("n", F.row_number().over(w))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    smooth = evaluation.smoothed(rows, "v", "t", 20, ["k"])
    last = w.rowsBetween(-19, 0)
    want = rows.select("k", "t", F.round(F.percentile("v", 0.5).over(last), 6).alias("m"), F.round(F.avg("v").over(last), 6).alias("a"), F.round(F.avg("v").over(w), 6).alias("g"))
    got = smooth.select("k", "t", F.round("median", 6).alias("m"), F.round("avg", 6).alias("a"), F.round("global_avg", 6).alias("g"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_blocks_of_a_framed_window(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 7)
    rows = spark.range(1, 61).select((F.col("id") % 2).alias("k"), ((F.col("id") + 1) / 2).cast("long").alias("n"), F.col("id").alias("v"))
    got = ordered.framed(rows, ["k"], "n", 5, {"s": F.sum("v")})
    want = rows.withColumn("s", F.sum("v").over(Window.partitionBy("k").orderBy("n").rowsBetween(-4, 0)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_asof_on_one_long_time_line(spark, parted):
    r = random.Random(1)
    left, right = [(k, r.randrange(5000)) for k in range(800)], [(k, r.randrange(5000)) for k in range(600)]
    out = matching.asof_nearest(spark.createDataFrame(left, "id long, t long").repartition(5), spark.createDataFrame(right, "id long, t long").repartition(5), tolerance=9)
    want = {}
    for i, t in left:
        d, _, j = min((abs(t - u), -u, j) for j, u in right)
        if d < 9:
            want[i] = (j, d)
    assert {x.id: (x.match_id, x.distance) for x in out.collect()} == want


def greedy(rows, edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    kept, by = [], {}
    for i, _ in sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0])):
        best = next((k for k in kept if k in near.get(i, ())), i)
        by[i] = best
        kept += [i] if best == i else []
    return by


@pytest.mark.parametrize("kind", ["random", "chain", "none"])
def test_suppression_by_rounds_is_the_greedy_one(spark, kind):
    r = random.Random(8)
    rows = [(k, None if k == 7 else float(r.randrange(9))) for k in range(60)] if kind != "chain" else [(k, float(-k)) for k in range(14)]
    edges = {"random": {tuple(sorted(r.sample(range(60), 2))) for _ in range(150)}, "chain": {(k, k + 1) for k in range(13)}, "none": set()}[kind]
    df, e = spark.createDataFrame(rows, "inst_id long, score double"), spark.createDataFrame(sorted(edges), "a long, b long")
    assert {x.inst_id: x.kept_by for x in suppression.by_rounds(df, e, []).collect()} == greedy(rows, edges)


def test_mask_suppression_without_a_scope(spark):
    r = random.Random(2)
    sets = {m: {r.randrange(30) for _ in range(12)} for m in range(25)}
    inst = spark.createDataFrame([(m, p) for m, s in sets.items() for p in s], "inst_id long, point_id long")
    info = spark.createDataFrame([(m, float(m * 7 % 11), m % 2) for m in sets], "inst_id long, score double, class_id int")
    edges = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.25}
    by = greedy([(m, float(m * 7 % 11)) for m in sets], edges)
    assert {x.inst_id for x in suppression.greedy_mask_nms(inst, info, 0.25).collect()} == {k for k, v in by.items() if k == v}
    votes = {}
    for m, k in by.items():
        for p in sets[m]:
            votes.setdefault((k, p), []).append(m)
    size = {k: list(by.values()).count(k) for k in by.values()}
    got = {(x.inst_id, x.point_id) for x in suppression.nms_and_merge(inst, info, 0.25).collect()}
    assert got == {kp for kp, v in votes.items() if 2 * len(v) >= size[kp[0]]}
    assert masks.overlaps(inst).count() > 0


@pytest.mark.parametrize("weighted, two", [(False, False), (True, False), (False, True), (True, True)])
def test_bitmaps_and_joins_give_the_same_overlaps(spark, monkeypatch, weighted, two):
    r = random.Random(6)
    sets = {m: {p for p in range(700) if r.random() < (0.5 if p % 3 else 0.01)} | {f for f in range(700, 760) if f % 7 == m % 7} for m in range(40)}
    size = {p: r.randrange(1000) for p in range(740)}  # the last elements have no weight
    df = spark.createDataFrame([(s, m, f"e{p}") for s in ("x", None) if s or not two for m, e in sets.items() for p in e], "s string, inst_id long, point_id string").where("s IS NOT NULL")
    w = spark.createDataFrame([(f"e{p}", v) for p, v in size.items()], "point_id string, size long") if weighted else None
    sides = (df.where("inst_id < 25"), df.where("inst_id >= 15")) if two else (df, None)
    out = []
    for some, tile in ((10**9, 512), (5, 512), (5, 7)):
        monkeypatch.setattr(masks.bitmaps, "SOME", some)
        monkeypatch.setattr(masks.bitmaps, "MANY", 10**9)
        monkeypatch.setattr(masks.bitmaps, "TILE", tile)
        rows = masks.overlaps(*sides, scope=["s"], weights=w).collect()
        assert len(rows) == len({(x.a, x.b) for x in rows})
        out.append({(x.a, x.b): (x.inter, x.size_a, x.size_b) for x in rows})
    weight = lambda e: sum(size.get(p, 0) for p in e) if weighted else len(e)
    ids = [(a, b) for a in sets for b in sets if (a < 25 and b >= 15 if two else a < b)]
    want = {(a, b): (weight(sets[a] & sets[b]), weight(sets[a]), weight(sets[b])) for a, b in ids if sets[a] & sets[b]}
    assert out[0] == out[1] == out[2] == want


@pytest.mark.parametrize("kind", ["union", "intersection", "difference", "symmetric"])
def test_run_algebra_equals_sets(spark, parted, kind):
    r = random.Random(11)
    rows = [(side, m, s, s + r.choice([0, 1, 3, 20])) for side in "ab" for m in (1, 2, 3) for s in (r.randrange(300) for _ in range(60 if m < 3 or side == "a" else 0))]
    df = spark.createDataFrame(rows, "side string, inst_id long, s long, e long")
    elements = lambda side, m: {x for d, k, s, e in rows if d == side and k == m for x in range(s, e)}
    out = runs.combine(kind, df.where("side = 'a'"), df.where("side = 'b'"), ["inst_id"]).collect()
    op = {"union": set.union, "intersection": set.intersection, "difference": set.difference, "symmetric": set.symmetric_difference}[kind]
    for m in (1, 2, 3):
        own = sorted((x.s, x.e) for x in out if x.inst_id == m)
        assert {p for s, e in own for p in range(s, e)} == op(elements("a", m), elements("b", m))
        assert all(s < e for s, e in own) and all(a[1] < b[0] for a, b in zip(own, own[1:], strict=False))


def test_runs_and_run_lengths(spark):
    sets = {1: {0, 1, 2, 9}, 2: {2, 3, 9, 10}, 3: {50}}
    inst = spark.createDataFrame([(m, p) for m, s in sets.items() for p in s], "inst_id long, point_id long")
    enc = masks.rle_encode(inst, ["inst_id"])
    back = runs.runs(enc, ["inst_id"])
    assert {x.inst_id: x.counts for x in runs.encode(runs.separate(back, ["inst_id"]), ["inst_id"]).collect()} == {x.inst_id: x.counts for x in enc.collect()}
    assert {x.inst_id: x.n for x in runs.area(back, ["inst_id"]).collect()} == {1: 4, 2: 4, 3: 1}
    assert [(x.a, x.b, x.inter, x.iou) for x in runs.overlaps(back).collect()] == [(1, 2, 2, 2 / 6)]


@pytest.mark.parametrize("keys", [[], ["s"]])
def test_farthest_points_of_a_large_group(spark, monkeypatch, keys):
    rng = np.random.default_rng(9)
    rows = [(s, k, *map(float, rng.integers(0, 9, 3))) for s, n in (("a", 150), (None, 3), ("b", 60)) for k in range(n) if keys or s == "a"]
    df = spark.createDataFrame(rows, "s string, point_id long, x double, y double, z double").where("s IS NOT NULL").repartition(4)
    small = spatial.farthest_points(df, ["s"], 12).collect()
    monkeypatch.setattr(spatial, "ONE_TASK", 100)
    monkeypatch.setattr(spatial, "ROUNDS", 5)
    large = spatial.farthest_points(df, keys, 12).collect()
    assert {(x.point_id, x["rank"], x.s if keys else "a") for x in large} == {(x.point_id, x["rank"], x.s) for x in small}
