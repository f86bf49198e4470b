"""Augmentation against plain numpy versions with the same hashed numbers."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from stratavane.operators import augment, labels, merge

XYZ = "s string, point_id long, x double, y double, z double"


def uniform(*of):
    return (int(hashlib.md5(":".join(map(str, of)).encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)


def normal(*of):
    return math.sqrt(-2 * math.log(uniform(*of, "r"))) * math.cos(2 * math.pi * uniform(*of, "a"))


def smooth(n, axis):
    padded = np.pad(n, [(1, 1) if k == axis else (0, 0) for k in range(3)])
    cut = lambda lo: np.take(padded, range(lo, lo + n.shape[axis]), axis)
    return (cut(0) + cut(1) + cut(2)) / 3


def plain_elastic(p, scene, gran, mag, seed):
    b = (np.abs(p).max(0).astype(int) // gran + 3).astype(int)
    out = p.copy()
    for c in range(3):
        n = np.array([[[normal(seed, scene, i, j, k, c) for k in range(b[2])] for j in range(b[1])] for i in range(b[0])])
        for axis in (0, 1, 2, 0, 1, 2):
            n = smooth(n, axis)
        t = (p + (b - 1) * gran) / (2 * gran)
        i0 = np.minimum(np.floor(t).astype(int), b - 2)
        f = t - i0
        for q in range(8):
            d = np.array([q >> k & 1 for k in range(3)])
            w = np.where(d, f, 1 - f).prod(1)
            out[:, c] += mag * w * n[tuple((i0 + d).T)]
    return out


def cloud(spark, n=60):
    rng = np.random.default_rng(3)
    p = {s: rng.normal(size=(n, 3)) * [9, 5, 2] for s in "ab"}
    return p, spark.createDataFrame([(s, k, *map(float, x)) for s, q in p.items() for k, x in enumerate(q)], XYZ)


def test_elastic_equals_numpy(spark):
    p, df = cloud(spark)
    for parts in (1, 5):
        got = augment.elastic(df.repartition(parts), 3, 2.0, scope=["s"], seed=4).orderBy("s", "point_id").collect()
        for s, q in p.items():
            assert np.allclose([(r.x, r.y, r.z) for r in got if r.s == s], plain_elastic(q, s, 3, 2.0, 4), atol=1e-9)


def test_turned_equals_numpy(spark):
    p, df = cloud(spark)
    got = augment.turned(df, scope=["s"], seed=9, jitter=True, flip=True, rotate=True).orderBy("s", "point_id").collect()
    for s, q in p.items():
        m = np.eye(3) + 0.1 * np.array([[normal(9, s, "m", r, c) for c in range(3)] for r in range(3)])
        t = uniform(9, s, "theta") * 2 * math.pi
        want = q @ m @ np.array([[math.cos(t), math.sin(t), 0], [-math.sin(t), math.cos(t), 0], [0, 0, 1]])
        for c in (0, 1):
            want[:, c] *= -1 if uniform(9, s, "flip", c) < 0.5 else 1
        assert np.allclose([(r.x, r.y, r.z) for r in got if r.s == s], want)


def test_crops_hold_few_enough_points(spark):
    rng = np.random.default_rng(1)
    rows = [(s, k, *map(float, x)) for s, n in (("big", 900), ("small", 40)) for k, x in enumerate(rng.random((n, 3)) * [100, 100, 5])]
    df = spark.createDataFrame(rows, XYZ)
    out = augment.cropped(df, 80, 200, scope=["s"], step=8, seed=2)
    got = {(r.s, r.point_id): (r.x, r.y, r.z) for r in out.collect()}
    assert got == {(r.s, r.point_id): (r.x, r.y, r.z) for r in augment.cropped(df.repartition(6), 80, 200, scope=["s"], step=8, seed=2).collect()}
    at = {(s, k): xyz for s, k, *xyz in rows}
    big = {k: np.subtract(v, at[k]) for k, v in got.items() if k[0] == "big"}
    assert 0 < len(big) <= 200 and len(got) - len(big) == 40
    assert all(np.allclose(v, next(iter(big.values()))) for v in big.values()) and all(min(got[k]) >= 0 and max(got[k]) < 80 for k in big)
    assert all(got["small", k] == tuple(at["small", k]) for k in range(40))


def test_string_classes_and_merge_parents(spark):
    f = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, feat array<double>")
    c = spark.createDataFrame([("b", [1.0, 0.1]), ("a", [1.0, 0.1]), ("c", [0.1, 1.0])], "class_id string, emb array<double>")
    for block in (10, 1):
        assert {r.id: r.class_id for r in labels.nearest_class(f, c, block=block).collect()} == {1: "a", 2: "c"}
    for n in (1, 2, 5, 7):
        frames = spark.range(n).select(F.lit(n).cast("bigint").alias("n"), F.col("id").alias("x"))
        levels = merge.tree(n)
        for depth in range(len(levels)):
            got = {r.x: (r.v["lo"], r.v["hi"]) for r in frames.select("x", merge.node_at(F.col("x"), F.col("n"), depth).alias("v")).collect()}
            for x, (lo, hi) in got.items():
                assert (lo, hi) in levels[depth] and lo <= x <= hi or lo == hi == x
