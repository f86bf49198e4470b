"""The first k points of a ball don't make a row for each pair within it."""

import random

from stratavane.operators import spatial


def _first(q, p, radius, k, scoped):
    out = set()
    for s, i, *at in q:
        if any(x is None or x != x for x in at):
            continue
        near = sorted(j for t, j, *b in p if (t == s or not scoped) and all(x is not None and x == x for x in b) and sum((x - y) * (x - y) for x, y in zip(at, b, strict=True)) < radius * radius)
        out |= {(s, i, j, n) for n, j in enumerate(near[:k])}
    return out


def test_first_points_of_dense_balls(spark, monkeypatch):
    r = random.Random(3)
    dense = [("a", i, r.gauss(0, 0.05), r.gauss(0, 0.05), r.gauss(0, 0.05)) for i in range(300)]
    sparse = [("a", 300 + i, r.uniform(-1, 1), r.uniform(-1, 1), r.uniform(-1, 1)) for i in range(60)]
    other = [("b", 400 + i, r.gauss(0, 0.01), 0.0, 0.0) for i in range(30)] + [("b", 500, float("nan"), 0.0, 0.0), ("b", 501, None, 0.0, 0.0), ("b", 502, 1e300, 0.0, 0.0)]
    rows = dense + sparse + other
    df = spark.createDataFrame(rows, "scene_id string, point_id long, x double, y double, z double")
    monkeypatch.setattr(spatial, "FIRST_HITS", 2)
    for k in (1, 4):
        got = spatial.ball_query(df.withColumnRenamed("point_id", "query_id"), df, 0.2, k, scope=["scene_id"])
        assert {(x.scene_id, x.query_id, x.point_id, x.n) for x in got.collect()} == _first(rows, rows, 0.2, k, True)
    pairs = spatial._first_within(df.withColumnRenamed("point_id", "query_id"), df, 0.2, 4, ["scene_id"], "query_id", "point_id", spatial.AXES).count()
    every = spatial.within(df.where("point_id < 400").withColumnRenamed("point_id", "query_id"), df.where("point_id < 400"), 0.2, scope=["scene_id"]).count()
    assert every > 50 * len(rows) and pairs < 16 * len(rows)
