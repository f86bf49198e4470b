"""Cosines are written once into a plan that uses them for the softmax and its parts."""

import math

from pyspark.sql import functions as F

from stratavane.operators import labels


def test_scores_compute_their_cosines_once(spark):
    feats = spark.createDataFrame([("s", k, k % 3, [float(k % 5 - 2), 1.0, float(k % 2)]) for k in range(12)], "scene_id string, point_id long, inst_id long, feat array<double>")
    classes = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 1.0]), (2, [0.0, 0.0, 0.0])], "class_id int, emb array<double>")
    s = labels.class_scores(feats, classes, scale=3.0).select("scene_id", "point_id", "inst_id", "scores")
    out = labels.mask_scores(s.drop("inst_id"), s.select("scene_id", "inst_id", "point_id"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("SQRT(") <= 4
    got = {(r.inst_id, r.class_id): r.score for r in out.collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (math.hypot(*a) * math.hypot(*b)) if any(b) else 0.0
    want = {}
    for r in feats.collect():
        e = [math.exp(3.0 * cos(r.feat, c.emb)) for c in classes.orderBy(F.col("class_id")).collect()]
        for c, x in enumerate(e):
            want.setdefault((r.inst_id, c), []).append(x / sum(e))
    assert got.keys() == want.keys() and all(abs(got[k] - sum(v) / len(v)) < 1e-9 for k, v in want.items())
