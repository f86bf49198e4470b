"""Evaluation reads the points of predictions once, however many tables follow from them."""

from pyspark.sql import functions as F

from stratavane import storage
from stratavane.operators import evaluation


def test_points_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [("s", m, p) for m in range(6) for p in range(m * 10, m * 10 + 15)]
    points = spark.createDataFrame(rows, "scan string, pred_id long, point_id long").mapInArrow(counted, "scan string, pred_id long, point_id long")
    gt = spark.createDataFrame([("s", p, 1000 * (p // 20 + 1) + p // 10) for p in range(60)], "scan string, point_id long, code long")
    preds = spark.createDataFrame([("s", m, m // 2 + 1, m / 7) for m in range(6)], "scan string, pred_id long, label_id int, conf double")
    with storage.scratch(spark):
        got = evaluation.evaluate(preds, points, gt, [1, 2, 3], overlaps=[0.25, 0.5], min_points=5).orderBy("label_id", "overlap").collect()
    assert seen.value == len(rows)
    assert len(got) == 6 and all(r.recall == 1.0 for r in got if r.overlap == 0.25)
