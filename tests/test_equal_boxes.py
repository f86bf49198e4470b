from pyspark.sql import functions as F

from stratavane.operators import boxes, evaluation


def test_equal_boxes_meet_once(spark, monkeypatch):
    """Copies of a box are one row with their ids, in lists of bounded length, and every pair of ids comes back."""
    monkeypatch.setattr(boxes, "LIST_ROWS", 50)
    corners = lambda x: F.array(*[(x + k).cast("double") for k in range(3)])
    rows = spark.range(400).withColumn("x", F.when(F.col("id") < 390, F.lit(0)).otherwise(F.col("id") * 10))
    b = rows.select(F.lit("s").alias("scan"), F.lit(1).alias("label_id"), "id", corners(F.col("x")).alias("low"), corners(F.col("x") + 2).alias("high"))
    p, g = b.withColumnRenamed("id", "pred_id"), b.withColumnRenamed("id", "gt_id")
    keys = ["scan", "label_id", "low", "high"]
    lists = boxes.alike(p, keys, "pred_id", "ids").select(F.size("ids")).toPandas().iloc[:, 0]
    assert 11 <= len(lists) <= 18 and lists.max() < 120 and lists.sum() == 400
    got = evaluation.box_matches(p, g)
    assert got.count() == 390 * 390 + 10 == got.select("pred_id", "gt_id").distinct().count()
    assert got.agg(F.min("iou"), F.max("inter")).first() == (1.0, 8.0)
