"""Incremental forms of the commutative sums, for frames that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_visibility(mapping: DataFrame, time: str | None = None, late: str = "10 minutes") -> DataFrame:
    """In how many frames each point has been visible so far (output mode update or complete); repeated
    deliveries of a (frame, point) within the watermark count once."""
    m = mapping
    if time is not None:
        m = m.withWatermark(time, late).dropDuplicatesWithinWatermark(["scene_id", "frame_id", "point_id"])
    return m.groupBy("scene_id", "point_id").agg(F.count(F.lit(1)).alias("visible"))


def running_vectors(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Component sums of the vectors of each key so far: keys, pos, total."""
    return rows.select(*keys, F.posexplode(vector).alias("pos", "v")).groupBy(*keys, "pos").agg(F.sum("v").alias("total"))


def windowed_counts(events: DataFrame, time: str, window: str, keys: list[str], late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts by event-time window; later rows than the watermark are dropped."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"))


def frame_poses(frames: DataFrame, poses: DataFrame, tolerance: str = "300 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Frames with the poses within the tolerance, as a stream-stream interval join (inner)."""
    f = frames.withWatermark("frame_time", late)
    p = poses.withWatermark("pose_time", late).withColumnRenamed("scene_id", "pose_scene")
    near = (F.col("pose_time") >= F.col("frame_time") - F.expr(f"INTERVAL {tolerance}")) & (F.col("pose_time") <= F.col("frame_time") + F.expr(f"INTERVAL {tolerance}"))
    return f.join(p, (F.col("scene_id") == F.col("pose_scene")) & near).drop("pose_scene")
