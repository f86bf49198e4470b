"""From a 3D network's raw proposals to instances: classes, masks over voxels, suppression, points, superpoints, run lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavane import storage
from stratavane.operators import masks, suppression

#: Proposals with a lower confidence are left out.
LEAST_CONF = 0.1


def instances(proposals: DataFrame, mask_logits: DataFrame, voxels: DataFrame, superpoints: DataFrame, *, semantic: DataFrame | None = None, whole_classes: list[int] = (), logit: float = 0.0, points: int = 100, nms: str = "matrix", threshold: float = 0.1, shift: int = 1) -> DataFrame:
    """scene_id, inst_id, label_id, conf and ``counts`` (run lengths over the scene's points).

    proposals: scene_id, inst_id, logits (one for each class and a last one for none), conf; mask_logits: scene_id, inst_id, voxel_id, logit;
    voxels: scene_id, point_id, voxel_id; superpoints: scene_id, point_id, spp; semantic: scene_id, voxel_id, sem.

    A proposal's class is that of its greatest logit (ties: the first), its score the confidence held within 0 and 1.  Masks of fewer than ``points``
    voxels go, then those that ``suppress`` (by name) strikes; what is left is taken from voxels to points, then aligned to superpoints of which
    at least half the points are in the mask, and goes if it has fewer than ``points`` points.  Each of ``whole_classes`` (floors, ceilings) is one
    more instance per scene, aligned to superpoints, with confidence 1 and the negative id -1 - class."""
    key = ["scene_id", "inst_id"]
    own = F.slice("logits", F.lit(1), F.size("logits") - 1)
    p = proposals.select(*key, (F.array_position(own, F.array_max(own)) - 1).cast("int").alias("class_id"), F.least(F.greatest(F.col("conf").cast("double"), F.lit(0.0)), F.lit(1.0)).alias("score"))
    p = p.where(F.col("score") >= LEAST_CONF)
    on = mask_logits.where(F.col("logit") >= logit).select(*key, "voxel_id").distinct().join(p.select(*key), key)
    big = on.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= points).select(*key)
    on = storage.stage(on.join(big, key), "proposals")
    p = storage.stage(p.join(big, key), "classes")
    kept = suppression.suppress(nms, on, p, threshold, scope=["scene_id"], element="voxel_id").select(*key)
    at_points = on.join(kept, key).join(voxels, ["scene_id", "voxel_id"]).select(*key, "point_id")
    whole = storage.stage(masks.majority(at_points, superpoints, scope=["scene_id"]), "whole")
    enough = whole.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= points).select(*key)
    out = masks.rle_encode(whole.join(enough, key), key).join(p, key).select(*key, (F.col("class_id") + shift).alias("label_id"), F.col("score").alias("conf"), "counts")
    if semantic is None or not len(whole_classes):
        return out
    back = semantic.where(F.col("sem").isin(list(whole_classes))).join(voxels, ["scene_id", "voxel_id"]).select("scene_id", (-1 - F.col("sem")).cast(dict(proposals.dtypes)["inst_id"]).alias("inst_id"), "point_id")
    back = masks.rle_encode(storage.stage(masks.majority(back, superpoints, scope=["scene_id"]), "back"), key)
    return out.unionByName(back.select(*key, (-F.col("inst_id")).cast("int").alias("label_id"), F.lit(1.0).alias("conf"), "counts"))
