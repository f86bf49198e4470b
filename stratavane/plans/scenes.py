"""End-to-end plans: lift masks to instances, classify them against text, answer query tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratavane import storage
from stratavane.functions import geometry as G
from stratavane.functions import text as X
from stratavane.operators import evaluation, labels, masks, merge


@dataclass
class Settings:
    height: int
    width: int
    cut: int = 0
    depth_threshold: float = 0.1
    visi: float = 0.7
    reca: float = 1.0
    simi: float = 0.5
    point_visi: float = 0.0
    valid_points: int = 50
    top_k: int = 300
    scale: float = 100.0


def mapping(points: DataFrame, frames: DataFrame, depth: DataFrame | None, s: Settings) -> DataFrame:
    """The visible (frame, point) pairs with their pixel.  frames: scene_id, frame_id, pose (camera to
    world), k.  Each point meets its own scene's frames; the pixel test and the depth join follow at once."""
    p = points.select("scene_id", "point_id", "x", "y", "z")
    f = frames.select("scene_id", "frame_id", G.rigid_inverse(F.col("pose")).alias("w2c"), "k")
    j = p.join(f, "scene_id")
    x, y, z = G.transform_point(F.col("w2c"), F.col("x"), F.col("y"), F.col("z"))
    j = j.select("scene_id", "frame_id", "point_id", x.alias("cx"), y.alias("cy"), z.alias("cz"), "k")
    if depth is None:
        j = j.where("cz > 0")
    col, row = G.pinhole(F.col("cx"), F.col("cy"), F.col("cz"), F.col("k"))
    j = j.where("cz <> 0").withColumn("row", row).withColumn("col", col).where(G.in_frame(F.col("row"), F.col("col"), s.height, s.width, s.cut))
    if depth is not None:
        j = j.join(depth, ["scene_id", "frame_id", "row", "col"]).where(G.depth_agrees(F.col("d"), F.col("cz"), s.depth_threshold))
    return j.select("scene_id", "frame_id", "point_id", "row", "col")


def z_buffer(mapped: DataFrame, slack: float = 0.2) -> DataFrame:
    """Of the points of a pixel those within ``slack`` of the nearest; mapped has z."""
    near = mapped.groupBy("scene_id", "frame_id", "row", "col").agg(F.min("z").alias("_z"))
    return mapped.join(near, ["scene_id", "frame_id", "row", "col"]).where(F.col("z") - F.col("_z") <= slack).drop("_z")


def lift(mapped: DataFrame, pixels: DataFrame, superpoints: DataFrame, frames: DataFrame, s: Settings, features: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Frame masks to instances: (inst points, confidences).  frames: scene_id, frame_id, frame_ord from 0."""
    leaves = merge.frame_masks(mapped, pixels, superpoints, features).join(frames.select("scene_id", "frame_id", "frame_ord"), ["scene_id", "frame_id"])
    leaves = storage.stage(leaves.withColumn("grp", F.xxhash64("scene_id", "frame_id", "mask_id")), "leaves")
    sizes = masks.superpoint_sizes(superpoints, ["scene_id"])
    n = frames.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))
    merged = merge.hierarchical_merge(leaves.select("scene_id", "frame_ord", "grp", "spp", "cnt", "weight"), n, sizes, visi=s.visi, reca=s.reca, simi=s.simi, features=features)
    conf = masks.confidence(merged, ["scene_id", "grp"])
    pts = merged.where("cnt > 0").select("scene_id", F.col("grp").alias("inst_id"), "spp", "cnt").join(superpoints, ["scene_id", "spp"])
    if s.point_visi > 0:
        seen = masks.visibility(mapped)
        pts = masks.visibility_ratio(pts, seen, s.point_visi)
        pts = masks.majority(pts.select("scene_id", "inst_id", "point_id"), superpoints, scope=["scene_id"])
    pts = pts.select("scene_id", "inst_id", "point_id").distinct()
    big = pts.groupBy("scene_id", "inst_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > s.valid_points).drop("_n")
    return pts.join(big, ["scene_id", "inst_id"]), conf.withColumnRenamed("grp", "inst_id").join(big, ["scene_id", "inst_id"])


def classify(inst: DataFrame, point_features: DataFrame, texts: DataFrame, s: Settings, duplicate: bool = True) -> DataFrame:
    """Instances' classes: mean over points of the scaled softmax, then the scene's top (instance, class)
    pairs, or each instance's best class."""
    scored = labels.class_scores(point_features, texts, scale=s.scale)
    m = labels.mask_scores(scored, inst)
    if duplicate:
        return labels.top_k(m, s.top_k, scope=["scene_id"])
    return labels.best_class(m, ["scene_id", "inst_id"])


def text_query(inst: DataFrame, point_features: DataFrame, query: str, encode, s: Settings, least: float = 0.5) -> DataFrame:
    """The instances that answer a free-text query "a.b": best class among the named ones and "others"."""
    spark = inst.sparkSession
    one = spark.createDataFrame([(query,)], "q string").select(F.posexplode(X.query_classes(F.col("q"))).alias("class_id", "name"))
    texts = one.withColumn("emb", encode(F.col("name")))
    best = classify(inst, point_features, texts, s, duplicate=False).join(F.broadcast(one), "class_id")
    return best.where((F.col("name") != "others") & (F.col("score") > least))


def query_table(queries: DataFrame, inst_scores: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """All rows of a query table at once: an instance answers if its score for the query's text exceeds
    the row's own threshold; each keeps its ``num_filter`` best (0: all).  inst_scores: video_id, query,
    inst_id, score."""
    j = queries.join(inst_scores, ["video_id", "query"]).where(F.col("score") > F.col("Score_min"))
    if sizes is not None:
        j = j.join(sizes, ["video_id", "inst_id"]).where((F.col("size_shrink") == 0) | ((F.col("n") > 6000) & (F.col("n") < 8000)))
    w = Window.partitionBy("video_id", "query_id").orderBy(F.desc("score"), "inst_id")
    return j.withColumn("rank", F.row_number().over(w)).where((F.col("num_filter") == 0) | (F.col("rank") <= F.col("num_filter")))


def evaluate(final: DataFrame, inst: DataFrame, gt: DataFrame, valid: list[int], **options) -> DataFrame:
    """AP of final (scene_id, inst_id, class_id, score) predictions."""
    preds = final.select(F.col("scene_id").alias("scan"), F.col("inst_id").alias("pred_id"), F.col("class_id").alias("label_id"), F.col("score").alias("conf"))
    pts = inst.select(F.col("scene_id").alias("scan"), F.col("inst_id").alias("pred_id"), "point_id")
    return evaluation.evaluate(preds, pts, gt, valid, **options)
