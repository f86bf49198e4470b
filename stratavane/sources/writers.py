"""Sinks: results to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_scene(df: DataFrame, path: str, scene: str = "scene_id") -> None:
    """Parquet partitioned by scene; scenes in ``df`` are replaced, others stay."""
    df.repartition(scene).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(scene).parquet(path)


def pending(scenes: DataFrame, done: DataFrame, scene: str = "scene_id") -> DataFrame:
    """The scenes that aren't done."""
    return scenes.join(done.select(scene).distinct(), scene, "left_anti")


def metric_csv(per_class: DataFrame, path: str) -> None:
    per_class.select("name", "ap", "ap50", "ap25").coalesce(1).sortWithinPartitions("name").write.mode("overwrite").csv(path, header=True)


def manifest(instances: DataFrame, folder: str = "predicted_masks") -> DataFrame:
    """Lines "folder/scene_007.json class score" of a submission, by scene."""
    name = F.concat(F.lit(f"{folder}/"), F.format_string("%s_%03d", "scene_id", "inst_id"), F.lit(".json"))
    return instances.select("scene_id", "inst_id", F.concat_ws(" ", name, F.col("class_id").cast("string"), F.col("score").cast("string")).alias("value"))


def rle_json(encoded: DataFrame) -> DataFrame:
    """JSON of each mask's run lengths: {"length": n, "counts": [...]}."""
    return encoded.select("scene_id", "inst_id", F.to_json(F.struct(F.col("rle.length").alias("length"), F.col("rle.counts").alias("counts"))).alias("value"))


def write_submission(instances: DataFrame, encoded: DataFrame, path: str) -> None:
    manifest(instances).orderBy("scene_id", "inst_id").select("scene_id", "value").repartition("scene_id").sortWithinPartitions("value").write.mode("overwrite").partitionBy("scene_id").text(f"{path}/manifest")
    rle_json(encoded).repartition("scene_id").write.mode("overwrite").partitionBy("scene_id", "inst_id").text(f"{path}/masks")


def dense_masks(inst: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each mask as one 0/1 line per point; sizes: scene_id, n."""
    some = inst.select("scene_id", "inst_id").distinct().join(sizes, "scene_id").select("scene_id", "inst_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("point_id"))
    hit = inst.select("scene_id", "inst_id", "point_id").distinct().withColumn("_h", F.lit(1))
    return some.join(hit, ["scene_id", "inst_id", "point_id"], "left").select("scene_id", "inst_id", "point_id", F.coalesce("_h", F.lit(0)).cast("string").alias("value"))


def write_dense(dense: DataFrame, path: str) -> None:
    named = dense.withColumn("name", F.concat("scene_id", F.lit("_"), F.lpad(F.col("inst_id").cast("string"), 3, "0")))
    named.repartition("name").sortWithinPartitions("name", "point_id").select("name", "value").write.mode("append").partitionBy("name").text(path)


def gt_instances(gt: DataFrame, path: str) -> None:
    """One file per instance with the ids of its points."""
    gt.where("code > 0").repartition("scan", "code").sortWithinPartitions("scan", "code", "point_id").select("scan", "code", F.col("point_id").cast("string").alias("value")).write.mode("overwrite").partitionBy("scan", "code").text(path)


def ids_text(df: DataFrame, path: str, id: str = "id", order: str = "point_id") -> None:
    df.orderBy(order).select(F.col(id).cast("string").alias("value")).write.mode("overwrite").text(path)


def tag_predictions(tags: DataFrame, path: str) -> None:
    """Lines "image,tag,tag"; tags: image_id, pos, tag."""
    line = F.concat_ws(",", F.col("image_id"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda s: s["tag"]))
    tags.groupBy("image_id").agg(line.alias("value")).select("value").write.mode("overwrite").text(path)


def report(df: DataFrame, rows: int = 200) -> str:
    """A printable table."""
    return df._show_string(rows, 40, False)


def coloured_points(points: DataFrame, inst: DataFrame) -> DataFrame:
    """Points of instances with a colour by instance, for any viewer."""
    h = F.xxhash64("inst_id")
    shade = lambda k: (F.shiftright(h, 8 * k).bitwiseAND(255)).cast("int")
    return points.join(inst, ["scene_id", "point_id"]).select("scene_id", "inst_id", "x", "y", "z", shade(0).alias("r"), shade(1).alias("g"), shade(2).alias("b"))
