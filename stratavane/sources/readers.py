"""Scans of scene data: files to DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratavane import types as S
from stratavane.functions import geometry as G
from stratavane.sources import formats

#: Fixed values of the datasets: depth units per metre.
DEPTH_SCALE = {"scannet": 1000.0, "scannetpp": 1000.0, "arkitscenes": 1000.0, "s3dis": 512.0, "replica": 6553.5}


def _files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (r.option("pathGlobFilter", pattern) if pattern else r).load(path)


def _stem() -> F.Column:
    return F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)


def _parsed(files: DataFrame, parse: Callable[[bytes], pd.DataFrame], schema: str) -> DataFrame:
    """One parse per file; its rows with the file's ``path``."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, blob in zip(batch["path"], batch["content"], strict=True):
                found = parse(bytes(blob))
                found.insert(0, "path", path)
                yield found[["path", *names]]

    return files.select("path", "content").mapInPandas(run, f"path string, {schema}")


def split_file(spark: SparkSession, path: str) -> DataFrame:
    """The scenes of a split file, sorted."""
    return spark.read.text(path).select(F.trim("value").alias("scene_id")).where("scene_id <> ''").orderBy("scene_id")


def point_clouds(spark: SparkSession, path: str, pattern: str = "*.ply") -> DataFrame:
    """Points of PLY files; the scene is the file's name."""

    def parse(blob: bytes) -> pd.DataFrame:
        v = formats.read_ply(blob)["vertex"]
        col = lambda *names: next((np.asarray(v[n], "f8") for n in names if n in v), np.zeros(len(v["x"])))
        return pd.DataFrame({"point_id": np.arange(len(v["x"])), "x": col("x"), "y": col("y"), "z": col("z"), "r": col("red", "r").astype("f4"), "g": col("green", "g").astype("f4"), "b": col("blue", "b").astype("f4")})

    return _parsed(_files(spark, path, pattern), parse, "point_id bigint, x double, y double, z double, r float, g float, b float").withColumn("scene_id", _stem()).select(*S.POINTS.fieldNames())


def mesh_faces(spark: SparkSession, path: str, pattern: str = "*.ply") -> DataFrame:
    """Triangles (or polygons) of PLY meshes."""

    def parse(blob: bytes) -> pd.DataFrame:
        face = formats.read_ply(blob).get("face", {})
        rows = next(iter(face.values()), [])
        return pd.DataFrame({"face_id": np.arange(len(rows)), "vertices": [[int(i) for i in r] for r in rows]})

    return _parsed(_files(spark, path, pattern), parse, "face_id bigint, vertices array<int>").withColumn("scene_id", _stem()).drop("path")


def depth_images(spark: SparkSession, path: str, scale: float, scene: str = r"([^/]+)/[^/]+/[^/]+$", pattern: str = "*.png") -> DataFrame:
    """Known depths in metres, one row per pixel with depth."""

    def parse(blob: bytes) -> pd.DataFrame:
        px = formats.read_png(blob)
        row, col = np.nonzero(px)
        return pd.DataFrame({"row": row.astype("i4"), "col": col.astype("i4"), "raw": px[row, col].astype("f8")})

    d = _parsed(_files(spark, path, pattern), parse, "row int, col int, raw double")
    return d.select(F.regexp_extract("path", scene, 1).alias("scene_id"), _stem().alias("frame_id"), "row", "col", (F.col("raw") / scale).alias("d"))


def images(spark: SparkSession, path: str, scene: str = r"([^/]+)/[^/]+/[^/]+$") -> DataFrame:
    """Colour images as bytes, for models."""
    return _files(spark, path).select(F.regexp_extract("path", scene, 1).alias("scene_id"), _stem().alias("frame_id"), "path", "content")


def matrices(spark: SparkSession, path: str, to: str, pattern: str = "*.txt") -> DataFrame:
    """Matrices in text files, as arrays by rows."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path).select("value", F.input_file_name().alias("path"))
    numbers = F.transform(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    return files.select("path", _stem().alias("frame_id"), numbers.alias(to))


def npz_poses(spark: SparkSession, path: str, key: str = "pose", invert: bool = False) -> DataFrame:
    d = _parsed(_files(spark, path, "*.npz"), lambda b: pd.DataFrame({"pose": [formats.read_npz_matrix(b, key)]}), "pose array<double>")
    return d.select(_stem().alias("frame_id"), (G.rigid_inverse(F.col("pose")) if invert else F.col("pose")).alias("pose"))


def trajectory(spark: SparkSession, path: str) -> DataFrame:
    """Lines "ts rx ry rz tx ty tz" (axis-angle, world to camera) as camera-to-world poses by time."""
    v = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double"))
    t = spark.read.text(path).where(F.trim("value") != "").select(v.alias("v"))
    m = G.axis_angle_pose(*[F.col("v")[k] for k in range(1, 7)])
    return t.where(F.size("v") == 7).select(F.round(F.col("v")[0], 3).alias("ts"), G.rigid_inverse(m).alias("pose"))


def pincams(spark: SparkSession, path: str) -> DataFrame:
    """Lines "w h fx fy hw hh" with their time from the file's name "..._<time>.pincam"."""
    v = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double"))
    t = spark.read.option("recursiveFileLookup", "true").text(path).select(v.alias("v"), F.regexp_extract(F.input_file_name(), r"_([0-9.]+)\.[A-Za-z]+$", 1).cast("double").alias("ts"))
    return t.select("ts", F.col("v")[0].cast("int").alias("width"), F.col("v")[1].cast("int").alias("height"), G.camera(F.col("v")[2], F.col("v")[3], F.col("v")[4], F.col("v")[5]).alias("k"))


def query_table(spark: SparkSession, path: str) -> DataFrame:
    """The query table; rows that don't fit are dropped."""
    return spark.read.csv(path, header=True, schema=S.QUERY_TABLE, mode="DROPMALFORMED")


def label_map(spark: SparkSession, path: str, source: str, target: str) -> DataFrame:
    return spark.read.csv(path, header=True, sep="\t").select(F.col(source).alias("source"), F.col(target).alias("target")).dropDuplicates(["source"])


def scene_types(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="scene_id string, scene_type string")


def segment_json(spark: SparkSession, path: str) -> DataFrame:
    """Points' segments from {"segIndices": [...]}."""
    j = spark.read.option("multiLine", True).schema("segIndices array<bigint>").json(path).withColumn("path", F.input_file_name())
    return j.select(F.regexp_extract("path", r"([^/]+?)(?:_vh_clean.*|\.[^/]*)?$", 1).alias("scene_id"), F.posexplode("segIndices").alias("point_id", "segment"))


def segment_groups(spark: SparkSession, path: str) -> DataFrame:
    """Objects from {"segGroups": [{"id", "label", "segments"}]}, one row per segment."""
    schema = "segGroups array<struct<id:bigint,label:string,segments:array<bigint>>>"
    j = spark.read.option("multiLine", True).schema(schema).json(path).withColumn("path", F.input_file_name())
    g = j.select(F.regexp_extract("path", r"([^/]+?)(?:_vh_clean.*|\.[^/]*)?$", 1).alias("scene_id"), F.explode("segGroups").alias("g"))
    return g.select("scene_id", F.col("g.id").alias("object_id"), F.col("g.label").alias("label"), F.explode("g.segments").alias("segment"))


def propagate_segments(segments: DataFrame, groups: DataFrame) -> DataFrame:
    """Objects' labels on points, by segment."""
    return segments.join(groups, ["scene_id", "segment"]).select("scene_id", "point_id", "object_id", "label")


def annotation_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines "x y z r g b" of per-object files "<class>_<k>.txt"."""
    v = F.split(F.trim("value"), r"\s+")
    t = spark.read.option("recursiveFileLookup", "true").text(path).select(v.alias("v"), F.input_file_name().alias("path")).where(F.size("v") == 6)
    return t.select(_stem().alias("object"), F.regexp_extract("path", r"([A-Za-z]+)_[0-9]+\.txt$", 1).alias("label"), *[F.col("v")[k].try_cast("double").alias(c) for k, c in enumerate("xyzrgb")])


def blocks_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows x, y, z, r, g, b, sem, inst without a header."""
    return spark.read.csv(path, schema="x double, y double, z double, r float, g float, b float, sem int, inst int")


def detections(spark: SparkSession, path: str, pattern: str = "*.pkl") -> DataFrame:
    """Pickled 2D detections with run-length masks, one row per mask pixel: the masks' number, score and class where there are
    any, the image's size, row and column.  Only plain values are unpickled (see ``formats.read_plain_pickle``)."""

    def parse(blob: bytes) -> pd.DataFrame:
        fields = formats.read_plain_pickle(blob)
        found = fields.get("pred_masks_rle")
        parts = []
        for k, rle in enumerate(found if found is not None else []):
            height, width = (int(v) for v in rle["size"])
            counts = rle["counts"] if isinstance(rle["counts"], list) else formats.coco_decode_counts(rle["counts"])
            at = np.flatnonzero(np.repeat(np.arange(len(counts)) % 2, counts))  # unset first, column by column
            own = lambda name, none, k=k: fields[name][k] if fields.get(name) is not None else none
            parts.append(pd.DataFrame({"mask_id": k, "score": float(own("scores", np.nan)), "label_id": int(own("pred_classes", -1)), "height": height, "width": width, "row": at % height, "col": at // height}))
        names = ["mask_id", "score", "label_id", "height", "width", "row", "col"]
        return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in names})

    d = _parsed(_files(spark, path, pattern), parse, "mask_id int, score double, label_id int, height int, width int, row int, col int")
    return d.withColumn("frame_id", _stem()).drop("path")


def prediction_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines "relative/path label confidence"; a path that leaves the folder is an error."""
    v = F.split(F.trim("value"), r"\s+")
    t = spark.read.text(path).where(F.trim("value") != "").select(v[0].alias("file"), v[1].cast("int").alias("label_id"), v[2].cast("double").alias("conf"))
    bad = F.col("file").startswith("/") | F.col("file").rlike(r"(^|/)\.\.(/|$)")
    return t.withColumn("file", F.when(bad, F.raise_error(F.concat(F.lit("path leaves the folder: "), "file"))).otherwise(F.col("file")))


def vertex_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id per line, by file and position."""
    w = spark.read.option("wholetext", True).text(path).select(_stem_of_input().alias("scene_id"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("point_id", "id"))
    return w.where("id <> ''").select("scene_id", "point_id", F.col("id").cast("bigint").alias("id"))


def _stem_of_input() -> F.Column:
    return F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)


def tag_lists(spark: SparkSession, path: str) -> DataFrame:
    """Lines "image,tag,tag"."""
    v = F.split("value", ",")
    return spark.read.text(path).where("value <> ''").select(v[0].alias("image_id"), F.posexplode(F.slice(v, 2, 1_000_000)).alias("pos", "tag")).withColumn("tag", F.trim("tag"))


def metric_csv(spark: SparkSession, path: str) -> DataFrame:
    """Per-class metrics by position; the header names more columns than rows have."""
    return spark.read.csv(path, header=False, schema="cls string, ap double, ap50 double, ap25 double").where("cls <> 'class'")


def tables(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Superpoints, features, proposals or ground truth, kept as Parquet."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def frames(spark: SparkSession, depth_path: str, scene: str = r"([^/]+)/[^/]+/[^/]+$", interval: int = 1) -> DataFrame:
    """The frames of each scene by the files of its depth folder, every ``interval``-th in order of id."""
    from pyspark.sql import Window

    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(depth_path).select(F.regexp_extract("path", scene, 1).alias("scene_id"), _stem().alias("frame_id"), F.col("path").alias("depth_path"))
    number = F.regexp_extract("frame_id", "([0-9]+)", 1).cast("bigint")
    f = f.withColumn("frame_ord", F.row_number().over(Window.partitionBy("scene_id").orderBy(number, "frame_id")) - 1)
    return f.where(F.col("frame_ord") % interval == 0)


class SceneReader:
    """A dataset: depth, poses, intrinsics and points below one root."""

    def __init__(self, spark: SparkSession, root: str, dataset: str, interval: int = 1):
        if dataset not in DEPTH_SCALE:
            raise ValueError(f"unknown dataset {dataset}")
        self.spark, self.root, self.dataset, self.interval = spark, root.rstrip("/"), dataset, interval

    def frames(self) -> DataFrame:
        return frames(self.spark, f"{self.root}/depth", interval=self.interval)

    def depth(self) -> DataFrame:
        return depth_images(self.spark, f"{self.root}/depth", DEPTH_SCALE[self.dataset])

    def points(self) -> DataFrame:
        return point_clouds(self.spark, f"{self.root}/points")

    def poses(self) -> DataFrame:
        if self.dataset == "arkitscenes":
            return trajectory(self.spark, f"{self.root}/trajectory")
        if self.dataset == "s3dis":
            return npz_poses(self.spark, f"{self.root}/pose", invert=True)
        return matrices(self.spark, f"{self.root}/pose", "pose")


def build_dataset(spark: SparkSession, name: str, root: str, interval: int = 1) -> SceneReader:
    return SceneReader(spark, root, name, interval)
