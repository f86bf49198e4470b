"""The boundary to neural models.

A model is a function over Arrow batches with a fixed schema.  No weights come with this package: the
functions here are deterministic stand-ins with the real ones' inputs and outputs, for tests and as
places to plug the real ones in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = 64


def hash_embedding(values: list, width: int = 64) -> np.ndarray:
    """A unit vector drawn from a hash of each value's words, so that texts with common words are near."""
    out = np.zeros((len(values), width), np.float32)
    for k, v in enumerate(values):
        for word in v.lower().split() if isinstance(v, str) else [bytes(v)] if v is not None else []:
            seed = int.from_bytes(hashlib.sha256(word.encode() if isinstance(word, str) else word).digest()[:8], "little")
            out[k] += np.random.default_rng(seed).standard_normal(width)
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n == 0, 1, n)


def encoder(load: Callable[[], Callable[[list], np.ndarray]], batch: int = BATCH) -> Callable[[Column], Column]:
    """An embedding as a column function.  load() runs once per worker and returns encode(values)."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for s in batches:
            parts = [encode(s.iloc[i : i + batch].tolist()) for i in range(0, len(s), batch)]
            yield pd.Series([v.tolist() for p in parts for v in p], index=s.index)

    return run


def stub_encoder(width: int = 64) -> Callable[[Column], Column]:
    return encoder(lambda: lambda values: hash_embedding(values, width))


DETECTIONS = "scene_id string, frame_id string, box_id int, x1 double, y1 double, x2 double, y2 double, score double, label string"


def detector(images: DataFrame, prompts: list[str], load: Callable[[], Callable]) -> DataFrame:
    """Boxes of a promptable detector.  load() returns detect(content, prompt) -> rows (x1, y1, x2, y2, score, label)."""
    names = [c.split()[0] for c in DETECTIONS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = load()
        for b in batches:
            out = []
            for scene, frame, content in zip(b["scene_id"], b["frame_id"], b["content"], strict=True):
                found = [r for p in prompts for r in detect(content, p)]
                out += [(scene, frame, k, *r) for k, r in enumerate(found)]
            yield pd.DataFrame(out, columns=names)

    return images.select("scene_id", "frame_id", "content").mapInPandas(run, DETECTIONS)


def precomputed_detector(boxes: DataFrame, classes: list[str], threshold: float) -> DataFrame:
    """A detector that was run elsewhere: its boxes for the prompted classes above the threshold."""
    return boxes.where(F.col("label").isin(classes) & (F.col("score") > threshold))


def box_masks(boxes: DataFrame) -> DataFrame:
    """A stand-in for a box-prompted segmenter: the ellipse within each box, as pixels."""
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    rows = F.sequence(F.floor("y1").cast("int"), F.ceil("y2").cast("int"))
    cols = F.sequence(F.floor("x1").cast("int"), F.ceil("x2").cast("int"))
    px = boxes.withColumn("row", F.explode(rows)).withColumn("col", F.explode(cols))
    u, v = (F.col("col") - cx) / ((F.col("x2") - F.col("x1")) / 2 + 1e-9), (F.col("row") - cy) / ((F.col("y2") - F.col("y1")) / 2 + 1e-9)
    return px.where(u * u + v * v <= 1).select("scene_id", "frame_id", F.col("box_id").alias("mask_id"), "row", "col")
