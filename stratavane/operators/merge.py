"""Merging masks of frames into instances.

The merge tree halves the frame list at (l + r) // 2, so the tree is known beforehand: one pass per
level merges all pairs of sibling nodes of that level at once, in one set of joins.  State is long:
(scene, node, grp, spp, cnt, weight).  Each level's state is written to the shared folder.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratavane import storage
from stratavane.functions import vectors
from stratavane.operators import masks
from stratavane.operators.graph import connected_components
from stratavane.operators.skew import numbered


def tree(n: int) -> list[list[tuple[int, int]]]:
    """The node ranges of the merge tree over 0..n-1 by depth, the root first."""
    levels, now = [], [(0, n - 1)] if n else []
    while now:
        levels.append(now)
        now = [half for lo, hi in now if lo < hi for half in ((lo, (lo + hi) // 2), ((lo + hi) // 2 + 1, hi))]
    return levels


def node_at(frame: Column, n: Column, depth: int) -> Column:
    """The node (lo, hi) at a depth of the tree over n frames that holds a frame, or the leaf above it."""
    root = F.struct(F.lit(0).cast("bigint").alias("lo"), (n - 1).cast("bigint").alias("hi"))
    if not depth:
        return root

    def down(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2)
        left = frame <= mid
        return F.struct(F.when(left, at["lo"]).otherwise(mid + 1).alias("lo"), F.when(left, mid).otherwise(at["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), root, lambda at, k: F.when(at["lo"] < at["hi"], down(at, k)).otherwise(at))


def _name(lo: Column, hi: Column) -> Column:
    return lo.cast("bigint") * (1 << 31) + hi


def frame_masks(mapping: DataFrame, pixels: DataFrame, superpoints: DataFrame, features: DataFrame | None, least: float = 0.5, similar: float = 0.5) -> DataFrame:
    """The leaves: of each mask the superpoints it covers by half or more, if there are at least two;
    with features (scene_id, spp, feat) only those similar to another covered one.  Weights are
    the full coverage vector, also of superpoints the mask does not keep."""
    # weights of all touched superpoints; cnt 1 for those that are kept
    cov = masks.coverage(mapping, pixels, superpoints, least=0.0)
    kept = cov.where(F.col("weight") >= least)
    key = ["scene_id", "frame_id", "mask_id"]
    many = kept.groupBy(*key).agg(F.count(F.lit(1)).alias("_k")).where("_k > 1")
    kept = kept.join(many.select(*key), key)
    if features is not None:
        f = kept.select(*key, "spp").join(features, ["scene_id", "spp"])
        other = f.select(*key, F.col("spp").alias("spp2"), F.col("feat").alias("feat2"))
        best = f.join(other, key).where("spp <> spp2").groupBy(*key, "spp").agg(F.max(vectors.cosine(F.col("feat"), F.col("feat2"))).alias("_s"))
        kept = kept.join(best.where(F.col("_s") >= similar).select(*key, "spp"), [*key, "spp"])
    valid = kept.select(*key).distinct()
    flagged = kept.select(*key, "spp", F.lit(1).alias("cnt"))
    return cov.join(valid, key).join(flagged, [*key, "spp"], "left").select(*key, "spp", F.coalesce("cnt", F.lit(0)).alias("cnt"), "weight")


def adjacency(pairs: DataFrame, visi: float, reca: float = 1.0, simi: float | None = None) -> DataFrame:
    """Edges among overlapping pairs (with iou, precision, recall and, if simi counts, similarity):
    iou >= visi, or recall of either side >= reca if reca < 0.98, and similarity >= simi if simi > 0.1."""
    near = F.col("iou") >= visi
    if reca < 0.98:
        near = near | (F.col("recall") >= reca) | (F.col("precision") >= reca)
    if simi is not None and simi > 0.1:
        near = near & (F.col("similarity") >= simi)
    return pairs.where(near).select("a", "b")


def merge_level(state: DataFrame, sizes: DataFrame, parents: DataFrame, *, visi: float, reca: float = 1.0, simi: float | None = None, features: DataFrame | None = None) -> DataFrame:
    """One level: groups of sibling nodes with adjacent overlap become one group of their parent.
    state: scene_id, node, grp (unique), spp, cnt, weight; parents: scene_id, node, parent. A node that isn't
    in ``parents`` waits for a later level."""
    here = state.join(parents, ["scene_id", "node"], "left")
    here = here.withColumn("node", F.coalesce("parent", "node")).withColumn("_up", F.col("parent").isNotNull()).drop("parent")
    on = here.where("_up AND cnt > 0")
    pairs = masks.overlaps(on, mask="grp", element="spp", scope=["scene_id", "node"], weights=sizes, weight="size")
    if features is not None and simi is not None and simi > 0.1:
        f = vectors.sum_vectors(on.join(features, ["scene_id", "spp"]), ["grp"], "feat")
        pairs = pairs.join(f.toDF("a", "fa"), "a").join(f.toDF("b", "fb"), "b").withColumn("similarity", vectors.cosine(F.col("fa"), F.col("fb")))
    comps = connected_components(adjacency(pairs, visi, reca, simi), vertices=on.select("grp").distinct())
    merged = masks.merge_groups(on.select("grp", "spp", "cnt", "weight").unionByName(here.where("_up AND cnt = 0").select("grp", "spp", "cnt", "weight")), comps)
    place = here.select("grp", "scene_id", "node").distinct()
    merged = merged.join(place, "grp").select("scene_id", "node", "grp", "spp", "cnt", "weight")
    return storage.stage(merged.unionByName(here.where("NOT _up").select("scene_id", "node", "grp", "spp", "cnt", "weight")), "merge")


def hierarchical_merge(leaves: DataFrame, frames: DataFrame, sizes: DataFrame, *, visi: float | list[float] = 0.7, reca: float = 1.0, simi: float | None = 0.5, features: DataFrame | None = None, inter: int = 1) -> DataFrame:
    """Bottom-up merge over the frame tree.  leaves: scene_id, frame_ord (dense from 0), grp (unique), spp,
    cnt, weight; frames: scene_id, n (frames of the scene); sizes: scene_id, spp, size.  A list of
    thresholds is indexed by depth // inter, so the root takes the first (loosest)."""
    n_max = frames.agg(F.max("n")).first()[0] or 0
    deepest = math.ceil(math.log2(n_max)) if n_max > 1 else 0
    state = leaves.select("scene_id", _name(F.col("frame_ord"), F.col("frame_ord")).alias("node"), "grp", "spp", "cnt", "weight")
    for depth in range(deepest - 1, -1, -1):
        nodes = state.select("scene_id", "node").distinct().join(frames.select("scene_id", F.col("n").cast("bigint").alias("n")), "scene_id")
        up = node_at(F.shiftright("node", 31), F.col("n"), depth)
        parents = nodes.select("scene_id", "node", _name(up["lo"], up["hi"]).alias("parent")).where("parent <> node")
        limit = visi if not isinstance(visi, list) else visi[min(depth // inter, len(visi) - 1)]
        state = merge_level(state, sizes, parents, visi=limit, reca=reca, simi=simi, features=features)
    return state.drop("node")


def best_match_merge(left: DataFrame, right: DataFrame, threshold: float, *, mask: str = "inst_id", element: str = "point_id", scope: list[str] = (), eps: float = 0.0) -> DataFrame:
    """Each mask of the left takes its best mask of the right (ties: the smaller id) if their IoU
    exceeds the threshold; the rest of both sides stay as they are.  Returns element rows with
    ``kind`` (matched, left, right) and the ids ``a`` and ``b``."""
    scope = list(scope)
    pairs = masks.overlaps(left, right, mask=mask, element=element, scope=scope, eps=eps)
    w = Window.partitionBy(*scope, "a").orderBy(F.desc("iou"), "b")
    best = pairs.withColumn("_r", F.row_number().over(w)).where((F.col("_r") == 1) & (F.col("iou") > threshold)).select(*scope, "a", "b")
    l, r = left.select(*scope, F.col(mask).alias("a"), element).distinct(), right.select(*scope, F.col(mask).alias("b"), element).distinct()
    none = F.lit(None).cast(dict(r.dtypes)["b"])
    matched = l.join(best, [*scope, "a"]).select(*scope, "a", "b", element).unionByName(r.join(best, [*scope, "b"]).select(*scope, "a", "b", element)).distinct().withColumn("kind", F.lit("matched"))
    only_l = l.join(best, [*scope, "a"], "left_anti").select(*scope, "a", none.alias("b"), element).withColumn("kind", F.lit("left"))
    only_r = r.join(best, [*scope, "b"], "left_anti").select(*scope, none.alias("a"), "b", element).withColumn("kind", F.lit("right"))
    return matched.unionByName(only_l).unionByName(only_r)


def sequential_merge(frames: list[DataFrame], threshold: float, *, element: str = "point_id") -> DataFrame:
    """A fold over a short list of frames' masks (inst_id, element): matched masks are united."""
    out = frames[0]
    for nxt in frames[1:]:
        m = best_match_merge(out, nxt, threshold, element=element)
        ids = numbered(m.select("kind", "a", "b").distinct(), ["kind", "a", "b"], "inst_id").withColumn("inst_id", F.col("inst_id") + 1)
        out = storage.stage(m.join(ids, (m.kind == ids.kind) & m.a.eqNullSafe(ids.a) & m.b.eqNullSafe(ids.b)).select("inst_id", element).distinct(), "fold")
    return out
