"""Suppression of overlapping boxes and masks.

Greedy suppression of boxes is a fold over each group's sorted boxes (a frame, a class), that of masks is decided in rounds over
overlapping pairs; the matrix and pairwise forms are plain joins.  All orders are by score descending, then id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratavane import storage
from stratavane.functions import geometry as G
from stratavane.operators import boxes, masks


def greedy_box_nms(df: DataFrame, keys: list[str], threshold: float, *, id: str = "box_id", score: str = "score", plus: float = 0.0, keep_equal: bool = True) -> DataFrame:
    """Rows (x1, y1, x2, y2) of each group that survive greedy suppression.  ``plus`` = 1 counts pixels;
    overlap of exactly the threshold survives if ``keep_equal``.  A group (a frame's detections) is sorted
    and folded over its survivors within the engine.  Null and NaN scores come last; a box with a null
    coordinate overlaps nothing."""
    def item(row: Column, at: Column) -> Column:
        x1, y1, x2, y2 = (row[c].cast("double") for c in ("x1", "y1", "x2", "y2"))
        last = F.coalesce(-row[score].cast("double"), F.lit(float("nan")))
        return F.struct(last.alias("s"), row[id].alias("i"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), ((x2 - x1 + plus) * (y2 - y1 + plus)).alias("area"), at.alias("at"))

    def goes(kept: Column, b: Column) -> Column:
        def overlaps(s: Column) -> Column:
            w = F.greatest(F.least(s["x2"], b["x2"]) - F.greatest(s["x1"], b["x1"]) + plus, F.lit(0.0))
            h = F.greatest(F.least(s["y2"], b["y2"]) - F.greatest(s["y1"], b["y1"]) + plus, F.lit(0.0))
            union = s["area"] + b["area"] - w * h
            iou = F.when(union > 0, w * h / union).otherwise(0.0)
            return iou > threshold if keep_equal else iou >= threshold

        return F.coalesce(F.exists(kept, overlaps), F.lit(False))

    rows = df.select(*[F.col(f"`{c}`").alias(f"_k{n}") for n, c in enumerate(keys)], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    lists = rows.groupBy(*[f"_k{n}" for n in range(len(keys))]).agg(F.collect_list("_row").alias("_rows"))
    none = F.array().cast(f"array<struct<s:double,i:{df.schema[id].dataType.simpleString()},x1:double,y1:double,x2:double,y2:double,area:double,at:int>>")
    kept = F.aggregate(F.sort_array(F.transform("_rows", item)), none, lambda kept, b: F.when(goes(kept, b), kept).otherwise(F.concat(kept, F.array(b))), lambda kept: kept["at"])
    return lists.select(F.explode(F.transform(kept, lambda k: F.get("_rows", k))).alias("_row")).select("_row.*")


def batched_box_nms(df: DataFrame, keys: list[str], category: str, threshold: float, **options) -> DataFrame:
    """Greedy suppression within each category."""
    return greedy_box_nms(df, [*keys, category], threshold, **options)


def pairwise_box_nms(df: DataFrame, keys: list[str], threshold: float, *, id: str = "box_id", score: str = "score") -> DataFrame:
    """Rows that overlap no better row by more than the threshold, whether or not that row survives."""
    keys, corners = list(keys), ("x1", "y1", "x2", "y2")
    side = lambda p: df.select(*keys, *[F.col(c).alias(p + c) for c in (id, score, *corners)])
    box = lambda p: G.box(*[F.col(p + c) for c in corners])
    ends = lambda p: [(p + "x1", p + "x2"), (p + "y1", p + "y2")]
    better = (F.col(f"b_{score}") > F.col(f"a_{score}")) | ((F.col(f"b_{score}") == F.col(f"a_{score}")) & (F.col(f"b_{id}") < F.col(f"a_{id}")))
    near = boxes.touching(side("a_"), side("b_"), keys, ends("a_"), ends("b_"), same=True)
    gone = near.where(better).withColumn("_a", box("a_")).withColumn("_b", box("b_")).where(G.iou(F.col("_a"), F.col("_b")) > threshold)
    return df.join(gone.select(*keys, F.col(f"a_{id}").alias(id)).distinct(), [*keys, id], "left_anti")


def by_rounds(rows: DataFrame, edges: DataFrame, keys: list[str], *, id: str = "inst_id", score: str = "score") -> DataFrame:
    """Greedy suppression over an edge table: keys, id and ``kept_by``, the row itself for one that stays, else the best row that stays
    among its better neighbours.

    rows: keys, id, score; edges: keys, a, b (each unordered pair once), ids that exclude each other.  Rows are in order of score
    descending (null and NaN last), then id.  In each round the rows whose better neighbours are all decided stay unless one of those
    has stayed, which decides their worse neighbours; edges with a decided end go.  Rounds follow the longest chain of
    rows that wait for each other; each is joins and grouped minima, and its edges are written to the shared folder."""
    keys = list(keys)
    last = lambda s: F.coalesce(-s.cast("double"), F.lit(float("nan")))
    place = rows.select(*keys, F.col(id).alias("_i"), F.struct(last(F.col(score)).alias("s"), F.col(id).alias("i")).alias("_o"))
    end = lambda to: place.select(*keys, F.col("_i").alias(to), F.col("_o").alias(f"_{to}"))
    both = edges.select(*keys, "a", "b").join(end("a"), [*keys, "a"]).join(end("b"), [*keys, "b"]).where("_a.i <> _b.i")
    up = F.col("_a") < F.col("_b")
    # hi is better than lo
    open_ = storage.stage(both.select(*keys, F.when(up, F.col("_a")).otherwise(F.col("_b")).alias("hi"), F.when(up, F.col("_b")).otherwise(F.col("_a")).alias("lo")).distinct(), "edges")
    every, struck = open_, []
    while not open_.isEmpty():
        waits = open_.select(*keys, F.col("lo").alias("hi")).distinct()
        stay = open_.select(*keys, "hi").distinct().join(waits, [*keys, "hi"], "left_anti")
        hit = storage.stage(open_.join(stay, [*keys, "hi"]).select(*keys, "lo").distinct(), "struck")
        struck.append(hit)
        decided = hit.withColumnRenamed("lo", "hi").unionByName(stay)
        left = open_.join(decided, [*keys, "hi"], "left_anti").join(hit, [*keys, "lo"], "left_anti")
        before, open_ = open_, storage.stage(left, "edges")
        if before is not every:
            storage.release(before)
    out = place.select(*keys, F.col("_i").alias(id), F.col("_o").alias("lo"))
    if not struck:
        return out.select(*keys, id, F.col(id).alias("kept_by"))
    all_ = reduce(DataFrame.unionByName, struck)
    by = every.join(all_.withColumnRenamed("lo", "hi"), [*keys, "hi"], "left_anti").groupBy(*keys, "lo").agg(F.min("hi").alias("by"))
    return out.join(by, [*keys, "lo"], "left").select(*keys, id, F.coalesce(F.col("by.i"), F.col(id)).alias("kept_by"))


def _mask_rounds(inst: DataFrame, info: DataFrame, threshold: float, scope: list[str], element: str, same_class: str | None) -> DataFrame:
    if same_class:  # masks of other classes never meet
        inst = inst.join(info.select(*scope, "inst_id", same_class), [*scope, "inst_id"])
    keys = [*scope, *([same_class] if same_class else [])]
    pairs = masks.overlaps(inst, element=element, scope=keys, eps=0.0)
    return by_rounds(info, pairs.where(F.col("iou") > threshold), keys).select(*scope, "inst_id", "kept_by")


def greedy_mask_nms(inst: DataFrame, info: DataFrame, threshold: float, *, scope: list[str] = (), element: str = "point_id", same_class: str | None = None) -> DataFrame:
    """Masks (inst_id, score) that survive; a mask goes if it overlaps a surviving better one (of its
    class, if ``same_class`` names that column) by more than the threshold.  Only overlapping pairs are
    compared, and decided in rounds."""
    return _mask_rounds(inst, info, threshold, list(scope), element, same_class).where("inst_id = kept_by").drop("kept_by")


def nms_and_merge(inst: DataFrame, info: DataFrame, threshold: float, *, scope: list[str] = (), element: str = "point_id", same_class: str | None = None) -> DataFrame:
    """Surviving masks with the elements that at least half of the masks they stand for have."""
    scope = list(scope)
    by = _mask_rounds(inst, info, threshold, scope, element, same_class)
    size = by.groupBy(*scope, "kept_by").agg(F.count(F.lit(1)).alias("_m"))
    votes = inst.join(by, [*scope, "inst_id"]).groupBy(*scope, "kept_by", element).agg(F.countDistinct("inst_id").alias("_v"))
    return votes.join(size, [*scope, "kept_by"]).where(F.col("_v") * 2 >= F.col("_m")).select(*scope, F.col("kept_by").alias("inst_id"), element)


def matrix_decay(pairs: DataFrame, info: DataFrame, keys: list[str], *, id: str = "inst_id", score: str = "score", sigma: float = 2.0, kernel: str = "gaussian") -> DataFrame:
    """Soft suppression: score' = score * min over better rows i of decay(iou_ij) / decay(iou_i), where iou_i
    is i's own best overlap with a better row.  pairs: keys, a, b, iou (each unordered pair once)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), id)
    ranked = info.withColumn("_rank", F.row_number().over(w))
    rank = ranked.select(*keys, F.col(id).alias("_id"), "_rank")
    both = pairs.join(rank.toDF(*keys, "a", "ra"), [*keys, "a"]).join(rank.toDF(*keys, "b", "rb"), [*keys, "b"])
    up = F.col("ra") < F.col("rb")
    both = both.select(*keys, F.when(up, F.col("a")).otherwise(F.col("b")).alias("i"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("j"), "iou")
    comp = both.groupBy(*keys, F.col("j").alias("i")).agg(F.max("iou").alias("comp"))
    x = both.join(comp, [*keys, "i"], "left").withColumn("comp", F.coalesce("comp", F.lit(0.0)))
    decay = F.exp(-sigma * (F.col("iou") * F.col("iou") - F.col("comp") * F.col("comp"))) if kernel == "gaussian" else (1 - F.col("iou")) / (1 - F.col("comp"))
    worst = x.groupBy(*keys, F.col("j").alias(id)).agg(F.min(decay).alias("_d"))
    return ranked.join(worst, [*keys, id], "left").withColumn("decayed", F.col(score) * F.least(F.lit(1.0), F.coalesce("_d", F.lit(1.0)))).drop("_rank", "_d")


def matrix_box_nms(df: DataFrame, keys: list[str], *, id: str = "box_id", score: str = "score", sigma: float = 2.0) -> DataFrame:
    """``matrix_decay`` (gaussian) of each group's boxes (x1, y1, x2, y2), with ids that are unique in their group: all rows and ``decayed``.

    A row meets the better ones of its group twice, for its own best overlap and for the least decay. Both joins and what is
    grouped from them are dealt out by ``keys``, so rows are shuffled once and pairs never. A row with a null key meets none."""
    keys, corners = list(keys), ("x1", "y1", "x2", "y2")
    rest = [c for c in df.columns if c not in (*keys, id)]
    known = reduce(lambda x, k: x & F.col(f"`{k}`").isNotNull(), keys, F.lit(True))
    rows = df.where(known)  # said here and not left to the joins, so that all read the same shuffled rows

    def met(better: DataFrame, of: Column) -> DataFrame:
        """Each row with ``_of``, an aggregate over its better rows (columns prefixed by b_)."""
        b = better.select(*keys, *[F.col(f"`{c}`").alias("b_" + c) for c in better.columns if c not in keys])
        mine, theirs = F.col(f"`{score}`"), F.col(f"`b_{score}`")
        first = F.when(theirs.eqNullSafe(mine), F.col(f"`b_{id}`") < F.col(f"`{id}`")).otherwise(mine.isNull() | (theirs > mine))
        on = reduce(lambda x, k: x & (F.col(f"r.`{k}`") == F.col(f"b.`{k}`")), keys, first)
        group = [F.col(f"r.`{k}`").alias(k) for k in keys]
        return rows.alias("r").join(b.alias("b"), on, "left").groupBy(*group, f"`{id}`").agg(*[F.first(f"`{c}`").alias(c) for c in rest], of.alias("_of"))

    iou = G.iou(G.box(*[F.col("b_" + c) for c in corners]), G.box(*[F.col(c) for c in corners]))
    comp = met(rows, F.max(iou)).withColumnRenamed("_of", "_comp")
    own = F.coalesce("b__comp", F.lit(0.0))
    worst = met(comp, F.min(F.exp(-sigma * (iou * iou - own * own))))
    out = worst.unionByName(df.where(~known).withColumn("_of", F.lit(None).cast("double"))) if keys else worst
    return out.withColumn("decayed", F.col(f"`{score}`") * F.least(F.lit(1.0), F.coalesce("_of", F.lit(1.0)))).select(*[F.col(f"`{c}`") for c in df.columns], "decayed")


def matrix_nms(inst: DataFrame, info: DataFrame, *, scope: list[str] = (), category: str = "class_id", element: str = "point_id", sigma: float = 2.0, top_k: int | None = None, least: float = 0.1) -> DataFrame:
    """Matrix suppression of masks within their class: the ``top_k`` best of a scope, or all with a decayed
    score of at least ``least``."""
    scope = list(scope)
    keys = [*scope, category]
    pairs = masks.overlaps(inst.join(info.select(*scope, "inst_id", category), [*scope, "inst_id"]), element=element, scope=keys, eps=0.0)
    out = matrix_decay(pairs.select(*keys, "a", "b", "iou"), info, keys, sigma=sigma)
    if top_k is None:
        return out.where(F.col("decayed") >= least)
    w = Window.partitionBy(*scope).orderBy(F.desc("decayed"), "inst_id")
    return out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_k).drop("_r")


def suppress(kind: str, inst: DataFrame, info: DataFrame, threshold: float, **options) -> DataFrame:
    """Suppression by name: greedy, class, merge or matrix."""
    if kind == "greedy":
        return greedy_mask_nms(inst, info, threshold, **options)
    if kind == "class":
        return greedy_mask_nms(inst, info, threshold, same_class=options.pop("category", "class_id"), **options)
    if kind == "merge":
        return nms_and_merge(inst, info, threshold, **options)
    if kind == "matrix":
        return matrix_nms(inst, info, least=threshold, **options)
    raise ValueError(kind)


def decode_head(logits: DataFrame, *, keys: list[str], sizes: DataFrame, logit: str = "logit", least: float = 0.05, nms_pre: int | None = None, id: str = "box_id", category: str = "cls", scale: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """A detector head's raw rows (keys, box, class, logit; x1, y1, x2, y2 in the network's frame) as detections: sigmoid, score filter, the
    ``nms_pre`` best, boxes divided by ``scale`` and clamped to the image; sizes: keys, width, height."""
    out = logits.withColumn("score", 1 / (1 + F.exp(-F.col(logit)))).where(F.col("score") > least)
    if nms_pre:
        w = Window.partitionBy(*keys).orderBy(F.desc("score"), id, category)
        out = out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= nms_pre).drop("_r")
    out = out.join(sizes, keys)
    for c, by, top in (("x1", scale[0], "width"), ("y1", scale[1], "height"), ("x2", scale[0], "width"), ("y2", scale[1], "height")):
        out = out.withColumn(c, F.least(F.greatest(F.col(c) / by, F.lit(0.0)), F.col(top).cast("double")))
    return out.drop("width", "height", logit)


def select_detections(df: DataFrame, keys: list[str], *, score: str = "score", id: str = "box_id", least: float = 0.05, nms_pre: int | None = None, keep: int = 100, threshold: float | None = 0.5, category: str | None = None) -> DataFrame:
    """A detector head's selection: score filter, the ``nms_pre`` best, greedy suppression, the ``keep`` best."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), id)
    out = df.where(F.col(score) > least)
    if nms_pre:
        out = out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= nms_pre).drop("_r")
    if threshold is not None:
        out = greedy_box_nms(out, [*keys, category] if category else keys, threshold, id=id, score=score)
    return out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")
