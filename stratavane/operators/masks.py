"""Masks in long form (one row per mask and element): run lengths, overlap, superpoints, visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratavane import storage
from stratavane.operators import bitmaps
from stratavane.operators.skew import numbered

EPS = 1e-6
#: Masks whose sizes are broadcast, at most.
BROADCAST_MASKS = 500_000
#: Elements of a mask whose pairs one key holds, at most about.
MASK_ELEMENTS = 100_000
#: Rows that a task encodes as runs, about.
PART_ROWS = 500_000

# --- run lengths -------------------------------------------------------------------------------------


def rle_encode(df: DataFrame, keys: list[str], index: str = "point_id", length: int | None = None) -> DataFrame:
    """Of each mask, ``counts``: pairs (1-based start, run length) in order, flattened, by gaps and
    islands over its distinct 0-based indexes; with ``length`` a struct of both.

    Rows are counted first and dealt once, by mask, to parts of about ``PART_ROWS`` rows, so that what a task sorts and holds doesn't
    grow with the table; only a mask of more rows makes a larger part."""
    w = Window.partitionBy(*keys).orderBy(index)
    rows = df.select(*keys, index)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    runs = rows.repartition(parts, *keys).distinct().withColumn("_g", F.col(index) - F.row_number().over(w)).groupBy(*keys, "_g").agg((F.min(index) + 1).cast("int").alias("s"), F.count(F.lit(1)).cast("int").alias("n"))
    out = runs.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("s", "n"))), lambda r: F.array(r["s"], r["n"]))).alias("counts"))
    return out if length is None else out.select(*keys, F.struct(F.lit(length).alias("length"), "counts").alias("rle"))


def rle_decode(df: DataFrame, counts: str = "counts", index: str = "point_id") -> DataFrame:
    """One row per set element of each encoded mask."""
    pairs = F.transform(F.sequence(F.lit(0), (F.size(counts) / 2).cast("int") - 1), lambda i: F.struct(F.get(F.col(counts), i * 2).alias("s"), F.get(F.col(counts), i * 2 + 1).alias("n")))
    kept = [c for c in df.columns if c != counts]
    runs = df.where(F.size(counts) > 0).select(*kept, F.explode(pairs).alias("_r"))
    return runs.where("_r.n > 0").select(*kept, F.explode(F.sequence(F.col("_r.s").cast("bigint") - 1, F.col("_r.s").cast("bigint") + F.col("_r.n") - 2)).alias(index))


def rle_area(counts: Column) -> Column:
    """The number of set elements of a mask of (start, length) pairs."""
    return F.aggregate(F.filter(counts, lambda _, i: i % 2 == 1), F.lit(0).cast("bigint"), lambda a, x: a + x)


def alternating_area(counts: Column) -> Column:
    """The area of alternating runs that begin with an unset one (the same arithmetic)."""
    return rle_area(counts)


def column_major(df: DataFrame, height: int, row: str = "row", col: str = "col", index: str = "index") -> DataFrame:
    return df.withColumn(index, F.col(col).cast("bigint") * height + F.col(row))


def alternating_runs(df: DataFrame, keys: list[str], total: int, index: str = "index") -> DataFrame:
    """Of each mask, the alternating run lengths (unset first) over ``total`` elements."""
    enc = rle_encode(df, keys, index)
    pairs = F.transform(F.sequence(F.lit(0), (F.size("counts") / 2).cast("int") - 1), lambda i: F.struct(F.get(F.col("counts"), i * 2).alias("s"), F.get(F.col("counts"), i * 2 + 1).alias("n")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda a, r: F.struct((r["s"] - 1 + r["n"]).alias("at"), F.concat(a["out"], F.array(r["s"] - 1 - a["at"], r["n"])).alias("out"))
    finish = lambda a: F.when(a["at"] < total, F.concat(a["out"], F.array(F.lit(total) - a["at"]))).otherwise(a["out"])
    return enc.select(*keys, F.aggregate(pairs, start, step, finish).alias("counts"))


def decode_alternating(df: DataFrame, counts: str = "counts", index: str = "index") -> DataFrame:
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,n:int>>").alias("out"))
    step = lambda a, n: F.struct((a["at"] + n["n"]).alias("at"), F.when(n["odd"], F.concat(a["out"], F.array(F.struct(a["at"].alias("s"), n["n"].alias("n"))))).otherwise(a["out"]).alias("out"))
    runs = F.aggregate(F.transform(counts, lambda n, i: F.struct(n.alias("n"), (i % 2 == 1).alias("odd"))), start, step, lambda a: a["out"])
    kept = [c for c in df.columns if c != counts]
    return df.select(*kept, F.explode(runs).alias("_r")).where("_r.n > 0").select(*kept, F.explode(F.sequence(F.col("_r.s").cast("bigint"), F.col("_r.s").cast("bigint") + F.col("_r.n") - 1)).alias(index))


# --- overlap -----------------------------------------------------------------------------------------


def overlaps(left: DataFrame, right: DataFrame | None = None, *, mask: str = "inst_id", element: str = "point_id", scope: list[str] = (), weights: DataFrame | None = None, weight: str = "size", eps: float = EPS) -> DataFrame:
    """Pairs of masks that share an element, with intersection, IoU, precision and recall.

    An equi-join on the element, so only pairs that meet cost anything; elements that many masks share go by bitmaps instead
    (``bitmaps``), unless weights are fractions.  With one table each pair appears once (a < b); with two, a is from the left.
    ``weights`` (element, weight) replaces counts by sums.  precision = inter / size b, recall = inter / size a."""
    scope, same = list(scope), right is None
    on = [c for c in scope if weights is not None and c in weights.columns]
    value = F.coalesce(F.col("_w"), F.lit(0)) if weights is not None else F.lit(1).cast("bigint")
    if weights is not None:
        weights = weights.select(*on, F.col(element).alias("_e"), F.col(weight).alias("_w"))

    def prepared(df: DataFrame, to: str) -> DataFrame:
        d = df.select(*scope, F.col(mask).alias(to), F.col(element).alias("_e")).distinct()
        return storage.stage(d.join(weights, [*on, "_e"], "left") if weights is not None else d, "masks")

    a = prepared(left, "a")
    b = a.withColumnRenamed("a", "b") if same else prepared(right, "b")
    size_a, size_b = (d.groupBy(*scope, c).agg(F.sum(value).alias(f"size_{c}")) for d, c in ((a, "a"), (b, "b")))
    whole = weights is None or dict(weights.dtypes)["_w"] in ("tinyint", "smallint", "int", "bigint")
    all_ = a.select(*scope, F.col("a").alias("_m"), "_e") if same else a.select(*scope, F.struct(F.lit(0).alias("s"), F.col("a").cast("string").alias("m")).alias("_m"), "_e").unionByName(b.select(*scope, F.struct(F.lit(1).alias("s"), F.col("b").cast("string").alias("m")).alias("_m"), "_e"))
    dense = storage.stage(bitmaps.shared_elements(all_, scope, "_m", "_e"), "shared") if whole else None
    if dense is not None and dense.isEmpty():
        dense = None
    few = lambda d: d if dense is None else d.join(dense, [*scope, "_e"], "left_anti")
    # up to 64 elements are one block, in which each pair stands once
    alone = dense is not None and dense.count() <= 64 and few(a).isEmpty() and (same or few(b).isEmpty())
    pair = None if alone else _meeting(few(a), None if same else few(b).drop("_w"), scope, value, weights is not None)
    if dense is not None:
        many = bitmaps.pairs(a.drop("_w"), None if same else b.drop("_w"), dense, scope, "_e", weights, "_w")
        pair = many if alone else pair.unionByName(many).groupBy(*scope, "a", "b").agg(F.sum("inter").alias("inter"))
    # pairs are many more than masks, and are not shuffled for the masks' sizes
    known = lambda d: F.broadcast(d) if d.count() <= BROADCAST_MASKS else d
    out = pair.join(known(size_a), [*scope, "a"]).join(known(size_b), [*scope, "b"])
    return out.select(
        *scope, "a", "b", "inter", "size_a", "size_b",
        (F.col("inter") / (F.col("size_a") + F.col("size_b") - F.col("inter") + eps)).alias("iou"),
        (F.col("inter") / (F.col("size_b") + eps)).alias("precision"),
        (F.col("inter") / (F.col("size_a") + eps)).alias("recall"),
    )


def _meeting(a: DataFrame, b: DataFrame | None, scope: list[str], value: Column, weighted: bool) -> DataFrame:
    """scope, a, b and the number or weight of shared elements, by an equi-join on the element.

    An element's masks travel as one list to each of its masks (of one table: of the smaller ids, so that a < b), and pairs
    are spread out and added up where the first mask's lists have met; a row for each pair and element is never shuffled.
    A mask with many elements is dealt to several keys of ``MASK_ELEMENTS`` elements, whose sums are added up again."""
    same, own = b is None, ["_e", *(["_w"] if weighted else [])]
    lists = (a.select(*scope, "_e", F.col("a").alias("b")) if same else b).groupBy(*scope, "_e").agg(F.sort_array(F.collect_list("b")).alias("_bs"))
    split = a.groupBy(*scope, "a").agg(F.ceil(F.count(F.lit(1)) / MASK_ELEMENTS).cast("int").alias("_n")).where("_n > 1")
    met = a.select(*scope, "a", *own).join(lists, [*scope, "_e"])
    if same:
        met = met.withColumn("_bs", F.expr("slice(_bs, int(array_position(_bs, a)) + 1, size(_bs))")).where(F.size("_bs") > 0)
    key = [*scope, "a", "_part"]
    part = F.pmod(F.xxhash64("_e"), F.coalesce("_n", F.lit(1)))
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = met.join(F.broadcast(split), [*scope, "a"], "left").withColumn("_part", part).select(*key, value.alias("_v"), "_bs").repartition(parts, *key)
    sums = at.select(*key, "_v", F.explode("_bs").alias("b")).groupBy(*key, "b").agg(F.sum("_v").alias("inter"))
    # sums of a mask's parts are added up; masks of one part have theirs already
    several = sums.join(F.broadcast(split.drop("_n")), [*scope, "a"], "left_semi").groupBy(*scope, "a", "b").agg(F.sum("inter").alias("inter")) if split.count() else None
    if several is None:
        return sums.select(*scope, "a", "b", "inter")
    return sums.join(F.broadcast(split.drop("_n")), [*scope, "a"], "left_anti").select(*scope, "a", "b", "inter").unionByName(several)


def drop_overlapping(left: DataFrame, right: DataFrame, threshold: float = 0.9, *, mask: str = "inst_id", element: str = "point_id", scope: list[str] = (), eps: float = EPS) -> DataFrame:
    """The masks of ``right`` whose best IoU with a mask of ``left`` stays below the threshold."""
    hit = overlaps(left, right, mask=mask, element=element, scope=scope, eps=eps).where(F.col("iou") >= threshold).select(*scope, F.col("b").alias(mask)).distinct()
    return right.join(hit, [*scope, mask], "left_anti")


def union_renumbered(first: DataFrame, second: DataFrame, *, mask: str = "inst_id", scope: list[str] = (), take_first: bool = True, take_second: bool = True) -> DataFrame:
    """Both sets of masks; the second's ids continue after the first's largest id of the scope."""
    if not take_first:
        return second.withColumn("src", F.lit("second"))
    a = first.withColumn("src", F.lit("first"))
    if not take_second:
        return a
    scope = list(scope)
    top = first.groupBy(*scope).agg((F.max(mask) + 1).alias("_top")) if scope else first.agg((F.max(mask) + 1).alias("_top"))
    b = second.join(top, scope, "left") if scope else second.join(F.broadcast(top))
    b = b.withColumn(mask, F.col(mask) + F.coalesce("_top", F.lit(0))).drop("_top").withColumn("src", F.lit("second"))
    return a.unionByName(b)


def set_operation(kind: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """Union, intersection or difference of masks in long form."""
    return {"union": left.unionByName(right).distinct(), "intersection": left.intersect(right), "difference": left.subtract(right)}[kind]


# --- points, superpoints, frames ---------------------------------------------------------------------


def membership(mapping: DataFrame, pixels: DataFrame, scope: list[str] = ("scene_id", "frame_id")) -> DataFrame:
    """The visible points under each mask's pixels."""
    return mapping.join(pixels, [*scope, "row", "col"])


def views_of_points(mapping: DataFrame, frame: list[str] = ("scene_id", "frame_id")) -> DataFrame:
    """Each point's distinct pixels (row, col) in a frame, in order, as ``_at``.  Points of a frame that lie in the same pixels lie under
    the same masks, so what follows meets masks by the distinct ``_at``, not by points."""
    return mapping.groupBy(*frame, "point_id").agg(F.array_sort(F.collect_set(F.struct("row", "col"))).alias("_at"))


def masks_over(at: DataFrame, pixels: DataFrame, *, mask: str = "mask_id", frame: list[str] = ("scene_id", "frame_id")) -> DataFrame:
    """The masks over each distinct (frame, ``_at``), and how many of their pixel rows it meets (``_n``)."""
    met = at.select(*frame, "_at").distinct().select("*", F.explode("_at").alias("_p")).select(*frame, "_at", "_p.row", "_p.col").join(pixels, [*frame, "row", "col"])
    return met.groupBy(*frame, "_at", mask).agg(F.count(F.lit(1)).alias("_n"))


def member_counts(mapping: DataFrame, pixels: DataFrame, *, mask: str = "mask_id", frame: list[str] = ("scene_id", "frame_id")) -> DataFrame:
    """How many distinct visible points (``n``) lie under each mask: points are counted by their pixels before they meet masks."""
    at = storage.stage(views_of_points(mapping, frame).groupBy(*frame, "_at").agg(F.count(F.lit(1)).alias("_points")), "views")
    return masks_over(at, pixels, mask=mask, frame=frame).join(at, [*frame, "_at"]).groupBy(*frame, mask).agg(F.sum("_points").alias("n"))


def coverage(mapping: DataFrame, pixels: DataFrame, superpoints: DataFrame, *, mask: str = "mask_id", frame: list[str] = ("scene_id", "frame_id"), least: float = 0.5) -> DataFrame:
    """The share of each superpoint's visible points that a mask covers, where it is ``least`` or more.  ``pixels`` are the masks'
    (frame, mask, row, col).  Points are counted by superpoint and pixels before they meet masks."""
    points = views_of_points(mapping, frame).join(superpoints.select("scene_id", "point_id", "spp").distinct(), ["scene_id", "point_id"])
    at = storage.stage(points.groupBy(*frame, "_at", "spp").agg(F.count(F.lit(1)).alias("_points")), "views")
    total = at.groupBy(*frame, "spp").agg(F.sum("_points").alias("total"))
    hit = masks_over(at, pixels, mask=mask, frame=frame).join(at, [*frame, "_at"]).groupBy(*frame, mask, "spp").agg(F.sum("_points").alias("hit"))
    return hit.join(total, [*frame, "spp"]).withColumn("weight", F.col("hit") / F.col("total")).where(F.col("weight") >= least)


def majority(inst: DataFrame, superpoints: DataFrame, *, mask: str = "inst_id", element: str = "point_id", spp: str = "spp", scope: list[str] = (), least: float = 0.5) -> DataFrame:
    """Masks aligned to superpoints: all points of those of which at least ``least`` are in the mask."""
    scope = list(scope)
    size = superpoints.groupBy(*scope, spp).agg(F.count(F.lit(1)).alias("_size"))
    share = inst.join(superpoints, [*scope, element]).groupBy(*scope, mask, spp).agg(F.countDistinct(element).alias("_hit")).join(size, [*scope, spp])
    return share.where(F.col("_hit") / F.col("_size") >= least).join(superpoints, [*scope, spp]).select(*scope, mask, element)


def superpoint_sizes(superpoints: DataFrame, scope: list[str] = ()) -> DataFrame:
    return superpoints.groupBy(*scope, "spp").agg(F.count(F.lit(1)).alias("size"))


def visibility(mapping: DataFrame, scope: list[str] = ("scene_id",)) -> DataFrame:
    """In how many frames each point is visible."""
    return mapping.groupBy(*scope, "point_id").agg(F.count(F.lit(1)).alias("visible"))


def visibility_ratio(counts: DataFrame, visible: DataFrame, least: float, *, count: str = "cnt", on: list[str] = ("scene_id", "point_id")) -> DataFrame:
    """The points seen in a mask often enough, against all frames in which they are visible."""
    ratio = F.col(count) / F.greatest(F.coalesce(F.col("visible").cast("double"), F.lit(0.0)), F.lit(EPS))
    return counts.join(visible, list(on), "left").withColumn("ratio", ratio).where(F.col("ratio") >= least)


def boxes(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """The pixel box of each mask."""
    return pixels.groupBy(*keys).agg(F.min("col").alias("x1"), F.min("row").alias("y1"), F.max("col").alias("x2"), F.max("row").alias("y2"), F.count(F.lit(1)).alias("n"))


def fit_to_box(pixels: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """A mask's pixels within its box (x1, y1, x2, y2, inclusive)."""
    b = boxes.select(*keys, *[F.col(c).alias("_" + c) for c in ("x1", "y1", "x2", "y2")])
    inside = F.col("col").between(F.col("_x1"), F.col("_x2")) & F.col("row").between(F.col("_y1"), F.col("_y2"))
    return pixels.join(b, keys).where(inside).select(*pixels.columns)


def batch_offsets(df: DataFrame, batch: str) -> DataFrame:
    """Of each batch its number of rows and where it begins in the concatenation of all, in order of the batch; the running sum
    goes over one row per batch."""
    n = df.groupBy(batch).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def views(mapping: DataFrame, inst: DataFrame, *, least: int = 20, k: int | None = None) -> DataFrame:
    """Of each instance, the frames that see more than ``least`` of its points, with the pixel box; the
    ``k`` with the most points (ties: the earlier frame)."""
    seen = boxes(mapping.join(inst, ["scene_id", "point_id"]), ["scene_id", "inst_id", "frame_id"]).where(F.col("n") > least)
    if k is None:
        return seen
    w = Window.partitionBy("scene_id", "inst_id").orderBy(F.desc("n"), "frame_id")
    return seen.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def stability(scores: DataFrame, keys: list[str], score: str, threshold: float = 0.0, offset: float = 1.0) -> DataFrame:
    """|score > threshold + offset| / |score > threshold - offset| of each mask's pixels."""
    n = lambda t: F.sum(F.when(F.col(score) > t, 1).otherwise(0))
    return scores.groupBy(*keys).agg(F.when(n(threshold - offset) > 0, n(threshold + offset) / n(threshold - offset)).alias("stability"))


def densify(df: DataFrame, column: str, scope: list[str] = (), to: str | None = None) -> DataFrame:
    """Ids renumbered from 0 in ascending order within the scope; rows without an id go. The distinct ids are ranked, not the
    rows, so a scope's rows need not fit in a task; without a scope not even the ids need to."""
    scope = list(scope)
    ids = df.select(*scope, column).where(F.col(column).isNotNull()).distinct()
    w = Window.partitionBy(*scope).orderBy(column) if scope else None
    ids = ids.withColumn("_dense", (F.row_number().over(w) - 1).cast("bigint")) if scope else numbered(ids, [column], "_dense")
    return df.join(ids, [*scope, column]).withColumn(to or column, F.col("_dense")).drop("_dense")


def confidence(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of the weights of a group's superpoints over the sum of their counts."""
    return groups.where("cnt > 0").groupBy(*keys).agg((F.sum("weight") / F.sum("cnt")).alias("conf"))


def merge_groups(groups: DataFrame, components: DataFrame, *, grp: str = "grp") -> DataFrame:
    """Groups merged by component: counts add up, weights are averaged over all members, absent
    superpoints as zero."""
    members = components.groupBy("component").agg(F.count(F.lit(1)).alias("_m"))
    j = groups.join(components.withColumnRenamed("node", grp), grp)
    return j.groupBy("component", "spp").agg(F.sum("cnt").alias("cnt"), F.sum("weight").alias("_w")).join(members, "component").select(F.col("component").alias(grp), "spp", "cnt", (F.col("_w") / F.col("_m")).alias("weight"))
