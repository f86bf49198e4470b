"""Points in space: grids, radius and nearest-neighbour joins, voxels, sampling.

Joins within a radius go over grid cells: every point is in one cell, every query asks the cells its radius
reaches, and the rest is an equi-join on the cell.  Nearest neighbours are sought in blocks of equally many points.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratavane import storage
from stratavane.operators import boxes, ordered
from stratavane.operators.skew import numbered

AXES = ("x", "y", "z")


def cell(size: float, axes=AXES) -> list[Column]:
    return [F.floor(F.col(a) / size).cast("bigint") for a in axes]


def squared(left: str, right: str, axes=AXES) -> Column:
    out = F.lit(0.0)
    for a in axes:
        out = out + (F.col(left + a) - F.col(right + a)) * (F.col(left + a) - F.col(right + a))
    return out


def within(queries: DataFrame, points: DataFrame, radius: float, *, scope: list[str] = (), qid: str = "query_id", pid: str = "point_id", axes=AXES) -> DataFrame:
    """Pairs (query, point) at a distance below the radius, with ``d2``."""
    scope = list(scope)
    q = queries.select(*scope, qid, *[F.col(a).cast("double").alias("q" + a) for a in axes])
    p = points.select(*scope, pid, *[F.col(a).cast("double").alias("p" + a) for a in axes])
    cells = []
    for a in axes:
        q = q.withColumn("c" + a, F.explode(F.sequence(F.floor(F.col("q" + a) / radius) - 1, F.floor(F.col("q" + a) / radius) + 1)))
        p = p.withColumn("c" + a, F.floor(F.col("p" + a) / radius))
        cells.append("c" + a)
    return q.join(p, [*scope, *cells]).withColumn("d2", squared("q", "p", axes)).where(F.col("d2") < radius * radius).select(*scope, qid, pid, "d2")


#: Points of a chunk that a query may meet in its ball at first, for each that it asks for, and how chunks grow.
FIRST_HITS, GROWTH = 8, 4


def _first_within(queries: DataFrame, points: DataFrame, radius: float, k: int, scope: list[str], qid: str, pid: str, axes) -> DataFrame:
    """Pairs within the radius, among them the first ``k`` points (by id) of each query, and at most ``k`` for each chunk of points.

    Points are taken in order of their ids in chunks, each of which is ``GROWTH`` times as far as what went before; a query that has its ``k`` meets
    no later chunk. So where ids don't follow space, pairs are some times k for each query, however dense the points are. Points
    go to the cells around their own and a query stays in its cell, so its pairs are in one task, and those beyond k aren't shuffled."""
    cells = ["c" + a for a in axes]
    placed = reduce(lambda x, a: x & (F.abs(F.col(a).cast("double")) < float("inf")), axes, F.lit(True))
    place = lambda c: F.floor(F.least(F.greatest(F.col(c) / radius, F.lit(-(2.0**62))), F.lit(2.0**62)))
    own = lambda df, i, p: df.where(placed).select(*scope, i, *[F.col(a).cast("double").alias(p + a) for a in axes]).select("*", *[place(p + a).alias("c" + a) for a in axes])
    q, p = own(queries, qid, "q"), own(points, pid, "p")
    n, most = p.groupBy(*scope, *cells).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    first = int((n or 0) * min(1.0, FIRST_HITS * k / (most or 1)))
    key = [*scope, *cells, qid]
    head = F.row_number().over(Window.partitionBy(*key).orderBy(pid))

    def meet(q: DataFrame, p: DataFrame) -> DataFrame:
        for a in axes:
            p = p.withColumn("c" + a, F.explode(F.sequence(F.col("c" + a) - 1, F.col("c" + a) + 1)))
        near = q.join(p, [*scope, *cells]).withColumn("d2", squared("q", "p", axes)).where(F.col("d2") < radius * radius)
        return near.select(*key, pid, "d2").withColumn("_r", head).where(F.col("_r") <= k).select(*scope, qid, pid, "d2")

    if first >= (n or 0):
        return meet(q, p)
    p = storage.stage(numbered(p, [pid, *scope, *["p" + a for a in axes]], "_n"), "points")
    q, parts, lo, hi = storage.stage(q, "queries"), [], 0, first
    while True:
        found = storage.stage(meet(q, p.where((F.col("_n") >= lo) & (F.col("_n") < hi)).drop("_n")), "found")
        parts.append(found)
        if hi >= n:
            return reduce(DataFrame.unionByName, parts)
        done = reduce(DataFrame.unionByName, parts).groupBy(*scope, qid).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= k).drop("_k")
        before, q = q, storage.stage(q.join(done, [*scope, qid], "left_anti"), "queries")
        storage.release(before)
        if q.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        lo, hi = hi, hi * GROWTH


def ball_query(queries: DataFrame, points: DataFrame, radius: float, k: int | None = None, *, scope: list[str] = (), qid: str = "query_id", pid: str = "point_id", axes=AXES, pad: bool = False) -> DataFrame:
    """Of each query the first ``k`` points (by id) within the radius, numbered from 0; without k all.
    ``pad`` repeats the first until there are k."""
    scope = list(scope)
    w = Window.partitionBy(*scope, qid).orderBy(pid)
    near = within(queries, points, radius, scope=scope, qid=qid, pid=pid, axes=axes) if k is None else _first_within(queries, points, radius, k, scope, qid, pid, axes)
    out = near.withColumn("n", F.row_number().over(w) - 1)
    if k is None:
        return out
    out = out.where(F.col("n") < k)
    if not pad:
        return out
    lists = out.groupBy(*scope, qid).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col(pid).alias("p")))), lambda s: s["p"]).alias("ps"))
    padded = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.get(F.col("ps"), i), F.get(F.col("ps"), F.lit(0))))
    return lists.select(*scope, qid, F.posexplode(padded).alias("n", pid))


#: Bits of an axis in a point's place on the space-filling curve.
CURVE_BITS = 16
#: Points of a block, unless 2 * k is more.
BLOCK_POINTS = 16


def curve_place(df: DataFrame, ranges: DataFrame, scope: list[str], axes) -> DataFrame:
    """``_z``: the place on a space-filling curve (bits of the coordinates by turns) through the bulk of the scope's points; what lies beyond
    is as good as on its rim.  It only says which points are likely to be near each other."""
    j = df.join(F.broadcast(ranges)) if not scope else df.join(ranges, scope)
    z, n = F.lit(0).cast("bigint"), min(CURVE_BITS, 62 // len(axes))
    for k, a in enumerate(axes):
        span = F.col(f"_r{a}")[1] - F.col(f"_r{a}")[0]
        at = F.when(span > 0, F.least(F.greatest((F.col(a).cast("double") - F.col(f"_r{a}")[0]) / span, F.lit(0.0)), F.lit(1.0)) * ((1 << n) - 1)).otherwise(0.0).cast("bigint")
        for bit in range(n):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(at, bit).bitwiseAND(1), bit * len(axes) + k))
    return j.withColumn("_z", z).drop(*[f"_r{a}" for a in axes])


def nearest(queries: DataFrame, points: DataFrame, k: int, *, scope: list[str] = (), qid: str = "query_id", pid: str = "point_id", axes=AXES) -> DataFrame:
    """The k nearest points of each query (ties: smaller id), with ``d2`` and ``rank``.

    Points are sorted along a space-filling curve and cut into blocks of equally many, which are small where points are dense.  A query
    first meets the points of the block at its own place and of the two beside it, and the k-th of them bounds its search: it
    then meets the blocks whose boxes the bound reaches (``boxes.touching``).  So a query meets some blocks, however dense its
    surroundings and however far from them it is.  Of points at one spot the k smallest ids are enough.  Where there are fewer
    than k points, all of them are the nearest; points and queries with a null, NaN or infinite coordinate have no distance and no rows."""
    scope = list(scope)
    at = lambda p: [p + a for a in axes]
    placed = lambda df: reduce(lambda x, a: x & (F.abs(F.col(a).cast("double")) < float("inf")), axes, F.lit(True))
    size = max(BLOCK_POINTS, 2 * k)
    spot = Window.partitionBy(*scope, *at("p")).orderBy(pid)
    p = points.where(placed(points)).select(*scope, pid, *[F.col(a).cast("double").alias("p" + a) for a in axes])
    p = p.withColumn("_r", F.row_number().over(spot)).where(F.col("_r") <= k).drop("_r")
    ranges = p.groupBy(*scope).agg(*[F.percentile_approx("p" + a, F.array(F.lit(0.01), F.lit(0.99)), F.lit(1000)).alias("_rp" + a) for a in axes])
    p = curve_place(p, ranges, scope, at("p"))
    p = numbered(p, [*scope, "_z", *at("p"), pid], "_n").withColumn("_block", F.floor(F.col("_n") / size))
    p = storage.stage(p.drop("_n"), "points")
    ends = [f("p" + a).alias(n + a) for a in axes for n, f in (("_lo", F.min), ("_hi", F.max))]
    blocks = storage.stage(p.groupBy(*scope, "_block").agg(F.min("_z").alias("_z"), *ends), "blocks")

    q = queries.where(placed(queries)).select(*scope, qid, *[F.col(a).cast("double").alias("q" + a) for a in axes])
    q = curve_place(q, ranges.withColumnsRenamed({"_rp" + a: "_rq" + a for a in axes}), scope, at("q"))
    # the last block that begins at or before the query's place, else the first one
    none = F.lit(None)
    u = q.withColumn("_block", none.cast("bigint")).unionByName(blocks.select(*scope, "_z", "_block"), allowMissingColumns=True).withColumn("_is", F.col("_block").isNotNull())
    u = ordered.carry(ordered.dealt(u, scope, ["_z"]), scope, {"_before": (F.max, F.col("_block"))}, {"_after": (F.min, F.col("_block"))})
    w = Window.partitionBy("_part", *scope).orderBy("_z")
    own = F.coalesce(F.max("_block").over(w.rangeBetween(Window.unboundedPreceding, 0)), "_before", F.min("_block").over(Window.partitionBy("_part", *scope)), "_after")
    q = storage.stage(u.withColumn("_own", own).where("NOT _is").select(*scope, qid, *at("q"), F.col("_own").alias("_own")), "queries")

    d2 = squared("q", "p", axes).alias("d2")
    rank = F.row_number().over(Window.partitionBy(*scope, qid).orderBy("d2", pid))
    near = q.withColumn("_block", F.explode(F.array(F.col("_own") - 1, F.col("_own"), F.col("_own") + 1))).join(p, [*scope, "_block"]).select(*scope, qid, *at("q"), pid, d2)
    near = storage.stage(near.withColumn("rank", rank).where(F.col("rank") <= k), "near")
    few = near.groupBy(*scope, qid).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") < k).select(*scope, qid)
    all_found = near.join(few, [*scope, qid]).select(*scope, qid, pid, "d2", "rank")

    bound = near.where(F.col("rank") == k).withColumn("_b2", F.col("d2"))
    reach = F.sqrt("_b2") * (1 + 1e-9)
    asked = bound.select(*scope, qid, *at("q"), "_b2", *[c for a in axes for c in ((F.col("q" + a) - reach).alias("_ql" + a), (F.col("q" + a) + reach).alias("_qh" + a))])
    met = boxes.touching(asked, blocks.drop("_z"), scope, [("_ql" + a, "_qh" + a) for a in axes], [("_lo" + a, "_hi" + a) for a in axes])
    gap = reduce(lambda x, y: x + y, [F.pow(F.greatest(F.col("_lo" + a) - F.col("q" + a), F.col("q" + a) - F.col("_hi" + a), F.lit(0.0)), F.lit(2.0)) for a in axes])
    met = met.where(gap <= F.col("_b2") * (1 + 1e-9)).select(*scope, qid, *at("q"), "_b2", "_block")
    found = met.join(p, [*scope, "_block"]).select(*scope, qid, pid, d2, "_b2").where(F.col("d2") <= F.col("_b2"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k).select(*scope, qid, pid, "d2", "rank")
    return all_found.unionByName(found)


def interpolate(near: DataFrame, features: DataFrame, *, keys: list[str], pid: str = "point_id", value: str = "value", eps: float = 1e-8) -> DataFrame:
    """Inverse-distance weighted mean of the neighbours' values."""
    weight = 1 / (F.sqrt("d2") + eps)
    return near.join(features, pid).groupBy(*keys).agg((F.sum(weight * F.col(value)) / F.sum(weight)).alias(value))


def fill_labels(points: DataFrame, known: DataFrame, *, scope: list[str] = (), label: str = "label") -> DataFrame:
    """Undecided points (null label) take the label of their nearest known point."""
    scope = list(scope)
    open_ = points.where(F.col(label).isNull())
    near = nearest(open_.withColumnRenamed("point_id", "query_id"), known, 1, scope=scope).select(*scope, F.col("query_id"), F.col("point_id").alias("_near"))
    found = near.join(known.select(*scope, F.col("point_id").alias("_near"), F.col(label).alias("_l")), [*scope, "_near"]).select(*scope, F.col("query_id").alias("point_id"), "_l")
    return points.join(found, [*scope, "point_id"], "left").withColumn(label, F.coalesce(label, "_l")).drop("_l")


def voxelize(points: DataFrame, size: float | dict[str, float], *, scope: list[str] = (), values: list[str] = (), id: str = "point_id", mode: str = "mean", axes=AXES, members: str | None = None) -> DataFrame:
    """One row per voxel: its cell, ``n``, each value's mean, sum, first or last (by id) and, in a column named
    ``members``, its points' ids in order (a voxel is a row then, however many points it has)."""
    sizes = size if isinstance(size, dict) else dict.fromkeys(axes, size)
    cells = [F.floor(F.col(a) / sizes[a]).cast("bigint").alias("v" + a) for a in axes]
    how = {"mean": F.avg, "sum": F.sum, "first": lambda c: F.min_by(c, id), "last": lambda c: F.max_by(c, id)}[mode]
    return points.groupBy(*scope, *cells).agg(F.count(F.lit(1)).alias("n"), *[how(v).alias(v) for v in values], *([F.sort_array(F.collect_list(id)).alias(members)] if members else []))


def point_to_voxel(points: DataFrame, size: float, *, scope: list[str] = (), axes=AXES) -> DataFrame:
    """Each point's voxel, numbered densely within its scope in order of cells."""
    cells = [F.floor(F.col(a) / size).cast("bigint").alias("v" + a) for a in axes]
    names = ["v" + a for a in axes]
    p = points.select(*scope, "point_id", *cells)
    cells = p.select(*scope, *names).distinct()
    ids = cells.withColumn("voxel_id", F.row_number().over(Window.partitionBy(*scope).orderBy(*names)) - 1) if scope else numbered(cells, names, "voxel_id")
    return p.join(ids, [*scope, *names]).select(*scope, "point_id", "voxel_id")


#: Groups of more points are sampled by all tasks together, smaller ones by a task each.
ONE_TASK = 1_000_000
#: Rounds after which the points' distances are written.
ROUNDS = 16


def farthest_points(points: DataFrame, keys: list[str], k: int, *, id: str = "point_id", axes=AXES) -> DataFrame:
    """Farthest-point sampling: starts at each group's first point (least id), then takes the point whose
    distance to those taken is largest (ties: the earlier).  Groups of more than ``ONE_TASK`` points stay where they are: in each
    round the tasks' farthest points meet in a grouped minimum, and the winner goes back to all."""
    keys = list(keys)
    n = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = n.where(F.col("_n") > ONE_TASK).drop("_n")
    if large.isEmpty():
        return _farthest_small(points, keys, k, id, axes)
    small = points.join(large, keys, "left_anti") if keys else points.limit(0)
    return _farthest_small(small, keys, k, id, axes).unionByName(_farthest_large(points.join(large, keys) if keys else points, keys, k, id, axes))


def _farthest_large(points: DataFrame, keys: list[str], k: int, id: str, axes) -> DataFrame:
    p = points.select(*keys, id, *[F.col(a).cast("double").alias(a) for a in axes], F.lit(float("inf")).alias("_far"))
    p, out, taken = storage.stage(p, "far"), None, None
    spot = [F.col(a) for a in axes]
    for k_ in range(k):
        if taken is not None:
            d2 = lambda w: reduce(lambda x, y: x + y, [(F.col(a) - w[a]) * (F.col(a) - w[a]) for a in axes])
            near = F.array_min(F.transform("_w", d2))
            now = (p.join(F.broadcast(taken), keys) if keys else p.join(F.broadcast(taken))).withColumn("_far", F.least("_far", near)).drop("_w")
        else:
            now = p
        if k_ and k_ % ROUNDS == 0:
            before, p = p, storage.stage(now, "far")
            storage.release(before)
            now, taken = p, None
        far = F.min(F.struct((-F.col("_far")).alias("f"), F.col(id).alias("i"), *spot)).alias("_b")
        best = storage.stage(now.groupBy(*keys).agg(far, F.count(F.lit(1)).alias("_c")).where(F.col("_c") > k_).select(*keys, "_b"), "winner")
        rows = best.select(*keys, F.col("_b.i").alias(id), F.lit(k_).cast("bigint").alias("rank"))
        out = rows if out is None else out.unionByName(rows)
        one = best.select(*keys, F.array(F.struct(*[F.col(f"_b.{a}").alias(a) for a in axes])).alias("_new"))
        if taken is None:
            taken = one.withColumnRenamed("_new", "_w")
        else:
            both = taken.join(one, keys, "left") if keys else taken.join(one)
            taken = storage.stage(both.select(*keys, F.when(F.col("_new").isNull(), F.col("_w")).otherwise(F.concat("_w", "_new")).alias("_w")), "taken")
    return out


def _farthest_small(points: DataFrame, keys: list[str], k: int, id: str, axes) -> DataFrame:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(id, kind="stable")
        p = g[list(axes)].to_numpy(float)
        far, order, at = np.full(len(p), np.inf), [], 0
        for _ in range(min(k, len(p))):
            order.append(at)
            far = np.minimum(far, ((p - p[at]) ** 2).sum(1))
            at = int(np.argmax(far))
        out = g.iloc[order][[*keys, id]].copy()
        out["rank"] = np.arange(len(order), dtype="int64")
        return out

    types = dict(points.dtypes)
    return points.groupBy(*keys).applyInPandas(run, ", ".join(f"{c} {types[c]}" for c in [*keys, id]) + ", rank bigint")


def boundary(points: DataFrame, radius: float, *, scope: list[str] = (), label: str = "label") -> DataFrame:
    """Whether a point has a neighbour with another label."""
    scope = list(scope)
    lab = points.select(*scope, "point_id", F.col(label).alias("_l"))
    near = within(points.withColumnRenamed("point_id", "query_id"), points, radius, scope=scope)
    x = near.join(lab.withColumnRenamed("point_id", "query_id"), [*scope, "query_id"]).join(lab.withColumnRenamed("_l", "_o"), [*scope, "point_id"])
    return x.groupBy(*scope, "query_id").agg(F.max((F.col("_l") != F.col("_o")).cast("int")).alias("boundary")).withColumnRenamed("query_id", "point_id")


def split_blocks(points: DataFrame, block: float, *, scope: list[str] = (), stride: float | None = None) -> DataFrame:
    """Points with the (closed) square blocks they lie in; one on a border is in both."""
    step = stride or block
    low = lambda a: F.greatest(F.ceil((F.col(a) - block) / step), F.lit(0)).cast("int")
    high = lambda a: F.greatest(F.floor(F.col(a) / step), F.lit(0)).cast("int")
    return points.where((F.col("x") >= 0) & (F.col("y") >= 0)).withColumn("bx", F.explode(F.sequence(low("x"), high("x")))).withColumn("by", F.explode(F.sequence(low("y"), high("y"))))


def stride_of(n: Column) -> Column:
    """The sampling stride of a room of n points."""
    return F.when(n > 1_000_000, 8).when(n >= 600_000, 6).when(n >= 400_000, 2).otherwise(1)


def strided(points: DataFrame, *, scope: list[str], id: str = "point_id", stride=stride_of) -> DataFrame:
    """Every stride-th point of each scope, the stride by the scope's size."""
    n = points.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n"))
    return points.join(n, scope).where(F.pmod(F.col(id), stride(F.col("_n"))) == 0).drop("_n")


def subsample(points: DataFrame, n: int, *, scope: list[str] = (), id: str = "point_id", seed: int = 0) -> DataFrame:
    """At most ``n`` points of each scope, drawn by hash: the same for the same seed, however the data are partitioned."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in (*scope, id)]))
    if not scope:
        return points.withColumn("_h", h).orderBy("_h", id).limit(n).drop("_h")
    w = Window.partitionBy(*scope).orderBy(h, id)
    return points.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def interleave(points: DataFrame, parts: int = 4, id: str = "point_id") -> DataFrame:
    """Points dealt to ``part`` by their id; the union of the parts is the input."""
    return points.withColumn("part", F.pmod(F.col(id), F.lit(parts)).cast("int"))


def instance_info(points: DataFrame, *, scope: list[str] = (), inst: str = "inst", sem: str = "sem") -> DataFrame:
    """Centroid, box, class and size of each instance; labels below zero aren't instances."""
    agg = [f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return points.where(F.col(inst) >= 0).groupBy(*scope, inst).agg(F.min(sem).alias(sem), F.count(F.lit(1)).alias("n"), *agg)


def sample_uncovered(seeds: DataFrame, cover, sizes: list[int], *, id: str = "point_id") -> DataFrame:
    """Rounds of sampling among what earlier rounds have not covered.  cover(sample) returns the ids
    that a sample covers; a round takes the first ``size`` remaining ids."""
    left, out = seeds, None
    for k, size in enumerate(sizes):
        part = left.orderBy(id).limit(size).withColumn("round", F.lit(k))
        out = part if out is None else out.unionByName(part)
        left = left.join(cover(part), id, "left_anti")
    return out


def grid_points(per_side: int) -> Column:
    """Centres of an n x n grid on the unit square, as an array of (x, y)."""
    half = 1 / (2 * per_side)
    axis = F.sequence(F.lit(0), F.lit(per_side - 1))
    return F.flatten(F.transform(axis, lambda j: F.transform(axis, lambda i: F.struct((i / per_side + half).alias("x"), (j / per_side + half).alias("y")))))


def crop_boxes(images: DataFrame, layers: int, overlap: float) -> DataFrame:
    """Crops (x1, y1, x2, y2) of images (width, height): layer i cuts each side into 2^i crops of equal size that share
    ``overlap`` * 2 / 2^i of the shorter side; layer 0 is the whole image."""
    side = F.pow(F.lit(2), F.col("layer")).cast("int")
    shared = F.floor(F.lit(overlap) * F.least("width", "height") * 2 / side)
    size = lambda full: F.ceil((shared * (side - 1) + F.col(full)) / side)
    rows = images.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(layers))))
    rows = rows.withColumn("_w", size("width")).withColumn("_h", size("height")).withColumn("_s", shared).withColumn("_i", F.sequence(F.lit(0), side - 1))
    rows = rows.withColumn("_x", F.explode("_i")).withColumn("_y", F.explode("_i"))
    x, y = F.col("_x") * (F.col("_w") - F.col("_s")), F.col("_y") * (F.col("_h") - F.col("_s"))
    box = {"x1": x, "y1": y, "x2": F.least(x + F.col("_w"), F.col("width")), "y2": F.least(y + F.col("_h"), F.col("height"))}
    return rows.select(*images.columns, "layer", *[c.cast("int").alias(n) for n, c in box.items()])
