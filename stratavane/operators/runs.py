"""Set operations on masks that are stored as runs, without going back to their elements.

A run is a row (keys, ``s``, ``e``): elements s, s + 1, ..., e - 1.  Operations sweep over the sorted ends of runs: at each end the number
of runs of either side that are open changes, and where what is to be kept begins or ends, a run of the result does.  A mask's
sweep may go through many tasks (``ordered``).  Input runs may overlap or touch each other; results are separate and sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratavane import storage
from stratavane.operators import boxes, ordered

#: What is kept of two masks, by whether an element is in the first and in the second.
KEPT = {"union": lambda a, b: a | b, "intersection": lambda a, b: a & b, "difference": lambda a, b: a & ~b, "symmetric": lambda a, b: a != b}


def runs(df: DataFrame, keys: list[str], counts: str = "counts") -> DataFrame:
    """The runs of encoded masks (pairs of a 1-based start and a length, flattened)."""
    pair = F.transform(F.sequence(F.lit(0), (F.size(counts) / 2).cast("int") - 1), lambda i: F.struct(F.get(F.col(counts), i * 2).cast("bigint").alias("s"), F.get(F.col(counts), i * 2 + 1).cast("bigint").alias("n")))
    r = df.where(F.size(counts) > 0).select(*keys, F.explode(pair).alias("_r")).where("_r.n > 0")
    return r.select(*keys, (F.col("_r.s") - 1).alias("s"), (F.col("_r.s") - 1 + F.col("_r.n")).alias("e"))


def encode(separate: DataFrame, keys: list[str], counts: str = "counts") -> DataFrame:
    """Separate runs as encoded masks, the form that ``runs`` reads."""
    lists = separate.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("_r"))
    return lists.select(*keys, F.flatten(F.transform("_r", lambda r: F.array((r["s"] + 1).cast("int"), (r["e"] - r["s"]).cast("int")))).alias(counts))


def _sweep(events: DataFrame, keys: list[str], keep) -> DataFrame:
    """events: keys, at, a, b (changes of the numbers of open runs); the runs where ``keep`` holds."""
    each = events.groupBy(*keys, "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a <> 0 OR b <> 0")
    d = ordered.carry(ordered.dealt(each, keys, ["at"]), keys, {"_a": (F.sum, F.col("a")), "_b": (F.sum, F.col("b"))})
    w = Window.partitionBy("_part", *keys).orderBy("at")
    up = lambda c: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.col(f"_{c}"), F.lit(0))
    d = d.select("_part", *keys, "at", "a", "b", up("a").alias("_na"), up("b").alias("_nb"))
    now, before = keep(F.col("_na") > 0, F.col("_nb") > 0), keep(F.col("_na") - F.col("a") > 0, F.col("_nb") - F.col("b") > 0)
    turns = storage.stage(d.where(now != before).select("_part", *keys, "at", now.alias("_on")), "turns")
    off: Column = F.when(~F.col("_on"), F.col("at"))
    turns = ordered.carry(turns, keys, {}, {"_later": (F.min, off)})
    back = Window.partitionBy("_part", *keys).orderBy(F.desc("at"))  # frames that shrink are computed anew for each row
    end = F.coalesce(F.min(off).over(back.rowsBetween(Window.unboundedPreceding, -1)), "_later")
    return turns.withColumn("e", end).where("_on").select(*keys, F.col("at").alias("s"), "e")


def combine(kind: str, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Union, intersection, difference or symmetric difference of the masks of equal keys; a mask that one side lacks is empty there."""
    zero = F.lit(0).cast("bigint")

    def ends(df: DataFrame, first: bool) -> DataFrame:
        step = lambda n: [F.lit(n).cast("bigint"), zero] if first else [zero, F.lit(n).cast("bigint")]
        ok = df.where("s < e")
        return ok.select(*keys, F.col("s").alias("at"), *[c.alias(n) for c, n in zip(step(1), "ab", strict=True)]).unionByName(ok.select(*keys, F.col("e").alias("at"), *[c.alias(n) for c, n in zip(step(-1), "ab", strict=True)]))

    return _sweep(ends(left, True).unionByName(ends(right, False)), keys, KEPT[kind])


def separate(df: DataFrame, keys: list[str]) -> DataFrame:
    """Runs that may overlap or touch, as separate ones."""
    return combine("union", df, df.limit(0), keys)


def area(separate: DataFrame, keys: list[str]) -> DataFrame:
    """The number of elements of each mask."""
    return separate.groupBy(*keys).agg(F.sum(F.col("e") - F.col("s")).alias("n"))


def overlaps(separate: DataFrame, *, mask: str = "inst_id", scope: list[str] = ()) -> DataFrame:
    """Pairs of masks a < b that share elements, with the number (``inter``), both sizes and the IoU, from the runs that meet."""
    scope = list(scope)
    side = lambda p: separate.select(*scope, F.col(mask).alias(p), F.col("s").alias(f"_{p}s"), (F.col("e") - 1).alias(f"_{p}e"))
    met = boxes.touching(side("a"), side("b"), scope, [("_as", "_ae")], [("_bs", "_be")], same=True).where("a < b")
    pair = met.groupBy(*scope, "a", "b").agg(F.sum(F.least("_ae", "_be") - F.greatest("_as", "_bs") + 1).alias("inter"))
    n = area(separate, [*scope, mask])
    out = pair.join(n.toDF(*scope, "a", "size_a"), [*scope, "a"]).join(n.toDF(*scope, "b", "size_b"), [*scope, "b"])
    return out.withColumn("iou", F.col("inter") / (F.col("size_a") + F.col("size_b") - F.col("inter")))
