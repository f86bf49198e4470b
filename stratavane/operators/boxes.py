"""Joins of boxes that touch, over grids whose cells fit the boxes.

A box's level is the power of two that its longest side fits into, and cells of a level are as wide, so a box lies in at most two
of them along each axis.  Two boxes meet in the cells of the larger one's level; boxes are dealt to the cells of their
own level and of the levels at which the other side has larger ones.  A pair counts only in the cell that holds the lowest
corner of what the two share, so it is found once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows with equal boxes in one list, at most about.
LIST_ROWS = 1024
#: Sides below two to this power count as that long.
LEAST_LEVEL = -20
#: Where no key has more boxes on a side, those of a key are simply compared.
FEW = 32


def touching(left: DataFrame, right: DataFrame, keys: list[str], left_box: list[tuple[str, str]], right_box: list[tuple[str, str]], *, same: bool = False) -> DataFrame:
    """Pairs of rows that agree in ``keys`` and whose boxes share at least a point.  A box is a list of (low, high) columns, one pair for each
    axis; the two sides' other columns must have different names.  With ``same`` both are one table, and each row meets itself, too.
    Boxes with a null, NaN or infinite end, or with a low end above the high one, touch nothing."""
    axes = range(len(left_box))

    def levelled(df: DataFrame, box: list[tuple[str, str]], side: str) -> DataFrame:
        ends = [(F.col(f"`{lo}`").cast("double"), F.col(f"`{hi}`").cast("double")) for lo, hi in box]
        proper = reduce(lambda x, e: x & (e[0] <= e[1]) & (e[0] > float("-inf")) & (e[1] < float("inf")), ends, F.lit(True))
        level = F.ceil(F.log2(F.greatest(*[hi - lo for lo, hi in ends], F.lit(2.0**LEAST_LEVEL)))).cast("int")
        named = [c for k, (lo, hi) in enumerate(ends) for c in (lo.alias(f"_{side}l{k}"), hi.alias(f"_{side}h{k}"))]
        return df.where(proper).select("*", *named, level.alias(f"_{side}v"))

    a, b = levelled(left, left_box, "a"), levelled(right, right_box, "b")
    low = lambda k: F.greatest(f"_al{k}", f"_bl{k}")
    touch = reduce(lambda x, k: x & (low(k) <= F.least(f"_ah{k}", f"_bh{k}")), axes, F.lit(True))
    kept = [F.col(f"`{c}`") for c in dict.fromkeys([*keys, *left.columns, *right.columns])]
    most = lambda df: (df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0)
    if keys and most(a) <= FEW and (same or most(b) <= FEW):
        return a.join(b, keys).where(touch).select(*kept)
    levels = lambda df, side: sorted(r[0] for r in df.select(f"_{side}v").distinct().collect())  # noqa: E731  some tens at most
    of_a = levels(a, "a")
    of_b = of_a if same else levels(b, "b")

    def dealt(df: DataFrame, side: str, other: list[int]) -> DataFrame:
        own = F.col(f"_{side}v")
        larger = F.filter(F.array(*map(F.lit, other)).cast("array<int>"), lambda v: v > own)
        df = df.withColumn("_v", F.explode(F.concat(F.array(own), larger)))
        for k in axes:
            cell = lambda end, k=k: F.floor(F.col(f"_{side}{end}{k}") / F.pow(F.lit(2.0), F.col("_v"))).cast("bigint")
            df = df.withColumn(f"_c{k}", F.explode(F.sequence(cell("l"), cell("h"))))
        return df

    cells = ["_v", *[f"_c{k}" for k in axes]]
    # a number of parts of its own, for few bytes may make many pairs
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    apart = lambda df: df.repartition(parts, *[F.col(f"`{c}`") for c in [*keys, *cells]])
    meet = apart(dealt(a, "a", of_b)).join(apart(dealt(b, "b", of_a)), [*keys, *cells])
    once: Column = touch & (F.col("_v") == F.greatest("_av", "_bv"))
    for k in axes:
        once = once & (F.floor(low(k) / F.pow(F.lit(2.0), F.col("_v"))) == F.col(f"_c{k}"))
    return meet.where(once).select(*kept)


def alike(df: DataFrame, keys: list[str], id: str, to: str) -> DataFrame:
    """Rows that agree in ``keys`` (their box among them) as one, with their ids as the array ``to``; many are dealt to lists of about ``LIST_ROWS``."""
    n = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).cast("int").alias("_n")).where("_n > 1")
    same = reduce(lambda x, c: x & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")), keys, F.lit(True))
    j = df.alias("x").join(F.broadcast(n.alias("y")), same, "left").select("x.*", F.coalesce("_n", F.lit(1)).alias("_n")) if n.count() else df.withColumn("_n", F.lit(1))
    part = F.pmod(F.xxhash64(id), F.col("_n"))
    return j.groupBy(*keys, part.alias("_part")).agg(F.collect_list(id).alias(to)).drop("_part")
