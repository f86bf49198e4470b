"""Ordered windows in two levels, so that one key may hold any share of the rows.

Rows are dealt out by range of (key, order), which cuts a long key into parts that many tasks hold.  A window is
computed within each part, and what the earlier (or later) parts of the same key add is carried over.  A part begins
within at most one key and ends within at most one, so there are at most two carried rows per part: they are broadcast.
Rows that are equal in key and order are never parted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratavane import storage

#: Rows of a block of a framed window, unless the frame is longer.
BLOCK_ROWS = 10_000


def dealt(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The rows, written in range order, with the number of their part in ``_part``."""
    return storage.stage(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "dealt")


def carry(parts: DataFrame, keys: list[str], before: dict[str, tuple[Callable, Column]] = {}, after: dict[str, tuple[Callable, Column]] = {}) -> DataFrame:  # noqa: B006
    """The rows of ``parts`` with, in each named column, the aggregate (``F.sum``, ``F.max``, ``F.min``) of a column over the earlier
    (``before``) or later (``after``) parts of the row's key; null where there are none."""
    each = parts.groupBy("_part", *keys).agg(*[f(c).alias(n) for n, (f, c) in {**before, **after}.items()])
    w = Window.partitionBy(*keys).orderBy("_part")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    sums = [f(n).over(back).alias(n) for n, (f, _) in before.items()] + [f(n).over(ahead).alias(n) for n, (f, _) in after.items()]
    names = {k: f"_carry_key{i}" for i, k in enumerate(keys)}
    found = each.select(F.col("_part").alias("_carry_part"), *[F.col(k).alias(names[k]) for k in keys], *sums, F.count(F.lit(1)).over(back).alias("_carry_back"), F.count(F.lit(1)).over(ahead).alias("_carry_ahead"))
    found = found.where("_carry_back > 0 OR _carry_ahead > 0").drop("_carry_back", "_carry_ahead")
    same = reduce(lambda on, k: on & F.col(k).eqNullSafe(F.col(names[k])), keys, F.col("_part") == F.col("_carry_part"))
    return parts.join(F.broadcast(found), same, "left").drop("_carry_part", *names.values())


def running(rows: DataFrame, keys: list[str], order: list, totals: dict[str, Column]) -> DataFrame:
    """The rows with, in each named column, the sum of a column over the key's rows up to and with this one.  ``order`` should
    break ties; rows that are equal in it are summed one after another in no defined order."""
    own = carry(dealt(rows, keys, order), keys, {f"_c{i}": (F.sum, c) for i, c in enumerate(totals.values())})
    w = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = [(F.coalesce(F.sum(c).over(w), F.lit(0)) + F.coalesce(F.col(f"_c{i}"), F.lit(0))).alias(n) for i, (n, c) in enumerate(totals.items())]
    return own.select(*[F.col(f"`{c}`") for c in rows.columns if c not in totals], *sums)


def framed(rows: DataFrame, keys: list[str], place: str, frame: int, values: dict[str, Column]) -> DataFrame:
    """The rows with aggregates over the last ``frame`` rows of their key, this one included.  ``place`` numbers a key's rows from 1 without
    gaps; blocks of consecutive places, each with the rows that its first frames reach back to, are windows of their own."""
    size = max(BLOCK_ROWS, frame)
    block = lambda n: F.floor(n / size).cast("bigint")
    there = rows.withColumn("_block", F.explode(F.array_distinct(F.array(block(F.col(place)), block(F.col(place) + frame - 1)))))
    w = Window.partitionBy(*keys, "_block").orderBy(place).rowsBetween(1 - frame, 0)
    kept = F.col("_block") == block(F.col(place))
    return there.select(*[F.col(f"`{c}`") for c in rows.columns], kept.alias("_kept"), *[c.over(w).alias(n) for n, c in values.items()]).where("_kept").drop("_kept")
