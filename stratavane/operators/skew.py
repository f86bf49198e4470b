"""Giving the members of groups something that is known of their group, without gathering the
members of a hot group in one task, and numbering rows without a single task for all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratavane import storage

#: A group is hot if it has more than one in so many rows, so there are fewer hot groups than this.
HOT_GROUPS = 1000


def meet_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, n_rows: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has one row per value of ``on`` and the group's
    number of rows in ``size``.  Groups with more than ``n_rows`` / HOT_GROUPS rows, of which there
    can't be more than HOT_GROUPS, are broadcast; the rows of all others are shuffled to theirs.
    Rows with a null in ``on`` have no group."""
    hot = F.col(size) * HOT_GROUPS > n_rows
    known = rows.join(F.broadcast(groups.where(hot)), on, "left")
    rest = known.where(F.col(size).isNull()).select(*rows.columns).join(groups.where(~hot), on)
    return known.where(F.col(size).isNotNull()).unionByName(rest)


def numbered(rows: DataFrame, order: list[str], to: str) -> DataFrame:
    """Distinct rows numbered from 0 in a column ``to`` in ascending order.  They are dealt out by range, numbered within their
    part, and each part begins where those before it end; only one count per part goes through one task."""
    dealt = storage.stage(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    first = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.join(F.broadcast(first), "_part").withColumn(to, (F.col("_first") + own).cast("bigint")).drop("_part", "_first")
