"""Connected components of an edge table.

Alternating large-star and small-star rounds (Kiveris et al., 2014): every node hands its larger
neighbours, then its smaller ones, the least node it knows.  Each round is grouped minima and a join
back; stars of any size are fine, because hot centres are broadcast.  Each round's edges are
written to the shared folder, so plans don't grow and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavane import storage
from stratavane.operators.skew import meet_groups


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r.n, r.x


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", vertices: DataFrame | None = None) -> DataFrame:
    """``node`` and ``component``, its component's least node, for every node of an edge and, if
    ``vertices`` (one column) is given, for those without edges too.  Directions, repeated edges,
    loops and edges with a null end don't matter."""
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b")
    loops = edges.where(F.col(a) == F.col(b)).select(F.col(a).alias("node"))
    e = storage.stage(e.distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n"))
        large = meet_groups(both, least, ["a"], "_n", 2 * mark[0]).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        large = storage.stage(large, "edges")
        n = large.count()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n"))
        small = meet_groups(large, least, ["a"], "_n", n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = storage.stage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        before, mark = mark, _mark(e)
        if before == mark:
            break
    out = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = out.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    rest = loops if vertices is None else loops.unionByName(vertices.toDF("node"))
    rest = rest.where("node IS NOT NULL").distinct().join(out.select("node"), "node", "left_anti")
    return out.unionByName(rest.withColumn("component", F.col("node")))
