"""Training-time augmentation of point clouds: elastic distortion, rotation and flips, crops.

All randomness is hashed from a seed, the scene and what it is for, so results depend neither on partitions nor on runs.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratavane import storage

AXES = ("x", "y", "z")
#: The turn about the vertical axis where no random one is asked for.
SLIGHT_TURN = 0.35 * math.pi


def uniform(*of) -> Column:
    """A number strictly between 0 and 1 from the first 48 bits of the parts' MD5 digest."""
    digits = F.substring(F.md5(F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(str(p))).cast("string") for p in of])), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def normal(*of) -> Column:
    """A standard normal number, from two uniform ones."""
    return F.sqrt(-2 * F.log(uniform(*of, "r"))) * F.cos(2 * math.pi * uniform(*of, "a"))


def noise_lattice(points: DataFrame, gran: float, scope: list[str], seed: int) -> DataFrame:
    """scope, the number of lattice points along each axis (bx, by, bz), a lattice point (i0, i1, i2) and its smoothed noise n0, n1, n2.  Points are 2 * gran
    apart, centred on the origin; smoothing means over three neighbours along each axis in turn, twice, with zero outside."""
    b = points.groupBy(*scope).agg(*[(F.floor(F.floor(F.max(F.abs(a))) / gran) + 3).cast("int").alias("b" + a) for a in AXES])
    grid = b
    for k, a in enumerate(AXES):
        grid = grid.withColumn(f"i{k}", F.explode(F.sequence(F.lit(0), F.col("b" + a) - 1)))
    place = [*[F.col(c) for c in scope], F.col("i0"), F.col("i1"), F.col("i2")]
    grid = grid.select(*scope, *["b" + a for a in AXES], "i0", "i1", "i2", *[normal(seed, *place, c).alias(f"n{c}") for c in range(3)])
    for axis in (0, 1, 2, 0, 1, 2):
        line = Window.partitionBy(*scope, *[f"i{k}" for k in range(3) if k != axis]).orderBy(f"i{axis}").rowsBetween(-1, 1)
        grid = grid.select(*scope, *["b" + a for a in AXES], "i0", "i1", "i2", *[(F.sum(f"n{c}").over(line) / 3).alias(f"n{c}") for c in range(3)])
    return grid


def elastic(points: DataFrame, gran: float, mag: float, *, scope: list[str] = (), seed: int = 0) -> DataFrame:
    """Points moved by ``mag`` times smooth noise, interpolated between the eight lattice points around each.  A lattice cell carries its
    corners, so a point meets one row."""
    scope = list(scope)
    lattice = storage.stage(noise_lattice(points, gran, scope, seed), "lattice")
    corner = F.explode(F.array(*[F.struct(*[F.lit(q >> k & 1).alias(f"d{k}") for k in range(3)], F.lit(q).alias("q")) for q in range(8)]))
    part = lattice.withColumn("_c", corner).select(*scope, *["b" + a for a in AXES], *[(F.col(f"i{k}") - F.col(f"_c.d{k}")).alias(f"i{k}") for k in range(3)], F.struct("_c.q", "n0", "n1", "n2").alias("_n"))
    cells = part.groupBy(*scope, *["b" + a for a in AXES], "i0", "i1", "i2").agg(F.sort_array(F.collect_list("_n")).alias("_n")).where(F.size("_n") == 8)
    sizes = lattice.select(*scope, *["b" + a for a in AXES]).distinct()
    p = points.join(sizes, scope) if scope else points.join(F.broadcast(sizes))
    at = [(F.col(a) + (F.col("b" + a) - 1) * gran) / (2 * gran) for a in AXES]
    p = p.withColumns({f"i{k}": F.least(F.greatest(F.floor(t), F.lit(0)), F.col("b" + a) - 2).cast("int") for k, (a, t) in enumerate(zip(AXES, at, strict=True))})
    j = p.join(cells.drop(*["b" + a for a in AXES]), [*scope, "i0", "i1", "i2"])
    share = [t - F.col(f"i{k}") for k, t in enumerate(at)]
    weight = [reduce(lambda x, y: x * y, [share[k] if q >> k & 1 else 1 - share[k] for k in range(3)]) for q in range(8)]
    moved = {a: F.col(a) + mag * reduce(lambda x, y: x + y, [weight[q] * F.get("_n", F.lit(q))[f"n{c}"] for q in range(8)]) for c, a in enumerate(AXES)}
    return j.withColumns(moved).select(*points.columns)


def turned(points: DataFrame, *, scope: list[str] = (), seed: int = 0, jitter: bool = False, flip: bool = False, rotate: bool = False, probability: float = 1.0) -> DataFrame:
    """Points times a matrix of their scene: the identity, with ``jitter`` plus a tenth of normal noise, times a turn about the vertical axis (a
    random one with ``rotate``), and with ``flip`` mirrored in x and y by even chances.  Each happens with the ``probability``."""
    key = [seed, *[F.col(c) for c in scope]]
    chance = lambda what: uniform(*key, what) < probability
    m = [[F.lit(float(r == c)) + (F.when(chance("jitter"), normal(*key, "m", r, c) * 0.1).otherwise(0.0) if jitter else F.lit(0.0)) for c in range(3)] for r in range(3)]
    theta = F.when(chance("rotate"), uniform(*key, "theta") * 2 * math.pi).otherwise(F.lit(SLIGHT_TURN)) if rotate else F.lit(SLIGHT_TURN)
    turn = [[F.cos(theta), F.sin(theta), F.lit(0.0)], [-F.sin(theta), F.cos(theta), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)]]
    dot = lambda row, col: reduce(lambda x, y: x + y, [a * b for a, b in zip(row, col, strict=True)])
    whole = [[dot(m[r], [turn[k][c] for k in range(3)]) for c in range(3)] for r in range(3)]
    out = [dot([F.col(a) for a in AXES], [whole[r][c] for r in range(3)]) for c in range(3)]
    if flip:
        out = [F.when(uniform(*key, "flip", c) < 0.5, -v).otherwise(v) if c < 2 else v for c, v in enumerate(out)]
    return points.withColumns(dict(zip(AXES, out, strict=True)))


def cropped(points: DataFrame, side: float, most: int, *, scope: list[str] = (), step: float = 32, seed: int = 0) -> DataFrame:
    """The points of each scene that a window holds, moved by its offset.  A scene of more than ``most`` points (none below zero) is moved at random within
    what it exceeds the window by and cut to the window, which shrinks in x and y by ``step`` (twice that above a million
    points) until few enough are left.  Rounds are counts per scene."""
    scope = list(scope)
    span = [c for a in AXES for c in ((F.max(a) - F.min(a)).alias("_r" + a),)]
    rooms = points.groupBy(*scope).agg(*span, F.count(F.lit(1)).alias("_n")).withColumns({"_side": F.lit(float(side)), "_cut": F.lit(None).cast("double")} | {"_o" + a: F.lit(0.0) for a in AXES})
    rooms, at = storage.stage(rooms, "rooms"), 0
    inside = lambda limit_xy: reduce(lambda x, y: x & y, [(F.col(a) + F.col("_o" + a) >= 0) & (F.col(a) + F.col("_o" + a) < (limit_xy if a != "z" else F.lit(float(side)))) for a in AXES])
    meet = lambda df, r: df.join(r, scope) if scope else df.join(F.broadcast(r))
    while not rooms.where((F.col("_n") > most) & (F.col("_side") > 0)).isEmpty():
        open_ = rooms.where((F.col("_n") > most) & (F.col("_side") > 0))
        free = {"_o" + a: F.least((F.col("_side") if a != "z" else F.lit(float(side))) - F.col("_r" + a) + 0.001, F.lit(0.0)) * uniform(seed, *[F.col(c) for c in scope], at, a) for a in AXES}
        next_ = open_.withColumns(free).withColumn("_cut", F.col("_side")).withColumn("_side", F.col("_side") - step * F.when(F.col("_n") > 1_000_000, 2).otherwise(1)).drop("_n")
        held = meet(points.select(*scope, *AXES), next_).where(inside(F.col("_cut"))).groupBy(*scope).agg(F.count(F.lit(1)).alias("_n"))
        next_ = next_.join(held, scope, "left") if scope else next_.join(held)
        rest = rooms.where((F.col("_n") <= most) | (F.col("_side") <= 0))
        rooms, at = storage.stage(rest.unionByName(next_.withColumn("_n", F.coalesce("_n", F.lit(0)))), "rooms"), at + 1
    j = meet(points, rooms.drop("_n", "_side"))
    j = j.where(F.col("_cut").isNull() | inside(F.col("_cut")))
    return j.withColumns({a: F.col(a) + F.col("_o" + a) for a in AXES}).select(*points.columns)
