"""Overlap of masks on elements that many of them share, by bitmaps.

Where an element belongs to m masks, an equi-join on it makes m * m rows.  Elements that many masks share are numbered and cut into
blocks of up to ``WORDS`` * 64; a mask's part of a block is an array of longs, and two masks are compared once per block, with ``&`` and
``bit_count``.  Weights are bit planes of a block: a plane holds the elements whose weight has that bit.  A block's masks
are dealt to tiles of about ``TILE`` masks, each of them one row; pairs of tiles are dealt by their numbers, then joined to the tiles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavane import storage
from stratavane.operators.skew import numbered

#: Longs of a block, and with weights longs times planes.
WORDS, PLANE_WORDS = 8, 16
TILE = 128
#: Masks' parts of blocks that are broadcast (some 100 bytes each); of more, the tiles are shuffled.
BROADCAST_PARTS = 100_000
#: An element goes by bitmap if more masks share it than the first number, or at least the second and one in ``SHARE`` of its scope's.
MANY, SOME, SHARE = 1024, 64, 16


def shared_elements(rows: DataFrame, scope: list[str], mask: str, element: str) -> DataFrame:
    """The elements (scope, element) that many masks share; rows: distinct (scope, mask, element)."""
    n = rows.groupBy(*scope, element).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= SOME)
    m = rows.select(*scope, mask).distinct().groupBy(*scope).agg(F.count(F.lit(1)).alias("_m"))
    j = n.join(m, scope) if scope else n.join(F.broadcast(m))
    return j.where((F.col("_n") > MANY) | (F.col("_n") * SHARE >= F.col("_m"))).select(*scope, element)


def _placed(j: DataFrame, words: int, *columns: str) -> DataFrame:
    """Rows with the block, word and bit of their element's number ``_at``."""
    at = F.col("_at")
    return j.select(*columns, F.floor(at / (64 * words)).alias("_block"), F.floor(at % (64 * words) / 64).alias("_word"), (at % 64).cast("int").alias("_bit"))


def _bits(words: int, *, where=lambda: F.lit(True)):
    return [F.coalesce(F.bit_or(F.when((F.col("_word") == k) & where(), F.expr("shiftleft(1L, _bit)"))), F.lit(0).cast("bigint")) for k in range(words)]


def pairs(left: DataFrame, right: DataFrame | None, places: DataFrame, scope: list[str], element: str, weights: DataFrame | None = None, weight: str = "size") -> DataFrame:
    """scope, a, b and their shared elements' number or weight (``inter``), on the elements of ``places``, for pairs that share some.  left: scope, a,
    element; right: scope, b, element, or none for pairs a < b of the left.  Weights are whole numbers, not below zero."""
    same, keys = right is None, [*scope, "_block"]
    places = storage.stage(numbered(places, [*scope, element], "_at"), "places")
    words, planes = min(WORDS, -(-places.count() // 64)), 0
    if weights is not None:
        v = storage.stage(places.join(weights, [*[c for c in scope if c in weights.columns], element]).select(*scope, "_at", F.col(weight).cast("bigint").alias("_v")), "weights")
        planes = int(v.agg(F.max("_v")).first()[0] or 0).bit_length()
        words = max(1, min(words, PLANE_WORDS // max(1, planes)))
        has = lambda p: lambda: F.shiftright("_v", p).bitwiseAND(1) == 1
        of_block = _placed(v, words, *scope, "_v").groupBy(*keys).agg(F.array(*[x for p in range(planes) for x in _bits(words, where=has(p))]).cast("array<bigint>").alias("_planes"))

    def packed(df: DataFrame, to: str) -> DataFrame:
        d = _placed(df.join(places, [*scope, element]), words, *scope, to)
        return storage.stage(d.groupBy(*keys, to).agg(F.array(*_bits(words)).alias(f"_w{to}")), "bitmaps")

    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")

    def tiles(df: DataFrame, to: str, number: str) -> DataFrame:
        """A tile's masks as one row, which every tile that it meets reads: masks themselves are never copied for each of those."""
        sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("_g"))
        own = df.join(sizes, keys).withColumn(number, place(to, "_g"))
        return own.groupBy(*keys, number).agg(F.collect_list(F.struct(F.col(to), F.col(f"_w{to}"))).alias(f"_{to}s"))

    a = packed(left, "a")
    b = a if same else packed(right, "b")
    l = storage.stage(tiles(a, "a", "_i"), "tiles")
    r = l.select(*keys, F.col("_i").alias("_j"), F.col("_as").alias("_bs")) if same else storage.stage(tiles(b, "b", "_j"), "tiles")
    # pairs of tiles' numbers are dealt before they learn their tiles' masks; were the side left open, the pairs might be broadcast to few tasks
    few = lambda masks, df: F.broadcast(df) if masks.count() <= BROADCAST_PARTS else df.hint("merge")
    work = l.select(*keys, "_i").join(r.select(*keys, "_j"), keys)
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = (work.where("_i <= _j") if same else work).repartition(parts, *keys, "_i", "_j")
    j = work.join(few(a, l.join(of_block, keys) if weights is not None else l), [*keys, "_i"]).join(few(b, r), [*keys, "_j"])
    known = [*scope, "_i", "_j", *(["_planes"] if weights is not None else [])]
    j = j.select(*known, F.explode("_as").alias("_l"), "_bs").select(*known, "_l", F.explode("_bs").alias("_r"))
    one, two = F.col("_l.a"), F.col("_r").getField("a" if same else "b")
    if same:  # of two tiles each pair stands once, whichever mask is the smaller; within a tile it stands twice
        j = j.where((one < two) | ((F.col("_i") < F.col("_j")) & (two < one)))
        one, two = F.when(one < two, one).otherwise(two), F.when(one < two, two).otherwise(one)
    j = j.select(*known, one.alias("a"), two.alias("b"), F.col("_l._wa").alias("_wa"), F.col("_r").getField("_wa" if same else "_wb").alias("_wb"))
    both = [F.get("_wa", F.lit(k)).bitwiseAND(F.get("_wb", F.lit(k))) for k in range(words)]
    if weights is None:
        terms = [F.bit_count(x).cast("bigint") for x in both]
    else:
        terms = [F.bit_count(x.bitwiseAND(F.get("_planes", F.lit(p * words + k)))).cast("bigint") * (1 << p) for k, x in enumerate(both) for p in range(planes)]
    some = reduce(lambda x, y: x | y, [x != 0 for x in both])
    inter = reduce(lambda x, y: x + y, terms, F.lit(0).cast("bigint"))
    return j.where(some).select(*scope, "a", "b", inter.alias("inter"))
