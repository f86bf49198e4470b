"""Vectors as array columns: products, norms, similarity, softmax, sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x)))


def normalize(a: Column, eps: float = 1e-12) -> Column:
    """The vector at unit length; divides by at least eps."""
    n = F.greatest(norm(a), F.lit(eps))
    return F.transform(a, lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    d = norm(a) * norm(b)
    return F.when(d == 0, F.lit(0.0)).otherwise(dot(a, b) / d)


def squared_distance(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used (an expression within a lambda is computed for each element)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(a: Column, scale: float = 1.0) -> Column:
    """Softmax of scale * a, shifted by the maximum."""
    share = lambda e: once(_total(e), lambda total: F.transform(e, lambda x: x / total))
    return once(a, lambda a: once(F.array_max(a), lambda top: once(F.transform(a, lambda x: F.exp((x - top) * scale)), share)))


def positional_encoding(x: Column, levels: int) -> Column:
    """(x, sin 2^k x, cos 2^k x) for k below levels, over an array of coordinates."""
    waves = [f for k in range(levels) for f in (lambda v, k=k: F.sin(v * 2.0**k), lambda v, k=k: F.cos(v * 2.0**k))]
    out = [x]
    for wave in waves:
        out.append(F.transform(x, _unary(wave)))
    return F.flatten(F.array(*out))


def _unary(f):
    return lambda v: f(v)


def sum_vectors(df: DataFrame, keys: list[str], vector: str, weight: Column | None = None, mean: bool = False) -> DataFrame:
    """The (weighted) sum or mean of the vectors of each key, in ``vector``.

    Each component is one row of a partial aggregate, so at most components x keys rows per task are
    shuffled whatever the group's size, and no group is gathered."""
    value = F.col("_v").cast("double") * (weight if weight is not None else F.lit(1.0))
    parts = df.select(*keys, *([weight.alias("_w")] if weight is not None else []), F.posexplode(vector).alias("_i", "_v"))
    if weight is not None:
        value = F.col("_v").cast("double") * F.col("_w")
    total = F.avg(value) if mean else F.sum(value)
    per = parts.groupBy(*keys, "_i").agg(total.alias("_s"))
    return per.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s"))), lambda x: x["_s"]).alias(vector))
