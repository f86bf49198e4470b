"""Matching rows across tables: nearest in time, optimal assignment."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratavane.operators import ordered

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package


def asof_nearest(left: DataFrame, right: DataFrame, *, by: list[str] = (), time: str = "t", left_id: str = "id", right_id: str = "id", tolerance: int, value: str = "match_id") -> DataFrame:
    """Each left row's nearest right row in time within its keys; times are integers (microseconds).

    Ties in distance go to the later row, ties in time to the smaller id; a distance of ``tolerance`` or
    more is no match.  Both sides are sorted together, which is linear in rows where a join on an interval would compare
    pairs; a key's time line may go through many tasks (``ordered``)."""
    by = list(by)
    null = F.lit(None).cast(dict(right.dtypes)[right_id])
    l = left.select(*by, F.col(time).alias("_t"), F.col(left_id).alias("_l"), null.alias("_r"))
    r = right.select(*by, F.col(time).alias("_t"), F.lit(None).cast(dict(left.dtypes)[left_id]).alias("_l"), F.col(right_id).alias("_r"))
    at = F.when(F.col("_r").isNotNull(), F.struct(F.col("_t").alias("t"), (-F.col("_r")).alias("n")))
    to = F.when(F.col("_r").isNotNull(), F.struct(F.col("_t").alias("t"), F.col("_r").alias("n")))
    u = ordered.carry(ordered.dealt(l.unionByName(r), by, ["_t"]), by, {"_before": (F.max, at)}, {"_after": (F.min, to)})
    w = Window.partitionBy("_part", *by).orderBy("_t")
    back = Window.partitionBy("_part", *by).orderBy(F.desc("_t"))  # frames that shrink are computed anew for each row
    u = u.withColumn("_p", F.coalesce(F.max(at).over(w.rangeBetween(Window.unboundedPreceding, -1)), "_before")).withColumn("_n", F.coalesce(F.min(to).over(back.rangeBetween(Window.unboundedPreceding, Window.currentRow)), "_after"))
    before, after = F.col("_t") - F.col("_p.t"), F.col("_n.t") - F.col("_t")
    previous = F.col("_p").isNotNull() & (F.col("_n").isNull() | (before < after))
    out = u.where(F.col("_l").isNotNull()).select(*by, F.col("_l").alias(left_id), F.when(previous, -F.col("_p.n")).otherwise(F.col("_n.n")).alias(value), F.when(previous, before).otherwise(after).alias("distance"))
    return out.where(F.col("distance") < tolerance)


def with_fallback(left: DataFrame, right: DataFrame, key: str, value: str, offsets: list[float] = (0.0, -0.001, 0.001)) -> DataFrame:
    """Lookup by a time key in thousandths, then by its neighbours; the first found counts."""
    out, names = left, []
    for k, offset in enumerate(offsets):
        names.append(f"_v{k}")
        probe = F.round((F.col(key) + offset) * 1000).cast("bigint")
        side = right.select(F.round(F.col(key) * 1000).cast("bigint").alias(f"_k{k}"), F.col(value).alias(names[-1])).dropDuplicates([f"_k{k}"])
        out = out.withColumn("_probe", probe).join(side, F.col("_probe") == F.col(f"_k{k}"), "left").drop("_probe", f"_k{k}")
    return out.withColumn(value, F.coalesce(*names)).drop(*names)


def solve_assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """The assignment of least total cost of a rectangular matrix (shortest augmenting paths)."""
    flipped = cost.shape[0] > cost.shape[1]
    c = cost.T if flipped else cost
    n, m = c.shape
    u, v, owner, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            free = ~used[1:]
            cur = c[i0 - 1] - u[i0] - v[1:]
            better = free & (cur < low[1:])
            low[1:][better], way[1:][better] = cur[better], j0
            j1 = 1 + int(np.argmin(np.where(free, low[1:], np.inf)))
            step = low[j1]
            u[owner[used]] += step
            v[used] -= step
            low[~used] -= step
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    return sorted((j - 1, owner[j] - 1) if flipped else (owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j])


#: Groups whose smaller side has at most so many rows are solved side by side, others one after the other.
SIDE_BY_SIDE = 8
#: Numbers of the matrices that are solved side by side, at most about.
CELLS = 2_000_000


def solve_many(cost: np.ndarray) -> np.ndarray:
    """``solve_assignment`` of many matrices (group, row, column) of no more rows than columns at once, with the same choice among
    equals: of each group and column the row that takes it, or -1.  Columns that a group doesn't have cost infinity."""
    count, n, m = cost.shape
    u, v, owner, way = np.zeros((count, n + 1)), np.zeros((count, m + 1)), np.zeros((count, m + 1), int), np.zeros((count, m + 1), int)
    for i in range(1, n + 1):
        owner[:, 0], last = i, np.zeros(count, int)
        low, used = np.full((count, m + 1), np.inf), np.zeros((count, m + 1), bool)
        at = np.arange(count)  # groups whose path is still open
        while len(at):
            used[at, last[at]] = True
            i0, taken, l, w = owner[at, last[at]], used[at], low[at], way[at]
            free = ~taken[:, 1:]
            cur = cost[at, i0 - 1] - u[at, i0][:, None] - v[at, 1:]
            better = free & (cur < l[:, 1:])
            l[:, 1:][better], w[:, 1:][better] = cur[better], np.broadcast_to(last[at][:, None], better.shape)[better]
            j1 = 1 + np.argmin(np.where(free, l[:, 1:], np.inf), axis=1)
            step = l[np.arange(len(at)), j1]
            g, j = np.nonzero(taken)
            u[at[g], owner[at[g], j]] += step[g]
            v[at] -= np.where(taken, step[:, None], 0.0)
            low[at], way[at], last[at] = np.where(taken, l, l - step[:, None]), w, j1
            at = at[owner[at, j1] != 0]
        at = np.arange(count)
        while len(at):
            before = way[at, last[at]]
            owner[at, last[at]] = owner[at, before]
            last[at] = before
            at = at[before != 0]
    return owner[:, 1:] - 1


def _ranks(group: np.ndarray, values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Each value's rank among the distinct ones of its group, and how many those are."""
    codes, distinct = pd.factorize(values, sort=True)
    pair, at = np.unique(group * (len(distinct) + 1) + codes + 1, return_inverse=True)
    n = np.bincount(pair // (len(distinct) + 1))
    return at - (np.cumsum(n) - n)[group], n


def _chosen(sizes: np.ndarray, left: pd.Series, right: pd.Series, cost: np.ndarray) -> np.ndarray:
    """Which rows of a batch of groups, ``sizes`` rows each, their assignments take."""
    out, group = np.zeros(len(cost), bool), np.repeat(np.arange(len(sizes)), sizes)
    (row, rows), (col, cols) = _ranks(group, left), _ranks(group, right)
    impossible = 2 * (np.bincount(group, np.abs(np.nan_to_num(cost))) + 1.0)
    cost = np.where(np.isnan(cost), impossible[group], cost)
    flipped = rows > cols
    row, col = np.where(flipped[group], col, row), np.where(flipped[group], row, col)
    rows, cols = np.minimum(rows, cols), np.maximum(rows, cols)
    wide = 2 ** np.ceil(np.log2(cols)).astype(int)
    first = np.cumsum(sizes) - sizes
    side = rows <= SIDE_BY_SIDE
    for n, m in np.unique(np.stack([rows, wide], 1)[side], axis=0):
        alike = np.flatnonzero(side & (rows == n) & (wide == m))
        most = max(1, CELLS // int(n * m))
        for some in (alike[k : k + most] for k in range(0, len(alike), most)):
            its = np.repeat(first[some] - (np.cumsum(sizes[some]) - sizes[some]), sizes[some]) + np.arange(sizes[some].sum())
            g = np.repeat(np.arange(len(some)), sizes[some])
            c = np.where(np.arange(m) < cols[some][:, None, None], impossible[some][:, None, None], np.inf).repeat(n, 1)
            c[g, row[its], col[its]] = cost[its]
            out[its] = solve_many(c)[g, col[its]] == row[its]
    for k in np.flatnonzero(~side):
        its = slice(first[k], first[k] + sizes[k])
        c = np.full((rows[k], cols[k]), impossible[k])
        c[row[its], col[its]] = cost[its]
        taken = np.zeros(c.shape, bool)
        taken[tuple(zip(*solve_assignment(c), strict=True))] = True
        out[its] = taken[row[its], col[its]]
    return out


def optimal_assignment(costs: DataFrame, keys: list[str], *, left: str = "a", right: str = "b", cost: str = "cost") -> DataFrame:
    """Of each group's (left, right, cost) rows, the one-to-one assignment of least total cost; pairs
    without a row or a cost are impossible.  A group is solved in one task, cubic in its smaller side; groups travel as lists, many
    to a batch, and those with a small side are solved together, for a call for each costs more than its solution."""
    names = costs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            rows = pa.RecordBatch.from_arrays(lists.flatten().flatten(), names)
            sizes = np.asarray(pc.list_value_length(lists))
            if rows.num_rows:
                taken = _chosen(sizes, rows.column(left).to_pandas(), rows.column(right).to_pandas(), rows.column(cost).to_pandas().to_numpy("float64"))
                yield rows.filter(pa.array(taken))

    return costs.groupBy(*keys).agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in names])).alias("_rows")).select("_rows").mapInArrow(run, costs.schema)


def best_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in an order that breaks all ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
