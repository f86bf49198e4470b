"""Centroid clustering (Lloyd's rounds) with adaptive distance bounds.

Each vector keeps an upper bound of the distance to its centroid, lower bounds of the distances to several centroids that were nearest
when it was last scanned, and one lower bound for all the others.  When centroids move, bounds move with them.  While the upper
bound is below all lower ones, the vector's assignment is certain and nothing is computed.  Otherwise the distance to its own
centroid is computed, then those to the listed centroids whose bounds don't exceed it; only if the best of them isn't certainly
nearer than the bound for the others are all centroids scanned.  How many centroids are listed follows what the last round needed.

Components are integers, floor(256 * x), and distances squared integers, computed exactly; bounds are floating-point distances with a
margin for their rounding, so a bound never decides a tie.  Rounds write their vectors with bounds to the shared folder,
each task deals with its own batches in numpy, and sums per centroid are partial aggregates; the driver sees one row per centroid.

Defined results: rows whose vector is null, has another number of components, or a null, NaN or infinite one are left out; components are
held within +-2^27 (x beyond +-524,288), so that distances fit a long; rows that repeat an id are vectors of their own; with fewer
vectors than centroids each is a centroid; ties go to the smaller number; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavane import storage
from stratavane.llm import _text

SCALE, LIMIT = 256, 1 << 27
#: Bounds are widened by this share of themselves, and of the largest coordinate, wherever they are computed or moved.
MARGIN = 1e-9
#: Below this magnitude sums of products are exact in floating point (64 * 2^44 < 2^53).
EXACT = 1 << 22


def integers(vector: Column, size: int) -> Column:
    """The vector's integer components; null for one that isn't kept."""
    good = (F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    held = lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x.cast("double"), F.lit(1e9)), F.lit(-1e9)) * SCALE), F.lit(LIMIT)), F.lit(-LIMIT))
    return F.when(F.coalesce(good, F.lit(False)), F.transform(vector, lambda x: held(x).cast("int")))


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroids (int64)."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) < EXACT:
        x, y = v.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :]).astype(np.int64)
    return np.stack([((v - row) ** 2).sum(1) for row in c], axis=1)


def pair_distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = v - c
    return np.einsum("ij,ij->i", d, d)


class Bounds:
    """The state of a batch of vectors: ``own``, ``upper``, listed centroids ``near`` (-1: none) with ``lower``, and ``rest``."""

    def __init__(self, v: np.ndarray, k: int, listed: int):
        n = len(v)
        self.v, self.k = v, k
        self.own, self.upper, self.rest = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n)
        self.near, self.lower = np.full((n, listed), -1, np.int64), np.full((n, listed), np.inf)
        #: the highest listed place whose bound had to be looked at, and whether all centroids were scanned
        self.used, self.scanned = np.zeros(n, np.int64), np.zeros(n, bool)

    def narrow(self, listed: int) -> None:
        """List fewer centroids; the bounds that go are merged into the one for the rest."""
        if listed < self.near.shape[1]:
            self.rest = np.minimum(self.rest, self.lower[:, listed:].min(1))
            self.near, self.lower = self.near[:, :listed], self.lower[:, :listed]

    def moved(self, by: np.ndarray) -> None:
        """Centroids have moved by these distances."""
        slack = MARGIN * (1 + by.max())
        self.upper = (self.upper + by[self.own] + slack) * (1 + MARGIN)
        self.lower -= np.where(self.near >= 0, by[self.near], 0) + slack
        self.rest -= by.max() + slack

    def assign(self, c: np.ndarray) -> None:
        """Make every vector's own centroid the nearest one (ties: the smallest number)."""
        least = np.minimum(self.lower.min(1, initial=np.inf), self.rest)
        todo = np.flatnonzero(~(self.upper < least))
        if not len(todo):
            return
        d2 = pair_distances(self.v[todo], c[self.own[todo]])
        self.upper[todo] = np.sqrt(d2.astype(np.float64)) * (1 + MARGIN)
        open_ = ~(self.upper[todo] < least[todo])
        todo, d2 = todo[open_], d2[open_]
        if not len(todo):
            return
        # the listed centroids that may be as near
        near = self.near[todo]
        asked = (near >= 0) & ~(self.upper[todo][:, None] < self.lower[todo])
        r, j = np.nonzero(asked)
        exact = np.full(near.shape, np.iinfo(np.int64).max)
        exact[r, j] = pair_distances(self.v[todo[r]], c[near[r, j]])
        self.used[todo] = np.where(asked.any(1), near.shape[1] - asked[:, ::-1].argmax(1), 0)
        all_d = np.concatenate([d2[:, None], exact], 1)
        all_c = np.concatenate([self.own[todo][:, None], near], 1)
        best_d = all_d.min(1)
        best = np.where(all_d == best_d[:, None], all_c, self.k).min(1)
        upper = np.sqrt(best_d.astype(np.float64)) * (1 + MARGIN)
        sure = upper < self.rest[todo]
        # those that are certain now: the asked centroids' bounds are exact again, and the old own one takes the new one's place
        self.lower[todo[r], j] = np.sqrt(exact[r, j].astype(np.float64)) * (1 - MARGIN)
        s = np.flatnonzero(sure & (best != self.own[todo]))
        at = (near[s] == best[s][:, None]).argmax(1)
        self.near[todo[s], at] = self.own[todo[s]]
        self.lower[todo[s], at] = np.sqrt(d2[s].astype(np.float64)) * (1 - MARGIN)
        self.own[todo[sure]], self.upper[todo[sure]] = best[sure], upper[sure]
        self.scan(todo[~sure], c)

    def scan(self, rows: np.ndarray, c: np.ndarray) -> None:
        """All centroids' exact distances, and new bounds from them."""
        if not len(rows):
            return
        d2, listed = distances(self.v[rows], c), self.near.shape[1]
        order = np.argsort(d2, axis=1, kind="stable")
        d = np.sqrt(np.take_along_axis(d2, order, 1).astype(np.float64))
        self.own[rows], self.upper[rows] = order[:, 0], d[:, 0] * (1 + MARGIN)
        n = min(listed, len(c) - 1)
        self.near[rows], self.lower[rows] = -1, np.inf
        self.near[rows, :n], self.lower[rows, :n] = order[:, 1 : n + 1], d[:, 1 : n + 1] * (1 - MARGIN)
        self.rest[rows] = d[:, n + 1] * (1 - MARGIN) if len(c) > n + 1 else np.inf
        self.scanned[rows], self.used[rows] = True, listed


_STATE = "cluster int, upper double, rest double, near array<int>, lower array<double>, used int, scanned boolean, distance bigint"


def _matrix(col: pa.Array, dtype) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def _round(shared: _text.Shared, listed: int, first: bool):
    """Batches of (row columns, v, state) to the same with the state of the next round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, by = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            b = Bounds(_matrix(batch.column("v"), np.int64), len(c), listed)
            if first:
                b.scan(np.arange(len(b.v)), c)
            else:
                b.own = batch.column("cluster").to_numpy().astype(np.int64)
                b.upper, b.rest = batch.column("upper").to_numpy().copy(), batch.column("rest").to_numpy().copy()
                b.near, b.lower = _matrix(batch.column("near"), np.int64).copy(), _matrix(batch.column("lower"), np.float64).copy()
                b.narrow(listed)
                b.moved(by)
                b.assign(c)
            lists = lambda m, t: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).ravel(), t))
            state = [pa.array(b.own, pa.int32()), pa.array(b.upper), pa.array(b.rest), lists(b.near, pa.int32()), lists(b.lower, pa.float64()), pa.array(b.used, pa.int32()), pa.array(b.scanned), pa.array(pair_distances(b.v, c[b.own]))]
            kept = [n for n in batch.schema.names if n in ("vec_id", "v")]
            names = [f.split()[0] for f in _STATE.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + state, kept + names)

    return run


def cluster(vectors: DataFrame, starts: list[list[int]], rounds: int, *, id: str = "vec_id", vector: str = "v", listed: int | None = None) -> tuple[DataFrame, list[list[int]], list[dict]]:
    """``rounds`` of assigning and replacing, then one more assignment, of integer vectors (``integers``) around the centroids ``starts``.
    Returns rows (vec_id, v, cluster, distance and the bounds), the centroids, and what each assignment had to compute:
    vectors scanned, and the most listed centroids that were looked at."""
    spark = vectors.sparkSession
    _text.bounded_batches(spark)
    c, told = np.array(starts, np.int64), []
    if not len(c):
        empty = vectors.limit(0).select(F.col(id).alias("vec_id"), F.col(vector).alias("v"))
        return empty.select("*", *[F.lit(None).cast(f.split(" ")[1]).alias(f.split(" ")[0]) for f in _STATE.split(", ")]), [], []
    listed = max(1, len(c) // 4) if listed is None else listed
    kind = f"vec_id {vectors.select(id).schema[0].dataType.simpleString()}, v array<int>, {_STATE}"
    rows, by = vectors.select(F.col(id).alias("vec_id"), F.col(vector).alias("v")), np.zeros(len(c))
    for at in range(rounds + 1):
        shared, before = _text.share(spark, (c, by)), rows
        rows = storage.stage(rows.mapInArrow(_round(shared, listed, at == 0), kind), "bounds")
        shared.drop()
        if at:
            storage.release(before)
        sums = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("scanned").cast("int")).alias("scanned"), F.max("used").alias("used"), *[F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(c.shape[1])]).collect()
        told.append({"scanned": sum(r.scanned for r in sums), "used": max((r.used for r in sums), default=0), "listed": listed})
        if at < rounds:
            old, c = c, c.copy()
            for r in sums:
                c[r.cluster] = [r[f"s{i}"] // r.n for i in range(c.shape[1])]
            by = np.sqrt(((c - old) ** 2).sum(1).astype(np.float64)) * (1 + MARGIN)
            if at:  # the first assignment scans everything
                listed = max(1, len(c) // 8, min(listed, told[-1]["used"]))
    return rows, c.tolist(), told


def first_centroids(vectors: DataFrame, k: int, seed: str, *, id: str = "vec_id", vector: str = "v") -> list[list[int]]:
    """The vectors of the k smallest SHA-256 digests (hex) of ``seed``:id; among equal ids the smaller vector comes first."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256)
    return [list(r.v) for r in vectors.select(h.alias("h"), F.col(vector).alias("v")).orderBy("h", "v").limit(k).collect()]


def summary(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Per vector: cluster, distance, the sums over its cluster and over all, and its centroid's digest."""
    spark = rows.sparkSession
    digests = spark.createDataFrame([(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    own = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    all_ = rows.agg(F.sum("distance").alias("inertia"))
    out = rows.select("vec_id", "cluster", "distance").join(F.broadcast(own), "cluster").join(F.broadcast(all_)).join(F.broadcast(digests), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


DIMENSIONS, CENTROIDS, ROUNDS = 64, 40, 5


def op12_drake_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", integers(F.col("embedding"), DIMENSIONS).alias("v")).where("v IS NOT NULL")
    rows, centroids, _ = cluster(e, first_centroids(e, CENTROIDS, "2"), ROUNDS)
    return summary(rows, centroids)


def _sql() -> str:
    """The same rounds with every distance computed."""
    kept = f"""k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
 WHERE len(embedding) = {DIMENSIONS} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
e AS MATERIALIZED (SELECT r, unnest(range({DIMENSIONS})) AS i, unnest(v) AS x FROM k)"""
    c0 = f"s AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c FROM k), c0 AS MATERIALIZED (SELECT c, i, x FROM e JOIN s USING (r) WHERE c < {CENTROIDS})"
    parts = [kept, c0]
    for n in range(ROUNDS + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, c, d FROM (SELECT r, c, sum((e.x - c{n}.x) * (e.x - c{n}.x))::BIGINT AS d FROM e JOIN c{n} USING (i) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if n < ROUNDS:
            parts.append(f"m{n} AS (SELECT c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM e JOIN a{n} USING (r) GROUP BY 1, 2), c{n + 1} AS MATERIALIZED (SELECT c, i, coalesce(m{n}.x, c{n}.x)::BIGINT AS x FROM c{n} LEFT JOIN m{n} USING (c, i))")
    last = f"h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS sha FROM c{ROUNDS} GROUP BY 1)"
    return "WITH " + ",\n".join([*parts, last]) + f"""
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha AS centroid_sha256 FROM a{ROUNDS} JOIN k USING (r) JOIN h USING (c)"""


SQL = _sql()
