"""Source mixing and clustering against plain versions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavane.llm import clustering, mixing

SF = "/root/testdata/sf0.001"


# --- mixing ------------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left, all_w = total - sum(most * sizes[s] for s in capped), sum(w[s] for s in sizes if s not in capped)
        share = {s: left * w[s] / all_w for s in sizes if s not in capped}
        over = {s for s in share if share[s] > most * sizes[s]}
        if not over:
            return share | {s: float(most * sizes[s]) for s in capped}
        capped |= over


def mix_rows():
    rows = [(k, "w " * (k % 37), f"s{k % 5}") for k in range(900)] + [(2000 + k, "w" if k % 2 else "é " * 40, None) for k in range(30)]
    rows += [(3000, None, "s0"), (3001, "", "only empty"), (3002, " \t\n\x0b", "only empty"), (3003, "x " * 5000, "s1"), (3004, "one", "A"), (None, "a b c", "s2"), (None, "a b c", "s2"), (7, "w " * 7, "s2")]
    return rows + [(4000 + k, "a b c d", "hot") for k in range(2000)]


def check_mix(out, rows, most=3):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in out) == Counter((i, words(t)) for i, t, _ in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    want, by, largest = plain_targets(sizes), defaultdict(int), max(r.size for r in out)
    source = {i: s for i, _, s in rows if i is not None} | {None: "s2"}
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-12) and 0 <= r.taken <= most * r.size and r.taken == r.size * r.copies
        low = math.floor(r.target / r.source_size) if r.source_size else 0
        assert low <= r.copies <= low + 1 or not r.size
        by[s] += r.taken
    for s, n in by.items():
        assert abs(n - want[s]) <= 0.02 * want[s] + 40 * (s != "s1") + largest * (s == "s1"), (s, n, want[s])


def test_mix_meets_its_targets_and_repeats_itself(spark):
    rows = mix_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS key", "'x' AS u", "2 AS size", "3 AS n", "'y' AS cls")
    out = mixing.mix(df.repartition(7)).collect()
    check_mix(out, rows)
    again = mixing.mix(df.orderBy(F.desc("text")).coalesce(2)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))


def test_mix_is_the_n_least_ranks_of_each_class(spark):
    rows = mix_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("liking", F.when(F.col("doc_id") % 2 == 0, 50.0).otherwise(F.lit(None)))
    keyed = df.select("doc_id", "source", mixing.uniform(F.col("doc_id").cast("string"), F.col("text")).alias("u"), F.expr("coalesce(liking, 1D)").alias("w"))
    u = {r.doc_id: (r.u, r.w) for r in keyed.collect()}
    for preference in (None, "liking"):
        out = [r for r in mixing.mix(df, preference=preference).collect() if r.size and r.doc_id not in (None, 7)]
        classes = defaultdict(list)
        for r in out:
            shift = max(r.size.bit_length() - 4, 0)
            x, w = u[r.doc_id]
            classes[r.target, r.source_size, (r.size >> shift) + 8 * shift].append((x / (1 - x) / (w if preference else 1.0), r.copies))
        for got in classes.values():
            low = min(c for _, c in got)
            taken, left = [k for k, c in got if c > low], [k for k, c in got if c == low]
            assert not taken or not left or max(taken) < min(left)
    hot = [r for r in out if r.doc_id >= 4000]
    drawn = [r.doc_id % 2 for r in hot if r.copies > math.floor(r.target / r.source_size)]
    assert len(hot) == 2000 and drawn.count(0) > 900 and 0 < drawn.count(1) < 500


def test_inclusion_is_fair_over_seeds(spark, monkeypatch):
    rows = [(k, "w " * (1 + k % 9), "ab"[k % 2]) for k in range(120)]
    df, n = spark.createDataFrame(rows, "doc_id long, text string, source string"), Counter()
    want = plain_targets({"a": sum(1 + k % 9 for k in range(0, 120, 2)), "b": sum(1 + k % 9 for k in range(1, 120, 2))})
    for seed in range(6):
        monkeypatch.setattr(mixing, "SEED", seed)
        for r in mixing.mix(df).collect():
            n["ab"[r.doc_id % 2]] += r.copies
    for s in "ab":
        mean = want[s] / sum(1 + k % 9 for k in range(s == "b", 120, 2))
        assert abs(n[s] / 6 / 60 - mean) < 0.08


def test_mix_of_nothing_and_of_empty_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).collect() == []
    out = mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], empty.schema)).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in out) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


# --- clustering --------------------------------------------------------------------------------------


def plain_clusters(rows, k=40, rounds=5, dim=64, limit=1 << 27):
    kept = [(i, [max(-limit, min(limit, math.floor(256 * float(np.float32(x))))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, _, v in sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), j, v) for j, (i, v) in enumerate(kept))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), n) for n, m in enumerate(c))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        c = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if groups[n] else m for n, m in enumerate(c)]
    out = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, n in out:
        inertia[n] += d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return Counter((i, n, d, inertia[n], sum(inertia.values()), sha[n]) for i, d, n in out)


def clusters(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS v", "'x' AS cluster", "2 AS distance").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return Counter(map(tuple, clustering.op12_drake_clusters(spark, str(tmp_path)).collect()))


def vectors(n, spread, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, 64)) * 2
    return [(k, (centres[k % 12] + r.normal(size=64) * spread).tolist()) for k in range(n)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_clusters_equal_a_plain_version(spark, tmp_path, spread):
    rows = vectors(300, spread)
    rows += [(1000, None), (1001, [1.0] * 63), (1002, [1.0] * 63 + [None]), (1003, [float("nan")] * 64), (1004, [float("inf")] * 64), (1005, [0.0] * 64), (5, rows[5][1]), (5, rows[6][1]), (1006, [1e30] * 64), (1007, [-3e5] * 64)]
    rows += [(2000 + k, rows[3][1]) for k in range(60)]
    assert clusters(spark, tmp_path, rows) == plain_clusters(rows)


def test_fewer_vectors_than_centroids(spark, tmp_path):
    rows = vectors(7, 0.1)
    assert clusters(spark, tmp_path, rows) == plain_clusters(rows)


def test_no_vectors(spark, tmp_path):
    assert not clusters(spark, tmp_path, [(1, None)])


def test_bounds_save_scans_and_never_change_a_result():
    r = np.random.default_rng(3)
    centres = r.integers(-3000, 3000, (16, 8))
    v = centres[r.integers(0, 16, 4000)] + r.integers(-300, 300, (4000, 8))
    c, b, scanned = v[:16].copy(), clustering.Bounds(v, 16, 4), []
    b.scan(np.arange(len(v)), c)
    for step in range(12):
        d = ((v[:, None, :] - c[None]) ** 2).sum(2)
        assert (b.own == d.argmin(1)).all()
        true = np.sqrt(d.astype(float))
        assert (b.upper >= true[np.arange(len(v)), b.own]).all()
        listed = np.zeros(d.shape, bool)
        for j in range(b.near.shape[1]):
            ok = b.near[:, j] >= 0
            assert (b.lower[ok, j] <= true[ok, b.near[ok, j]]).all()
            listed[np.flatnonzero(ok), b.near[ok, j]] = True
        listed[np.arange(len(v)), b.own] = True
        assert (b.rest <= np.where(listed, np.inf, true).min(1)).all()
        old = c.copy()
        c = np.array([v[b.own == k].sum(0) // max(1, (b.own == k).sum()) if (b.own == k).any() else c[k] for k in range(16)])
        b.scanned[:] = False
        b.narrow(4 if step < 6 else 2)
        b.moved(np.sqrt(((c - old) ** 2).sum(1).astype(float)) * (1 + clustering.MARGIN))
        b.assign(c)
        scanned.append(b.scanned.mean())
    assert scanned[-1] < 0.05
