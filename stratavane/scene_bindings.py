"""More operators bound to the benchmark tables: lines as the points of scenes, frames and masks.

A return flag is a scene, a line number a frame, a part a point (its pixel follows from its key), a supplier a
mask or an instance.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stratavane.bindings import _B, _BP, _E, _boxes, _r, _read, query
from stratavane.functions import geometry as G
from stratavane.functions import text as X
from stratavane.operators import augment, boxes, evaluation, labels, masks, matching, merge, runs, spatial, suppression
from stratavane.plans import proposals
from stratavane.streaming import incremental

# --- points, pixels, frames --------------------------------------------------------------------------

_MAP = """mp AS (SELECT DISTINCT l_returnflag AS s, l_linenumber AS f, l_partkey AS p, (l_partkey % 12)::INT AS r, (l_partkey // 12 % 12)::INT AS c FROM lineitem),
px AS (SELECT DISTINCT l_returnflag AS s, l_linenumber AS f, l_suppkey % 20 AS k, (l_partkey % 11)::INT AS r, (l_orderkey % 12)::INT AS c FROM lineitem)"""
_HIT = f"{_MAP}, hit AS (SELECT DISTINCT mp.s, mp.f, px.k, mp.p FROM mp JOIN px ON mp.s = px.s AND mp.f = px.f AND mp.r = px.r AND mp.c = px.c)"


def _mapping(spark, sf):
    p = F.col("l_partkey")
    return _read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("scene_id"), F.col("l_linenumber").alias("frame_id"), p.alias("point_id"), (p % 12).cast("int").alias("row"), (F.floor(p / 12) % 12).cast("int").alias("col")).distinct()


def _pixels(spark, sf):
    return _read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("scene_id"), F.col("l_linenumber").alias("frame_id"), (F.col("l_suppkey") % 20).alias("mask_id"), (F.col("l_partkey") % 11).cast("int").alias("row"), (F.col("l_orderkey") % 12).cast("int").alias("col")).distinct()


def _superpoints(spark, sf, n=50):
    return _read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("scene_id"), F.col("l_partkey").alias("point_id"), (F.col("l_partkey") % n).alias("spp")).distinct()


@query(f"WITH {_HIT} SELECT s AS scene_id, f AS frame_id, k AS mask_id, count(*) AS n FROM hit GROUP BY 1, 2, 3")
def mask_membership(spark, sf):
    """How many visible points lie under each mask."""
    return masks.member_counts(_mapping(spark, sf), _pixels(spark, sf))


@query(f"""WITH {_HIT}, t AS (SELECT s, f, p % 50 AS spp, count(*) AS total FROM mp GROUP BY 1, 2, 3), h AS (SELECT s, f, k, p % 50 AS spp, count(*) AS hit FROM hit GROUP BY 1, 2, 3, 4)
SELECT h.s AS scene_id, h.f AS frame_id, k AS mask_id, h.spp, hit, total, round(hit / total, 6) AS weight FROM h JOIN t ON t.s = h.s AND t.f = h.f AND t.spp = h.spp WHERE hit / total >= 0.3""")
def superpoint_coverage(spark, sf):
    """The superpoints that a mask covers well enough."""
    c = masks.coverage(_mapping(spark, sf), _pixels(spark, sf), _superpoints(spark, sf), least=0.3)
    return c.select("scene_id", "frame_id", "mask_id", "spp", "hit", "total", _r("weight"))


@query(f"""WITH {_MAP}, v AS (SELECT s, p % 30 AS i, f, min(c) AS x1, min(r) AS y1, max(c) AS x2, max(r) AS y2, count(*) AS n FROM mp GROUP BY 1, 2, 3)
SELECT s AS scene_id, i AS inst_id, f AS frame_id, x1, y1, x2, y2, n, row_number() OVER (PARTITION BY s, i ORDER BY n DESC, f) AS rank FROM v WHERE n > 2 QUALIFY rank <= 3""")
def instance_views(spark, sf):
    """The three frames that see most of an instance, with its pixel box."""
    inst = _superpoints(spark, sf, 30).withColumnRenamed("spp", "inst_id")
    return masks.views(_mapping(spark, sf), inst, least=2, k=3).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""WITH {_MAP}, b AS (SELECT s, f, k, min(r) + 1 AS y1, max(r) AS y2, 2 AS x1, 8 AS x2 FROM px GROUP BY 1, 2, 3)
SELECT px.s AS scene_id, px.f AS frame_id, px.k AS mask_id, r AS row, c AS col FROM px JOIN b ON b.s = px.s AND b.f = px.f AND b.k = px.k WHERE r BETWEEN y1 AND y2 AND c BETWEEN x1 AND x2""")
def fitted_masks(spark, sf):
    """Masks cut to boxes."""
    px, key = _pixels(spark, sf), ["scene_id", "frame_id", "mask_id"]
    boxes = masks.boxes(px, key).select(*key, F.lit(2).alias("x1"), (F.col("y1") + 1).alias("y1"), F.lit(8).alias("x2"), "y2")
    return masks.fit_to_box(px, boxes, key)


@query("SELECT l_suppkey AS grp, round(sum(l_quantity) / sum(l_linenumber), 6) AS conf FROM lineitem WHERE l_linenumber > 0 GROUP BY 1")
def mask_confidence(spark, sf):
    """Weights of groups over their counts."""
    g = _read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("grp"), F.col("l_quantity").alias("weight"), F.col("l_linenumber").alias("cnt"))
    return masks.confidence(g, ["grp"]).select("grp", _r("conf"))


def _vector(*parts):
    return F.array(*[p.cast("double") for p in parts])


@query(f"""WITH {_HIT}, m AS (SELECT s, k, f, k * 1.0 AS a, f * 2.0 AS b FROM (SELECT DISTINCT s, f, k FROM px))
SELECT hit.s AS scene_id, hit.p AS point_id, sum(a)::DOUBLE AS f0, sum(b)::DOUBLE AS f1 FROM hit JOIN m ON m.s = hit.s AND m.f = hit.f AND m.k = hit.k GROUP BY 1, 2""")
def point_features(spark, sf):
    """Each point's sum of the features of the masks over it."""
    feats = _pixels(spark, sf).select("scene_id", "frame_id", "mask_id").distinct().withColumn("feat", _vector(F.col("mask_id"), F.col("frame_id") * 2))
    out = labels.accumulate_features(_mapping(spark, sf), _pixels(spark, sf), feats)
    return out.select("scene_id", "point_id", F.col("feat")[0].alias("f0"), F.col("feat")[1].alias("f1"))


_LF = "(l_partkey % 11)::DOUBLE AS a, (l_partkey % 7 + 1)::DOUBLE AS b"


def _point_vectors(spark, sf):
    p = F.col("l_partkey")
    return _read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("scene_id"), p.alias("point_id"), _vector(p % 11, p % 7 + 1).alias("feat")).distinct()


@query(f"""WITH p AS (SELECT DISTINCT l_returnflag AS s, l_partkey AS p, {_LF} FROM lineitem), t AS (SELECT s, p % 50 AS spp, sum(a) AS a, sum(b) AS b FROM p GROUP BY 1, 2)
SELECT s AS scene_id, spp, round(a / sqrt(a * a + b * b), 9) AS f0, round(b / sqrt(a * a + b * b), 9) AS f1 FROM t""")
def superpoint_features(spark, sf):
    """Superpoints' summed features at unit length."""
    out = labels.superpoint_features(_point_vectors(spark, sf), _superpoints(spark, sf))
    return out.select("scene_id", "spp", F.round(F.col("feat")[0], 9).alias("f0"), F.round(F.col("feat")[1], 9).alias("f1"))


@query(f"WITH p AS (SELECT DISTINCT l_returnflag AS s, l_partkey AS p, {_LF} FROM lineitem) SELECT s AS scene_id, p % 50 AS spp, round(avg(p * 1.0), 6) AS x, round(avg(p % 9), 6) AS y, round(avg(a), 9) AS f0, round(avg(b), 9) AS f1 FROM p GROUP BY 1, 2")
def superpoint_pool(spark, sf):
    """Superpoints' mean coordinates and features."""
    pts = _point_vectors(spark, sf).withColumn("x", F.col("point_id").cast("double")).withColumn("y", (F.col("point_id") % 9).cast("double"))
    out = labels.superpoint_pool(pts, _superpoints(spark, sf), ["x", "y"], vector="feat")
    return out.select("scene_id", "spp", _r("x"), _r("y"), F.round(F.col("feat")[0], 9).alias("f0"), F.round(F.col("feat")[1], 9).alias("f1"))


@query("""WITH p AS (SELECT DISTINCT l_returnflag AS s, l_partkey AS p FROM lineitem), n AS (SELECT s, p % 50 AS spp, p % 3 AS label, count(*) AS n, avg((p % 10) / 10.0) AS score FROM p GROUP BY 1, 2, 3)
SELECT s AS scene_id, spp, label, round(n / sum(n) OVER (PARTITION BY s, spp), 9) AS share, round(score, 9) AS mean_score FROM n QUALIFY row_number() OVER (PARTITION BY s, spp ORDER BY n DESC, label) = 1""")
def superpoint_vote(spark, sf):
    """Superpoints' majority labels with share and score."""
    pts = _superpoints(spark, sf).select("scene_id", "point_id", (F.col("point_id") % 3).alias("label"), ((F.col("point_id") % 10) / 10.0).alias("score"))
    return labels.superpoint_vote(pts, _superpoints(spark, sf)).select("scene_id", "spp", "label", _r("share", 9), _r("mean_score", 9))


@query(f"WITH {_E} SELECT label, i - 1 AS pos, round(avg(v), 9) AS v FROM e GROUP BY 1, 2")
def mean_features(spark, sf):
    """Unweighted mean features."""
    e = _read(spark, sf, "embeddings")
    return labels.mean_features(e, keys=["label"], vector="embedding").select("label", F.posexplode("embedding").alias("pos", "v")).select("label", "pos", _r("v", 9))


@query(f"""WITH {_E}, p AS (SELECT label AS c, i, avg(v) AS v FROM e GROUP BY 1, 2), n AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM e GROUP BY 1), np AS (SELECT c, sqrt(sum(v * v)) AS n FROM p GROUP BY 1),
x AS (SELECT e.vec_id, p.c, sum(e.v * p.v) / (any_value(n.n) * any_value(np.n)) AS cosine FROM e JOIN p USING (i) JOIN n ON n.vec_id = e.vec_id JOIN np ON np.c = p.c GROUP BY 1, 2)
SELECT vec_id, c AS class_id, round(cosine, 6) AS cosine FROM x QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, c) = 1""")
def nearest_class(spark, sf):
    """The nearest class mean, three classes at a time."""
    e = _read(spark, sf, "embeddings", "vec_id", "label", F.col("embedding").alias("feat"))
    protos = labels.prototypes(e, "label", "feat").select(F.col("label").alias("class_id"), F.col("feat").alias("emb"))
    return labels.nearest_class(e, protos, block=3).select("vec_id", "class_id", _r("cosine"))


# --- suppression of masks, detections ----------------------------------------------------------------

_INST = """m AS (SELECT DISTINCT l_returnflag AS s, l_suppkey AS i, l_partkey % 97 + l_suppkey // 4 * 48 AS p FROM lineitem),
n AS (SELECT s, i, count(*) AS n, i * 5 % 24 AS score, i % 2 AS cls FROM m GROUP BY 1, 2)"""
_NEAR = """rk AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY score DESC, i) AS k FROM n),
x AS (SELECT a.s, a.i AS a, b.i AS b, count(*) AS x FROM m a JOIN m b ON a.s = b.s AND a.p = b.p AND a.i <> b.i GROUP BY 1, 2, 3),
near AS (SELECT x.s, ra.k AS better, rb.k, ra.cls = rb.cls AS same FROM x JOIN rk ra ON ra.s = x.s AND ra.i = a JOIN rk rb ON rb.s = x.s AND rb.i = b WHERE ra.k < rb.k AND x.x / (ra.n + rb.n - x.x) > 0.29)"""


def _instances(spark, sf):
    i = F.col("l_suppkey")
    inst = _read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("scene_id"), i.alias("inst_id"), (F.col("l_partkey") % 97 + F.floor(i / 4) * 48).alias("point_id")).distinct()
    info = inst.select("scene_id", "inst_id").distinct().withColumn("score", (F.col("inst_id") * 5 % 24).cast("double")).withColumn("class_id", F.col("inst_id") % 2)
    return inst, info


def _kept_sql(same: str, inst: str = _INST) -> str:
    """The rows in order, one after another: each stays unless a better neighbour is among those kept so far."""
    return f"""{inst}, {_NEAR}, ov AS (SELECT s, k, list(better) AS over FROM near WHERE true {same} GROUP BY 1, 2), bo AS MATERIALIZED (SELECT rk.s, rk.k, rk.i, coalesce(over, []) AS over FROM rk LEFT JOIN ov ON ov.s = rk.s AND ov.k = rk.k),
st(s, k, i, kept) AS (SELECT DISTINCT s, 0::BIGINT, 0::BIGINT, []::BIGINT[] FROM rk UNION ALL SELECT bo.s, bo.k, bo.i, CASE WHEN list_has_any(kept, over) THEN kept ELSE list_append(kept, bo.k) END FROM st JOIN bo ON bo.s = st.s AND bo.k = st.k + 1),
kept AS (SELECT s, k, i FROM st WHERE k > 0 AND list_contains(kept, k))"""


@query(f"WITH RECURSIVE {_kept_sql('')} SELECT s AS scene_id, i AS inst_id FROM kept")
def mask_nms(spark, sf):
    """Greedy suppression of overlapping masks."""
    inst, info = _instances(spark, sf)
    return suppression.suppress("greedy", inst, info, 0.29, scope=["scene_id"]).select("scene_id", "inst_id")


@query(f"WITH RECURSIVE {_kept_sql('AND same')} SELECT s AS scene_id, i AS inst_id FROM kept")
def class_mask_nms(spark, sf):
    """Greedy suppression of masks within their class."""
    inst, info = _instances(spark, sf)
    return suppression.suppress("class", inst, info, 0.29, scope=["scene_id"]).select("scene_id", "inst_id")


@query(f"""WITH RECURSIVE {_kept_sql('')}, own AS (SELECT rk.s, rk.i, coalesce(min(kept.k), any_value(rk.k)) AS k FROM rk LEFT JOIN near ON near.s = rk.s AND near.k = rk.k LEFT JOIN kept ON kept.s = rk.s AND kept.k = near.better GROUP BY 1, 2),
own2 AS (SELECT own.s, own.i, rk.i AS w FROM own JOIN rk ON rk.s = own.s AND rk.k = own.k), c AS (SELECT s, w, count(*) AS c FROM own2 GROUP BY 1, 2),
v AS (SELECT m.s, w, p, count(*) AS v FROM m JOIN own2 ON own2.s = m.s AND own2.i = m.i GROUP BY 1, 2, 3)
SELECT v.s AS scene_id, v.w AS inst_id, count(*) AS n, sum(p)::BIGINT AS points FROM v JOIN c ON c.s = v.s AND c.w = v.w WHERE 2 * v >= c GROUP BY 1, 2""")
def nms_and_merge(spark, sf):
    """Surviving masks with the points that half of the masks they stand for have."""
    inst, info = _instances(spark, sf)
    out = suppression.suppress("merge", inst, info, 0.29, scope=["scene_id"])
    return out.groupBy("scene_id", "inst_id").agg(F.count(F.lit(1)).alias("n"), F.sum("point_id").alias("points"))


# of a frame's boxes, the first 3 by score that pass the filter, then greedily those that overlap no kept one by more than 0.3, the best two of them
@query(f"""WITH {_BP}, t AS (SELECT f, id, score, x1, row_number() OVER (PARTITION BY f ORDER BY score DESC, id) AS r FROM bx WHERE score > 20000 QUALIFY r <= 3),
o AS (SELECT f, a, b FROM pr WHERE i / (sa + sb - i) > 0.3), u AS (SELECT t.*, (SELECT list(x.r) FROM t x JOIN o ON o.f = x.f AND o.a = x.id WHERE x.f = t.f AND o.b = t.id AND x.r < t.r) AS over FROM t),
k AS (SELECT *, CASE WHEN r = 1 THEN true WHEN r = 2 THEN over IS NULL ELSE NOT list_contains(coalesce(over, []), 1) AND (NOT list_contains(coalesce(over, []), 2) OR (SELECT y.over IS NOT NULL FROM u y WHERE y.f = u.f AND y.r = 2)) END AS kept FROM u)
SELECT f, id AS box_id, x1 FROM k WHERE kept QUALIFY row_number() OVER (PARTITION BY f ORDER BY r) <= 2""")
def detection_selection(spark, sf):
    """Score filter, the best boxes of a frame, suppression among them, and the best that are left."""
    out = suppression.select_detections(_boxes(spark, sf), ["f"], least=20000, nms_pre=3, keep=2, threshold=0.3)
    return out.select("f", "box_id", "x1")


@query(f"""WITH {_B}, l AS (SELECT f, id, cls, (score - 30000) / 10000 AS z, x1, y1, x2, y2 FROM bx), p AS (SELECT *, 1 / (1 + exp(-z)) AS score FROM l), k AS (SELECT * FROM p WHERE score > 0.3 QUALIFY row_number() OVER (PARTITION BY f ORDER BY score DESC, id, cls) <= 3)
SELECT f, id AS box_id, round(score, 9) AS score, least(greatest(x1 / 2, 0), 20 + f % 9)::DOUBLE AS x1, least(greatest(y1 / 0.5, 0), 100)::DOUBLE AS y1, least(greatest(x2 / 2, 0), 20 + f % 9)::DOUBLE AS x2, least(greatest(y2 / 0.5, 0), 100)::DOUBLE AS y2 FROM k""")
def head_decode(spark, sf):
    """A detector head's logits and boxes as detections."""
    raw = _boxes(spark, sf).withColumn("logit", (F.col("score") - 30000) / 10000).drop("score")
    sizes = raw.select("f").distinct().select("f", (20 + F.col("f") % 9).alias("width"), F.lit(100).alias("height"))
    out = suppression.decode_head(raw, keys=["f"], sizes=sizes, least=0.3, nms_pre=3, scale=(2.0, 0.5))
    return out.select("f", "box_id", _r("score", 9), "x1", "y1", "x2", "y2")


# --- boxes, crops, cameras ---------------------------------------------------------------------------


@query("""WITH g AS (SELECT n_nationkey AS id, 100 + n_nationkey * 7 AS w, 60 + n_nationkey * 11 AS h FROM nation), l AS (SELECT *, unnest([0, 1, 2]) AS layer FROM g), n AS (SELECT *, (2 ** layer)::INT AS n FROM l),
s AS (SELECT *, floor(0.3 * least(w, h) * 2 / n)::INT AS o FROM n), c AS (SELECT *, ceil((o * (n - 1) + w) / n)::INT AS cw, ceil((o * (n - 1) + h) / n)::INT AS ch FROM s),
x AS (SELECT *, unnest(range(n)) AS i FROM c), y AS (SELECT *, unnest(range(n)) AS j FROM x)
SELECT id, layer, (i * (cw - o))::INT AS x1, (j * (ch - o))::INT AS y1, least(i * (cw - o) + cw, w)::INT AS x2, least(j * (ch - o) + ch, h)::INT AS y2 FROM y""")
def crop_boxes(spark, sf):
    """Overlapping crops of images in layers."""
    k = F.col("n_nationkey")
    images = _read(spark, sf, "nation").select(k.alias("id"), (100 + k * 7).alias("width"), (60 + k * 11).alias("height"))
    return spatial.crop_boxes(images, 2, 0.3).drop("width", "height")


@query("SELECT n_nationkey AS id, round((i + 0.5) / 4, 9) AS x, round((j + 0.5) / 4, 9) AS y FROM nation, (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j)")
def grid_points(spark, sf):
    """Centres of a grid."""
    return _read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.explode(spatial.grid_points(4)).alias("g")).select("id", F.round("g.x", 9).alias("x"), F.round("g.y", 9).alias("y"))


@query(f"WITH {_B} SELECT f, id AS box_id, round(x1 + f % 100, 6) AS x1, round(y1 + f % 50, 6) AS y1, round(x2 + f % 100, 6) AS x2, round(y2 + f % 50, 6) AS y2 FROM bx")
def uncropped(spark, sf):
    """Boxes of crops in the image's frame."""
    b = G.uncrop(F.struct("x1", "y1", "x2", "y2"), F.col("f") % 100, F.col("f") % 50)
    return _boxes(spark, sf).withColumn("b", b).select("f", "box_id", *[F.round(f"b.{c}", 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("""SELECT p_partkey AS id, round((500 + p_size) * (floor(240 * 640 / 480) / 640), 6) AS fx, round((510 + p_size) * 240 / 480, 6) AS fy, round((320 + p_size) * 319 / 639.0, 6) AS cx, round((240 + p_size) * 239 / 479.0, 6) AS cy FROM part""")
def resized_cameras(spark, sf):
    """Cameras of resized images."""
    n = F.col("p_size").cast("double")
    k = G.resized_camera(G.camera(500 + n, 510 + n, 320 + n, 240 + n), (640, 480), (320, 240))
    return _read(spark, sf, "part").withColumn("k", k).select(F.col("p_partkey").alias("id"), *[F.round(F.col("k")[i], 6).alias(c) for i, c in ((0, "fx"), (4, "fy"), (2, "cx"), (5, "cy"))])


@query("""WITH p AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, (p_partkey % 13)::DOUBLE AS y, p_retailprice / 100 AS z FROM part)
SELECT id, round(0.6 * x - 0.8 * y + 1.25, 6) AS tx, round(0.8 * x + 0.6 * y - 2.1, 6) AS ty, round(z + 3, 6) AS tz, round(x / 127.5 - 1, 9) AS colour, CASE WHEN x > 20 THEN y ELSE y * 0.5 END AS dimmed FROM p""")
def transformed_points(spark, sf):
    """Points under a rigid transform, normalised colours, dimmed pixels."""
    p = _read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 13).cast("double").alias("y"), (F.col("p_retailprice") / 100).alias("z"))
    m = F.array(*map(F.lit, [0.6, -0.8, 0.0, 1.25, 0.8, 0.6, 0.0, -2.1, 0.0, 0.0, 1.0, 3.0, 0.0, 0.0, 0.0, 1.0]))
    tx, ty, tz = G.transform_point(m, F.col("x"), F.col("y"), F.col("z"))
    return p.select("id", F.round(tx, 6).alias("tx"), F.round(ty, 6).alias("ty"), F.round(tz, 6).alias("tz"), F.round(G.normalize_colour(F.col("x")), 9).alias("colour"), G.darken(F.col("y"), F.col("x") > 20).alias("dimmed"))


@query("""WITH p AS (SELECT p_partkey AS id, (p_partkey % 40)::DOUBLE AS d, (p_partkey % 40 + (p_size - 25) / 8.0)::DOUBLE AS z FROM part)
SELECT id, abs(d - z) <= 1 AS near, abs(d - z) <= 0.05 * d AS relative, d <> 0 AND abs(d - z) <= 0.5 AS seen FROM p""")
def depth_tests(spark, sf):
    """The occlusion tests of points against depths."""
    p = _read(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 40).cast("double").alias("d"), (F.col("p_partkey") % 40 + (F.col("p_size") - 25) / 8.0).cast("double").alias("z"))
    d, z = F.col("d"), F.col("z")
    return p.select("id", G.depth_agrees(d, z, 1.0).alias("near"), G.depth_agrees(d, z, 0.05, relative=True).alias("relative"), G.visible(d, z, 0.5).alias("seen"))


_B3 = """b AS (SELECT c_custkey AS id, c_nationkey AS scan, c_custkey % 3 AS label, (c_custkey % 17)::DOUBLE AS x, (c_custkey % 11)::DOUBLE AS y, (c_custkey % 7)::DOUBLE AS z, (1 + c_custkey % 5)::DOUBLE AS e FROM customer),
pr AS (SELECT * FROM b WHERE id % 2 = 0), gt AS (SELECT * FROM b WHERE id % 2 = 1),
j AS (SELECT p.scan, p.label, p.id AS pred_id, g.id AS gt_id, greatest(least(p.x + p.e, g.x + g.e) - greatest(p.x, g.x), 0) * greatest(least(p.y + p.e, g.y + g.e) - greatest(p.y, g.y), 0) * greatest(least(p.z + p.e, g.z + g.e) - greatest(p.z, g.z), 0) AS i,
  p.x <= g.x + g.e AND g.x <= p.x + p.e AND p.y <= g.y + g.e AND g.y <= p.y + p.e AND p.z <= g.z + g.e AND g.z <= p.z + p.e AS touch, p.e ** 3 AS pv, g.e ** 3 AS gv, (greatest(p.x + p.e, g.x + g.e) - least(p.x, g.x)) * (greatest(p.y + p.e, g.y + g.e) - least(p.y, g.y)) * (greatest(p.z + p.e, g.z + g.e) - least(p.z, g.z)) AS hull FROM pr p JOIN gt g ON g.scan = p.scan AND g.label = p.label)"""


def _boxes_3d(spark, sf):
    k = F.col("c_custkey")
    corner = [k % 17, k % 11, k % 7]
    c = _read(spark, sf, "customer").withColumn("e", 1 + k % 5)
    b = c.select(F.col("c_nationkey").alias("scan"), (k % 3).alias("label_id"), k.alias("id"), _vector(*corner).alias("low"), _vector(*[x + F.col("e") for x in corner]).alias("high"))
    return b.where("id % 2 = 0").withColumnRenamed("id", "pred_id"), b.where("id % 2 = 1").withColumnRenamed("id", "gt_id")


@query(f"WITH {_B3} SELECT scan, label AS label_id, pred_id, gt_id, i AS inter, round(i / (pv + gv - i), 9) AS iou FROM j WHERE i > 0")
def box_matches(spark, sf):
    """Predicted and true 3D boxes that share volume."""
    return evaluation.box_matches(*_boxes_3d(spark, sf)).select("scan", "label_id", "pred_id", "gt_id", "inter", _r("iou", 9))


@query(f"WITH {_B3} SELECT pred_id, gt_id, round(i / (pv + gv - i + 1e-6), 9) AS iou, round(i / (pv + gv - i + 1e-6) - (hull - (pv + gv - i)) / (hull + 1e-6), 9) AS giou FROM j WHERE touch")
def box_giou_3d(spark, sf):
    """IoU and generalised IoU of 3D boxes that touch."""
    p, g = _boxes_3d(spark, sf)
    ends = lambda df, i, n: df.select("scan", "label_id", i, *[F.get(c, F.lit(k)).alias(f"{n}{c}{k}") for k in range(3) for c in ("low", "high")])
    axes = lambda n: [(f"{n}low{k}", f"{n}high{k}") for k in range(3)]
    side = lambda df, i, n, to: boxes.alike(ends(df, i, n), ["scan", "label_id", *[c for x in axes(n) for c in x]], i, to)
    j = boxes.touching(side(p, "pred_id", "p", "ps"), side(g, "gt_id", "g", "gs"), ["scan", "label_id"], axes("p"), axes("g"))
    iou, giou = G.iou_giou_3d(*[[(F.col(lo), F.col(hi)) for lo, hi in axes(n)] for n in "pg"])
    j = j.select("ps", "gs", F.round(iou, 9).alias("iou"), F.round(giou, 9).alias("giou"))
    return j.select("*", F.explode("ps").alias("pred_id")).select("*", F.explode("gs").alias("gt_id")).select("pred_id", "gt_id", "iou", "giou")


# --- scores and reports ------------------------------------------------------------------------------


@query("WITH c AS (SELECT l_returnflag AS scan, ((l_suppkey % 7) * 1000 + l_linenumber)::BIGINT AS code FROM lineitem) SELECT scan, code AS gt_id, count(*) AS n, (code // 1000)::INT AS label_id FROM c WHERE code > 0 AND code // 1000 IN (1, 2, 5) GROUP BY 1, 2")
def gt_instances(spark, sf):
    """True instances with class and size."""
    gt = _read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("scan"), F.col("l_partkey").alias("point_id"), (F.col("l_suppkey") % 7 * 1000 + F.col("l_linenumber")).cast("bigint").alias("code"))
    return evaluation.gt_instances(gt, [1, 2, 5])


_APS = "a AS (SELECT p_size % 9 AS label_id, [0.25, 0.5, 0.55, 0.6][p_partkey % 4 + 1]::DOUBLE AS overlap, CASE WHEN p_size % 9 = 4 THEN 'nan'::DOUBLE ELSE avg(p_retailprice) / 3000 END AS ap, avg(p_size) / 60 AS recall FROM part GROUP BY 1, 2)"


def _aps(spark, sf):
    at = F.element_at(F.array(*map(F.lit, [0.25, 0.5, 0.55, 0.6])), (F.col("p_partkey") % 4 + 1).cast("int"))
    a = _read(spark, sf, "part").groupBy((F.col("p_size") % 9).alias("label_id"), at.alias("overlap")).agg((F.avg("p_retailprice") / 3000).alias("ap"), (F.avg("p_size") / 60).alias("recall"))
    return a.withColumn("ap", F.when(F.col("label_id") == 4, F.lit(float("nan"))).otherwise(F.col("ap")))


@query(f"WITH {_APS} SELECT label_id, coalesce(round(avg(nullif(ap, 'nan')) FILTER (overlap <> 0.25), 9), -1) AS ap, coalesce(round(max(nullif(ap, 'nan')) FILTER (overlap = 0.5), 9), -1) AS ap50, coalesce(round(max(nullif(ap, 'nan')) FILTER (overlap = 0.25), 9), -1) AS ap25, round(avg(recall) FILTER (overlap <> 0.25), 9) AS rc FROM a GROUP BY 1")
def ap_averages(spark, sf):
    """Mean precision by class; -1 for a class without truth (NaN)."""
    return evaluation.averages(_aps(spark, sf)).select("label_id", *[F.when(F.isnan(c), -1.0).otherwise(F.round(c, 9)).alias(c) for c in ("ap", "ap50", "ap25")], _r("rc", 9))


@query(f"WITH {_APS}, c AS (SELECT label_id, avg(ap) FILTER (overlap <> 0.25) AS ap, max(ap) FILTER (overlap = 0.5) AS ap50 FROM a WHERE label_id <> 4 GROUP BY 1) SELECT round(avg(ap), 9) AS ap, round(avg(ap50), 9) AS ap50 FROM c")
def ap_overall(spark, sf):
    """Means over classes, those without truth left out."""
    return evaluation.overall(evaluation.averages(_aps(spark, sf)), ["ap", "ap50"]).select(_r("ap", 9), _r("ap50", 9))


@query("WITH c AS (SELECT l_linenumber AS gt, CASE WHEN l_suppkey % 9 IN (1, 2, 3, 4) THEN l_suppkey % 9 ELSE -1 END AS pred, count(*) AS n FROM lineitem WHERE l_linenumber IN (1, 2, 3, 4) GROUP BY 1, 2) SELECT gt, pred::BIGINT AS pred, n FROM c")
def confusion_unknown(spark, sf):
    """Confusion of valid classes, all others being one unknown class."""
    l = _read(spark, sf, "lineitem").select(F.col("l_linenumber").alias("gt"), (F.col("l_suppkey") % 9).alias("pred"))
    return evaluation.confusion(l, valid=[1, 2, 3, 4])


@query("SELECT round(avg((abs(l_quantity - l_linenumber) + abs(l_tax - l_discount)) / 2), 9) AS mae FROM lineitem WHERE l_quantity > 10")
def mean_absolute_error(spark, sf):
    """Mean absolute error over two pairs of columns."""
    return evaluation.mean_absolute_error(_read(spark, sf, "lineitem"), [("l_quantity", "l_linenumber"), ("l_tax", "l_discount")], F.col("l_quantity") > 10).select(_r("mae", 9))


@query("""WITH i AS (SELECT c_nationkey AS scan, c_custkey AS gt_id, c_custkey % 5 AS label FROM customer), h AS (SELECT DISTINCT c_nationkey AS scan, c_custkey AS gt_id FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice / 300000 > 0.5)
SELECT CASE WHEN label < 2 THEN 'head' ELSE 'tail' END AS grp, round(avg(CASE WHEN h.gt_id IS NULL THEN 0 ELSE 1 END), 9) AS recall FROM i LEFT JOIN h ON h.scan = i.scan AND h.gt_id = i.gt_id GROUP BY 1""")
def group_recall(spark, sf):
    """Recall by group of classes."""
    c = _read(spark, sf, "customer").select(F.col("c_nationkey").alias("scan"), F.col("c_custkey").alias("gt_id"), (F.col("c_custkey") % 5).alias("label_id"))
    hits = _read(spark, sf, "orders").select(F.col("o_custkey").alias("gt_id"), (F.col("o_totalprice") / 300000).alias("iou")).join(c, "gt_id")
    groups = spark.createDataFrame([(k, "head" if k < 2 else "tail") for k in range(5)], "label_id bigint, grp string")
    return evaluation.group_recall(hits, c, groups, 0.5).select("grp", _r("recall", 9))


@query("""WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT vec_id AS image_id, string_agg('t' || (i - 1), ' | ' ORDER BY i) AS tags FROM v WHERE 1 / (1 + exp(-x)) > 0.45 + 0.003 * (i - 1) GROUP BY 1""")
def tags_above(spark, sf):
    """Tags above their own thresholds."""
    e = _read(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("logits"))
    return labels.tags_above(e, spark.createDataFrame([(k, f"t{k}", 0.45 + 0.003 * k) for k in range(64)], "idx int, tag string, threshold double"))


@query("SELECT vec_id AS id, (vec_id * 7 // 5)::BIGINT AS inst, (vec_id * 7 % 5)::BIGINT AS cls FROM embeddings")
def unflattened(spark, sf):
    """Instance and class of flat indexes."""
    inst, cls = labels.unflatten(F.col("vec_id") * 7, 5)
    return _read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), inst.alias("inst"), cls.alias("cls"))


# --- points and voxels, names, lookups ---------------------------------------------------------------


@query("SELECT floor(l_quantity / 5)::BIGINT AS vx, l_linenumber::BIGINT AS vy, l_suppkey % 3 AS vz, count(*) AS n, string_agg(l_orderkey::VARCHAR, ',' ORDER BY l_orderkey) AS members FROM lineitem GROUP BY 1, 2, 3")
def voxel_members(spark, sf):
    """The points of each voxel."""
    l = _read(spark, sf, "lineitem").select((F.col("l_quantity") / 5).alias("x"), F.col("l_linenumber").cast("double").alias("y"), (F.col("l_suppkey") % 3).cast("double").alias("z"), F.col("l_orderkey").alias("point_id"))
    return spatial.voxelize(l, 1.0, members="members").withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), ","))


@query("WITH l AS (SELECT l_returnflag AS scene_id, l_orderkey * 8 + l_linenumber AS point_id FROM lineitem) SELECT scene_id, point_id FROM l QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY md5('3:' || scene_id || ':' || point_id), point_id) <= 100")
def subsampled(spark, sf):
    """A sample of at most a hundred points of each scene."""
    l = _read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("scene_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("point_id"))
    return spatial.subsample(l, 100, scope=["scene_id"], seed=3)


@query("""SELECT p_partkey AS id, lower(replace(replace(p_name, '_', ' '), '/', ' or ')) AS name, CASE WHEN lower(p_name[1]) IN ('a', 'e', 'i', 'o', 'u') THEN 'an' ELSE 'a' END AS article, contains(p_type, p_name) OR contains(p_name, p_type) AS same,
p_brand || '_' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') AS numbered FROM part""")
def processed_names(spark, sf):
    """Names for prompts: cleaned, with article, matched and numbered."""
    p = _read(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), X.processed_name(F.col("p_name")).alias("name"), X.article(F.col("p_name")).alias("article"), X.matches_class(F.col("p_type"), F.col("p_name")).alias("same"), X.numbered(F.col("p_brand"), F.col("p_partkey") % 1000).alias("numbered"))


@query("""WITH l AS (SELECT o_orderkey AS id, round((o_orderkey % 60000) / 1000.0, 3) AS t FROM orders), r AS (SELECT (p_partkey * 3)::BIGINT AS ms, max(p_size) AS v FROM part GROUP BY 1)
SELECT l.id, coalesce(a.v, b.v, c.v) AS v FROM l LEFT JOIN r a ON a.ms = round(l.t * 1000)::BIGINT LEFT JOIN r b ON b.ms = round((l.t - 0.001) * 1000)::BIGINT LEFT JOIN r c ON c.ms = round((l.t + 0.001) * 1000)::BIGINT""")
def lookup_with_fallback(spark, sf):
    """A lookup by time in thousandths, then by the neighbours."""
    left = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.round((F.col("o_orderkey") % 60000) / 1000.0, 3).alias("t"))
    right = _read(spark, sf, "part").groupBy((F.col("p_partkey") * 3 / 1000.0).alias("t")).agg(F.max("p_size").alias("v"))
    return matching.with_fallback(left, right, "t", "v").select("id", "v")


@query(f"WITH {_E} SELECT label, i - 1 AS pos, round(sum(v), 5) AS total FROM e GROUP BY 1, 2")
def running_vectors(spark, sf):
    """Component sums as the incremental form has them, here over the whole table."""
    e = _read(spark, sf, "embeddings")
    return incremental.running_vectors(e.select("label", F.col("embedding").cast("array<double>").alias("v")), ["label"], "v").select("label", "pos", _r("total", 5))


# --- run lengths -------------------------------------------------------------------------------------

_RL = """m AS (SELECT DISTINCT l_suppkey % 30 AS m, l_orderkey // 8 AS p, l_returnflag = 'A' AS one FROM lineitem)"""
_ISLANDS = "g AS (SELECT m, p, p - row_number() OVER (PARTITION BY m ORDER BY p) AS g FROM x), r AS (SELECT m, min(p) AS s, max(p) + 1 AS e FROM g GROUP BY m, g)"


def _runs(spark, sf, where="true"):
    """Masks as run lengths, read back as runs."""
    l = _read(spark, sf, "lineitem").where(where).select((F.col("l_suppkey") % 30).alias("inst_id"), F.floor(F.col("l_orderkey") / 8).alias("point_id"))
    return runs.runs(masks.rle_encode(l, ["inst_id"]), ["inst_id"])


def _run_sql(elements: str) -> str:
    return f"WITH {_RL}, x AS ({elements}), {_ISLANDS} SELECT m AS inst_id, s, e FROM r"


@query(_run_sql("SELECT m, p FROM m WHERE one INTERSECT SELECT m, p FROM m WHERE NOT one"))
def run_intersection(spark, sf):
    """What two masks share, from their runs."""
    return runs.combine("intersection", _runs(spark, sf, "l_returnflag = 'A'"), _runs(spark, sf, "l_returnflag <> 'A'"), ["inst_id"])


@query(_run_sql("SELECT m, p FROM m WHERE one EXCEPT SELECT m, p FROM m WHERE NOT one"))
def run_difference(spark, sf):
    """What the first of two masks has alone, from their runs."""
    return runs.combine("difference", _runs(spark, sf, "l_returnflag = 'A'"), _runs(spark, sf, "l_returnflag <> 'A'"), ["inst_id"])


@query(_run_sql("SELECT DISTINCT m, p FROM m"))
def run_union(spark, sf):
    """The union of two masks, from their runs."""
    return runs.combine("union", _runs(spark, sf, "l_returnflag = 'A'"), _runs(spark, sf, "l_returnflag <> 'A'"), ["inst_id"])


@query(f"""WITH {_RL}, d AS (SELECT DISTINCT m, p FROM m), n AS (SELECT m, count(*) AS n FROM d GROUP BY 1), x AS (SELECT a.m AS a, b.m AS b, count(*) AS inter FROM d a JOIN d b ON a.p = b.p AND a.m < b.m GROUP BY 1, 2)
SELECT a, b, inter, na.n AS size_a, nb.n AS size_b, round(inter / (na.n + nb.n - inter), 9) AS iou FROM x JOIN n na ON na.m = a JOIN n nb ON nb.m = b""")
def run_overlap_iou(spark, sf):
    """Overlap of masks from their runs."""
    return runs.overlaps(_runs(spark, sf)).select("a", "b", F.col("inter").cast("bigint").alias("inter"), "size_a", "size_b", _r("iou", 9))


# --- a 3D network's proposals ------------------------------------------------------------------------

_PROPOSED = """m0 AS (SELECT DISTINCT l_returnflag AS s, l_suppkey AS i, l_partkey % 97 + l_suppkey // 4 * 48 AS p FROM lineitem WHERE l_quantity >= 20 AND l_suppkey * 7 % 13 / 10.0 >= 0.1),
n AS (SELECT s, i, count(*) AS n, least(i * 7 % 13 / 10.0, 1.0) AS score, list_position([i * 3 % 7, i * 5 % 7, i * 2 % 7], greatest(i * 3 % 7, i * 5 % 7, i * 2 % 7)) - 1 AS cls FROM m0 GROUP BY 1, 2 HAVING count(*) >= 20),
m AS (SELECT m0.s, m0.i, m0.p FROM m0 JOIN n ON n.s = m0.s AND n.i = m0.i)"""
_TO_POINTS = """vx AS (SELECT DISTINCT l_returnflag AS s, l_partkey % 97 + l_suppkey // 4 * 48 AS p FROM lineitem), pt AS (SELECT s, p, p * 2 + d AS pt FROM vx, (SELECT unnest([0, 1]) AS d)), sz AS (SELECT s, pt // 3 AS spp, count(*) AS sz FROM pt GROUP BY 1, 2),
a0 AS (SELECT kept.s, kept.i, pt FROM kept JOIN m ON m.s = kept.s AND m.i = kept.i JOIN pt ON pt.s = m.s AND pt.p = m.p UNION ALL SELECT s, -1 - p % 9, pt FROM pt WHERE p % 9 IN (0, 4)),
a1 AS (SELECT a0.s, i, pt // 3 AS spp FROM a0 JOIN sz ON sz.s = a0.s AND sz.spp = pt // 3 GROUP BY 1, 2, 3 HAVING 2 * count(*) >= any_value(sz)), a2 AS (SELECT a1.s, i, pt FROM a1 JOIN pt ON pt.s = a1.s AND pt.pt // 3 = a1.spp),
g AS (SELECT s, i, pt, pt - row_number() OVER (PARTITION BY s, i ORDER BY pt) AS g FROM a2), fin AS (SELECT s, i, count(*) AS n, count(DISTINCT g) AS runs, sum(pt)::BIGINT AS points FROM g GROUP BY 1, 2 HAVING count(*) >= 20 OR i < 0)"""


@query(f"""WITH RECURSIVE {_kept_sql('AND same', _PROPOSED)}, {_TO_POINTS}
SELECT fin.s AS scene_id, fin.i AS inst_id, CASE WHEN fin.i < 0 THEN -fin.i ELSE cls + 1 END::INT AS label_id, CASE WHEN fin.i < 0 THEN 1.0 ELSE score END::DOUBLE AS conf, fin.n, runs, points FROM fin LEFT JOIN n ON n.s = fin.s AND n.i = fin.i""")
def proposal_instances(spark, sf):
    """Raw proposals as instances with classes and run lengths."""
    l, i = _read(spark, sf, "lineitem"), F.col("l_suppkey")
    at = l.select(F.col("l_returnflag").alias("scene_id"), i.alias("inst_id"), (F.col("l_partkey") % 97 + F.floor(i / 4) * 48).alias("voxel_id"), (F.col("l_quantity") - 20).alias("logit"))
    p = at.select("scene_id", "inst_id").distinct().select("*", F.array(*[(F.col("inst_id") * k % 7).cast("double") for k in (3, 5, 2, 1)]).alias("logits"), (F.col("inst_id") * 7 % 13 / 10.0).alias("conf"))
    voxels = at.select("scene_id", "voxel_id").distinct()
    pts = voxels.withColumn("point_id", F.explode(F.array(F.col("voxel_id") * 2, F.col("voxel_id") * 2 + 1)))
    spp = pts.select("scene_id", "point_id", F.floor(F.col("point_id") / 3).alias("spp"))
    out = proposals.instances(p, at, pts, spp, semantic=voxels.withColumn("sem", F.col("voxel_id") % 9), whole_classes=[0, 4], points=20, nms="class", threshold=0.29)
    starts = F.transform(F.sequence(F.lit(0), (F.size("counts") / 2).cast("int") - 1), lambda j: F.struct(F.get("counts", j * 2).cast("bigint").alias("s"), F.get("counts", j * 2 + 1).cast("bigint").alias("n")))
    points = F.aggregate(starts, F.lit(0).cast("bigint"), lambda a, r: a + r["n"] * (r["s"] - 1) + (r["n"] * (r["n"] - 1) / 2).cast("bigint"))
    return out.select("scene_id", "inst_id", "label_id", "conf", masks.rle_area(F.col("counts")).alias("n"), (F.size("counts") / 2).cast("bigint").alias("runs"), points.alias("points"))


# --- the merge tree ----------------------------------------------------------------------------------

_LEAVES = """lv0 AS (SELECT l_returnflag AS s, l_linenumber - 1 AS node, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END * 10000 + (l_linenumber - 1) * 100 + l_suppkey % 6 AS grp,
 l_partkey % 250 + l_suppkey % 6 * 200 + (l_linenumber - 1) * 30 AS spp, least(count(*), 4) / 4.0 AS weight, (count(*) >= 2)::BIGINT AS cnt FROM lineitem GROUP BY 1, 2, 3, 4),
size AS (SELECT DISTINCT s, spp, 1 + spp % 3 AS size FROM lv0)"""


def _level_sql(n: int, up: str, least: float) -> str:
    """One level: the groups of nodes for which ``up`` holds move to the parent (half the node's number) and merge there."""
    return f"""on{n} AS (SELECT s, node // 2 AS node, grp, spp, cnt, weight FROM lv{n} WHERE {up}), cv{n} AS (SELECT o.s, node, grp, o.spp, size FROM on{n} o JOIN size z ON z.s = o.s AND z.spp = o.spp WHERE cnt > 0),
sg{n} AS (SELECT s, grp, sum(size) AS n FROM cv{n} GROUP BY 1, 2), pr{n} AS (SELECT a.grp AS a, b.grp AS b, sum(a.size) AS x FROM cv{n} a JOIN cv{n} b ON a.s = b.s AND a.node = b.node AND a.spp = b.spp AND a.grp < b.grp GROUP BY 1, 2),
ed{n} AS (SELECT a, b FROM pr{n} JOIN sg{n} ga ON ga.grp = a JOIN sg{n} gb ON gb.grp = b WHERE x / (ga.n + gb.n - x + 1e-6) >= {least}), sy{n} AS (SELECT a, b FROM ed{n} UNION SELECT b, a FROM ed{n}),
re{n}(a, b) AS (SELECT grp, grp FROM sg{n} UNION SELECT re{n}.a, sy{n}.b FROM re{n} JOIN sy{n} ON sy{n}.a = re{n}.b), co{n} AS MATERIALIZED (SELECT a AS grp, min(b) AS comp FROM re{n} GROUP BY 1), me{n} AS (SELECT comp, count(*) AS m FROM co{n} GROUP BY 1),
lv{n + 1} AS MATERIALIZED (SELECT s, node, comp AS grp, spp, sum(weight) / any_value(m) AS weight, sum(cnt) AS cnt FROM on{n} JOIN co{n} USING (grp) JOIN me{n} USING (comp) GROUP BY 1, 2, 3, 4 UNION ALL SELECT s, node // 2, grp, spp, weight, cnt FROM lv{n} WHERE NOT ({up}))"""


@query(f"""WITH RECURSIVE {_LEAVES}, {_level_sql(0, "node < 6", 0.6)}, {_level_sql(1, "true", 0.5)}, {_level_sql(2, "true", 0.35)}
SELECT s AS scene_id, grp, spp, cnt::BIGINT AS cnt, round(weight, 9) AS weight FROM lv3""")
def hierarchical_merge(spark, sf):
    """The masks of seven frames merged up the tree of frames, looser towards the root."""
    f, k = F.col("l_linenumber") - 1, F.col("l_suppkey") % 6
    scene = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    at = [F.col("l_returnflag").alias("scene_id"), f.alias("frame_ord"), (scene * 10000 + f * 100 + k).alias("grp"), (F.col("l_partkey") % 250 + k * 200 + f * 30).alias("spp")]
    leaves = _read(spark, sf, "lineitem").groupBy(*at).agg((F.count(F.lit(1)) >= 2).cast("bigint").alias("cnt"), (F.least(F.count(F.lit(1)), F.lit(4)) / 4.0).alias("weight"))
    sizes = leaves.select("scene_id", "spp").distinct().withColumn("size", 1 + F.col("spp") % 3)
    frames = leaves.groupBy("scene_id").agg((F.max("frame_ord") + 1).alias("n"))
    out = merge.hierarchical_merge(leaves, frames, sizes, visi=[0.35, 0.5, 0.6], simi=None)
    return out.select("scene_id", "grp", "spp", "cnt", _r("weight", 9))


# --- augmentation ------------------------------------------------------------------------------------


def _elastic_sql(gran: int, mag: float, seed: int) -> str:
    u = lambda c, t: f"((('0x' || md5('{seed}:' || s || ':' || i || ':' || j || ':' || k || ':{c}:{t}')[1:12])::BIGINT + 0.5) / 281474976710656.0)"
    noise = ", ".join(f"sqrt(-2 * ln({u(c, 'r')})) * cos(2 * pi() * {u(c, 'a')}) AS n{c}" for c in range(3))
    smooth = []
    for n, axis in enumerate("ijkijk"):
        others = ", ".join(a for a in "ijk" if a != axis)
        smooth.append(f"l{n + 1} AS (SELECT s, i, j, k, " + ", ".join(f"sum(n{c}) OVER w / 3 AS n{c}" for c in range(3)) + f" FROM l{n} WINDOW w AS (PARTITION BY s, {others} ORDER BY {axis} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))")
    size = ", ".join(f"(floor(floor(max(abs({a}))) / {gran}) + 3)::INT AS sz{a}" for a in "xyz")
    place = ", ".join(f"({a} + (sz{a} - 1) * {gran}) / {2 * gran} AS t{a}" for a in "xyz")
    cell = ", ".join(f"least(greatest(floor(t{a}), 0), sz{a} - 2)::INT AS c{a}" for a in "xyz")
    on = " AND ".join(f"l6.{i} = c{a} + (q >> {n} & 1)" for n, (i, a) in enumerate(zip("ijk", "xyz", strict=True)))
    w = " * ".join(f"(CASE WHEN q >> {n} & 1 = 1 THEN t{a} - c{a} ELSE 1 - (t{a} - c{a}) END)" for n, a in enumerate("xyz"))
    return f"""WITH p AS (SELECT p_partkey % 3 AS s, p_partkey AS id, p_size - 25.0::DOUBLE AS x, p_partkey % 13 - 6.0::DOUBLE AS y, (p_retailprice - 1000) / 100 AS z FROM part), b AS (SELECT s, {size} FROM p GROUP BY 1),
g AS (SELECT s, i, j, unnest(range(szz)) AS k FROM (SELECT *, unnest(range(szy)) AS j FROM (SELECT *, unnest(range(szx)) AS i FROM b))), l0 AS (SELECT s, i, j, k, {noise} FROM g), {", ".join(smooth)},
t AS (SELECT p.*, b.* EXCLUDE s, {place} FROM p JOIN b ON b.s = p.s), c AS (SELECT *, {cell} FROM t), m AS (SELECT c.s, id, sum({w} * n0) AS d0, sum({w} * n1) AS d1, sum({w} * n2) AS d2 FROM c, (SELECT unnest(range(8)) AS q) qs JOIN l6 ON l6.s = c.s AND {on} GROUP BY 1, 2)
SELECT p.s AS scene_id, p.id AS point_id, round(x + {mag} * d0, 6) AS x, round(y + {mag} * d1, 6) AS y, round(z + {mag} * d2, 6) AS z FROM p JOIN m ON m.id = p.id"""


@query(_elastic_sql(4, 1.5, 5))
def elastic_points(spark, sf):
    """Points moved by smooth noise."""
    k = F.col("p_partkey")
    p = _read(spark, sf, "part").select((k % 3).alias("scene_id"), k.alias("point_id"), (F.col("p_size") - 25.0).alias("x"), (k % 13 - 6.0).alias("y"), ((F.col("p_retailprice") - 1000) / 100).alias("z"))
    return augment.elastic(p, 4, 1.5, scope=["scene_id"], seed=5).select("scene_id", "point_id", _r("x"), _r("y"), _r("z"))
