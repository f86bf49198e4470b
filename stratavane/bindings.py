"""The operators bound to the benchmark tables, each with SQL for the same rows.

Scenes don't exist among those tables, so the bindings read them as such: a supplier is a mask over parts, an
order is a frame with its lines as boxes, a customer is a superpoint of orders, embeddings are features.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratavane.functions import geometry as G
from stratavane.functions import text as X
from stratavane.functions import vectors as V
from stratavane.operators import evaluation, graph, labels, masks, matching, merge, pairs, spatial, suppression
from stratavane.plans import scenes
from stratavane.sources import formats, writers

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from stratavane import scene_bindings  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from stratavane import scene_bindings  # noqa: F401

    return dict(_SQL)


def _read(spark: SparkSession, sf: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{table}.parquet")
    return df.select(*columns) if columns else df


def _r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


# --- embeddings --------------------------------------------------------------------------------------

_E = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)"
_PROTO = _E + """, p AS (SELECT label AS class_id, i, avg(v) AS v FROM e GROUP BY 1, 2),
ne AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM e GROUP BY 1), np AS (SELECT class_id, sqrt(sum(v * v)) AS n FROM p GROUP BY 1),
c AS (SELECT e.vec_id, p.class_id, sum(e.v * p.v) / (any_value(ne.n) * any_value(np.n)) AS c FROM e JOIN p ON e.i = p.i JOIN ne ON ne.vec_id = e.vec_id JOIN np ON np.class_id = p.class_id GROUP BY 1, 2),
s AS (SELECT vec_id, class_id, c, exp(20 * (c - max(c) OVER (PARTITION BY vec_id))) AS x FROM c),
f AS (SELECT vec_id, class_id, c, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM s)"""


def _scored(spark, sf):
    e = _read(spark, sf, "embeddings", "vec_id", "label", F.col("embedding").alias("feat"))
    protos = labels.prototypes(e, "label", "feat").select(F.col("label").alias("class_id"), F.col("feat").alias("emb"))
    return labels.class_scores(e, protos, scale=20.0)


@query(f"WITH {_PROTO} SELECT vec_id, class_id, round(c, 6) AS cosine, round(p, 6) AS p FROM f QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class_id) = 1")
def prototype_classify(spark, sf):
    """Each vector's best class by softmax over its cosines with the class means."""
    best = F.array_max(F.transform("scores", lambda s: F.struct(s["p"].alias("p"), (-s["class_id"]).alias("c"), s["cosine"].alias("cosine"))))
    return _scored(spark, sf).withColumn("b", best).select("vec_id", (-F.col("b.c")).alias("class_id"), F.round("b.cosine", 6).alias("cosine"), F.round("b.p", 6).alias("p"))


@query(f"WITH {_PROTO} SELECT e2.label, f.class_id, round(avg(f.p), 6) AS score FROM f JOIN embeddings e2 USING (vec_id) GROUP BY 1, 2")
def mask_class_score(spark, sf):
    """Mean softmax score of each class over a mask's (label's) points."""
    s = _scored(spark, sf).select(F.lit("s").alias("scene_id"), F.col("vec_id").alias("point_id"), F.col("label").alias("inst_id"), "scores")
    return labels.mask_scores(s.drop("inst_id"), s.select("scene_id", "inst_id", "point_id")).select(F.col("inst_id").alias("label"), "class_id", _r("score"))


@query(f"WITH {_E} SELECT label, i - 1 AS pos, round(sum(v) , 5) AS total, round(avg(v), 6) AS mean FROM e GROUP BY 1, 2")
def vector_sums(spark, sf):
    """Component sums and means of each label's vectors."""
    e = _read(spark, sf, "embeddings")
    s = V.sum_vectors(e, ["label"], "embedding").select("label", F.posexplode("embedding").alias("pos", "total"))
    m = V.sum_vectors(e, ["label"], "embedding", mean=True).select("label", F.posexplode("embedding").alias("pos", "mean"))
    return s.join(m, ["label", "pos"]).select("label", "pos", _r("total", 5), _r("mean"))


@query(f"WITH {_E}, w AS (SELECT e.label, e.i, sum(e.v * (e.vec_id % 7 + 1)) AS v FROM e GROUP BY 1, 2) SELECT label, i - 1 AS pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 6) AS v FROM w")
def weighted_unit_sums(spark, sf):
    """Weighted sums of vectors at unit length."""
    e = _read(spark, sf, "embeddings").withColumn("conf", (F.col("vec_id") % 7 + 1).cast("double"))
    return labels.weighted_features(e, keys=["label"], vector="embedding").select("label", F.posexplode("embedding").alias("pos", "v")).select("label", "pos", _r("v"))


_PAIRS = f"""{_E}, n AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM e GROUP BY 1),
c AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label, round(sum(a.v * b.v) / (any_value(na.n) * any_value(nb.n)), 6) AS cosine FROM e a JOIN e b ON a.label = b.label AND a.i = b.i AND a.vec_id <> b.vec_id
  JOIN n na ON na.vec_id = a.vec_id JOIN n nb ON nb.vec_id = b.vec_id GROUP BY 1, 2, 3)"""


@query(f"WITH {_PAIRS} SELECT a, b, cosine, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS rank FROM c QUALIFY rank <= 3")
def cosine_topk(spark, sf):
    """The three most similar vectors of the same label."""
    best = pairs.nearest_by_cosine(_read(spark, sf, "embeddings"), 3, group="label", id="vec_id", vector="embedding")
    return best.withColumn("rank", F.col("rank").cast("bigint"))


@query(f"WITH {_E} SELECT a.vec_id AS a, b.vec_id AS b, round(sum((a.v - b.v) * (a.v - b.v)), 6) AS d2 FROM e a JOIN e b ON a.label = b.label AND a.i = b.i AND a.vec_id < b.vec_id GROUP BY 1, 2")
def squared_distances(spark, sf):
    """Squared distances of the vectors of a label."""
    return pairs.squared_distances(_read(spark, sf, "embeddings"), group="label", id="vec_id", vector="embedding")


@query("""WITH v AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT vec_id, pos, round(x, 6) AS e0, round(sin(x), 6) AS e1, round(cos(x), 6) AS e2, round(sin(2 * x), 6) AS e3, round(cos(2 * x), 6) AS e4 FROM v""")
def positional_encoding(spark, sf):
    """Sines and cosines of doubled frequencies."""
    e = _read(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return e.withColumn("p", V.positional_encoding(F.array(F.col("v").cast("double")), 2)).select("vec_id", "pos", *[F.round(F.col("p")[k], 6).alias(f"e{k}") for k in range(5)])


# --- masks -------------------------------------------------------------------------------------------

_M = "m AS (SELECT DISTINCT l_suppkey AS m, l_partkey AS p FROM lineitem)"


def _mask_rows(spark, sf):
    return _read(spark, sf, "lineitem", F.col("l_suppkey").alias("inst_id"), F.col("l_partkey").alias("point_id"))


def _masks(spark, sf):
    return _mask_rows(spark, sf).distinct()


@query(f"""WITH {_M}, n AS (SELECT m, count(*) AS n FROM m GROUP BY 1), x AS (SELECT a.m AS a, b.m AS b, count(*) AS inter FROM m a JOIN m b ON a.p = b.p AND a.m < b.m GROUP BY 1, 2)
SELECT a, b, inter, round(inter / (na.n + nb.n - inter + 1e-6), 6) AS iou, round(inter / (nb.n + 1e-6), 6) AS precision, round(inter / (na.n + 1e-6), 6) AS recall
FROM x JOIN n na ON na.m = a JOIN n nb ON nb.m = b""")
def mask_overlap_iou(spark, sf):
    """Overlap of masks by an equi-join on their elements."""
    return masks.overlaps(_masks(spark, sf)).select("a", "b", "inter", _r("iou"), _r("precision"), _r("recall"))


@query(f"""WITH {_M}, sp AS (SELECT DISTINCT m, p_brand AS s FROM m JOIN part ON p_partkey = p), w AS (SELECT p_brand AS s, count(*) AS w FROM part GROUP BY 1),
n AS (SELECT m, sum(w)::BIGINT AS n FROM sp JOIN w USING (s) GROUP BY 1), x AS (SELECT a.m AS a, b.m AS b, sum(w)::BIGINT AS inter FROM sp a JOIN sp b ON a.s = b.s AND a.m < b.m JOIN w ON w.s = a.s GROUP BY 1, 2)
SELECT a, b, inter, round(inter / (na.n + nb.n - inter + 1e-6), 6) AS iou FROM x JOIN n na ON na.m = a JOIN n nb ON nb.m = b""")
def weighted_mask_iou(spark, sf):
    """Overlap of masks over superpoints, weighted by their sizes."""
    part = _read(spark, sf, "part", F.col("p_partkey").alias("point_id"), F.col("p_brand").alias("spp"))
    on = _masks(spark, sf).join(part, "point_id").select("inst_id", "spp")
    return masks.overlaps(on, element="spp", weights=masks.superpoint_sizes(part)).select("a", "b", "inter", _r("iou"))


_RUNS = f"{_M}, g AS (SELECT m, p, p - row_number() OVER (PARTITION BY m ORDER BY p) AS g FROM m), r AS (SELECT m, min(p) + 1 AS s, count(*) AS n FROM g GROUP BY m, g)"


@query(f"WITH {_RUNS} SELECT m AS inst_id, string_agg(s::VARCHAR || ' ' || n::VARCHAR, ' ' ORDER BY s) AS counts FROM r GROUP BY 1")
def rle_encode(spark, sf):
    """Run lengths of each mask by gaps and islands."""
    return masks.rle_encode(_mask_rows(spark, sf), ["inst_id"]).select("inst_id", F.array_join(F.transform("counts", lambda x: x.cast("string")), " ").alias("counts"))


@query(f"WITH {_M} SELECT m AS inst_id, p AS point_id FROM m")
def rle_decode(spark, sf):
    """Encoding and decoding gives the masks back."""
    return masks.rle_decode(masks.rle_encode(_mask_rows(spark, sf), ["inst_id"]))


@query(f"WITH {_M} SELECT m AS inst_id, count(*) AS area FROM m GROUP BY 1")
def rle_area(spark, sf):
    """Areas from run lengths."""
    return masks.rle_encode(_mask_rows(spark, sf), ["inst_id"]).select("inst_id", masks.rle_area(F.col("counts")).alias("area"))


@query("""WITH g AS (SELECT n_regionkey::BIGINT AS inst_id, n_nationkey, n_nationkey - row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS g FROM nation),
r AS (SELECT inst_id, min(n_nationkey) AS s, max(n_nationkey) + 1 AS e FROM g GROUP BY inst_id, g),
z AS (SELECT inst_id, s, e, s - lag(e, 1, 0) OVER (PARTITION BY inst_id ORDER BY s) AS gap, lead(s) OVER (PARTITION BY inst_id ORDER BY s) AS nxt FROM r)
SELECT inst_id, string_agg(gap::VARCHAR || ' ' || (e - s)::VARCHAR || CASE WHEN nxt IS NULL AND e < 25 THEN ' ' || (25 - e)::VARCHAR ELSE '' END, ' ' ORDER BY s) AS counts FROM z GROUP BY 1""")
def alternating_runs(spark, sf):
    """Run lengths in the alternating form, unset first."""
    n = _read(spark, sf, "nation", F.col("n_regionkey").cast("bigint").alias("inst_id"), F.col("n_nationkey").cast("bigint").alias("index"))
    return masks.alternating_runs(n, ["inst_id"], 25).select("inst_id", F.array_join(F.transform("counts", lambda x: x.cast("string")), " ").alias("counts"))


@query("SELECT n_regionkey::BIGINT AS inst_id, n_nationkey::BIGINT AS index FROM nation")
def alternating_decode(spark, sf):
    n = _read(spark, sf, "nation", F.col("n_regionkey").cast("bigint").alias("inst_id"), F.col("n_nationkey").cast("bigint").alias("index"))
    return masks.decode_alternating(masks.alternating_runs(n, ["inst_id"], 25))


@query("""WITH s AS (SELECT o_custkey AS spp, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS h FROM orders GROUP BY 1)
SELECT 0::BIGINT AS inst_id, o_orderkey AS point_id FROM orders JOIN s ON spp = o_custkey WHERE h / n >= 0.5""")
def superpoint_majority(spark, sf):
    """A mask aligned to superpoints by majority."""
    o = _read(spark, sf, "orders")
    spp = o.select(F.col("o_orderkey").alias("point_id"), F.col("o_custkey").alias("spp"))
    inst = o.where("o_orderstatus = 'F'").select(F.lit(0).cast("bigint").alias("inst_id"), F.col("o_orderkey").alias("point_id"))
    return masks.majority(inst, spp)


@query("""WITH v AS (SELECT user_id AS point_id, count(*) AS visible FROM events GROUP BY 1), c AS (SELECT event_type AS inst_id, user_id AS point_id, count(*) AS cnt FROM events GROUP BY 1, 2)
SELECT inst_id, point_id, cnt, visible, round(cnt / greatest(visible::DOUBLE, 1e-6), 6) AS ratio FROM c JOIN v USING (point_id) WHERE cnt / greatest(visible::DOUBLE, 1e-6) >= 0.2""")
def visibility_ratio(spark, sf):
    """Points that are seen in a mask often enough."""
    e = _read(spark, sf, "events", F.col("event_type").alias("inst_id"), F.col("user_id").alias("point_id"))
    c = e.groupBy("inst_id", "point_id").agg(F.count(F.lit(1)).alias("cnt"))
    return masks.visibility_ratio(c, masks.visibility(e, []), 0.2, on=["point_id"]).select("inst_id", "point_id", "cnt", "visible", _r("ratio"))


@query("""WITH l AS (SELECT DISTINCT l_suppkey AS i, l_partkey AS p FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT DISTINCT l_suppkey AS i, l_partkey AS p FROM lineitem WHERE l_returnflag <> 'A'),
nl AS (SELECT i, count(*) AS n FROM l GROUP BY 1), nr AS (SELECT i, count(*) AS n FROM r GROUP BY 1),
x AS (SELECT l.i AS a, r.i AS b, count(*) AS x FROM l JOIN r USING (p) GROUP BY 1, 2), hit AS (SELECT DISTINCT b FROM x JOIN nl ON nl.i = a JOIN nr ON nr.i = b WHERE x / (nl.n + nr.n - x + 1e-6) >= 0.16),
top AS (SELECT max(i) + 1 AS t FROM l)
SELECT i AS inst_id, p AS point_id, 'first' AS src FROM l UNION ALL SELECT i + t, p, 'second' FROM r, top WHERE i NOT IN (SELECT b FROM hit)""")
def proposal_dedup_union(spark, sf):
    """Second proposals that overlap no first one too much are added with new ids."""
    l = _read(spark, sf, "lineitem", F.col("l_suppkey").alias("inst_id"), F.col("l_partkey").alias("point_id"), "l_returnflag")
    a = l.where("l_returnflag = 'A'").drop("l_returnflag").distinct()
    b = l.where("l_returnflag <> 'A'").drop("l_returnflag").distinct()
    return masks.union_renumbered(a, masks.drop_overlapping(a, b, 0.16))


@query("""WITH l AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS point_id FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT DISTINCT l_suppkey AS b, l_partkey AS point_id FROM lineitem WHERE l_returnflag <> 'A'),
nl AS (SELECT a, count(*) AS n FROM l GROUP BY 1), nr AS (SELECT b, count(*) AS n FROM r GROUP BY 1), x AS (SELECT a, b, count(*) AS x FROM l JOIN r USING (point_id) GROUP BY 1, 2),
i AS (SELECT a, b, x / (nl.n + nr.n - x) AS iou FROM x JOIN nl USING (a) JOIN nr USING (b)), m AS (SELECT a, b FROM i QUALIFY row_number() OVER (PARTITION BY a ORDER BY iou DESC, b) = 1 AND iou > 0.15)
SELECT a, b, point_id, 'matched' AS kind FROM (SELECT a, b, point_id FROM l JOIN m USING (a) UNION SELECT a, b, point_id FROM r JOIN m USING (b))
UNION ALL SELECT a, NULL, point_id, 'left' FROM l WHERE a NOT IN (SELECT a FROM m) UNION ALL SELECT NULL, b, point_id, 'right' FROM r WHERE b NOT IN (SELECT b FROM m)""")
def best_match_merge(spark, sf):
    """Masks of two halves united with their best match."""
    l = _read(spark, sf, "lineitem", F.col("l_suppkey").alias("inst_id"), F.col("l_partkey").alias("point_id"), "l_returnflag")
    return merge.best_match_merge(l.where("l_returnflag = 'A'").drop("l_returnflag"), l.where("l_returnflag <> 'A'").drop("l_returnflag"), 0.15)


@query(f"""WITH {_M}, n AS (SELECT m, count(*) AS n FROM m GROUP BY 1) SELECT arg_min(m.m, n.n::DOUBLE - m.m / 1e9) AS inst_id, p AS point_id FROM m JOIN n ON n.m = m.m GROUP BY p""")
def painter_points(spark, sf):
    """Each contested point goes to the smallest mask (ties: larger id)."""
    return labels.painter(_masks(spark, sf)).select("inst_id", "point_id")


@query("""WITH t AS (SELECT l_partkey, l_suppkey, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, l_suppkey, score FROM t QUALIFY score = max(score) OVER (PARTITION BY l_partkey) AND score > 50000""")
def panoptic_resolve(spark, sf):
    """The best-scored masks of each element."""
    t = _read(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_extendedprice").alias("score"))
    return labels.panoptic(t, ["l_partkey"], least=50000.0)


@query("SELECT l_suppkey, min(l_linenumber) AS x1, min(l_partkey) AS y1, max(l_linenumber) AS x2, max(l_partkey) AS y2, count(*) AS n FROM lineitem GROUP BY 1")
def mask_boxes(spark, sf):
    """Boxes of masks."""
    return masks.boxes(_read(spark, sf, "lineitem", "l_suppkey", F.col("l_partkey").alias("row"), F.col("l_linenumber").alias("col")), ["l_suppkey"])


@query("""SELECT l_suppkey, round(count(*) FILTER (l_quantity > 26) / count(*) FILTER (l_quantity > 24), 6) AS stability FROM lineitem GROUP BY 1""")
def stability_score(spark, sf):
    return masks.stability(_read(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", 25.0, 1.0).select("l_suppkey", _r("stability"))


@query("SELECT o_orderkey, o_custkey, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) - 1 AS dense FROM orders")
def densify_ids(spark, sf):
    """Ids renumbered densely within a scope."""
    return masks.densify(_read(spark, sf, "orders"), "o_custkey", ["o_orderstatus"], to="dense").select("o_orderkey", "o_custkey", "dense")


@query("""WITH c AS (SELECT l_suppkey, l_linenumber AS f, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, f, n, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, f) AS rank FROM c WHERE n > 20 QUALIFY rank <= 5""")
def top_views(spark, sf):
    """The frames that see most of an instance."""
    m = _read(spark, sf, "lineitem").select(F.lit("s").alias("scene_id"), F.col("l_linenumber").alias("frame_id"), F.monotonically_increasing_id().alias("point_id"), F.lit(0).alias("row"), F.lit(0).alias("col"), "l_suppkey")
    pts = m.select("scene_id", F.col("l_suppkey").alias("inst_id"), "point_id", F.col("frame_id").alias("f"))
    n = pts.groupBy("inst_id", "f").agg(F.count(F.lit(1)).alias("n")).where("n > 20")
    return labels.top_k(n, 5, scope=["inst_id"], score="n", ties=["f"]).select(F.col("inst_id").alias("l_suppkey"), "f", "n", F.col("rank").cast("bigint").alias("rank"))


# --- graphs ------------------------------------------------------------------------------------------

_EDGES = "ed AS (SELECT DISTINCT x.l_orderkey AS a, y.l_orderkey AS b FROM lineitem x JOIN lineitem y ON x.l_partkey = y.l_partkey AND x.l_suppkey = y.l_suppkey AND x.l_linenumber = y.l_linenumber AND x.l_orderkey < y.l_orderkey)"
_COMP = f"""{_EDGES}, un AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), reach(n, r) AS (SELECT o_orderkey, o_orderkey FROM orders UNION SELECT reach.n, un.b FROM reach JOIN un ON un.a = reach.r),
comp AS (SELECT n AS node, min(r) AS component FROM reach GROUP BY 1)"""


def _components(spark, sf):
    l = _read(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    key = ["l_partkey", "l_suppkey", "l_linenumber"]
    least = l.groupBy(*key).agg(F.min("l_orderkey").alias("b"))  # a star per group connects what all its pairs would
    edges = l.join(least, key).select(F.col("l_orderkey").alias("a"), "b").where("a <> b")
    return graph.connected_components(edges, vertices=_read(spark, sf, "orders", "o_orderkey"))


@query(f"WITH RECURSIVE {_COMP} SELECT node, component FROM comp")
def components(spark, sf):
    """Connected components of orders that share a line."""
    return _components(spark, sf)


@query(f"WITH RECURSIVE {_COMP}, z AS (SELECT component, count(*) AS n FROM comp GROUP BY 1) SELECT component, n FROM z WHERE n >= 0.5 * (SELECT avg(n) FROM z) AND n > 1")
def component_clusters(spark, sf):
    """Components that are large enough against the mean."""
    z = _components(spark, sf).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return z.join(F.broadcast(z.agg(F.avg("n").alias("mean")))).where((F.col("n") >= 0.5 * F.col("mean")) & (F.col("n") > 1)).select("component", "n")


@query(f"""WITH RECURSIVE {_COMP}, mem AS (SELECT component, count(*) AS m FROM comp GROUP BY 1)
SELECT component AS grp, l_suppkey AS spp, count(*) AS cnt, round(sum(l_quantity) / any_value(m), 6) AS weight FROM lineitem JOIN comp ON node = l_orderkey JOIN mem USING (component) GROUP BY 1, 2""")
def group_merge(spark, sf):
    """Groups merged by component: counts add, weights average over all members."""
    g = _read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("grp"), F.col("l_suppkey").alias("spp")).agg(F.count(F.lit(1)).alias("cnt"), F.sum("l_quantity").alias("weight"))
    return masks.merge_groups(g, _components(spark, sf)).select("grp", "spp", "cnt", _r("weight"))


# --- boxes -------------------------------------------------------------------------------------------

_B = """bx AS (SELECT l_orderkey AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax, l_shipdate) AS id, l_extendedprice AS score, l_linenumber AS cls,
 l_quantity AS x1, l_discount * 400 AS y1, l_quantity + 20 + l_linenumber AS x2, l_discount * 400 + 30 + l_linenumber AS y2 FROM lineitem)"""
_IOU = """(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0))"""
_BP = f"""{_B}, pr AS (SELECT a.f, a.id AS a, b.id AS b, a.cls AS ca, b.cls AS cb, {_IOU} AS i, (a.x2 - a.x1) * (a.y2 - a.y1) AS sa, (b.x2 - b.x1) * (b.y2 - b.y1) AS sb,
 (greatest(a.x2, b.x2) - least(a.x1, b.x1)) * (greatest(a.y2, b.y2) - least(a.y1, b.y1)) AS hull FROM bx a JOIN bx b ON a.f = b.f AND a.id < b.id)"""


def _boxes(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    l = _read(spark, sf, "lineitem").withColumn("box_id", F.row_number().over(w).cast("bigint"))
    q, d, n = F.col("l_quantity"), F.col("l_discount") * 400, F.col("l_linenumber")
    return l.select(F.col("l_orderkey").alias("f"), "box_id", F.col("l_extendedprice").alias("score"), n.alias("cls"), q.alias("x1"), d.alias("y1"), (q + 20 + n).alias("x2"), (d + 30 + n).alias("y2"))


def _box_pairs(spark, sf):
    b = _boxes(spark, sf).select("f", "box_id", "cls", F.struct("x1", "y1", "x2", "y2").alias("box"))
    return b.toDF("f", "a", "ca", "ba").join(b.toDF("f", "b", "cb", "bb"), "f").where("a < b")


@query(f"WITH {_BP} SELECT f, a, b, round(i / (sa + sb - i), 9) AS iou, round(i / (sa + sb - i) - (hull - (sa + sb - i)) / hull, 9) AS giou FROM pr")
def box_iou_giou(spark, sf):
    """IoU and generalised IoU of the boxes of a frame."""
    a, b = F.col("ba"), F.col("bb")
    return _box_pairs(spark, sf).select("f", "a", "b", F.round(G.iou(a, b), 9).alias("iou"), F.round(G.giou(a, b), 9).alias("giou"))


@query(f"WITH {_BP}, g AS (SELECT DISTINCT f, b FROM pr WHERE i / (sa + sb - i) > 0.3) SELECT f, id AS box_id FROM bx WHERE (f, id) NOT IN (SELECT (f, b) FROM g)")
def pairwise_nms(spark, sf):
    """Boxes that overlap no better box, whether or not that one survives."""
    return suppression.pairwise_box_nms(_boxes(spark, sf), ["f"], 0.3).select("f", "box_id")


def _greedy_sql(same: str, threshold: float) -> str:
    return f"""WITH RECURSIVE {_BP}, over AS (SELECT f, b AS id, bit_or(1::BIGINT << a::INT) AS mask FROM pr WHERE i / (sa + sb - i) > {threshold} {same} GROUP BY 1, 2),
bo AS (SELECT bx.f, bx.id, coalesce(mask, 0) AS mask FROM bx LEFT JOIN over ON over.f = bx.f AND over.id = bx.id),
st(f, id, kept) AS (SELECT DISTINCT f, 0::BIGINT, 0::BIGINT FROM bx UNION ALL SELECT bo.f, bo.id, CASE WHEN kept & mask = 0 THEN kept | (1::BIGINT << bo.id::INT) ELSE kept END FROM st JOIN bo ON bo.f = st.f AND bo.id = st.id + 1)
SELECT f, id AS box_id FROM st WHERE id > 0 AND kept & (1::BIGINT << id::INT) <> 0"""


@query(_greedy_sql("", 0.3))
def greedy_nms(spark, sf):
    """Greedy suppression of a frame's boxes."""
    return suppression.greedy_box_nms(_boxes(spark, sf), ["f"], 0.3).select("f", "box_id")


@query(_greedy_sql("AND ca = cb", 0.3))
def class_nms(spark, sf):
    """Greedy suppression within each class."""
    return suppression.batched_box_nms(_boxes(spark, sf), ["f"], "cls", 0.3).select("f", "box_id")


@query(f"""WITH {_BP}, p AS (SELECT f, a, b, i / (sa + sb - i) AS iou FROM pr), comp AS (SELECT f, b AS a, max(iou) AS c FROM p GROUP BY 1, 2),
d AS (SELECT p.f, p.b AS id, min(exp(-2 * (iou * iou - coalesce(c, 0) * coalesce(c, 0)))) AS d FROM p LEFT JOIN comp ON comp.f = p.f AND comp.a = p.a GROUP BY 1, 2)
SELECT bx.f, bx.id AS box_id, round(score * least(1, coalesce(d, 1)), 4) AS decayed FROM bx LEFT JOIN d ON d.f = bx.f AND d.id = bx.id""")
def matrix_nms(spark, sf):
    """Soft suppression by the decay matrix."""
    return suppression.matrix_box_nms(_boxes(spark, sf).drop("cls"), ["f"]).select("f", "box_id", _r("decayed", 4))


@query(f"""WITH {_B}, c AS (SELECT f, id, least(greatest(x1, 0), 60) AS x1, least(greatest(y1, 0), 50) AS y1, least(greatest(x2, 0), 60) AS x2, least(greatest(y2, 0), 50) AS y2 FROM bx)
SELECT f, id AS box_id, x2 - x1 > 1 AND y2 - y1 > 1 AND (x2 - x1) * (y2 - y1) / 3000.0 < 0.4 AS ok FROM c""")
def box_size_filter(spark, sf):
    """The size predicate on clipped boxes."""
    return _boxes(spark, sf).select("f", "box_id", G.sensible(F.struct("x1", "y1", "x2", "y2"), 60, 50, 0.4).alias("ok"))


@query(f"WITH {_B} SELECT f, id AS box_id, round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy, round(x2 - x1, 6) AS w, round(y2 - y1, 6) AS h FROM bx")
def box_formats(spark, sf):
    """Corner boxes to centre form, through both conversions."""
    c = G.to_cxcywh(F.struct("x1", "y1", "x2", "y2"))
    back = G.to_cxcywh(G.from_cxcywh(F.col("c.cx"), F.col("c.cy"), F.col("c.w"), F.col("c.h")))
    return _boxes(spark, sf).withColumn("c", c).withColumn("d", back).select("f", "box_id", *[F.round(f"d.{k}", 6).alias(k) for k in ("cx", "cy", "w", "h")])


@query(f"""WITH {_B}, k AS (SELECT unnest([0, 1, 2]) AS scale) SELECT f, id AS box_id, scale, round(greatest(x1 - g * (x2 - x1), 0), 6) AS x1, round(least(x2 + g * (x2 - x1), 100), 6) AS x2
FROM (SELECT *, 0.2 * greatest(scale - 1, 0) AS g FROM bx, k)""")
def multi_scale_crops(spark, sf):
    """Three crops of each box, the last 20 % larger per side."""
    b = _boxes(spark, sf).select("f", "box_id", F.posexplode(G.multi_scale(F.struct("x1", "y1", "x2", "y2"), 100, 100)).alias("scale", "c"))
    return b.select("f", "box_id", "scale", F.round("c.x1", 6).alias("x1"), F.round("c.x2", 6).alias("x2"))


@query(f"""WITH {_B}, e AS (SELECT f, id, (abs(x1 - 10) <= 5 AND abs(x1) > 5) OR (abs(y1 - 0) <= 5 AND abs(y1) > 5) OR (abs(x2 - 60) <= 5 AND abs(x2 - 100) > 5) OR (abs(y2 - 50) <= 5 AND abs(y2 - 100) > 5) AS edge FROM bx) SELECT f, id AS box_id, edge FROM e""")
def crop_edge(spark, sf):
    """Boxes that touch an edge of their crop."""
    crop = G.box(10.0, 0.0, 60.0, 50.0)
    return _boxes(spark, sf).select("f", "box_id", G.near_crop_edge(F.struct("x1", "y1", "x2", "y2"), crop, 100, 100, 5.0).alias("edge"))


@query("""WITH b AS (SELECT c_custkey AS id, c_nationkey AS f, c_custkey % 37 AS x1, c_custkey % 23 AS y1, c_custkey % 37 + 1 + c_custkey % 5 AS x2, c_custkey % 23 + 1 + c_custkey % 3 AS y2, c_acctbal AS score FROM customer),
px AS (SELECT f, unnest(range(y1, least(y2, 24))) AS r, x1, x2, y1, y2, id, score FROM b), p2 AS (SELECT f, r, unnest(range(x1, least(x2, 40))) AS c, (x2 - x1) * (y2 - y1) AS a, id, score FROM px)
SELECT f, r::INT AS row, c::INT AS col, id AS label, score FROM p2 QUALIFY row_number() OVER (PARTITION BY f, r, c ORDER BY a, id DESC) = 1""")
def paint_boxes(spark, sf):
    """A label raster in which smaller boxes paint over larger ones."""
    k = F.col("c_custkey")
    b = _read(spark, sf, "customer").select(F.col("c_nationkey").alias("f"), k.alias("box_id"), k.alias("label"), F.col("c_acctbal").alias("score"), (k % 37).cast("double").alias("x1"), (k % 23).cast("double").alias("y1"), (k % 37 + 1 + k % 5).cast("double").alias("x2"), (k % 23 + 1 + k % 3).cast("double").alias("y2"))
    return labels.paint_boxes(b, ["f"], height=24, width=40)


# --- time, text, labels ------------------------------------------------------------------------------


@query("""WITH c AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'), o AS (SELECT event_id AS match_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type <> 'click')
SELECT c.user_id, c.event_id, o.match_id, abs(c.t - o.t) AS distance FROM c JOIN o ON o.user_id = c.user_id AND abs(c.t - o.t) < 21600000000
QUALIFY row_number() OVER (PARTITION BY c.event_id ORDER BY abs(c.t - o.t), o.t DESC, o.match_id) = 1""")
def asof_nearest(spark, sf):
    """Each click's nearest other event of its user, within six hours."""
    e = _read(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return matching.asof_nearest(e.where("event_type = 'click'"), e.where("event_type <> 'click'"), by=["user_id"], left_id="event_id", right_id="event_id", tolerance=6 * 3600 * 1_000_000)


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, avg(value) AS m FROM events GROUP BY 1, 2) SELECT user_id, event_type, n, round(m, 6) AS mean_score FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1""")
def label_mode(spark, sf):
    """Each user's modal event type and its mean value."""
    return labels.modal_label(_read(spark, sf, "events"), ["user_id"], label="event_type", score="value").select("user_id", "event_type", "n", _r("mean_score"))


_S = "s AS (SELECT c_nationkey::BIGINT AS inst_id, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS class_id, c_acctbal AS v FROM customer), z AS (SELECT inst_id, class_id, round(avg(v), 6) AS score FROM s GROUP BY 1, 2)"


def _segment_scores(spark, sf):
    c = _read(spark, sf, "customer")
    return masks.densify(c, "c_mktsegment", to="class_id").groupBy(F.col("c_nationkey").cast("bigint").alias("inst_id"), "class_id").agg(F.round(F.avg("c_acctbal"), 6).alias("score"))


@query(f"WITH {_S} SELECT inst_id, class_id, score, inst_id * 5 + class_id AS flat FROM z ORDER BY score DESC, inst_id, class_id LIMIT 20")
def topk_flat(spark, sf):
    """The twenty best (instance, class) pairs and their flat index."""
    top = labels.top_k(_segment_scores(spark, sf), 20).withColumn("flat", F.col("inst_id") * 5 + F.col("class_id"))
    i, c = labels.unflatten(F.col("flat"), 5)
    return top.select(i.alias("inst_id"), c.alias("class_id"), "score", "flat")


@query(f"WITH {_S} SELECT inst_id, class_id, score FROM z QUALIFY row_number() OVER (PARTITION BY inst_id ORDER BY score DESC, class_id) = 1")
def best_class(spark, sf):
    """Each instance's best class."""
    return labels.best_class(_segment_scores(spark, sf), ["inst_id"])


@query("SELECT c_custkey, coalesce(r_regionkey, -100) AS label FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND r_name <> 'ASIA'")
def label_remap(spark, sf):
    """Sparse labels to dense ones; the rest become the sentinel."""
    n = _read(spark, sf, "nation").join(_read(spark, sf, "region").where("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return evaluation.remap(_read(spark, sf, "customer", "c_custkey", F.col("c_nationkey").alias("label")), "label", n, "n_nationkey", "r_regionkey")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 - 3 + 1 < 0 THEN 0 ELSE (o_orderkey % 20)::BIGINT * 1000 + o_custkey % 5 - 3 + 1 END AS code FROM orders")
def gt_encode(spark, sf):
    """Class and instance in one code; ignored instances are 0."""
    return _read(spark, sf, "orders").select("o_orderkey", evaluation.encode_gt(F.col("o_orderkey") % 20, F.col("o_custkey") % 5 - 3).alias("code"))


@query("SELECT doc_id, CASE WHEN ends_with(t, '.') THEN t ELSE t || '.' END AS caption FROM (SELECT item_id AS doc_id, trim(lower(text)) AS t FROM benchmark)")
def caption_norm(spark, sf):
    """Captions in lower case with a full stop."""
    return _read(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), X.caption(F.col("text")).alias("caption"))


@query("SELECT doc_id, CASE WHEN ends_with(t, '.') THEN t ELSE t || '.' END AS caption FROM (SELECT doc_id, trim(lower(text)) AS t FROM documents)")
def caption_norm_documents(spark, sf):
    """Captions of the whole documents table."""
    return _read(spark, sf, "documents").select("doc_id", X.caption(F.col("text")).alias("caption"))


@query("""WITH n AS (SELECT DISTINCT p_brand FROM part), r AS (SELECT p_brand, (row_number() OVER (ORDER BY p_brand) - 1) // 5 AS k FROM n) SELECT k::INT AS chunk, string_agg(p_brand, '.' ORDER BY p_brand) AS names FROM r GROUP BY 1""")
def vocab_chunk(spark, sf):
    """A vocabulary in chunks of five joined names."""
    v = _read(spark, sf, "part").agg(F.array_sort(F.collect_set("p_brand")).alias("names"))
    return v.select(F.posexplode(X.chunks(F.col("names"), 5)).alias("chunk", "names"))


@query("SELECT p_partkey, upper(substr(p_name, 1, 1)) AS initial, CASE WHEN lower(substr(p_name, 1, 1)) IN ('a', 'e', 'i', 'o', 'u') THEN 'an' ELSE 'a' END AS article, replace(replace(lower(p_type), '_', ' '), '/', ' or ') AS name, p_brand || '_' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') AS numbered FROM part")
def name_functions(spark, sf):
    return _read(spark, sf, "part").select("p_partkey", F.upper(F.substring("p_name", 1, 1)).alias("initial"), X.article(F.col("p_name")).alias("article"), X.processed_name(F.col("p_type")).alias("name"), X.numbered(F.col("p_brand"), F.col("p_partkey") % 1000).alias("numbered"))


_QT = "VALUES ('q0', 0, 4000.0, 2), ('q1', 1, 5000.0, 0), ('q2', 3, 4800.0, 1)"


@query(f"WITH {_S}, q(query_id, class_id, least, k) AS ({_QT}) SELECT query_id, inst_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, inst_id) AS rank FROM q JOIN z ON z.class_id = q.class_id AND score > least QUALIFY k = 0 OR rank <= k")
def query_table(spark, sf):
    """Several queries with their own thresholds in one join."""
    q = spark.sql(f"SELECT col1 AS query_id, CAST(col2 AS STRING) AS query, CAST(col3 AS DOUBLE) AS Score_min, col4 AS num_filter, 'v' AS video_id, 0 AS size_shrink FROM {_QT}")
    s = _segment_scores(spark, sf).select(F.lit("v").alias("video_id"), F.col("class_id").cast("string").alias("query"), "inst_id", "score")
    return scenes.query_table(q, s).select("query_id", "inst_id", "score", F.col("rank").cast("bigint").alias("rank"))


# --- evaluation --------------------------------------------------------------------------------------

_AP = """ev AS (SELECT d.lang AS cls, d.n_chars AS score, l.quality AS tp FROM labels l JOIN documents d USING (doc_id)), g AS (SELECT cls, score, sum(tp) AS tp, count(*) AS n FROM ev GROUP BY 1, 2),
c AS (SELECT cls, score, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY cls) AS pos FROM g WINDOW w AS (PARTITION BY cls ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT cls, score::DOUBLE AS score, ctp / cn AS p, ctp / pos AS r FROM c UNION ALL SELECT DISTINCT cls, 'infinity'::DOUBLE, 1.0, 0.0 FROM ev),
st AS (SELECT cls, p, r, 0.5 * (coalesce(lag(r) OVER o, r) - coalesce(lead(r) OVER o, 0)) AS s FROM pr WINDOW o AS (PARTITION BY cls ORDER BY score)), ap AS (SELECT cls, sum(p * s) AS ap, max(r) AS recall FROM st GROUP BY 1)"""


def _ap(spark, sf):
    ev = _read(spark, sf, "labels").join(_read(spark, sf, "documents", "doc_id", "lang", "n_chars"), "doc_id").select(F.col("lang").alias("cls"), F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("tp"))
    flags = ev.groupBy("cls").agg(F.lit(0).alias("hard_fn"), (F.sum("tp") > 0).alias("has_gt"), F.lit(True).alias("has_pred"))
    return evaluation.average_precision(ev, flags, ["cls"])


@query(f"WITH {_AP} SELECT cls, round(ap, 6) AS ap, round(recall, 6) AS recall FROM ap")
def ap_pr_curve(spark, sf):
    """Average precision from the precision-recall curve."""
    return _ap(spark, sf).select("cls", _r("ap"), _r("recall"))


@query(f"WITH {_AP} SELECT CASE WHEN cls IN ('en', 'de') THEN 'germanic' ELSE 'romance' END AS grp, round(avg(ap), 6) AS ap FROM ap GROUP BY 1 UNION ALL SELECT 'all', round(avg(ap), 6) FROM ap")
def group_report(spark, sf):
    """Means of groups of classes and of all."""
    groups = spark.createDataFrame([("en", "germanic"), ("de", "germanic"), ("fr", "romance"), ("es", "romance")], "cls string, grp string")
    return evaluation.grouped_report(_ap(spark, sf), groups, ["ap"], on="cls").select("grp", _r("ap"))


_CF = "cf AS (SELECT quality AS gt, toxic AS pred, count(*) AS n FROM labels GROUP BY 1, 2)"


@query(f"""WITH {_CF}, a AS (SELECT gt AS cls, sum(n) AS ng, sum(CASE WHEN gt = pred THEN n ELSE 0 END) AS tp FROM cf GROUP BY 1), b AS (SELECT pred AS cls, sum(n) AS np FROM cf GROUP BY 1)
SELECT cls, coalesce(tp, 0)::BIGINT AS tp, (coalesce(np, 0) - coalesce(tp, 0))::BIGINT AS fp, (coalesce(ng, 0) - coalesce(tp, 0))::BIGINT AS fn, round(coalesce(tp, 0) / (coalesce(ng, 0) + coalesce(np, 0) - coalesce(tp, 0)), 6) AS iou, round(tp / ng, 6) AS accuracy FROM a FULL JOIN b USING (cls)""")
def confusion_miou(spark, sf):
    """Class IoU and accuracy from a confusion table."""
    return evaluation.class_iou(evaluation.confusion(_read(spark, sf, "labels"), "quality", "toxic")).select("cls", "tp", "fp", "fn", _r("iou"), _r("accuracy"))


@query("""WITH s AS (SELECT lang AS tag, n_chars, doc_id, quality AS t FROM labels JOIN documents USING (doc_id)), r AS (SELECT tag, t, row_number() OVER w AS n, sum(t) OVER w AS tp FROM s WINDOW w AS (PARTITION BY tag ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING))
SELECT tag, round(coalesce(sum(CASE WHEN t = 1 THEN tp / n END) / sum(t), 0), 6) AS ap, sum(t)::BIGINT AS n_pos FROM r GROUP BY 1""")
def tag_map(spark, sf):
    """Rank average precision per tag."""
    s = _read(spark, sf, "labels").join(_read(spark, sf, "documents", "doc_id", "lang", "n_chars"), "doc_id").select("doc_id", F.col("lang").alias("tag"), F.col("n_chars").alias("score"), F.col("quality").cast("bigint").alias("truth"))
    return evaluation.tag_precision(s, id="doc_id").select("tag", _r("ap"), "n_pos")


@query("""WITH s AS (SELECT lang AS tag, (n_chars > 1500)::INT AS p, quality AS t FROM labels JOIN documents USING (doc_id)) SELECT tag, round(sum(p * t) / sum(p), 6) AS precision, round(sum(p * t) / sum(t), 6) AS recall FROM s GROUP BY 1""")
def tag_pr(spark, sf):
    """Precision and recall per tag at a threshold."""
    s = _read(spark, sf, "labels").join(_read(spark, sf, "documents", "doc_id", "lang", "n_chars"), "doc_id").select(F.col("lang").alias("tag"), F.col("n_chars").alias("score"), F.col("quality").alias("truth"))
    th = spark.createDataFrame([(x, 1500) for x in ("en", "fr", "de", "es")], "tag string, threshold int")
    return evaluation.tag_pr(s, th).select("tag", _r("precision"), _r("recall"))


_CV = "t AS (SELECT l_returnflag AS scan, l_suppkey AS g, l_partkey % 50 AS p, l_linenumber % 3 AS s, l_linenumber % 2 AS ps FROM lineitem)"


@query(f"""WITH {_CV}, ng AS (SELECT scan, g, s, count(*) AS ng FROM t GROUP BY 1, 2, 3), np AS (SELECT scan, p, ps, count(*) AS np FROM t GROUP BY 1, 2, 3), x AS (SELECT scan, g, p, s, count(*) AS x FROM t WHERE s = ps GROUP BY 1, 2, 3, 4),
i AS (SELECT x.scan, x.g, x.p, x.s, x / (ng + np - x) AS iou FROM x JOIN ng ON ng.scan = x.scan AND ng.g = x.g AND ng.s = x.s JOIN np ON np.scan = x.scan AND np.p = x.p AND np.ps = x.s),
b AS (SELECT scan, g, s, max(iou) AS iou FROM i GROUP BY 1, 2, 3),
tps AS (SELECT s, count(*) FILTER (iou >= 0.02) AS tp FROM (SELECT scan, p, s, max(iou) AS iou FROM i GROUP BY 1, 2, 3) GROUP BY 1), k AS (SELECT ps AS s, count(*) AS k FROM np GROUP BY 1)
SELECT ng.s AS cls, round(avg(coalesce(iou, 0)), 6) AS mucov, round(sum(coalesce(iou, 0) * ng) / sum(ng), 6) AS mwcov, round(coalesce(any_value(tp), 0) / any_value(k), 6) AS precision, round(coalesce(any_value(tp), 0) / count(*), 6) AS recall
FROM ng LEFT JOIN b ON b.scan = ng.scan AND b.g = ng.g AND b.s = ng.s LEFT JOIN tps ON tps.s = ng.s LEFT JOIN k ON k.s = ng.s GROUP BY 1""")
def instance_coverage(spark, sf):
    """Mean and weighted coverage of instances by predictions."""
    t = _read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("scan"), F.col("l_suppkey").alias("gt"), (F.col("l_partkey") % 50).alias("pred"), (F.col("l_linenumber") % 3).alias("sem"), (F.col("l_linenumber") % 2).alias("pred_sem"))
    return evaluation.coverage(t, threshold=0.02).select("cls", _r("mucov"), _r("mwcov"), _r("precision"), _r("recall"))


_MT = """p AS (SELECT DISTINCT l_returnflag AS scan, l_suppkey AS pred_id, l_partkey AS pt FROM lineitem), g AS (SELECT f.scan, p_partkey AS pt, (p_size % 5 + 1)::BIGINT * 1000 + p_partkey % 7 + 1 AS gt_id FROM part, (SELECT DISTINCT l_returnflag AS scan FROM lineitem) f),
np AS (SELECT scan, pred_id, count(*) AS np FROM p GROUP BY 1, 2), ng AS (SELECT scan, gt_id, count(*) AS ng FROM g GROUP BY 1, 2),
e AS (SELECT p.scan, pred_id, gt_id, count(*) AS inter FROM p JOIN g ON g.scan = p.scan AND g.pt = p.pt GROUP BY 1, 2, 3)"""


def _match_tables(spark, sf):
    l = _read(spark, sf, "lineitem", F.col("l_returnflag").alias("scan"), F.col("l_suppkey").alias("pred_id"), F.col("l_partkey").alias("point_id")).distinct()
    part = _read(spark, sf, "part").select(F.col("p_partkey").alias("point_id"), evaluation.encode_gt(F.col("p_size") % 5 + 1, F.col("p_partkey") % 7).alias("code"))
    scans = spark.createDataFrame([("A",), ("N",), ("R",)], "scan string")
    return l, part.join(F.broadcast(scans))


@query(f"WITH {_MT} SELECT e.scan, e.pred_id, e.gt_id, inter, round(inter / (np + ng - inter), 6) AS iou FROM e JOIN np ON np.scan = e.scan AND np.pred_id = e.pred_id JOIN ng ON ng.scan = e.scan AND ng.gt_id = e.gt_id")
def gt_match_edges(spark, sf):
    """Predictions and instances that share points."""
    p, g = _match_tables(spark, sf)
    return evaluation.match_edges(p, g).select("scan", "pred_id", "gt_id", "inter", _r("iou"))


@query(f"""WITH {_MT}, i AS (SELECT e.scan, e.pred_id, e.gt_id, inter / (np + ng - inter + 1e-5) AS iou FROM e JOIN np ON np.scan = e.scan AND np.pred_id = e.pred_id JOIN ng ON ng.scan = e.scan AND ng.gt_id = e.gt_id)
SELECT scan, pred_id, gt_id, gt_id // 1000 AS label_id, round(iou, 6) AS iou FROM i QUALIFY row_number() OVER (PARTITION BY scan, pred_id ORDER BY iou DESC, gt_id) = 1""")
def oracle_class(spark, sf):
    """Each prediction's best instance and its class."""
    p, g = _match_tables(spark, sf)
    return evaluation.best_match(p, g).select("scan", "pred_id", "gt_id", F.col("label_id").cast("bigint").alias("label_id"), _r("iou"))


@query(f"""WITH RECURSIVE {_MT}, pl AS (SELECT scan, pred_id, np AS n, (pred_id % 5 + 1)::INT AS label_id, pred_id % 11 / 11.0 AS conf FROM np WHERE np >= 10), gl AS (SELECT scan, gt_id, ng, (gt_id // 1000)::INT AS label_id FROM ng),
el AS MATERIALIZED (SELECT e.scan, pl.label_id, e.pred_id, e.gt_id, inter, inter / (n + ng - inter) AS iou, ng FROM e JOIN pl ON pl.scan = e.scan AND pl.pred_id = e.pred_id JOIN gl ON gl.scan = e.scan AND gl.gt_id = e.gt_id AND gl.label_id = pl.label_id),
th AS (SELECT unnest([0.02::DOUBLE, 0.04::DOUBLE]) AS overlap), x AS (SELECT scan, label_id, overlap, gt_id, pred_id FROM el, th WHERE ng >= 10 AND iou > overlap),
o AS MATERIALIZED (SELECT scan, label_id, overlap, gt_id, list(pred_id ORDER BY pred_id) AS ps, row_number() OVER (PARTITION BY scan, label_id, overlap ORDER BY gt_id) AS r FROM x GROUP BY 1, 2, 3, 4),
st(scan, label_id, overlap, r, gt_id, free, taken) AS (SELECT DISTINCT scan, label_id, overlap, 0::BIGINT, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM o
 UNION ALL SELECT o.scan, o.label_id, o.overlap, o.r, o.gt_id, [z FOR z IN o.ps IF NOT list_contains(st.taken, z)], list_concat(st.taken, [z FOR z IN o.ps IF NOT list_contains(st.taken, z)][1:1]) FROM st JOIN o ON o.scan = st.scan AND o.label_id = st.label_id AND o.overlap = st.overlap AND o.r = st.r + 1),
fr AS (SELECT scan, label_id, overlap, gt_id, unnest(free) AS pred_id FROM st WHERE r > 0), ma AS (SELECT fr.*, conf, (row_number() OVER (PARTITION BY fr.scan, fr.label_id, overlap, gt_id ORDER BY conf DESC) = 1)::INT AS tp FROM fr JOIN pl ON pl.scan = fr.scan AND pl.pred_id = fr.pred_id),
un AS (SELECT pl.label_id, overlap, conf FROM pl, th WHERE NOT EXISTS (SELECT 1 FROM el WHERE el.scan = pl.scan AND el.pred_id = pl.pred_id AND iou > overlap) AND coalesce((SELECT sum(inter) FROM el WHERE el.scan = pl.scan AND el.pred_id = pl.pred_id AND ng < 10), 0) / n <= overlap),
ev AS (SELECT label_id, overlap, conf, tp FROM ma UNION ALL SELECT label_id, overlap, conf, 0 FROM un), big AS (SELECT label_id, overlap, count(*) AS big FROM gl, th WHERE ng >= 10 GROUP BY 1, 2),
gr AS (SELECT label_id, overlap, conf, sum(tp) AS tp, count(*) AS n FROM ev GROUP BY 1, 2, 3), c AS (SELECT label_id, overlap, conf, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM gr WINDOW w AS (PARTITION BY label_id, overlap ORDER BY conf DESC ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT c.label_id, c.overlap, conf::DOUBLE AS conf, ctp / cn AS p, ctp / big AS r FROM c JOIN big ON big.label_id = c.label_id AND big.overlap = c.overlap UNION ALL SELECT DISTINCT label_id, overlap, 'infinity'::DOUBLE, 1.0, 0.0 FROM ev),
sp AS (SELECT *, 0.5 * (coalesce(lag(r) OVER w, r) - coalesce(lead(r) OVER w, 0)) AS s FROM pr WINDOW w AS (PARTITION BY label_id, overlap ORDER BY conf))
SELECT label_id, overlap, round(sum(p * s), 6) AS ap, round(max(r), 6) AS recall FROM sp GROUP BY 1, 2""")
def instance_ap(spark, sf):
    """AP by class and threshold of suppliers as predictions of parts' instances."""
    p, g = _match_tables(spark, sf)
    preds = p.select("scan", "pred_id").distinct().select("scan", "pred_id", (F.col("pred_id") % 5 + 1).cast("int").alias("label_id"), (F.col("pred_id") % 11 / 11.0).alias("conf"))
    return evaluation.evaluate(preds, p, g, [1, 2, 3, 4, 5], overlaps=[0.02, 0.04], min_points=10).select("label_id", "overlap", _r("ap"), _r("recall"))


@query("SELECT l_suppkey, round(avg(greatest(x, 0) - x * t + ln(1 + exp(-abs(x)))), 6) AS bce, round(1 - (2 * sum(t / (1 + exp(-x))) + 1) / (sum(1 / (1 + exp(-x))) + sum(t) + 1), 6) AS dice FROM (SELECT l_suppkey, (l_quantity - 25) / 10 AS x, (l_discount > 0.05)::INT AS t FROM lineitem) GROUP BY 1")
def mask_losses(spark, sf):
    """Dice and cross-entropy losses of masks."""
    l = _read(spark, sf, "lineitem").select("l_suppkey", ((F.col("l_quantity") - 25) / 10).alias("x"), (F.col("l_discount") > 0.05).cast("int").alias("t"))
    return evaluation.losses(l, "x", "t", ["l_suppkey"]).select("l_suppkey", _r("bce"), _r("dice"))


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 19 PRECEDING), 9) AS avg, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 9) AS global_avg, round(median(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 19 PRECEDING), 9) AS median FROM events")
def smoothed_values(spark, sf):
    """Windowed median and mean."""
    return evaluation.smoothed(_read(spark, sf, "events", "user_id", "event_id", "value"), "value", "event_id", 20, ["user_id"]).select("user_id", "event_id", _r("avg", 9), _r("global_avg", 9), _r("median", 9))


# --- space -------------------------------------------------------------------------------------------

_P = "pt AS (SELECT vec_id AS id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


def _points(spark, sf):
    e = F.col("embedding")
    return _read(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), "label", *[e[k].cast("double").alias(a) for k, a in enumerate("xyz")])


_D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


@query(f"WITH {_P} SELECT a.id AS query_id, b.id AS point_id, (row_number() OVER (PARTITION BY a.id ORDER BY b.id) - 1)::INT AS n FROM pt a, pt b WHERE {_D2} < 0.01 QUALIFY n < 8")
def ball_query(spark, sf):
    """The first eight points within a radius."""
    p = _points(spark, sf)
    return spatial.ball_query(p.withColumnRenamed("point_id", "query_id"), p, 0.1, 8).select("query_id", "point_id", F.col("n").cast("int").alias("n"))


@query(f"WITH {_P} SELECT a.id AS query_id, b.id AS point_id, round({_D2}, 9) AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.id) AS rank FROM pt a, pt b QUALIFY rank <= 3")
def three_nn(spark, sf):
    """The three nearest points."""
    p = _points(spark, sf)
    return spatial.nearest(p.withColumnRenamed("point_id", "query_id"), p, 3).select("query_id", "point_id", _r("d2", 9), F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {_P}, n AS (SELECT a.id, b.id AS o, b.label, {_D2} AS d2 FROM pt a, pt b QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.id) <= 3)
SELECT id AS query_id, round(sum(label / (sqrt(d2) + 1e-8)) / sum(1 / (sqrt(d2) + 1e-8)), 4) AS value FROM n GROUP BY 1""")
def three_interpolate(spark, sf):
    """Inverse-distance interpolation from three neighbours."""
    p = _points(spark, sf)
    near = spatial.nearest(p.withColumnRenamed("point_id", "query_id").drop("label"), p, 3)
    return spatial.interpolate(near, p.select("point_id", F.col("label").alias("value")), keys=["query_id"]).select("query_id", _r("value", 4))


@query(f"""WITH {_P}, u AS (SELECT *, CASE WHEN id % 4 <> 0 THEN label END AS l FROM pt), n AS (SELECT a.id, b.l FROM u a, u b WHERE a.l IS NULL AND b.l IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.id) = 1)
SELECT u.id AS point_id, coalesce(u.l, n.l) AS label FROM u LEFT JOIN n ON n.id = u.id""")
def fill_labels(spark, sf):
    """Undecided points with the label of the nearest decided one."""
    p = _points(spark, sf).withColumn("label", F.when(F.col("point_id") % 4 != 0, F.col("label")))
    return spatial.fill_labels(p, p.where("label IS NOT NULL")).select("point_id", "label")


@query(f"WITH {_P} SELECT a.id AS point_id, max((a.label <> b.label)::INT) AS boundary FROM pt a, pt b WHERE {_D2} < 0.01 GROUP BY 1")
def boundary_points(spark, sf):
    """Points with a differently labelled neighbour."""
    return spatial.boundary(_points(spark, sf), 0.1)


@query("""SELECT floor(l_quantity / 5)::BIGINT AS vx, floor(l_discount / 0.02)::BIGINT AS vy, l_linenumber::BIGINT AS vz, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1, 2, 3""")
def voxelize(spark, sf):
    """Voxel sums."""
    l = _read(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_linenumber").cast("double").alias("z"), F.col("l_extendedprice").alias("price"), F.col("l_orderkey").alias("point_id"))
    return spatial.voxelize(l, {"x": 5.0, "y": 0.02, "z": 1.0}, values=["price"], mode="sum").select("vx", "vy", "vz", "n", _r("price", 2))


@query(f"WITH {_P} SELECT floor(x / 0.1)::BIGINT AS vx, floor(y / 0.1)::BIGINT AS vy, floor(z / 0.1)::BIGINT AS vz, count(*) AS n, arg_min(label, id) AS label FROM pt GROUP BY 1, 2, 3")
def voxel_first(spark, sf):
    """The first point's label of each voxel."""
    return spatial.voxelize(_points(spark, sf), 0.1, values=["label"], mode="first")


@query(f"WITH {_P}, v AS (SELECT id, floor(x / 0.1)::BIGINT AS a, floor(y / 0.1)::BIGINT AS b, floor(z / 0.1)::BIGINT AS c FROM pt) SELECT id AS point_id, dense_rank() OVER (ORDER BY a, b, c) - 1 AS voxel_id FROM v")
def point_to_voxel(spark, sf):
    """Each point's voxel number."""
    return spatial.point_to_voxel(_points(spark, sf), 0.1).select("point_id", F.col("voxel_id").cast("bigint").alias("voxel_id"))


def _farthest_sql(k: int) -> str:
    """Each round takes, of each label, the point with the largest distance to those taken (ties: the smaller id)."""
    far = ["f0 AS (SELECT *, 'infinity'::DOUBLE AS far FROM pt)"]
    for n in range(k):
        far.append(f"w{n} AS MATERIALIZED (SELECT * FROM f{n} QUALIFY row_number() OVER (PARTITION BY label ORDER BY far DESC, id) = 1)")
        far.append(f"f{n + 1} AS MATERIALIZED (SELECT a.id, a.label, a.x, a.y, a.z, least(a.far, {_D2}) AS far FROM f{n} a JOIN w{n} b ON b.label = a.label)")
    return f"WITH {_P}, {', '.join(far)} " + " UNION ALL ".join(f"SELECT label, id AS point_id, {n}::BIGINT AS rank FROM w{n}" for n in range(k))


@query(_farthest_sql(8))
def farthest_points(spark, sf):
    """Farthest-point sampling per label."""
    return spatial.farthest_points(_points(spark, sf), ["label"], 8)


@query(f"""WITH {_P} SELECT label AS inst, count(*) AS n, round(avg(x), 6) AS mean_x, round(min(x), 6) AS min_x, round(max(x), 6) AS max_x FROM pt GROUP BY 1""")
def instance_info(spark, sf):
    """Centroids and boxes of instances."""
    p = _points(spark, sf).withColumnRenamed("label", "inst").withColumn("sem", F.col("inst"))
    return spatial.instance_info(p).select("inst", "n", _r("mean_x"), _r("min_x"), _r("max_x"))


@query("""WITH n AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderkey FROM orders JOIN n ON s = o_orderstatus WHERE o_orderkey % (CASE WHEN n > 50000 THEN 8 WHEN n >= 5000 THEN 6 ELSE 2 END) = 0""")
def strided_scan(spark, sf):
    """Every k-th point, k by the size of the scene."""
    stride = lambda n: F.when(n > 50000, 8).when(n >= 5000, 6).otherwise(2)
    return spatial.strided(_read(spark, sf, "orders"), scope=["o_orderstatus"], id="o_orderkey", stride=stride).select("o_orderkey")


@query("SELECT o_orderkey, (o_orderkey % 4)::INT AS part FROM orders")
def interleave(spark, sf):
    """Points dealt to four parts."""
    return spatial.interleave(_read(spark, sf, "orders", "o_orderkey"), 4, "o_orderkey")


@query("""SELECT l_orderkey, l_partkey, bx, unnest(range(greatest(ceil((l_discount * 300 - 10) / 10), 0)::INT, floor(l_discount * 300 / 10)::INT + 1))::INT AS by FROM
(SELECT *, unnest(range(greatest(ceil((l_quantity - 10) / 10), 0)::INT, floor(l_quantity / 10)::INT + 1))::INT AS bx FROM lineitem)""")
def split_blocks(spark, sf):
    """Points with the closed blocks they lie in."""
    l = _read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").alias("x"), (F.col("l_discount") * 300).alias("y"))
    return spatial.split_blocks(l, 10.0).select("l_orderkey", "l_partkey", "bx", "by")


@query("""WITH p AS (SELECT p_partkey AS id, (p_size - 25) / 10.0 AS x, (p_partkey % 21 - 10) / 5.0 AS y, 1 + p_retailprice / 1000 AS z FROM part), q AS (SELECT id, 100 * x / z + 64 AS u, 100 * y / z + 48 AS v FROM p),
r AS (SELECT id, round_even(u, 0)::INT AS c, round_even(v, 0)::INT AS r FROM q) SELECT id AS point_id, r AS row, c AS col, floor(r * 240 / 96.0)::INT AS big_row FROM r WHERE c >= 2 AND r >= 2 AND c < 126 AND r < 94""")
def pinhole_project(spark, sf):
    """Projection, rounding half to even, frustum test and rescaling of pixels."""
    k = G.camera(100.0, 100.0, 64.0, 48.0)
    p = _read(spark, sf, "part").select(F.col("p_partkey").alias("point_id"), ((F.col("p_size") - 25) / 10.0).alias("x"), ((F.col("p_partkey") % 21 - 10) / 5.0).alias("y"), (1 + F.col("p_retailprice") / 1000).alias("z"))
    col, row = G.pinhole(F.col("x"), F.col("y"), F.col("z"), k)
    return p.select("point_id", row.alias("row"), col.alias("col")).where(G.in_frame(F.col("row"), F.col("col"), 96, 128, 2)).withColumn("big_row", G.rescale_pixel(F.col("row"), 96, 240))


@query("""WITH p AS (SELECT p_partkey AS id, p_size % 10 AS r, p_partkey % 12 AS c, p_retailprice AS z FROM part) SELECT id AS point_id, r AS row, c::INT AS col, z FROM p QUALIFY z - min(z) OVER (PARTITION BY r, c) <= 150""")
def z_buffer(spark, sf):
    """The points of a pixel that nothing hides."""
    p = _read(spark, sf, "part").select(F.lit("s").alias("scene_id"), F.lit("f").alias("frame_id"), F.col("p_partkey").alias("point_id"), (F.col("p_size") % 10).alias("row"), (F.col("p_partkey") % 12).cast("int").alias("col"), F.col("p_retailprice").alias("z"))
    return scenes.z_buffer(p, 150.0).select("point_id", "row", "col", "z")


@query("""SELECT id AS point_id, round(cos(a) * x - sin(a) * y, 6) AS rx, round(sin(a) * x + cos(a) * y, 6) AS ry, round((x - lo) / (hi - lo), 6) AS sx FROM
(SELECT p_partkey AS id, p_size::DOUBLE AS x, p_retailprice / 100 AS y, p_partkey / 100.0 AS a, min(p_size) OVER () AS lo, max(p_size) OVER () AS hi FROM part)""")
def rotate_rescale(spark, sf):
    """Rotation about an axis and rescaling to a range."""
    p = _read(spark, sf, "part").select(F.col("p_partkey").alias("point_id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"), (F.col("p_partkey") / 100.0).alias("a"))
    ends = p.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    rx, ry, _ = G.rotate_about("z", F.col("a"), F.col("x"), F.col("y"), F.lit(0.0))
    return p.join(F.broadcast(ends)).select("point_id", F.round(rx, 6).alias("rx"), F.round(ry, 6).alias("ry"), F.round(G.rescale(F.col("x"), F.col("lo"), F.col("hi")), 6).alias("sx"))


# --- assignment, sinks -------------------------------------------------------------------------------


def _slots_sql() -> str:
    """The least cost of each set of slots, order after order: without the order, or with it in one of the set's slots."""
    one = ["least(" + ", ".join([f"st.c[{m + 1}]", *[f"st.c[{m - (1 << b) + 1}] + o.c{b}" for b in range(3) if m >> b & 1]]) + ")" if m else "0.0" for m in range(8)]
    return f"""WITH RECURSIVE o AS MATERIALIZED (SELECT o_custkey AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, {", ".join(f"(abs(o_orderkey % 17 - {b * 5}) + o_orderkey % 3 * {b})::DOUBLE AS c{b}" for b in range(3))} FROM orders),
st(g, r, c) AS (SELECT DISTINCT g, 0::BIGINT, [0.0, 1e9, 1e9, 1e9, 1e9, 1e9, 1e9, 1e9]::DOUBLE[] FROM o UNION ALL SELECT o.g, o.r, [{", ".join(one)}]::DOUBLE[] FROM st JOIN o ON o.g = st.g AND o.r = st.r + 1),
l AS (SELECT g, r, c FROM st QUALIFY row_number() OVER (PARTITION BY g ORDER BY r DESC) = 1)
SELECT g AS o_custkey, least(r, 3)::BIGINT AS n, CASE WHEN r >= 3 THEN c[8] WHEN r = 2 THEN least(c[4], c[6], c[7]) ELSE least(c[2], c[3], c[5]) END AS cost FROM l"""


@query(_slots_sql())
def hungarian(spark, sf):
    """The least total cost of giving three slots to a customer's orders."""
    o, b = _read(spark, sf, "orders", "o_custkey", F.col("o_orderkey").alias("a")), F.col("b")
    costs = o.withColumn("b", F.explode(F.array(*map(F.lit, range(3))))).withColumn("cost", (F.abs(F.col("a") % 17 - b * 5) + F.col("a") % 3 * b).cast("double"))
    return matching.optimal_assignment(costs, ["o_custkey"]).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))


@query(f"WITH {_RUNS} SELECT m AS inst_id, '{{\"length\":2000000,\"counts\":[' || string_agg(s::VARCHAR || ',' || n::VARCHAR, ',' ORDER BY s) || ']}}' AS value FROM r GROUP BY 1")
def submission_json(spark, sf):
    """Run lengths as JSON for a submission."""
    enc = masks.rle_encode(_mask_rows(spark, sf), ["inst_id"], length=2_000_000).withColumn("scene_id", F.lit("s"))
    return writers.rle_json(enc).select("inst_id", "value")


@query("SELECT 'predicted_masks/' || c_mktsegment || '_' || lpad(c_nationkey::VARCHAR, 3, '0') || '.json 3 ' || count(*)::VARCHAR AS value FROM customer GROUP BY c_mktsegment, c_nationkey")
def submission_manifest(spark, sf):
    """Lines of a submission's manifest."""
    c = _read(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("scene_id"), F.col("c_nationkey").alias("inst_id")).agg(F.count(F.lit(1)).alias("score"), F.lit(3).alias("class_id"))
    return writers.manifest(c).select("value")


@query("SELECT n_regionkey AS inst_id, i AS point_id, CASE WHEN n.n_nationkey IS NULL THEN '0' ELSE '1' END AS value FROM (SELECT r_regionkey, unnest(range(25)) AS i FROM region) r LEFT JOIN nation n ON n_regionkey = r_regionkey AND n_nationkey = i".replace("SELECT n_regionkey AS", "SELECT r_regionkey AS"))
def dense_masks(spark, sf):
    """Dense 0/1 masks."""
    n = _read(spark, sf, "nation").select(F.lit("s").alias("scene_id"), F.col("n_regionkey").alias("inst_id"), F.col("n_nationkey").cast("bigint").alias("point_id"))
    return writers.dense_masks(n, spark.createDataFrame([("s", 25)], "scene_id string, n bigint")).select("inst_id", "point_id", "value")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal < 0)")
def pending_scenes(spark, sf):
    """Work that isn't done yet, by an anti-join."""
    o = _read(spark, sf, "orders", "o_orderkey", F.col("o_custkey").alias("scene_id"))
    done = _read(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("scene_id"))
    return writers.pending(o, done).select("o_orderkey")


@query("SELECT DISTINCT p_brand FROM part EXCEPT SELECT DISTINCT p_brand FROM part WHERE p_size > 48")
def set_difference(spark, sf):
    """Labels without those to ignore."""
    p = _read(spark, sf, "part", "p_brand", "p_size")
    return masks.set_operation("difference", p.select("p_brand"), p.where("p_size > 48").select("p_brand"))


@query("SELECT user_id, count(*) AS n FROM (SELECT user_id, date_trunc('hour', ts) AS h FROM events GROUP BY 1, 2) GROUP BY 1")
def visible_hours(spark, sf):
    """In how many hours (frames) each user (point) is seen."""
    e = _read(spark, sf, "events").select("user_id", F.date_trunc("hour", "ts").alias("h")).distinct()
    return masks.visibility(e.withColumnRenamed("user_id", "point_id"), []).select(F.col("point_id").alias("user_id"), F.col("visible").alias("n"))


@query("WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_suppkey, n, (sum(n) OVER (ORDER BY l_suppkey) - n)::BIGINT AS first FROM c")
def batch_offsets(spark, sf):
    """Where each group begins in the concatenation of all."""
    return masks.batch_offsets(_read(spark, sf, "lineitem"), "l_suppkey")


@query("""WITH c AS (SELECT o_custkey AS id, o_orderkey AS k, (floor(o_totalprice)::BIGINT % 5000) AS n FROM orders),
d AS (SELECT id, k, n, row_number() OVER (PARTITION BY id ORDER BY k) AS pos, lag(n, 2) OVER (PARTITION BY id ORDER BY k) AS two FROM c),
x AS (SELECT id, pos, n, CASE WHEN pos > 3 THEN n - two ELSE n END AS v FROM d),
u AS (SELECT id, pos, j, floor(v / pow(32, j))::BIGINT & 31 AS c, floor(v / pow(32, j + 1))::BIGINT AS rest FROM x, (SELECT unnest(range(5)) AS j)),
m AS (SELECT *, rest <> (CASE WHEN c & 16 <> 0 THEN -1 ELSE 0 END) AS more FROM u),
l AS (SELECT id, pos, min(j) FILTER (NOT more) AS last FROM m GROUP BY 1, 2)
SELECT m.id, string_agg(chr((c + CASE WHEN j < last THEN 32 ELSE 0 END + 48)::INT), '' ORDER BY m.pos, j) AS encoded, sum(CASE WHEN j = 0 THEN x.n ELSE 0 END)::BIGINT AS total
FROM m JOIN l ON l.id = m.id AND l.pos = m.pos JOIN x ON x.id = m.id AND x.pos = m.pos WHERE j <= last GROUP BY 1""")
def coco_round_trip(spark, sf):
    """Run lengths as compressed strings, and the sum of what these give back."""
    o = _read(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.struct("o_orderkey", F.pmod(F.floor("o_totalprice"), F.lit(5000)).alias("n")).alias("x"))
    lists = o.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["n"].cast("int")).alias("counts"))

    def run(batches):
        for b in batches:
            text = [formats.coco_encode_counts([int(n) for n in c]) for c in b["counts"]]
            yield pd.DataFrame({"id": b["id"], "encoded": text, "total": [sum(formats.coco_decode_counts(t)) for t in text]})

    return lists.mapInPandas(run, "id bigint, encoded string, total bigint")
