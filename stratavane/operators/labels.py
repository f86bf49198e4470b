"""Class scores, top-k, and who owns a contested pixel or point."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratavane import storage
from stratavane.functions import vectors as V
from stratavane.operators import masks

#: Classes (rows of a text-feature table) that are broadcast at a time.
BROADCAST_CLASSES = 20_000


def class_scores(features: DataFrame, classes: DataFrame, *, vector: str = "feat", emb: str = "emb", cls: str = "class_id", scale: float = 100.0) -> DataFrame:
    """Each row's ``scores``: (class, cosine, softmax of scale * cosine) over the text features, as an array.

    The vocabulary is one array row per executor, which a softmax over all classes needs whole: at most ``BROADCAST_CLASSES``
    (about 60 MB at 768 components), else an error; ``class_probabilities`` gives the same as rows and ``nearest_class`` the best class,
    by blocks and without a bound."""
    n = classes.count()
    if n > BROADCAST_CLASSES:
        raise ValueError(f"{n} classes; class_probabilities has no bound, this form has {BROADCAST_CLASSES}")
    table = classes.agg(F.array_sort(F.collect_list(F.struct(F.col(cls).alias("c"), F.col(emb).alias("e"), V.norm(F.col(emb)).alias("n")))).alias("_classes"))
    own = F.col(vector)
    cosine = lambda x, d: F.when(d == 0, F.lit(0.0)).otherwise(V.dot(own, x["e"]) / d)
    cosines = V.once(V.norm(own), lambda n: F.transform("_classes", lambda x: cosine(x, n * x["n"])))
    named = lambda cos, p: F.zip_with(F.zip_with("_classes", cos, lambda x, c: F.struct(x["c"].alias("c"), c.alias("cosine"))), p, lambda x, p: F.struct(x["c"].alias(cls), x["cosine"].alias("cosine"), p.alias("p")))
    # one expression, in which cosines and softmax are computed once: as columns they would be put in wherever they are used
    scores = V.once(cosines, lambda cos: named(cos, V.softmax(cos, scale)))
    return features.join(F.broadcast(table)).withColumn("scores", scores).drop("_classes")


def class_probabilities(features: DataFrame, classes: DataFrame, *, vector: str = "feat", emb: str = "emb", cls: str = "class_id", scale: float = 100.0, block: int = BROADCAST_CLASSES) -> DataFrame:
    """A row for each row and class with ``cosine`` and ``p``, the softmax of scale * cosine over all classes, over any number of them: a block of classes
    is broadcast at a time, first to find each row's greatest value and the sum of the exponentials, then to give the shares."""
    n = classes.count()
    blocks = max(1, -(-n // block))
    part = lambda k: classes if blocks == 1 else classes.where(F.pmod(F.xxhash64(cls), F.lit(blocks)) == k)
    table = lambda k: F.broadcast(part(k).agg(F.collect_list(F.struct(F.col(cls).alias("c"), F.col(emb).alias("e"))).alias("_classes")))
    cos = lambda x: V.cosine(F.col(vector), x["e"]).cast("double")
    out = features.withColumn("_m", F.lit(float("-inf"))).withColumn("_z", F.lit(0.0))
    for k in range(blocks):
        x = out.join(table(k)).withColumn("_cos", F.transform("_classes", lambda c: cos(c) * scale)).withColumn("_top", F.greatest("_m", F.coalesce(F.array_max("_cos"), F.lit(float("-inf")))))
        here = F.aggregate("_cos", F.lit(0.0), lambda a, c: a + F.exp(c - F.col("_top")))
        x = x.withColumn("_z", F.when(F.col("_m") > float("-inf"), F.col("_z") * F.exp(F.col("_m") - F.col("_top"))).otherwise(0.0) + here)
        out = x.withColumn("_m", F.col("_top")).drop("_classes", "_cos", "_top")
    out = storage.stage(out, "softmax")
    rows = [out.join(table(k)).withColumn("_c", F.explode(F.transform("_classes", lambda c: F.struct(c["c"].alias("c"), cos(c).alias("s"))))) for k in range(blocks)]
    share = F.exp(F.col("_c.s") * scale - F.col("_m")) / F.col("_z")
    return reduce(DataFrame.unionByName, rows).select(*[F.col(f"`{c}`") for c in features.columns], F.col("_c.c").alias(cls), F.col("_c.s").alias("cosine"), share.alias("p"))


def nearest_class(features: DataFrame, classes: DataFrame, *, vector: str = "feat", emb: str = "emb", cls: str = "class_id", block: int = BROADCAST_CLASSES) -> DataFrame:
    """Each row with its class of the greatest ``cosine`` (ties: the smaller id), over any number of classes: a block of them
    is broadcast at a time, and the best so far goes along."""
    n = classes.count()
    kind = dict(classes.dtypes)[cls]
    out = features.withColumn("_best", F.lit(None).cast(f"struct<s:double,c:{kind}>"))
    for k in range(max(1, -(-n // block))):
        part = classes if n <= block else classes.where(F.pmod(F.xxhash64(cls), F.lit(-(-n // block))) == k)
        table = part.agg(F.collect_list(F.struct(F.col(cls).alias("c"), F.col(emb).alias("e"))).alias("_classes"))
        found = F.array_min(F.transform("_classes", lambda x: F.struct((-V.cosine(F.col(vector), x["e"])).cast("double").alias("s"), x["c"].alias("c"))))
        out = out.join(F.broadcast(table)).withColumn("_best", F.least(F.col("_best"), found)).drop("_classes")
    return out.withColumn(cls, F.col("_best.c")).withColumn("cosine", -F.col("_best.s")).drop("_best")


def prototypes(df: DataFrame, label: str, vector: str) -> DataFrame:
    """The mean vector of each label."""
    return V.sum_vectors(df, [label], vector, mean=True)


def mask_scores(point_scores: DataFrame, inst: DataFrame, *, cls: str = "class_id") -> DataFrame:
    """Each instance's mean over its points of each class's score."""
    return inst.join(point_scores, ["scene_id", "point_id"]).select("scene_id", "inst_id", F.explode("scores").alias("s")).groupBy("scene_id", "inst_id", F.col(f"s.{cls}").alias(cls)).agg(F.avg("s.p").alias("score"))


def accumulate_features(mapping: DataFrame, pixels: DataFrame, mask_features: DataFrame, *, vector: str = "feat") -> DataFrame:
    """Each point's sum over frames of the features of all masks over its pixel.  Features are summed for each distinct set of
    pixels that points of a frame lie in, and then once for each (point, frame)."""
    frame = ["scene_id", "frame_id"]
    points = storage.stage(masks.views_of_points(mapping, frame), "views")
    over = masks.masks_over(points, pixels, frame=frame).join(mask_features, [*frame, "mask_id"])
    sums = V.sum_vectors(over, [*frame, "_at"], vector, weight=F.col("_n").cast("double"))
    return V.sum_vectors(points.join(sums, [*frame, "_at"]), ["scene_id", "point_id"], vector)


def weighted_features(views: DataFrame, *, keys: list[str], vector: str = "feat", weight: str = "conf") -> DataFrame:
    """The confidence-weighted sum of features, at unit length."""
    return V.sum_vectors(views, keys, vector, weight=F.col(weight)).withColumn(vector, V.normalize(F.col(vector)))


def mean_features(views: DataFrame, *, keys: list[str], vector: str = "feat") -> DataFrame:
    return V.sum_vectors(views, keys, vector, mean=True)


def superpoint_features(points: DataFrame, superpoints: DataFrame, *, vector: str = "feat") -> DataFrame:
    """The sum of the points' features of each superpoint, at unit length."""
    return V.sum_vectors(points.join(superpoints, ["scene_id", "point_id"]), ["scene_id", "spp"], vector).withColumn(vector, V.normalize(F.col(vector)))


def superpoint_pool(points: DataFrame, superpoints: DataFrame, values: list[str], *, vector: str | None = None) -> DataFrame:
    """The mean of each superpoint's point values (coordinates, box corners) and, if named, of their vectors."""
    keys = ["scene_id", "spp"]
    j = points.join(superpoints, ["scene_id", "point_id"])
    out = j.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])
    return out if vector is None else out.join(V.sum_vectors(j, keys, vector, mean=True), keys)


def superpoint_vote(points: DataFrame, superpoints: DataFrame, *, label: str = "label", score: str = "score") -> DataFrame:
    """Each superpoint's most frequent label (ties: the smaller), the share of its points that have it, and their mean score."""
    keys = ["scene_id", "spp"]
    j = points.join(superpoints, ["scene_id", "point_id"])
    size = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    return modal_label(j, keys, label=label, score=score).join(size, keys).select(*keys, label, (F.col("n") / F.col("_size")).alias("share"), "mean_score")


def top_k(scores: DataFrame, k: int, *, scope: list[str] = (), score: str = "score", ties: list[str] = ("inst_id", "class_id")) -> DataFrame:
    """The k best (instance, class) rows of each scope, over all classes at once."""
    if not scope:
        return scores.orderBy(F.desc(score), *ties).limit(k)
    w = Window.partitionBy(*scope).orderBy(F.desc(score), *ties)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def unflatten(index, n_classes: int):
    """(instance, class) of an index into flattened scores."""
    return F.floor(index / n_classes).cast("bigint"), F.pmod(index, F.lit(n_classes)).cast("bigint")


def best_class(scores: DataFrame, keys: list[str], *, cls: str = "class_id", score: str = "score") -> DataFrame:
    """Each key's best class (ties: the smaller)."""
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(cls)).alias("c"))).alias("_b")
    return scores.groupBy(*keys).agg(best).select(*keys, (-F.col("_b.c")).alias(cls), F.col("_b.s").alias(score))


def modal_label(df: DataFrame, keys: list[str], *, label: str = "label", score: str = "score") -> DataFrame:
    """Each key's most frequent label (ties: the smaller), its count and the mean score of its rows."""
    n = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), label)
    return n.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def panoptic(df: DataFrame, keys: list[str], *, score: str = "score", least: float = 0.5) -> DataFrame:
    """At each element the rows with the best score, if it exceeds ``least``; ties stay."""
    top = df.groupBy(*keys).agg(F.max(score).alias("_top"))
    return df.join(top, keys).where((F.col(score) == F.col("_top")) & (F.col(score) > least)).drop("_top")


def painter(inst: DataFrame, *, scope: list[str] = (), mask: str = "inst_id", element: str = "point_id", smallest_wins: bool = True, least: int = 0) -> DataFrame:
    """One mask per element: painted in order of size, the last one stays.  Ties: the larger id is painted
    last.  Masks with fewer than ``least`` elements left go."""
    scope = list(scope)
    d = inst.select(*scope, mask, element).distinct()
    size = d.groupBy(*scope, mask).agg(F.count(F.lit(1)).alias("_n"))
    rank = F.struct((-F.col("_n") if smallest_wins else F.col("_n")).alias("o"), F.col(mask).alias("m"))
    out = d.join(size, [*scope, mask]).groupBy(*scope, element).agg(F.max(rank).alias("_b")).select(*scope, F.col("_b.m").alias(mask), element)
    if not least:
        return out
    big = out.groupBy(*scope, mask).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= least).drop("_k")
    return out.join(big, [*scope, mask])


def paint_boxes(boxes: DataFrame, keys: list[str], *, height: int, width: int, id: str = "box_id", label: str = "label", score: str = "score") -> DataFrame:
    """A label raster: each pixel has the label and score of the smallest box over it (ties: larger id);
    pixels under no box have no row."""
    clip = lambda c, top: F.least(F.greatest(F.floor(c).cast("int"), F.lit(0)), F.lit(top))
    b = boxes.withColumn("_a", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    r0, r1, c0, c1 = clip("y1", height), clip("y2", height), clip("x1", width), clip("x2", width)
    b = b.where((r1 > r0) & (c1 > c0))
    px = b.withColumn("row", F.explode(F.sequence(r0, r1 - 1))).withColumn("col", F.explode(F.sequence(c0, c1 - 1)))
    best = F.max(F.struct((-F.col("_a")).alias("a"), F.col(id).alias("i"), F.col(label).alias("l"), F.col(score).alias("s"))).alias("_b")
    return px.groupBy(*keys, "row", "col").agg(best).select(*keys, "row", "col", F.col("_b.l").alias(label), F.col("_b.s").alias(score))


def tags_above(logits: DataFrame, thresholds: DataFrame, *, id: str = "image_id", vector: str = "logits") -> DataFrame:
    """Each image's tags, "a | b", whose sigmoid exceeds the tag's own threshold; thresholds: idx, tag, threshold."""
    x = logits.select(id, F.posexplode(vector).alias("idx", "v")).join(F.broadcast(thresholds), "idx").where(V.sigmoid(F.col("v")) > F.col("threshold"))
    return x.groupBy(id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "tag"))), lambda s: s["tag"]), " | ").alias("tags"))


def largest_region(pixels: DataFrame, keys: list[str], least: int, mode: str = "islands", height: int | None = None, width: int | None = None) -> DataFrame:
    """Masks without small regions under 8-neighbour connectivity: ``islands`` drops set regions of fewer
    than ``least`` pixels (the largest stays), ``holes`` fills unset ones."""
    from stratavane.operators.graph import connected_components

    px = pixels.select(*keys, "row", "col").distinct()
    if mode == "holes":
        frame = px.select(*keys).distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
        work = frame.join(px, [*keys, "row", "col"], "left_anti")
    else:
        work = px
    node = F.struct(*keys, "row", "col")
    w = work.withColumn("a", node)
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1))])
    to = w.withColumn("_s", F.explode(steps)).select(*keys, "a", (F.col("row") + F.col("_s.dr")).alias("row"), (F.col("col") + F.col("_s.dc")).alias("col"))
    edges = to.join(w.withColumnRenamed("a", "b"), [*keys, "row", "col"]).select("a", "b")
    comp = connected_components(edges, vertices=w.select("a")).withColumnRenamed("node", "a")
    size = w.join(comp, "a").groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("n"))
    if mode == "holes":
        fill = size.where(F.col("n") < least).select(*keys, "component")
        return px.unionByName(w.join(comp, "a").join(fill, [*keys, "component"]).select(*keys, "row", "col"))
    top = size.groupBy(*keys).agg(F.max(F.struct("n", F.col("component").alias("c"))).alias("t"))
    keep = size.join(top, keys).where((F.col("n") >= least) | (F.col("component") == F.col("t.c"))).select(*keys, "component")
    return w.join(comp, "a").join(keep, [*keys, "component"]).select(*keys, "row", "col")
