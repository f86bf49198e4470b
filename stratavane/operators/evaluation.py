"""Scoring predictions: matching, average precision, confusion, coverage, recall by group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratavane import storage
from stratavane.functions import geometry as G
from stratavane.operators import boxes, ordered

#: IoU thresholds of the averaged precision, and the extra one.
OVERLAPS = [round(0.5 + 0.05 * k, 2) for k in range(9)] + [0.25]
#: The least number of points of an instance that counts.
MIN_POINTS = 100
#: Instance codes are class * ENCODE + instance.
ENCODE = 1000


def encode_gt(sem: Column, inst: Column, base: int = ENCODE, shift: int = 1) -> Column:
    """sem * base + inst + shift; points whose shifted instance is below zero are 0 (ignored)."""
    code = sem.cast("bigint") * base + inst + shift
    return F.when(inst + shift < 0, F.lit(0).cast("bigint")).otherwise(code)


def remap(df: DataFrame, column: str, table: DataFrame, source: str, target: str, missing: int = -100) -> DataFrame:
    """Labels through a small mapping; those without an entry become the sentinel."""
    t = table.select(F.col(source).alias("_s"), F.col(target).alias("_t")).dropDuplicates(["_s"])
    return df.join(t, F.col(column) == F.col("_s"), "left").withColumn(column, F.coalesce("_t", F.lit(missing))).drop("_s", "_t")


def gt_instances(gt: DataFrame, valid: list[int], base: int = ENCODE) -> DataFrame:
    """scan, gt_id, label_id, n of each instance of a valid class; gt: scan, point_id, code."""
    return gt.where(F.col("code") > 0).groupBy("scan", F.col("code").alias("gt_id")).agg(F.count(F.lit(1)).alias("n")).withColumn("label_id", F.floor(F.col("gt_id") / base).cast("int")).where(F.col("label_id").isin(valid))


def match_edges(pred_points: DataFrame, gt: DataFrame) -> DataFrame:
    """Intersections and IoU of predictions and instances that share points."""
    p = pred_points.select("scan", "pred_id", "point_id").distinct()
    np_, ng = p.groupBy("scan", "pred_id").agg(F.count(F.lit(1)).alias("n_pred")), gt.groupBy("scan", F.col("code").alias("gt_id")).agg(F.count(F.lit(1)).alias("n_gt"))
    x = p.join(gt.select("scan", "point_id", F.col("code").alias("gt_id")), ["scan", "point_id"]).groupBy("scan", "pred_id", "gt_id").agg(F.count(F.lit(1)).alias("inter"))
    return x.join(np_, ["scan", "pred_id"]).join(ng, ["scan", "gt_id"]).withColumn("iou", F.col("inter") / (F.col("n_pred") + F.col("n_gt") - F.col("inter")))


def best_match(pred_points: DataFrame, gt: DataFrame, eps: float = 1e-5) -> DataFrame:
    """Each prediction's best instance by IoU (ties: smaller id), with its class: oracle labels."""
    e = match_edges(pred_points, gt).withColumn("iou", F.col("inter") / (F.col("n_pred") + F.col("n_gt") - F.col("inter") + eps))
    w = Window.partitionBy("scan", "pred_id").orderBy(F.desc("iou"), "gt_id")
    return e.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").withColumn("label_id", F.floor(F.col("gt_id") / ENCODE).cast("int"))


def _claims(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Of predictions that several instances claim, who takes them: keys, pred_id, ``by``.  edges: keys, gt_id, pred_id.  Instances, in order of
    their ids, take the first prediction that no earlier one has taken.  Only instances that share a claim are
    folded, those of one key (a scan, class and threshold) in a row; all others take what nobody else wants."""
    several = edges.groupBy(*keys, "pred_id").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    rivals = edges.join(several, [*keys, "pred_id"]).select(*keys, "gt_id").distinct()
    wanted = edges.join(rivals, [*keys, "gt_id"]).groupBy(*keys, "gt_id").agg(F.sort_array(F.collect_list("pred_id")).alias("preds"))
    rows = wanted.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("gt_id", "preds"))).alias("rows"))
    kind = dict(edges.dtypes)
    none = F.array().cast(f"array<struct<pred_id:{kind['pred_id']},by:{kind['gt_id']}>>")

    def step(taken, g):
        first = F.get(F.filter(g["preds"], lambda p: ~F.exists(taken, lambda t: t["pred_id"] == p)), F.lit(0))
        return F.when(first.isNull(), taken).otherwise(F.concat(taken, F.array(F.struct(first.alias("pred_id"), g["gt_id"].alias("by")))))

    return rows.select(*keys, F.explode(F.aggregate("rows", none, step)).alias("t")).select(*keys, "t.pred_id", "t.by")


def average_precision(events: DataFrame, flags: DataFrame, keys: list[str]) -> DataFrame:
    """ap and recall of each key.  events: keys, score, tp (0 or 1); flags: keys, hard_fn, has_gt, has_pred.

    Precision and recall at each distinct score, one point (1, 0) added at the high end, and each precision
    weighed by half the recall step around it.  Without truth it is NaN; without predictions 0."""
    g = events.groupBy(*keys, "score").agg(F.sum("tp").alias("_tp"), F.count(F.lit(1)).alias("_n"))
    g = ordered.running(g, keys, [F.desc("score")], {"_ctp": F.col("_tp"), "_cn": F.col("_n")}).join(flags.select(*keys, "hard_fn"), keys)
    # A score's recall step counts half at its own precision and half at that of the next higher score (1 at the high end), which
    # the running sums without its own rows give.
    above = F.when(F.col("_cn") > F.col("_n"), (F.col("_ctp") - F.col("_tp")) / (F.col("_cn") - F.col("_n"))).otherwise(1.0)
    ap = g.groupBy(*keys).agg(F.sum(F.col("_tp") * (F.col("_ctp") / F.col("_cn") + above)).alias("_area"), (F.sum("_tp") + F.max("hard_fn")).alias("_gt"), F.sum("_tp").alias("_all"))
    ap = ap.select(*keys, F.when(F.col("_gt") > 0, F.col("_area") / 2 / F.col("_gt")).alias("_ap"), F.when(F.col("_gt") > 0, F.col("_all") / F.col("_gt")).alias("_rc"))
    nan = F.lit(float("nan"))
    value = lambda x: F.when(~F.col("has_gt"), nan).when(~F.col("has_pred"), 0.0).otherwise(F.coalesce(x, F.lit(0.0)))
    return flags.join(ap, keys, "left").select(*keys, value(F.col("_ap")).alias("ap"), value(F.col("_rc")).alias("recall"))


def evaluate(preds: DataFrame, pred_points: DataFrame, gt: DataFrame, valid: list[int], *, overlaps: list[float] = OVERLAPS, min_points: int = MIN_POINTS, base: int = ENCODE, agnostic: bool = False) -> DataFrame:
    """AP and recall by class and IoU threshold.  preds: scan, pred_id, label_id, conf; pred_points: scan,
    pred_id, point_id; gt: scan, point_id, code.  An instance takes the first prediction (by id) that overlaps it by more than the
    threshold and isn't taken; the best of all that it might have taken counts as right, the others as wrong.  A prediction that overlaps
    no instance counts against precision only if at most the threshold's share of its points is void or in small instances.
    Predictions of classes that aren't valid and those below ``min_points`` points are left out."""
    one = F.lit(0) if agnostic else F.col("label_id")
    # points meet instances once; what follows is of the size of predictions, instances and pairs of them, and each is computed once
    points = storage.stage(pred_points.select("scan", "pred_id", "point_id").distinct(), "points")
    meets = storage.stage(points.join(gt.select("scan", "point_id", "code"), ["scan", "point_id"], "left").groupBy("scan", "pred_id", "code").agg(F.count(F.lit(1)).alias("inter")), "meets")
    void = ~F.coalesce(F.floor(F.col("code") / base).isin(valid), F.lit(False))
    sizes = meets.groupBy("scan", "pred_id").agg(F.sum("inter").alias("n"), F.sum(void.cast("int") * F.col("inter")).alias("void"))
    p = preds if agnostic else preds.where(F.col("label_id").isin(valid))
    p = p.join(sizes, ["scan", "pred_id"]).where(F.col("n") >= min_points)
    p = storage.stage(p.select("scan", one.cast("int").alias("label_id"), "pred_id", F.col("conf").cast("double").alias("conf"), "n", "void"), "preds")
    g = storage.stage(gt_instances(gt, valid, base).select("scan", one.cast("int").alias("label_id"), "gt_id", "n"), "instances")
    k = ["scan", "label_id", "overlap"]
    at = lambda df: df.withColumn("overlap", F.explode(F.array(*map(F.lit, overlaps))))
    e = meets.withColumnRenamed("code", "gt_id").join(g.withColumnRenamed("n", "n_gt"), ["scan", "gt_id"]).join(p.select("scan", "label_id", "pred_id"), ["scan", "label_id", "pred_id"])
    e = e.join(points.groupBy("scan", "pred_id").agg(F.count(F.lit(1)).alias("n_pred")), ["scan", "pred_id"]).withColumn("iou", F.col("inter") / (F.col("n_pred") + F.col("n_gt") - F.col("inter")))
    e = storage.stage(e.select("scan", "label_id", "gt_id", "pred_id", "inter", "iou", "n_gt"), "edges")
    over = storage.stage(at(e).where(F.col("iou") > F.col("overlap")), "claims")
    claims = over.where(F.col("n_gt") >= min_points).select(*k, "gt_id", "pred_id")
    open_ = claims.join(_claims(claims, k), [*k, "pred_id"], "left").where("by IS NULL OR by >= gt_id").join(p.select("scan", "label_id", "pred_id", "conf"), ["scan", "label_id", "pred_id"])
    best = F.row_number().over(Window.partitionBy(*k, "gt_id").orderBy(F.desc("conf"), "pred_id")) == 1
    matched = storage.stage(open_.select(*k, "gt_id", F.col("conf").alias("score"), best.cast("int").alias("tp")), "matched")
    small = (F.col("gt_id") < base).cast("int") + (F.col("n_gt") < min_points).cast("int")
    ignored = e.groupBy("scan", "label_id", "pred_id").agg(F.sum(F.col("inter") * small).alias("_small"))
    alone = at(p.join(ignored, ["scan", "label_id", "pred_id"], "left")).join(over.select(*k, "pred_id").distinct(), [*k, "pred_id"], "left_anti")
    alone = alone.where((F.col("void") + F.coalesce("_small", F.lit(0))) / F.col("n") <= F.col("overlap"))
    ev = matched.select("label_id", "overlap", "score", "tp").unionByName(alone.select("label_id", "overlap", F.col("conf").alias("score"), F.lit(0).alias("tp")))
    keys = ["label_id", "overlap"]
    big = at(g.where(F.col("n") >= min_points)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_big"))
    met = matched.where("tp = 1").groupBy(*keys).agg(F.count(F.lit(1)).alias("_met"))
    seen = at(p.select("label_id").unionByName(g.select("label_id")).distinct())
    some = at(p.select("label_id").distinct()).withColumn("_p", F.lit(True))
    flags = seen.join(big, keys, "left").join(met, keys, "left").join(some, keys, "left").select(*keys, (F.coalesce("_big", F.lit(0)) - F.coalesce("_met", F.lit(0))).alias("hard_fn"), F.col("_big").isNotNull().alias("has_gt"), F.coalesce("_p", F.lit(False)).alias("has_pred"))
    return average_precision(ev, flags, keys)


def averages(aps: DataFrame) -> DataFrame:
    """Per class: ap (mean over 0.5 and up), ap50, ap25 and recall."""
    at = lambda o, c="ap": F.max(F.when(F.col("overlap") == o, F.col(c)))
    return aps.groupBy("label_id").agg(F.avg(F.when(F.col("overlap") != 0.25, F.col("ap"))).alias("ap"), at(0.5).alias("ap50"), at(0.25).alias("ap25"), F.avg(F.when(F.col("overlap") != 0.25, F.col("recall"))).alias("rc"))


def overall(per_class: DataFrame, columns: list[str] = ("ap", "ap50", "ap25"), by: list[str] = ()) -> DataFrame:
    """Means over classes without NaN, in all or by group."""
    return per_class.groupBy(*by).agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in columns])


def grouped_report(per_class: DataFrame, groups: DataFrame, columns: list[str] = ("ap", "ap50", "ap25"), on: str = "name") -> DataFrame:
    """The means of each category group and, as group "all", of all classes."""
    j = per_class.join(groups, on).select("grp", *columns)
    return overall(j, columns, ["grp"]).unionByName(overall(per_class, columns).withColumn("grp", F.lit("all")))


def box_matches(preds: DataFrame, gts: DataFrame, *, low: str = "low", high: str = "high") -> DataFrame:
    """Predictions and instances of a scan and class whose 3D boxes share volume, with both volumes, the shared one and the IoU.
    preds: scan, label_id, pred_id, low and high corners (arrays); gts: scan, label_id, gt_id, low, high."""
    ends = lambda df, i, p: df.select("scan", "label_id", i, *[F.get(c, F.lit(k)).cast("double").alias(f"_{p}{e}{k}") for k in range(3) for c, e in ((low, "l"), (high, "h"))])
    key = lambda p: ["scan", "label_id", *[f"_{p}{e}{k}" for k in range(3) for e in "lh"]]
    p, g = boxes.alike(ends(preds, "pred_id", "p"), key("p"), "pred_id", "_ps"), boxes.alike(ends(gts, "gt_id", "g"), key("g"), "gt_id", "_gs")
    near = boxes.touching(p, g, ["scan", "label_id"], [(f"_pl{k}", f"_ph{k}") for k in range(3)], [(f"_gl{k}", f"_gh{k}") for k in range(3)])
    volume = lambda lo, hi: reduce(lambda x, k: x * F.greatest(hi(k) - lo(k), F.lit(0.0)), range(3), F.lit(1.0))
    end = lambda c: lambda k: F.col(f"_{c}{k}")
    shared = volume(lambda k: F.greatest(f"_pl{k}", f"_gl{k}"), lambda k: F.least(f"_ph{k}", f"_gh{k}"))
    j = near.withColumn("inter", shared).where("inter > 0").withColumn("n_pred", volume(end("pl"), end("ph"))).withColumn("n_gt", volume(end("gl"), end("gh")))
    iou = F.col("inter") / (F.col("n_pred") + F.col("n_gt") - F.col("inter"))
    j = j.select("scan", "label_id", "_ps", "_gs", "inter", "n_pred", "n_gt", iou.alias("iou"))
    return j.select("*", F.explode("_ps").alias("pred_id")).select("*", F.explode("_gs").alias("gt_id")).select("scan", "label_id", "pred_id", "gt_id", "inter", "n_pred", "n_gt", "iou")


def confusion(df: DataFrame, gt: str = "gt", pred: str = "pred", ignore: int | None = -100, valid: list[int] | None = None, unknown: int = -1) -> DataFrame:
    """Counts of (truth, prediction).  With ``valid`` classes, rows of other truths are left out and all other
    predictions are one ``unknown`` class."""
    d = df if ignore is None else df.where(F.col(gt) != ignore)
    if valid is not None:
        d = d.where(F.col(gt).isin(valid)).withColumn(pred, F.when(F.col(pred).isin(valid), F.col(pred)).otherwise(F.lit(unknown)))
    return d.groupBy(F.col(gt).alias("gt"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_iou(conf: DataFrame) -> DataFrame:
    """tp, fp, fn, iou and accuracy of each class of a confusion table."""
    rows = conf.groupBy(F.col("gt").alias("cls")).agg(F.sum("n").alias("n_gt"), F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    cols = conf.groupBy(F.col("pred").alias("cls")).agg(F.sum("n").alias("n_pred"))
    j = rows.join(cols, "cls", "full").na.fill(0, ["n_gt", "tp", "n_pred"])
    return j.select("cls", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"), F.when(F.col("n_gt") + F.col("n_pred") - F.col("tp") > 0, F.col("tp") / (F.col("n_gt") + F.col("n_pred") - F.col("tp"))).alias("iou"), F.when(F.col("n_gt") > 0, F.col("tp") / F.col("n_gt")).alias("accuracy"))


def mean_absolute_error(df: DataFrame, pairs: list[tuple[str, str]], where: Column) -> DataFrame:
    total = F.lit(0.0)
    for a, b in pairs:
        total = total + F.abs(F.col(a) - F.col(b))
    return df.where(where).agg((F.sum(total) / (F.count(F.lit(1)) * len(pairs))).alias("mae"))


def coverage(points: DataFrame, *, scope: str = "scan", gt: str = "gt", pred: str = "pred", sem: str = "sem", threshold: float = 0.5) -> DataFrame:
    """Of each class, the mean (mucov) and size-weighted (mwcov) best IoU of its instances, and precision and
    recall at the threshold.  points: scan, gt, pred, sem (truth), pred_sem; -1 is none, background 0 counts."""
    p = points.withColumnsRenamed({gt: "g", pred: "p", sem: "gs"})
    ng = p.where("g >= 0").groupBy(scope, "g", "gs").agg(F.count(F.lit(1)).alias("ng"))
    np_ = p.where("p >= 0").groupBy(scope, "p", "pred_sem").agg(F.count(F.lit(1)).alias("np"))
    x = p.where("g >= 0 AND p >= 0 AND gs = pred_sem").groupBy(scope, "g", "p", "gs").agg(F.count(F.lit(1)).alias("x"))
    x = x.join(ng, [scope, "g", "gs"]).join(np_.withColumnRenamed("pred_sem", "gs"), [scope, "p", "gs"]).withColumn("iou", F.col("x") / (F.col("ng") + F.col("np") - F.col("x")))
    best = x.groupBy(scope, "g", "gs").agg(F.max("iou").alias("iou"))
    cov = ng.join(best, [scope, "g", "gs"], "left").na.fill(0.0, ["iou"]).groupBy("gs").agg(F.avg("iou").alias("mucov"), (F.sum(F.col("iou") * F.col("ng")) / F.sum("ng")).alias("mwcov"), F.count(F.lit(1)).alias("n_gt"))
    hit = x.groupBy(scope, "p", "gs").agg(F.max("iou").alias("iou")).where(F.col("iou") >= threshold).groupBy("gs").agg(F.count(F.lit(1)).alias("tp"))
    n = np_.groupBy(F.col("pred_sem").alias("gs")).agg(F.count(F.lit(1)).alias("n_pred"))
    j = cov.join(hit, "gs", "left").join(n, "gs", "left").na.fill(0, ["tp", "n_pred"])
    return j.select(F.col("gs").alias("cls"), "mucov", "mwcov", F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).alias("precision"), (F.col("tp") / F.col("n_gt")).alias("recall"))


def tag_precision(scores: DataFrame, tag: str = "tag", score: str = "score", truth: str = "truth", id: str = "id") -> DataFrame:
    """Rank average precision of each tag (0 without positives) over rows by score descending, then id."""
    r = ordered.running(scores.select(tag, score, truth, id), [tag], [F.desc(score), F.col(id)], {"_n": F.lit(1), "_tp": F.col(truth)})
    return r.groupBy(tag).agg(F.coalesce(F.sum(F.when(F.col(truth) == 1, F.col("_tp") / F.col("_n"))) / F.sum(truth), F.lit(0.0)).alias("ap"), F.sum(truth).alias("n_pos"))


def tag_pr(scores: DataFrame, thresholds: DataFrame, tag: str = "tag", score: str = "score", truth: str = "truth") -> DataFrame:
    """Precision and recall of each tag at its threshold."""
    j = scores.join(F.broadcast(thresholds), tag).withColumn("_p", (F.col(score) > F.col("threshold")).cast("int"))
    hit = F.sum(F.col("_p") * F.col(truth))
    return j.groupBy(tag).agg(F.when(F.sum("_p") > 0, hit / F.sum("_p")).alias("precision"), F.when(F.sum(truth) > 0, hit / F.sum(truth)).alias("recall"))


def group_recall(matches: DataFrame, instances: DataFrame, groups: DataFrame, threshold: float, on: str = "label_id") -> DataFrame:
    """The share of each group's instances that some prediction overlaps by more than the threshold."""
    hit = matches.where(F.col("iou") > threshold).select("scan", "gt_id").distinct().withColumn("_h", F.lit(1))
    return instances.join(hit, ["scan", "gt_id"], "left").join(groups, on).groupBy("grp").agg(F.avg(F.coalesce("_h", F.lit(0))).alias("recall"))


def losses(df: DataFrame, logit: str, target: str, keys: list[str], alpha: float = 0.25, gamma: float = 2.0) -> DataFrame:
    """Dice, focal and binary cross-entropy losses of each mask's logits."""
    p = 1 / (1 + F.exp(-F.col(logit)))
    t = F.col(target)
    bce = F.greatest(F.col(logit), F.lit(0.0)) - F.col(logit) * t + F.log1p(F.exp(-F.abs(F.col(logit))))
    focal = (alpha * t + (1 - alpha) * (1 - t)) * bce * F.pow(1 - (p * t + (1 - p) * (1 - t)), gamma)
    return df.groupBy(*keys).agg((1 - (2 * F.sum(p * t) + 1) / (F.sum(p) + F.sum(t) + 1)).alias("dice"), F.avg(focal).alias("focal"), F.avg(bce).alias("bce"))


def smoothed(df: DataFrame, value: str, order: str, window: int = 20, keys: list[str] = ()) -> DataFrame:
    """Median and mean over the last ``window`` values and the mean of all so far, in order of ``order`` within the keys."""
    n = ordered.running(df, list(keys), [order], {"_n": F.lit(1), "_sum": F.col(value), "_known": F.col(value).isNotNull().cast("int")})
    out = ordered.framed(n, list(keys), "_n", window, {"median": F.percentile(value, 0.5), "avg": F.avg(value)})
    return out.withColumn("global_avg", F.when(F.col("_known") > 0, F.col("_sum") / F.col("_known"))).drop("_n", "_sum", "_known")
