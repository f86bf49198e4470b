"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words: its weight's share of the total, at most ``MOST`` times its own size, what is cut off
there being shared again by weight.  A source of size S and target t takes each of its documents floor(t / S) times for certain; the
rest of the target is a sample of fixed size without repetition.  Its documents are ranked by random odds over inclusion
odds, u / (1 - u) over p / (1 - p), u being a hash of the document, and the first ones are taken (Pareto sampling).

The sample's size is fixed in words, not only in documents: each source's documents are cut into classes of nearly equal size, and from
the class of the largest documents on, each takes a whole number of documents (rounded at random, so that any document may be
drawn, unless the classes below couldn't make up for it) and hands what it took too much or too little to the next smaller class, whose inclusion odds follow from that.
With ``preference``, a column of positive numbers, a document's odds are multiplied by it, at the same sample sizes.

DataFrame functions only.  A hot source is never gathered: the n-th rank of a class is found in counts of ``BUCKETS`` ranges of
ranks, and only the documents in the range where the sample ends are sorted.  Texts are read once, where words are counted.

Defined results: null and empty texts have size 0 and take nothing; a null source is a source of its own, the last in order; rows that
repeat an id and a text draw the same number and are told apart in no defined order (their results as a set are); a preference
that is null or not above zero counts as one; an empty table gives no rows; other columns are ignored.  The same rows give the
same result in any order and partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratavane import storage
from stratavane.operators import ordered, skew

#: A source takes at most so many times its size, and a document at most so many copies.
MOST = 3
#: Ranges of ranks that are counted in each class.
BUCKETS = 1 << 16
SEED = 11


def uniform(*of: Column | str) -> Column:
    """A number strictly between 0 and 1 from a hash of the columns."""
    return (F.xxhash64(F.lit(SEED), *of).bitwiseAND((1 << 52) - 1) + 0.5) / float(1 << 52)


def size_class(size: Column) -> Column:
    """Sizes below 16 are classes of their own, larger ones share one if they agree in their highest four bits; monotone."""
    shift = F.greatest(F.length(F.bin(size)) - 4, F.lit(0))
    return F.floor(size / F.pow(F.lit(2.0), shift)).cast("int") + 8 * shift


def targets(sources: DataFrame, *, most: int = MOST) -> DataFrame:
    """sources (key, weight, source_size) with ``target``: shares of the summed sizes by weight, none above ``most`` times the
    source's size.  Sources reach that in order of size over weight, so running sums in that order say which do."""
    row = sources.withColumn("_most", (F.col("source_size") * most).cast("long")).withColumn("_ratio", F.col("_most") / F.col("weight"))
    all_ = row.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("_t"), F.coalesce(F.sum("weight"), F.lit(0)).alias("_all_w"))
    row = ordered.running(row, [], ["_ratio", "key"], {"_sum": F.col("_most"), "_sum_w": F.col("weight")}).join(F.broadcast(all_))
    left, left_w = F.col("_t") - F.col("_sum") + F.col("_most"), F.col("_all_w") - F.col("_sum_w") + F.col("weight")
    row = storage.stage(row.withColumn("_left", left).withColumn("_left_w", left_w).drop("_sum", "_sum_w"), "shares")
    first = row.where(F.col("_most") * F.col("_left_w").cast("double") > F.col("_left") * F.col("weight").cast("double")).agg(F.min(F.struct("_ratio", "key", "_left", "_left_w")).alias("_f"))
    capped = F.col("_f").isNull() | (F.struct("_ratio", "key") < F.struct("_f._ratio", "_f.key"))
    share = F.col("_f._left") * F.col("weight") / F.col("_f._left_w")
    return row.join(F.broadcast(first)).select(*sources.columns, F.when(capped, F.col("_most").cast("double")).otherwise(share.cast("double")).alias("target"))


def allocate(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Of each source and size class: ``n``, its documents, ``draw``, the size of the sample from them, ``copies``, the certain ones, and
    the source's size and target.  A source's classes are at most some hundred, so they are folded in one row."""
    per = sizes.groupBy("key", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    lists = per.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("cls", "n", "words")), asc=False).alias("classes"))
    one = lists.join(sources, "key").withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    rest = F.when(F.col("source_size") > 0, F.greatest(F.col("target") / F.col("source_size") - F.col("copies"), F.lit(0.0))).otherwise(0.0)

    def step(a: Column, c: Column) -> Column:
        mean = c["words"] / c["n"]
        want = c["words"] * F.col("_rest") + a["over"]
        below, low = a["below"] - c["words"], F.floor(want / mean)
        draw = F.floor(want / mean + uniform(F.col("key"), c["cls"]))
        # what is left for the classes below must be between nothing and all of them
        left = want - draw * mean + F.col("_rest") * below
        draw = F.when(left > below, low + 1).when(left < 0, low).otherwise(draw)
        draw = F.when(mean > 0, F.least(F.greatest(draw, F.lit(0)), c["n"])).otherwise(0).cast("long")
        return F.struct(below.alias("below"), (want - draw * mean).alias("over"), F.concat(a["out"], F.array(F.struct(c["cls"].alias("cls"), c["n"].alias("n"), draw.alias("draw")))).alias("out"))

    start = F.struct(F.col("source_size").alias("below"), F.lit(0.0).alias("over"), F.array().cast("array<struct<cls:int,n:bigint,draw:bigint>>").alias("out"))
    return one.withColumn("_rest", rest).select("key", "source_size", "target", "copies", F.explode(F.aggregate("classes", start, step, lambda a: a["out"])).alias("c")).select("key", "c.cls", "c.n", "c.draw", "copies", "source_size", "target")


def mix(docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), preference: str | None = None, most: int = MOST) -> DataFrame:
    """One row per document: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` (words, repeats counted) and ``copies``.  Sources in order
    of their names' code points weigh ``weights``, repeating."""
    t, s = F.col(f"`{text}`"), F.col(f"`{source}`")
    liking = F.lit(1.0) if preference is None else F.when(F.col(f"`{preference}`") > 0, F.col(f"`{preference}`").cast("double")).otherwise(1.0)
    rows = docs.select(
        F.col(f"`{id}`").alias("doc_id"),
        F.coalesce(F.concat(F.lit("+"), s.cast("string")), F.lit("-")).alias("key"),
        F.coalesce(F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        uniform(F.col(f"`{id}`").cast("string"), t).alias("u"),
        liking.alias("liking"),
    )
    rows = storage.stage(rows.withColumn("cls", size_class(F.col("size"))), "sizes")
    total = rows.count()
    sources = skew.numbered(rows.groupBy("key").agg(F.sum("size").alias("source_size")), ["key"], "at")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")).cast("long")
    classes = storage.stage(allocate(rows, targets(sources.select("key", "source_size", weight.alias("weight")), most=most)), "classes")

    p = F.col("draw") / F.col("n")
    rank = F.col("u") / (1 - F.col("u")) / F.col("liking") / (p / (1 - p))
    # a class that gives all or nothing needs no ranks
    open_ = (F.col("draw") > 0) & (F.col("draw") < F.col("n"))
    met = skew.meet_groups(rows, classes, ["key", "cls"], "n", total).withColumn("rank", F.when(open_, rank))
    met = storage.stage(met.withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS).cast("int")), "ranks")
    counts = met.where("rank IS NOT NULL").groupBy("key", "cls", "n", "draw", "bucket").agg(F.count(F.lit(1)).alias("held"))
    up = F.sum("held").over(Window.partitionBy("key", "cls").orderBy("bucket"))
    end = counts.withColumn("up", up).where("up >= draw AND up - held < draw").select("key", "cls", "n", F.col("bucket").alias("last"), (F.col("draw") - F.col("up") + F.col("held")).alias("need"))
    placed = skew.meet_groups(met.where("rank IS NOT NULL").drop("n"), end, ["key", "cls"], "n", total)
    order = Window.partitionBy("key", "cls").orderBy("rank", F.col("doc_id").asc_nulls_first(), "u")
    in_last = placed.where("bucket = last").withColumn("drawn", (F.row_number().over(order) <= F.col("need")).cast("long"))
    rest = placed.where("bucket <> last").withColumn("drawn", (F.col("bucket") < F.col("last")).cast("long"))
    sure = met.where("rank IS NULL").withColumn("drawn", (F.col("draw") > 0).cast("long"))
    keep = ["doc_id", "size", "source_size", "target", (F.col("copies") + F.col("drawn")).alias("copies")]
    out = in_last.select(*keep).unionByName(rest.select(*keep)).unionByName(sure.select(*keep))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op11_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
