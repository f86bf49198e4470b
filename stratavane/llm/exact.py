"""Exact deduplication by content-defined chunk recipes.

A text is cut where its own content says so (after a character of ``CUTS``, once a chunk has
``MIN_CHUNK`` characters, at the latest after ``MAX_CHUNK``), so equal passages give equal chunks.
Each distinct chunk gets a verified identifier: its 64-bit hash, unless that hash belongs to chunks
with different SHA-256 digests, in which case their digests tell them apart.  Documents are then
equal if their ordered identifier lists are; texts themselves are never shuffled, only digests
and recipes, whatever a document's length.

DataFrame functions only.  Groups are counted with partial aggregates before the shuffle, so a text
that a third of all rows share is one row per task, and the rows of such hot groups learn their
group from a broadcast of bounded size instead of meeting in one task.

Defined results: null and empty texts are equal (an empty recipe).  Of equal texts the row with the
largest id stays; a null id is smaller than any other, and of rows repeated with the same id, each
is reported, with ``kept`` for all that carry the id that stays (``drop_copies`` keeps one of
them).  Other columns are ignored, or kept by ``drop_copies``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavane import storage

MIN_CHUNK, MAX_CHUNK = 256, 4096
#: Characters behind which a chunk may end: line ends and full stops, and some letters of several scripts, so that text without
#: sentences is cut by its content, too, and falls into step again behind an insertion.
CUTS = r"\n.\u3002kqz07\u7684\u4e00\u0e32\u0627\u0430\u03b1"
#: Groups with more than one in so many rows are hot; there can't be as many of them.
HOT_GROUPS = 1000
#: Rows to drop that are broadcast (about 100 bytes each); more are shuffled, and the documents with them.
BROADCAST_ROWS = 300_000


def chunks(text: Column) -> Column:
    """A text's content-defined chunks, in order; together they are the text."""
    cut = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?[{CUTS}]|.{{1,{MAX_CHUNK}}}"
    return F.when(F.length(text) <= MIN_CHUNK, F.filter(F.array(text), lambda x: x != "")).otherwise(F.regexp_extract_all(text, F.lit(cut), F.lit(0)))


def recipes(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's id, ``text_sha256`` and ``recipe``, its chunks' hashes in order, with
    ``digests``, their SHA-256 digests."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return (
        docs.select(F.col(f"`{id}`").alias("doc_id"), F.sha2(t, 256).alias("text_sha256"), chunks(t).alias("c"))
        .select("doc_id", "text_sha256", F.transform("c", lambda x: F.xxhash64(x)).alias("recipe"), F.transform("c", lambda x: F.unhex(F.sha2(x, 256))).alias("digests"))
    )


def ambiguous(found: DataFrame) -> DataFrame:
    """The chunk hashes that belong to more than one digest; normally there are none."""
    each = found.select(F.explode(F.arrays_zip("recipe", "digests")).alias("c"))
    # the whole digest as longs of seven bytes, so that minima and maxima are kept in hash aggregates before the shuffle
    parts = [F.conv(F.hex(F.substring("c.digests", 7 * k + 1, 7)), 16, 10).cast("long").alias(f"d{k}") for k in range(5)]
    span = [f(f"d{k}").alias(f"{n}{k}") for k in range(5) for n, f in (("lo", F.min), ("hi", F.max))]
    return each.select(F.col("c.recipe").alias("hash"), *parts).groupBy("hash").agg(*span).where(" OR ".join(f"lo{k} <> hi{k}" for k in range(5))).select("hash")


def verified(found: DataFrame) -> DataFrame:
    """``doc_id``, ``text_sha256`` and ``ids``, the recipe as verified identifiers: a chunk's hash,
    with its digest behind it where the hash alone is ambiguous."""
    doubtful = storage.stage(ambiguous(found), "chunks")
    name = F.transform("recipe", lambda h: F.hex(h))
    if not doubtful.count():
        return found.select("doc_id", "text_sha256", name.alias("ids"))
    # only documents with a doubtful chunk are taken apart
    row = found.select("doc_id", "text_sha256", "digests", name.alias("ids"), "recipe")
    part = row.select(F.col("doc_id").alias("_i"), F.col("text_sha256").alias("_t"), F.posexplode("recipe").alias("pos", "hash")).join(doubtful, "hash").groupBy("_i", "_t").agg(F.collect_set("pos").alias("at"))
    told = F.transform("ids", lambda x, i: F.when(F.array_contains("at", i), F.concat_ws("-", x, F.hex(F.get("digests", i)))).otherwise(x))
    return row.join(part, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("text_sha256") == F.col("_t")), "left").select("doc_id", "text_sha256", F.when(F.col("at").isNull(), F.col("ids")).otherwise(told).alias("ids"))


def groups(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    found = storage.stage(recipes(docs, id=id, text=text), "recipes")
    rows, n = verified(found), found.count()
    size = rows.groupBy("ids").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Fewer than HOT_GROUPS groups hold more than n / HOT_GROUPS rows: those are broadcast, and only
    # the rows of the others are shuffled to meet their group.
    hot = F.col("group_size") * HOT_GROUPS > n
    known = rows.join(F.broadcast(size.where(hot)), "ids", "left")
    rest = known.where("group_size IS NULL").drop("keep_id", "group_size").join(size.where(~hot), "ids")
    out = known.where("group_size IS NOT NULL").unionByName(rest)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without exact copies, one row for each text, with all their columns."""
    found = storage.stage(groups(docs, id=id, text=text), "copies")
    i, t = f"id_{uuid.uuid4().hex}", f"text_{uuid.uuid4().hex}"
    named = lambda df: df.select(F.col("doc_id").alias(i), F.col("text_sha256").alias(t))
    same = F.col(f"`{id}`").eqNullSafe(F.col(i)) & (F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256) == F.col(t))
    gone = storage.stage(named(found.where("NOT kept")).distinct(), "dropped")
    left = docs.join(_small(gone), same, "left_anti")
    # rows that carry the id and the text that stay more than once
    again = storage.stage(named(found.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1")), "repeated")
    if not again.count():
        return left
    return left.join(_small(again), same, "left_anti").unionByName(left.join(_small(again), same, "left_semi").dropDuplicates([id, text]))


def _small(rows: DataFrame) -> DataFrame:
    """A written table of ids and digests, to be broadcast if it is small enough; beyond that texts move once."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
