"""Near-duplicate documents by weighted MinHash (BagMinHash) and exact verification.

A document is the bag of its five-word shingles; two documents are near duplicates if the weighted
Jaccard similarity of their bags is at least 0.8.  Classes are the connected components of that
relation.

* Texts with the same words in the same order are one node.
* BagMinHash (Ertl, 2018): each shingle's weight axis is cut at the powers of two, and each piece of
  it carries a Poisson process of its own, seeded by shingle and piece, whose points have a time, a
  weight level and a signature slot.  A bag sees the points whose level lies below its weight; a slot
  holds the earliest time it sees.  Two bags agree on a slot with the probability of their weighted
  Jaccard similarity, without bias.  Points are drawn in rounds for all bags of a block together, and
  only while they can still lower a slot, so that a bag of n shingles costs about n + slots * log(slots).
* ``BANDS`` bands of ``ROWS`` slots give bucket keys.  In each bucket every member is paired with its
  first and its last member only, and the pairs are verified by the overlap of the whole bags.
* In buckets whose members then still lie in different components, the members outside the largest one are
  compared with all others, in tiles of bounded size that hold the texts: pairs from different components
  whose signatures agree on enough slots are verified on the spot, and a tile gives only the links that
  join components.  So no link that joins components within a bucket is skipped for the bucket's size, and
  what is given out is linear; a pair of similarity 0.8 shares no bucket with probability 7e-5.

No group is gathered: a hot node, bucket or class is broadcast as one row, the texts of a hot pair
partner are dealt out over ``SALTS`` tasks, and texts are only moved for pairs.

Defined results: words are those of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  A text of
one to four words is a single shingle; null and wordless texts are near to nothing, each a class of
its own.  The class id is its least document id (null only if it has no other).  Repeated rows each get
a row in one class.  Other columns are ignored, or kept by ``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratavane import storage
from stratavane.llm import _text as X
from stratavane.operators.graph import connected_components
from stratavane.operators.skew import meet_groups

SHINGLE = 5
SIMILARITY = (4, 5)
BANDS, ROWS = 24, 5
SLOTS = BANDS * ROWS
#: Slots on which a pair must agree to be verified; a pair of similarity 0.8 has 96 on average and
#: fewer than this with probability below 1e-7.
AGREE = 72
#: Documents and bytes that are signed together.
BLOCK_DOCS, BLOCK_BYTES = 2048, 8 << 20
HASH_BITS = 53
#: Tasks over which the pairs of one partner are dealt, and the side of a tile in documents and in shingles (about 8 bytes of text each);
#: a longer document is a side of its own.
SALTS, TILE, TILE_SHINGLES = 1024, 256, 1 << 20
#: Rows of text requests that are broadcast; more are shuffled.
BROADCAST_ROWS = 500_000


def bags(b: X.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The block's bags: (document, shingle, count) without repeats, sorted, and each document's
    number of shingles."""
    h = X.word_hashes(b)
    n_words = b.n_words
    at = X.window_starts(b.offsets, SHINGLE)
    value = X.windows(h, SHINGLE)[at] if len(at) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(n_words)), np.maximum(n_words - SHINGLE + 1, 0))
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(short):
        s1, _ = sequence_hashes(h, b.offsets)
        value, doc = np.concatenate([value, X.mix(s1[short])]), np.concatenate([doc, short])
    packed = np.sort(doc.astype(np.uint64) << X.U(HASH_BITS) | value >> X.U(64 - HASH_BITS))
    new = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if len(packed) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(packed)))
    packed = packed[new]
    return (packed >> X.U(HASH_BITS)).astype(np.int64), packed & X.U((1 << HASH_BITS) - 1), count, np.bincount(doc, minlength=len(n_words))


def sequence_hashes(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each document's word sequence."""
    place = X.mix((np.arange(len(h)) - np.repeat(offsets[:-1], np.diff(offsets))).astype(np.uint64) * X.K1 + X.U(1))
    n = np.diff(offsets).astype(np.uint64)
    return tuple(X.sums(X.mix((h ^ X.U(seed)) + place).view(np.int64), offsets).view(np.uint64) + X.mix(n + X.U(seed)) for seed in (11, 23))


def sign(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """BagMinHash signatures, one row of times per document; infinite where a bag is empty."""
    sig = np.full(n_docs * slots, np.inf)
    parts = [(doc, shingle, count, np.zeros(len(doc), np.int64))]  # the piece [0, 1) of the weight axis
    for j in range(1, int(count.max(initial=1)).bit_length() + 1):
        some = np.flatnonzero(count > (1 << (j - 1)))  # the piece [2^(j-1), 2^j)
        if not len(some):
            break
        parts.append((doc[some], shingle[some], count[some], np.full(len(some), j)))
    doc, shingle, count, piece = (np.concatenate(x) for x in zip(*parts, strict=True))
    low = np.where(piece > 0, 1 << np.maximum(piece - 1, 0), 0)
    width = np.where(piece > 0, low, 1)
    seed = X.mix(shingle * X.K1 + X.mix(piece.astype(np.uint64) + X.K3))
    time = np.zeros(len(doc))
    k = 0
    while len(doc):
        k += 1
        u = X.mix(seed + np.full(1, k, np.uint64) * X.K2)
        time = time - np.log(((u >> X.U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        u = X.mix(u ^ X.K3)
        slot = ((u >> X.U(32)) * X.U(slots) >> X.U(32)).astype(np.int64)
        if piece.any():
            seen = low + (((u & X.U(0xFFFFFFFF)) * width.astype(np.uint64)) >> X.U(32)).astype(np.int64) < count
            np.minimum.at(sig, doc[seen] * slots + slot[seen], time[seen])
        else:
            np.minimum.at(sig, doc * slots + slot, time)
        if k < 8 or k % 8 == 0:  # later rounds have few points; a point too many does no harm
            latest = sig.reshape(n_docs, slots).max(1)
            live = np.flatnonzero(time < latest[doc])
            doc, seed, time, count, piece, low, width = (x[live] for x in (doc, seed, time, count, piece, low, width))
    return sig.reshape(n_docs, slots).astype(np.float32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for each band."""
    v = sig.view(np.uint32).astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = X.mix(np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + X.K1, (len(sig), BANDS)))
    for j in range(ROWS):
        key = X.mix((key ^ v[:, :, j]) * X.K1 + X.K3)
    return key.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base, done = TaskContext.get().partitionId() << 40, 0
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK_DOCS):
            part = batch.slice(lo, BLOCK_DOCS)
            for b in X.blocks(part.column("text"), X.ALNUM, True, BLOCK_BYTES):
                n = b.last - b.first
                s1, s2 = sequence_hashes(X.word_hashes(b), b.offsets)
                doc, shingle, count, size = bags(b)
                sig = sign(doc, shingle, count, n)
                empty = size == 0
                keys = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(band_keys(sig).ravel()), mask=pa.array(empty))
                rows = pa.array(np.arange(base + done, base + done + n))
                done += n
                yield pa.RecordBatch.from_arrays(
                    [rows, *[part.column(c).slice(b.first, n) for c in ("id", "text", "rest")], pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(size), keys, pa.array([x.tobytes() for x in sig], pa.binary())],
                    ["row", "id", "text", "rest", "s1", "s2", "n", "keys", "sig"],
                )


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (b, salt, role): the pairs whose bags overlap enough. A row of role 0 is b."""
    hub, own = None, None
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK_DOCS):
            part = batch.slice(lo, BLOCK_DOCS)
            out = []
            for blk in X.blocks(part.column("text"), X.ALNUM, True, BLOCK_BYTES):
                doc, shingle, count, size = bags(blk)
                cut = np.searchsorted(doc, np.arange(blk.last - blk.first + 1))
                some = part.slice(blk.first, blk.last - blk.first)
                for d, (a, b, role) in enumerate(zip(some.column("row").to_pylist(), some.column("b").to_pylist(), some.column("role").to_pylist(), strict=True)):
                    bag = shingle[cut[d] : cut[d + 1]], count[cut[d] : cut[d + 1]], int(size[d])
                    if role == 0:
                        hub, own = b, (bag[0].copy(), bag[1].copy(), bag[2])
                    elif hub == b and len(bag[0]) and len(own[0]):
                        at = np.minimum(np.searchsorted(own[0], bag[0]), len(own[0]) - 1)
                        both = int(np.minimum(own[1][at], bag[1])[own[0][at] == bag[0]].sum())
                        if both * SIMILARITY[1] >= SIMILARITY[0] * (bag[2] + own[2] - both):
                            out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows whose bags are similar enough. texts: row, text."""
    pairs = storage.stage(pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(SALTS)).alias("salt")), "pairs")
    asked = pairs.select(F.col("a").alias("row"), "b", "salt", F.lit(1).alias("role"))
    asked = asked.unionByName(pairs.select(F.col("b").alias("row"), "b", "salt", F.lit(0).alias("role")).distinct())
    if pairs.count() * 2 <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    return texts.select("row", "text").join(asked, "row").repartition("b", "salt").sortWithinPartitions("b", "salt", "role").mapInArrow(X.lean(_verified), "a long, b long")


def _tiles(table: pa.Table) -> pa.Table:
    """Links between members of side 0 (outside their bucket's largest component) and side 1 that join
    different components. A pair is looked at in the first band that it shares."""
    table = table.combine_chunks()
    row, comp, n, side, out, band = (table[c].to_numpy() for c in ("row", "component", "n", "side", "outside", "band"))
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.float32).reshape(len(row), BANDS, ROWS)
    bags_: list = []
    for b in X.blocks(table["text"], X.ALNUM, True, BLOCK_BYTES):
        doc, shingle, count, _ = bags(b)
        cut = np.searchsorted(doc, np.arange(b.last - b.first + 1))
        bags_ += [(shingle[lo:hi], count[lo:hi]) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
    parent: dict[int, int] = {}

    def find(c: int) -> int:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    right = np.flatnonzero(side == 1)
    found = []
    for a in np.flatnonzero(side == 0).tolist():
        js = right[(comp[right] != comp[a]) & (np.minimum(n[right], n[a]) * SIMILARITY[1] >= SIMILARITY[0] * np.maximum(n[right], n[a])) & (~out[right] | (row[right] < row[a]))]
        same = sig[js] == sig[a]
        whole = same.all(2)
        js = js[(same.sum((1, 2)) >= AGREE) & whole.any(1) & (whole.argmax(1) == band[a])]
        for j in js.tolist():
            x, y = find(int(comp[a])), find(int(comp[j]))
            if x == y:
                continue
            (s, c), (t, d) = bags_[a], bags_[j]
            at = np.minimum(np.searchsorted(t, s), len(t) - 1)
            both = int(np.minimum(d[at], c)[t[at] == s].sum())
            if both * SIMILARITY[1] >= SIMILARITY[0] * (int(n[a]) + int(n[j]) - both):
                parent[max(x, y)] = min(x, y)
                found.append((max(row[a], row[j]), min(row[a], row[j])))
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def links(signed: DataFrame) -> DataFrame:
    """Links (a, b) between nodes, enough of them to connect all that are similar; ``signed`` is
    the written table of signatures."""
    node = signed.groupBy("s1", "s2").agg(F.min("row").alias("row"))
    node = storage.stage(signed.select("row", "n", "keys").join(node.select("row"), "row"), "nodes")
    member = node.select("row", "n", F.posexplode("keys").alias("band", "key"))
    bucket = member.groupBy("key").agg(F.min("row").alias("lo"), F.min_by("n", "row").alias("lo_n"), F.max("row").alias("hi"), F.max_by("n", "row").alias("hi_n"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # both sides are plain shuffles here, so that adaptive execution can split a hot bucket's rows
    found = storage.stage(member.join(storage.stage(bucket, "buckets"), "key"), "members")
    fits = lambda x, y: F.least(x, y) * SIMILARITY[1] >= SIMILARITY[0] * F.greatest(x, y)
    end = lambda e: found.where((F.col("row") != F.col(e)) & fits(F.col("n"), F.col(f"{e}_n"))).select(F.greatest("row", e).alias("a"), F.least("row", e).alias("b"))
    first = storage.stage(verify(end("lo").unionByName(end("hi")).distinct(), signed), "links")
    comp = connected_components(first).withColumnRenamed("node", "row")
    # buckets of more than three members that are not all in one component (the ends have met everyone)
    known = found.where("_n > 3").select("key", "band", "row", "n").join(comp, "row", "left").withColumn("component", F.coalesce("component", "row"))
    known = storage.stage(known, "known")
    parts = known.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    parts = parts.groupBy("key").agg(F.max(F.struct("c", "component", "w")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("c").alias("_m"), F.sum("w").alias("_mw"))
    parts = parts.where("parts > 1").select("key", F.col("main.component").alias("main"), (F.col("_m") - F.col("main.c")).alias("_o"), "_m", (F.col("_mw") - F.col("main.w")).alias("_ow"), "_mw")
    rest = meet_groups(known, parts, ["key"], "_m", max(1, known.count())).withColumn("outside", F.col("component") != F.col("main"))
    tiles_o, tiles_m = (F.ceil(F.greatest(F.col(c) / F.lit(TILE), F.col(f"{c}w") / F.lit(TILE_SHINGLES))).cast("int") for c in ("_o", "_m"))
    place = lambda t: F.pmod(F.xxhash64("row"), t).cast("int")
    every = lambda t: F.explode(F.sequence(F.lit(0), t - 1))
    left = rest.where("outside").withColumn("i", place(tiles_o)).withColumn("j", every(tiles_m)).withColumn("side", F.lit(0))
    right = rest.withColumn("j", place(tiles_m)).withColumn("i", every(tiles_o)).withColumn("side", F.lit(1))
    dealt = left.unionByName(right).select("key", "band", "i", "j", "side", "row", "component", "n", "outside")
    dealt = storage.stage(dealt, "tiles")
    whole = signed.select("row", "sig", "text")
    asked = F.broadcast(dealt) if dealt.count() <= BROADCAST_ROWS else dealt
    more = whole.join(asked, "row").groupBy("key", "i", "j").applyInArrow(_tiles, "a long, b long")
    return storage.stage(first.unionByName(more), "links")


def classes(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, ``class_id`` (the least id of its class) and ``class_size``; an id column named like one of these
    comes out as ``id``."""
    found, _ = _classes(docs.select(X.named(id).alias("id"), X.named(text).alias("text"), F.struct(F.lit(0)).alias("rest")))
    return found.select(F.col("id").alias(X.own_name(id, "class_id", "class_size")), "class_id", "class_size")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs: id, text and rest, which is passed on. Returns the rows' classes and the signed table."""
    X.bounded_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("row", T.LongType()), *docs.schema.fields])
    for f in T._parse_datatype_string("s1 long, s2 long, n long, keys array<long>, sig binary").fields:
        schema.add(f)
    signed = storage.stage(docs.mapInArrow(X.lean(_signed), schema), "signed")
    n = signed.count()
    full = signed.where("n > 0")
    comp = storage.stage(connected_components(links(full)).withColumnRenamed("node", "first"), "components")
    copies = full.groupBy("s1", "s2").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("_n")).join(comp, "first", "left").withColumn("component", F.coalesce("component", "first"))
    member = meet_groups(full.select("row", "id", "s1", "s2"), copies.select("s1", "s2", "component", "_n"), ["s1", "s2"], "_n", n).select("row", "id", "component")
    member = storage.stage(member, "classes")
    size = member.groupBy("component").agg(F.min("id").alias("class_id"), F.min(F.struct("id", "row")).alias("least"), F.count(F.lit(1)).alias("class_size"))
    found = meet_groups(member, size, ["component"], "class_size", n).select("row", "id", "class_id", "class_size", (F.col("row") == F.col("least.row")).alias("stays"))
    alone = signed.where("n = 0").select("row", "id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("stays"))
    return found.unionByName(alone), signed


def drop_near_copies(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, that with the least id, with all its columns."""
    others = [c for c in docs.columns if c not in (id, text)]
    rest = F.struct(*[X.named(c).alias(f"c{k}") for k, c in enumerate(others)]) if others else F.struct(F.lit(0))
    found, signed = _classes(docs.select(X.named(id).alias("id"), X.named(text).alias("text"), rest.alias("rest")))
    gone = storage.stage(found.where("NOT stays").select("row"), "dropped")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    kept = signed.select("row", "id", "text", "rest").join(gone, "row", "left_anti")
    own = {id: F.col("id"), text: F.col("text")} | {c: F.col(f"rest.c{k}") for k, c in enumerate(others)}
    return kept.select(*[own[c].alias(c) for c in docs.columns])


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
