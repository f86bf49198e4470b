"""Benchmark decontamination by binary search in suffix arrays of the training text.

Each bounded shard of training documents gets a suffix array: word positions ordered by the
words that follow them.  Every suffix of every benchmark item is binary-searched in every
shard, which yields all verbatim occurrences of its leading window and their places; occurrences
that continue each other are joined into the longest verbatim matches.  A document is affected
if enough of its words lie in such occurrences.

Only positions that can start a match enter a shard's array (the next ``shortest window``
words must all be benchmark words), which drops nothing: a suffix left out has no match.

The benchmark is the stated query set.  It is read in blocks of at most ``block_bytes``
characters, each sent to the executors; blocks follow each other as map stages over the same
rows, so there is no shuffle and no join, whatever the benchmark's size.  Training rows stay
where they were read.

Defined results: a null or wordless text has no words and is never contaminated.  A null or
wordless item has no window.  An item with a null id marks words but is never listed.  Items
with equal ids count as one, repeated documents each get a row, and further columns of either
table are ignored (kept by ``remove_contaminated``).  An empty benchmark leaves all rows clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratavane import storage
from stratavane.llm import _text as X

WINDOW = 13
#: Characters of benchmark text held by an executor at a time.
BLOCK_CHARS = 32 << 20
#: Bytes of training text in a shard; one longer document is a shard of its own.
SHARD_BYTES = 4 << 20
#: A document is contaminated if at least one in this many words is hit.
ONE_IN = 20


class Probe:
    """One block of the benchmark: distinct items, their vocabulary and distinct windows."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.window, self.ids, seqs, seen = window, [], [], {}
        arr = pa.array([t for _, t in items], pa.large_string())
        for b in X.blocks(arr, X.ALNUM, True):
            h = X.word_hashes(b)
            for d in range(b.last - b.first):
                words, item = h[b.offsets[d] : b.offsets[d + 1]], items[b.first + d][0]
                if not len(words):
                    continue
                at = seen.setdefault(words.tobytes(), len(seqs))
                if at == len(seqs):
                    seqs.append(words)
                    self.ids.append(set())
                if item is not None:
                    self.ids[at].add(str(item))
        self.ids = [sorted(x) for x in self.ids]
        self.vocab = _distinct(np.concatenate(seqs)) if seqs else np.zeros(0, np.uint64)
        self.width = 2 if len(self.vocab) < 0xFFFF else 4
        self.shortest = min([window, *map(len, seqs)])
        #: windows by length: (length, sorted distinct patterns, of each pattern the number of its set of items, and all places in order
        #: of item and place: item, place, pattern)
        self.groups, sets = [], {}
        for size in sorted({min(window, len(s)) for s in seqs}):
            pats, item, place = [], [], []
            for k, s in enumerate(seqs):
                if min(window, len(s)) == size:
                    e = self.encode(s)
                    n = len(s) - size + 1
                    pats.append(np.concatenate([e[j : j + n, None] for j in range(size)], 1))
                    item.append(np.full(n, k))
                    place.append(np.arange(n))
            distinct, which = np.unique(self.keys(np.concatenate(pats)), return_inverse=True)
            item, place = np.concatenate(item), np.concatenate(place)
            pairs = np.unique(which * len(seqs) + item)
            owner = np.split(pairs % len(seqs), np.searchsorted(pairs // len(seqs), np.arange(1, len(distinct))))
            group = np.array([sets.setdefault(x.tobytes(), len(sets)) for x in owner], np.int64)
            self.groups.append((size, distinct, group, item, place, which))
        #: of each set of items their ids
        self.sets = [sorted({x for k in np.frombuffer(b, np.int64) for x in self.ids[k]}) for b in sets]

    def encode(self, h: np.ndarray) -> np.ndarray:
        """1 + the word's place in the vocabulary; 0 for any other word."""
        at = np.minimum(np.searchsorted(self.vocab, h), max(len(self.vocab) - 1, 0))
        return np.where(self.vocab[at] == h, at + 1, 0) if len(self.vocab) else np.zeros(len(h), np.int64)

    def keys(self, m: np.ndarray, fill: int = 0) -> np.ndarray:
        """Rows of word numbers as byte strings of the window's length that sort like them."""
        out = np.full((len(m), self.window), fill, f">u{self.width}")
        out[:, : m.shape[1]] = m
        return out.view(f"S{self.window * self.width}").ravel()

    def above(self, p: np.ndarray, size: int) -> np.ndarray:
        """The upper end of the suffixes that begin with each pattern of ``size`` words."""
        m = p.view(f">u{self.width}").reshape(len(p), self.window)[:, :size]
        return self.keys(m, (1 << (8 * self.width)) - 1)


def _distinct(a: np.ndarray) -> np.ndarray:
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the ranges lo..hi: the range's number and the member, for every member."""
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + lo[which]


def search(b: X.Block, probe: Probe) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The occurrences in a shard, for each length of windows: the length, positions, and the window of each."""
    e = probe.encode(X.word_hashes(b))
    cut = np.zeros(len(e) + 1, bool)
    cut[b.offsets] = True
    # words from here to the next foreign word or the document's end
    stop = np.flatnonzero((e == 0) | cut[:-1])
    nxt = np.append(stop, len(e))
    ahead = nxt[np.searchsorted(stop, np.arange(len(e)), "right")] - np.arange(len(e))
    at = np.flatnonzero((e > 0) & (ahead >= probe.shortest)) if len(probe.vocab) else np.zeros(0, np.int64)
    if not len(at):
        return []
    padded = np.concatenate([e, np.zeros(probe.window, e.dtype)])
    m = padded[at[:, None] + np.arange(probe.window)]
    m[np.arange(probe.window)[None, :] >= ahead[at][:, None]] = 0
    key = probe.keys(m)
    order = np.argsort(key, kind="stable")  # the suffix array
    at, key = at[order], key[order]
    out = []
    for size, pats, *_ in probe.groups:
        lo = np.searchsorted(key, pats, "left")
        hi = np.searchsorted(key, pats if size == probe.window else probe.above(pats, size), "right")
        which, member = _spread(lo, hi)
        out.append((size, at[member], which))
    return out


def longest(pos: np.ndarray, which: np.ndarray, item: np.ndarray, place: np.ndarray, there: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The longest verbatim matches as rows (position, item, place, windows): at each position the longest match with any item (the
    first place that has it, in the order of suffixes), unless it only continues the one a word before.

    ``pos`` and ``which`` are occurrences and their windows, ``item``, ``place`` and ``there`` the items' places and theirs.  Both sides' suffixes are ranked
    together by doubling, and a position's longest match is with a neighbour of the other side in that order, so the work
    is that of sorting occurrences and places, however many of each have the same words."""
    if not len(pos):
        return np.zeros((0, 4), np.int64)
    order = np.argsort(pos, kind="stable")
    pos, which = pos[order], which[order]
    near = np.isin(there, which)
    item, place, there = item[near], place[near], there[near]
    doc = np.searchsorted(offsets, pos, "right")
    n = len(pos)
    own = np.concatenate([which, there])
    follows = np.zeros(len(own) + 1, bool)
    follows[1:n] = (pos[1:] == pos[:-1] + 1) & (doc[1:] == doc[:-1])
    follows[n + 1 : -1] = (place[1:] == place[:-1] + 1) & (item[1:] == item[:-1])
    # runs of windows that follow each other, as slots with an own sign behind each run
    run = np.cumsum(~follows[:-1]) - 1
    slot = np.arange(len(own)) + run
    rank = -1 - np.arange(len(own) + run[-1] + 2)
    rank[slot] = own
    levels = [np.unique(rank, return_inverse=True)[1]]
    reach = int(np.bincount(run).max())
    while (1 << (len(levels) - 1)) < reach:
        r, step = levels[-1], 1 << (len(levels) - 1)
        behind = np.concatenate([r[step:], np.zeros(min(step, len(r)), r.dtype)])[: len(r)]
        levels.append(np.unique(r * (len(r) + 1) + behind, return_inverse=True)[1])
    by = np.argsort(levels[-1], kind="stable")
    by = by[rank[by] >= 0]
    bench = by >= slot[n] if len(own) > n else np.zeros(len(by), bool)
    # of each suffix the benchmark's last one before it and first one behind it
    k = np.arange(len(by))
    before = np.maximum.accumulate(np.where(bench, k, -1))
    behind = np.minimum.accumulate(np.where(bench, k, len(by))[::-1])[::-1]
    mine = ~bench
    p = by[mine]
    best, with_ = np.zeros(len(p), np.int64), np.full(len(p), -1)
    for other in (before[mine], behind[mine]):
        ok = (other >= 0) & (other < len(by))
        q = by[np.where(ok, other, 0)]
        size = np.zeros(len(p), np.int64)
        for j in range(len(levels) - 1, -1, -1):
            x, y = np.minimum(p + size, len(rank) - 1), np.minimum(q + size, len(rank) - 1)
            size += np.where(ok & (levels[j][x] == levels[j][y]) & (x != y), 1 << j, 0)
        better = size > best
        best, with_ = np.where(better, size, best), np.where(better, q, with_)
    back = np.full(len(rank), -1)
    back[slot] = np.arange(len(own))
    at = back[p]
    length, other = np.zeros(n, np.int64), np.zeros(n, np.int64)
    length[at], other[at] = best, back[with_] - n
    new = np.concatenate([[True], ~(follows[1:n] & (length[:-1] == length[1:] + 1))])
    return np.stack([pos[new], item[other[new]], place[other[new]], length[new]], 1)


RESULT = "n_words long, hits array<long>, items array<string>, matches array<struct<item_id:string,item_start:long,doc_start:long,n_words:long>>"


def _annotated(texts: pa.Array, probe: Probe, before: pa.RecordBatch | None, located: bool) -> dict[str, pa.Array]:
    n_words, hits, items, matches = [], [], [], []
    for b in X.blocks(texts, X.ALNUM, True, SHARD_BYTES):
        edge = np.zeros(len(b.start) + 1, np.int64)
        found: list[np.ndarray] = []
        sets = np.zeros(0, np.int64)
        for (size, pos, which), (_, _, group, item, place, there) in zip(search(b, probe), probe.groups, strict=False):
            np.add.at(edge, pos, 1)
            np.add.at(edge, pos + size, -1)
            doc = np.searchsorted(b.offsets, pos, "right") - 1
            sets = np.union1d(sets, doc * len(probe.sets) + group[which])
            if located:
                rows = longest(pos, which, item, place, there, b.offsets)
                rows[:, 3] += size - 1
                found.append(rows)
        hit = np.cumsum(edge)[:-1] > 0
        own: dict[int, list] = {}
        named: dict[int, set] = {}
        for x in sets.tolist():
            named.setdefault(x // len(probe.sets), set()).update(probe.sets[x % len(probe.sets)])
        for p, k, q, n in np.concatenate(found).tolist() if found else []:
            d = int(np.searchsorted(b.offsets, p, "right")) - 1
            own.setdefault(d, []).append({"item_id": next(iter(probe.ids[k]), None), "item_start": q, "doc_start": p - int(b.offsets[d]), "n_words": n})
        n_words.append(b.n_words)
        ranges: dict[int, list[int]] = {}
        for d in np.flatnonzero(X.sums(hit, b.offsets)).tolist():
            x = hit[b.offsets[d] : b.offsets[d + 1]].astype(np.int8)
            ranges[d] = np.flatnonzero(np.diff(np.concatenate([[0], x, [0]]))).tolist()
        for d in range(b.last - b.first):
            hits.append(ranges.get(d, []))
            items.append(sorted(named.get(d, ())))
            matches.append(own.get(d, []))
    if before is not None:
        hits = [_union(a, b) if a and b else a or b for a, b in zip(before.column("hits").to_pylist(), hits, strict=True)]
        items = [sorted({*a, *b}) for a, b in zip(before.column("items").to_pylist(), items, strict=True)]
        matches = [[*a, *b] for a, b in zip(before.column("matches").to_pylist(), matches, strict=True)]
    match = pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("n_words", pa.int64())])
    return {
        "n_words": pa.array(np.concatenate([*n_words, np.zeros(0, np.int64)]), pa.int64()),
        "hits": pa.array(hits, pa.list_(pa.int64())),
        "items": pa.array(items, pa.list_(pa.string())),
        "matches": pa.array(matches, pa.list_(match)),
    }


def _union(a: list[int], b: list[int]) -> list[int]:
    """The union of two sorted lists of range ends."""
    out: list[int] = []
    for lo, hi in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and lo <= out[-1]:
            out[-1] = max(out[-1], hi)
        else:
            out += [lo, hi]
    return out


def annotate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS, keep: list[str] | None = None, located: bool = True) -> DataFrame:
    """Each document with its verbatim benchmark matches.

    Returns ``row`` (a struct of the document's columns, or of those in ``keep``), ``n_words``,
    ``hits`` (ends of the ranges of words that lie in any occurrence: start, end, start, ...),
    ``items`` (ids of the items with occurring windows) and, unless ``located`` is false, ``matches``
    (the longest verbatim matches, see ``longest``: item, its first word, the document's first word, length; at most one for
    each word of a document and length of windows).
    """
    spark = docs.sparkSession
    X.bounded_batches(spark)
    kept = [c for c in docs.columns if keep is None or c in keep]
    bench = benchmark.select(X.named(item_id).cast("string").alias("i"), X.named(item_text).alias("t"))
    chars = bench.agg(F.sum(F.length("t"))).first()[0] or 0
    n_blocks = max(1, -(-chars // block_chars))
    df = docs.select(F.struct(*[X.named(c) for c in kept]).alias("row"), X.named(text).alias("text"))
    written = None
    for k in range(n_blocks):
        part = bench if n_blocks == 1 else bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == k)
        probe = X.share(spark, Probe([tuple(r) for r in part.collect()], window))
        last = k == n_blocks - 1
        fields = T.StructType([df.schema["row"], *([] if last else [df.schema["text"]])])
        for f in T._parse_datatype_string(RESULT).fields:
            fields.add(f)

        def run(batches: Iterator[pa.RecordBatch], probe=probe, first=k == 0, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                got = _annotated(batch.column("text"), probe.value, None if first else batch, located)
                names = ["row"] if last else ["row", "text"]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + list(got.values()), names + list(got))

        df = df.mapInArrow(X.lean(run), fields)
        if not last:  # the next block begins where this one's results are written, so that no task holds two
            df, read = storage.stage(df, "matched"), written
            probe.drop()
            storage.release(read)
            written = df
    return df


def n_hit() -> F.Column:
    return F.coalesce(F.aggregate(F.transform("hits", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))


def contaminated() -> F.Column:
    """Whether at least one in ``ONE_IN`` words is hit."""
    return (n_hit() > 0) & (n_hit() * ONE_IN >= F.col("n_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    return annotate(docs, benchmark, located=False, **options).where(~contaminated()).select("row.*")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return annotate(docs, bench, keep=["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0)).alias("longest"),
    )


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bpos AS (
  SELECT item_id, r, i, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, row_number() OVER () AS r, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM bw WHERE len(w) > 0)),
bwin AS (SELECT DISTINCT item_id, n, win FROM bpos),
sizes AS (SELECT DISTINCT n FROM bwin),
occ AS (
  SELECT d.doc_id, d.i, d.n, d.win FROM (
    SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)) d
  WHERE EXISTS (SELECT 1 FROM bwin b WHERE b.n = d.n AND b.win = d.win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (
  SELECT DISTINCT o.doc_id, CAST(b.item_id AS VARCHAR) AS i FROM occ o JOIN bwin b ON b.n = o.n AND b.win = o.win) GROUP BY 1),
dia AS (SELECT o.doc_id, b.r, o.n, o.i - b.i AS g, o.i - row_number() OVER (PARTITION BY o.doc_id, b.r, o.n, o.i - b.i ORDER BY o.i) AS island FROM occ o JOIN bpos b ON b.n = o.n AND b.win = o.win),
lng AS (SELECT doc_id, max(k) AS longest FROM (SELECT doc_id, count(*) + n - 1 AS k FROM dia GROUP BY doc_id, r, n, g, island) GROUP BY 1)
SELECT doc_id, coalesce(longest, 0) AS longest, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN lng USING (doc_id)
"""
