"""Substring deduplication behind a count-min prefilter.

A window is ``window`` consecutive words of one document; every word covered by a window whose
word sequence also starts earlier is removed.  Documents are packed once into compressed rows
(packs), which stay as they are for all passes:

1. Each pack makes a count-min sketch of ``ROWS`` rows, each with ``CELLS_PER_WINDOW`` cells for every window
   of the corpus, kept sparse (sorted cell numbers, delta-coded, counts saturating at two) and cut
   by cell range.  The merged sketches of a range overestimate every window's count; a window is taken
   for repeated if its cell counts two in every row.  Each pack gets back one bit per cell.  No repeated
   window is lost; of the others (1 - exp(-1 / CELLS_PER_WINDOW)) ** ROWS pass, 1.4 %.
2. Only windows estimated repeated are grouped exactly, by 128 bits of their words: a pack sends
   each distinct one once, with its first place, and gets back one bit: whether the corpus'
   first occurrence is its own.

What reaches a range is at most one entry per pack and window, however often the window repeats, so
hot passages don't make hot tasks; ranges are cut by hash, their number grows with the corpus, and a pack
writes only to those in which it has windows.
What is shuffled is about three bytes a window, then the repeated windows, and the packs; the first
shuffle's files are gone before the second begins.

Defined results: ids are integers.  Null and empty texts have no words.  Rows are ordered by id (null first); rows
with one id follow each other in the order of their packs, and the later one repeats the earlier.
Other columns are ignored.  A document shorter than the window loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavane import storage
from stratavane.llm import _text as X

WINDOW = 20
#: Bytes of text in a pack; one longer document is a pack of its own.
PACK_BYTES = 8 << 20
#: Windows that a range of cells or keys holds on average.
RANGE_WINDOWS = 2_000_000
#: Rows of the sketch, and each row's cells for every window of the corpus.
ROWS, CELLS_PER_WINDOW = 2, 8


def _deflate(a: np.ndarray) -> bytes:
    """Compress numbers by byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()) if len(a) else b""


def _inflate(blob: bytes, dtype: type) -> np.ndarray:
    if not blob:
        return np.zeros(0, dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def _bits(flags: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(flags).tobytes())


def _flags(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), count=n).astype(bool)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, k = TaskContext.get().partitionId(), 0
    held: list[pa.Table] = []
    size = 0

    def out() -> pa.RecordBatch:
        t = pa.concat_tables(held).combine_chunks()
        t = t.take(pa.compute.sort_indices(t, [("id", "ascending")], null_placement="at_start")) if t.num_rows > 1 else t
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(t)
        n = sum(int(np.maximum(b.n_words, 0).sum()) for b in X.blocks(t["text"], X.NOT_SPACE, False))
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) | k], pa.int64()), pa.array([n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["pack", "n", "blob"])

    for batch in batches:
        text = batch.column("text").cast(pa.large_string()).fill_null("")
        t = pa.Table.from_arrays([batch.column("id"), text], ["id", "text"])
        off = X.buffers(text)[1]
        at = 0
        while at < t.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + PACK_BYTES - size, "right")) - 1)
            if size and off[at + 1] - off[at] > PACK_BYTES - size:
                end = at
            if end > at:
                held.append(t.slice(at, end - at))
                size += int(off[end] - off[at])
                at = end
            if size >= PACK_BYTES or at < t.num_rows:
                yield out()
                held, size, k = [], 0, k + 1
    if held:
        yield out()


class Pack:
    """A pack's documents and the hashes of their windows."""

    def __init__(self, blob: bytes, window: int, with_blocks: bool = False):
        t = pa.ipc.open_stream(blob).read_all().combine_chunks()
        self.ids, self.text, self.window = t["id"].combine_chunks(), t["text"], window
        words, sizes, self.blocks = [], [], []
        for b in X.blocks(self.text, X.NOT_SPACE, False):
            words.append(X.word_hashes(b))
            sizes.append(b.n_words)
            if with_blocks:
                self.blocks.append(b)
        self.words = np.concatenate([*words, np.zeros(0, np.uint64)])
        self.offsets = np.concatenate([[0], np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)]))]).astype(np.int64)
        self.starts = X.window_starts(self.offsets, window)
        self.hash = X.windows(self.words, window)[self.starts] if len(self.starts) else np.zeros(0, np.uint64)

    def placed(self, bits: int, row: int) -> np.ndarray:
        """Each window's cell in a row of the sketch."""
        return (X.mix(self.hash * X.K2 + X.U(row)) if row else self.hash) >> X.U(64 - bits)

    def cells(self, bits: int, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct cells, sorted, and whether the pack itself has two windows in each."""
        c = np.sort(self.placed(bits, row))
        new = np.concatenate([[True], c[1:] != c[:-1]]) if len(c) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        return c[at], np.diff(np.append(at, len(c))) > 1

    def keys(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows ``which``, ordered by key and place: their numbers, both halves of
        the key, and where a new key begins."""
        a = self.hash[which]
        b = np.zeros(len(which), np.uint64)
        at = self.starts[which]
        for j in range(self.window):
            b = X.mix(b + self.words[at + j] * X.K2 + X.K1)
        order = np.lexsort((which, b, a))
        a, b = a[order], b[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        return which[order], a, b, np.flatnonzero(new)


def _parts(values: np.ndarray, bits: int, ranges: int) -> list[tuple[int, slice]]:
    """The parts of sorted numbers that lie in each of the ``ranges`` equal parts of the number space, where any do."""
    r = values >> X.U(bits - (ranges.bit_length() - 1))
    at = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, np.int64)
    return [(int(r[lo]), slice(int(lo), int(hi))) for lo, hi in zip(at, np.append(at[1:], len(r)), strict=True)]


def _binary(columns: dict) -> pa.RecordBatch:
    kinds = {"pack": pa.int64(), "r": pa.int64(), "kind": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.binary())) for k, v in columns.items()], list(columns))


def _sketch(bits: int, ranges: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, blob in zip(batch.column("pack").to_pylist(), batch.column("blob"), strict=True):
                p = Pack(blob.as_py(), window)
                for row in range(ROWS):
                    cells, twice = p.cells(bits, row)
                    value = cells * X.U(2) + twice
                    parts = _parts(cells, bits, ranges)
                    yield _binary({"pack": [pack] * len(parts), "r": [row * ranges + r for r, _ in parts], "data": [_deflate(np.diff(value[s], prepend=X.U(0))) for _, s in parts]})

    return run


def _merge(table: pa.Table) -> pa.Table:
    """The merged sketch of a range of cells: for each pack, which of its cells count two."""
    packs, rows = table["pack"].to_pylist(), []
    for blob in table["data"].to_pylist():
        rows.append(np.cumsum(_inflate(blob, np.uint64), dtype=np.uint64))
    cells = np.sort(np.concatenate([v >> X.U(1) for v in rows]))
    again = cells[1:][cells[1:] == cells[:-1]]
    again = np.sort(np.concatenate([again, *[v[(v & X.U(1)) > 0] >> X.U(1) for v in rows]]))
    return pa.table({"pack": pa.array(packs, pa.int64()), "r": table["r"].combine_chunks().cast(pa.int64()), "data": pa.array([_bits(_member(v >> X.U(1), again)) for v in rows], pa.binary())})


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def _replies(got: list | None, parts: list[tuple[int, slice]], n: int, first: int = 0) -> np.ndarray:
    """The replies of the ranges from ``first`` on, in the order of what was sent."""
    out, place = np.zeros(n, bool), {first + r: s for r, s in parts}
    for x in got or []:
        if x["r"] in place:
            s = place[x["r"]]
            out[s] = _flags(x["data"], s.stop - s.start)
    return out


def _candidates(bits: int, ranges: int, key_ranges: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, blob, got in zip(batch.column("pack").to_pylist(), batch.column("blob"), batch.column("got"), strict=True):
                p = Pack(blob.as_py(), window)
                answers, maybe = got.as_py(), np.ones(len(p.hash), bool)
                for row in range(ROWS):
                    cells, _ = p.cells(bits, row)
                    maybe &= _member(p.placed(bits, row), cells[_replies(answers, _parts(cells, bits, ranges), len(cells), row * ranges)])
                which, a, b, new = p.keys(np.flatnonzero(maybe))
                parts = _parts(a[new], 64, key_ranges)
                doc = np.searchsorted(p.offsets, p.starts[which[new]], "right") - 1
                ids = p.ids.cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)[doc]
                a, b = a[new], b[new]
                yield _binary(
                    {
                        "kind": [0, *[1] * len(parts)],
                        "pack": [pack] * (len(parts) + 1),
                        "r": [-1, *[r for r, _ in parts]],
                        "data": [_bits(maybe), *[_deflate(np.diff(a[s], prepend=X.U(0))) for _, s in parts]],
                        "more": [b"", *[_deflate(b[s]) for _, s in parts]],
                        "ids": [b"", *[_deflate(ids[s]) for _, s in parts]],
                    }
                )

    return run


def _first(table: pa.Table) -> pa.Table:
    """Of a range of keys: for each pack, which of its keys first occur in it."""
    packs = table["pack"].to_numpy()
    a = [np.cumsum(_inflate(x, np.uint64), dtype=np.uint64) for x in table["data"].to_pylist()]
    b = [_inflate(x, np.uint64) for x in table["more"].to_pylist()]
    ids = [_inflate(x, np.int64) for x in table["ids"].to_pylist()]
    sizes = [len(x) for x in a]
    a, b, ids, owner = np.concatenate(a), np.concatenate(b), np.concatenate(ids), np.repeat(packs, sizes)
    order = np.lexsort((owner, ids, b, a))
    sa, sb = a[order], b[order]
    new = np.concatenate([[True], (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])])
    first = np.zeros(len(a), bool)
    first[order] = new
    ends = np.cumsum(sizes)
    return pa.table({"pack": pa.array(packs, pa.int64()), "r": table["r"].combine_chunks().cast(pa.int64()), "data": pa.array([_bits(first[e - n : e]) for e, n in zip(ends, sizes, strict=True)], pa.binary())})


def _clean(key_ranges: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, state, got in zip(batch.column("blob"), batch.column("state"), batch.column("got"), strict=True):
                p = Pack(blob.as_py(), window, True)
                which, a, _, new = p.keys(np.flatnonzero(_flags(state.as_py(), len(p.starts))))
                own = _replies(got.as_py(), _parts(a[new], 64, key_ranges), len(new))
                later = np.ones(len(which), bool)
                later[new[own]] = False
                edge = np.zeros(len(p.words) + 1, np.int64)
                at = p.starts[which[later]]
                edge[at] += 1  # each window starts at its own word
                edge[at + window] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                yield from _cleaned(p, gone)

    return run


def _cleaned(p: Pack, gone: np.ndarray) -> Iterator[pa.RecordBatch]:
    done = 0
    for b in p.blocks:
        n = len(b.start)
        keep = ~gone[done : done + n]
        sizes = b.n_words
        kept = X.sums(keep, b.offsets)
        start, end = b.start[keep], b.end[keep]
        # each kept word and one space, without the last space of a document
        size = end - start + 1
        at = np.cumsum(size) - size
        total = int(size.sum())
        index = np.arange(total) - np.repeat(at, size) + np.repeat(start, size)
        space = at + size - 1
        out = np.append(b.data, np.uint8(32))[np.minimum(index, len(b.data))] if total else np.zeros(0, np.uint8)
        out[space] = 32
        last = np.cumsum(kept)[kept > 0] - 1
        drop = space[last]
        out = np.delete(out, drop)
        length = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=length[1:])
        ends = length[np.cumsum(kept)] - np.cumsum(kept > 0)
        off = np.concatenate([[0], ends]).astype(np.int64)
        text = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(off.tobytes()), pa.py_buffer(out.tobytes()))
        ids = p.ids.slice(b.first, b.last - b.first)
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(sizes - kept, pa.int64()), text.cast(pa.string())], ["id", "n_words", "n_removed", "kept_text"])
        done += n


def _ranges(windows: int) -> int:
    return 1 << max(3, (max(1, windows // RANGE_WINDOWS) - 1).bit_length())


def remove_repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: its id, ``n_words``, ``n_removed`` and ``kept_text``, the kept words
    joined by one space."""
    spark = docs.sparkSession
    if docs.schema[id].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id} must be an integer")
    X.bounded_batches(spark)
    packs = storage.stage(docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(_pack, "pack long, n long, blob binary"), "packs")
    n = packs.agg(F.sum("n")).first()[0] or 0
    bits, ranges = min(62, max(20, (max(1, n) * CELLS_PER_WINDOW).bit_length())), _ranges(n)
    sketches = packs.select("pack", "blob").mapInArrow(_sketch(bits, ranges, window), "pack long, r long, data binary")
    merged = sketches.groupBy("r").applyInArrow(_merge, "pack long, r long, data binary")
    found = storage.stage(
        _answered(packs, merged).mapInArrow(_candidates(bits, ranges, ranges, window), "kind int, pack long, r long, data binary, more binary, ids binary"),
        "windows",
    )
    first = found.where("kind = 1").select("pack", "r", "data", "more", "ids").groupBy("r").applyInArrow(_first, "pack long, r long, data binary")
    state = found.where("kind = 0").select("pack", F.col("data").alias("state"))
    cleaned = _answered(packs, first).join(state, "pack").mapInArrow(_clean(ranges, window), "id long, n_words long, n_removed long, kept_text string")
    return cleaned.withColumnRenamed("id", id)


def _answered(packs: DataFrame, replies: DataFrame) -> DataFrame:
    """Each pack with the replies it got, at most one for each of its windows."""
    got = replies.groupBy("pack").agg(F.collect_list(F.struct("r", "data")).alias("got"))
    return packs.select("pack", "blob").join(got, "pack", "left")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 19], ' ')) AS a, md5(array_to_string(w[i:i + 19], ' ')) AS b
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
