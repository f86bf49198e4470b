"""Vectorised words and hashes over Arrow string columns.

Everything works on the UTF-8 bytes of a whole batch: a 256-entry table says which bytes
belong to words (bytes from 0x80 on always do, so code points are never cut), words are byte
ranges, and a word's hash is folded from its bytes eight at a time.  No Python string is made.
"""

from __future__ import annotations

import contextlib
import ctypes
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

U = np.uint64
K1, K2, K3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Bytes of text that are tokenised at a time; one longer document is taken alone.
BLOCK_BYTES = 1 << 21
#: Session settings that keep Arrow batches small whatever the texts' lengths.
BATCH_BYTES = 4 << 20
#: Batches after which a worker gives back the memory it has freed.
TRIM_BATCHES = 8


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        t[lo : hi + 1] = True
    return t


#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
ALNUM = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: `[^\x20\x09-\x0D]+`
NOT_SPACE = ~byte_table((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def bounded_batches(spark) -> None:
    """Bound Arrow batches by bytes as well as rows, so that long texts don't add up."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def named(column: str):
    """A column by its name, whatever signs are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def own_name(id: str, *results: str) -> str:
    """The name under which a result carries the rows' id: the id column's own, or ``id`` if a result column is named like it."""
    return id if id not in results else "id"


class Shared:
    """A broadcast value that travels as bytes, unpickled once in each worker."""

    def __init__(self, blob):
        self.blob, self.got = blob, None

    def __reduce__(self):
        return Shared, (self.blob,)

    @property
    def value(self):
        if self.got is None:
            self.got = pickle.loads(self.blob.value)
            vars(self.blob).pop("_value", None)  # the bytes themselves aren't needed any more
        return self.got

    def drop(self) -> None:
        """Free the executors' copies; no task may need them any more."""
        self.blob.destroy()


def share(spark, value) -> Shared:
    """Broadcast ``value`` with the code of its class, so that executors need no installation of this package."""
    return Shared(spark.sparkContext.broadcast(cloudpickle.dumps(value)))


def trim() -> None:
    """Give memory that Arrow and the C library hold in reserve back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """``run`` over batches, with the worker's reserves given back now and then and at the end: workers outlive their tasks, and
    several share an executor."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fed() -> Iterator[pa.RecordBatch]:
            for k, batch in enumerate(batches):
                yield batch
                if k % TRIM_BATCHES == TRIM_BATCHES - 1:
                    del batch
                    trim()

        yield from run(fed())
        trim()

    return wrapped


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not (pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)):
        arr = arr.cast(pa.large_binary() if pa.types.is_binary(arr.type) else pa.large_string())
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_large_binary(arr.type) else "")
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


@dataclass
class Block:
    """Documents ``first``..``last`` of a batch. Word i is data[start[i]:end[i]]; document d
    (from 0) holds words offsets[d]..offsets[d + 1]."""

    first: int
    last: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.offsets)


def blocks(arr: pa.Array, table: np.ndarray, lower: bool, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The batch's documents in order, in blocks of about ``limit`` bytes."""
    data, off = buffers(arr)
    n, first = len(off) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        d = data[off[first] : off[last]]
        yield _block(first, last, LOWER[d] if lower else d, off[first : last + 1] - off[first], table)
        first = last


def _block(first: int, last: int, d: np.ndarray, off: np.ndarray, table: np.ndarray) -> Block:
    m = np.zeros(len(d) + 2, bool)
    m[1:-1] = table[d]
    inner = m[1:-1]
    cut = np.zeros(len(d) + 1, bool)
    cut[off] = True
    start = np.flatnonzero(inner & (~m[:-2] | cut[:-1]))
    end = np.flatnonzero(inner & (~m[2:] | cut[1:])) + 1
    return Block(first, last, d, start, end, np.searchsorted(start, off))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * K2
    x = (x ^ (x >> U(27))) * K3
    return x ^ (x >> U(31))


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    size = end - start
    h = mix(size.astype(np.uint64) * K1 + U(seed))
    if not len(start):
        return h
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    at8 = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    live, pos, left = None, start, size
    while True:
        x = at8[pos] & MASKS[np.minimum(left, 8)]
        if live is None:
            h = mix((h ^ x) * K1 + K3)
        else:
            h[live] = mix((h[live] ^ x) * K1 + K3)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h
        live = more if live is None else live[more]
        pos, left = pos[more] + 8, left[more] - 8


def word_hashes(b: Block, seed: int = 0) -> np.ndarray:
    return hash_ranges(b.data, b.start, b.end, seed)


def windows(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each n consecutive hashes; the result has len(h) - n + 1 entries."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, seed, np.uint64)
    for j in range(n):
        out *= K1
        out += h[j : j + m]
        out ^= out >> U(29)
    return mix(out)


def window_starts(offsets: np.ndarray, n: int) -> np.ndarray:
    """The word indexes at which a window of n words fits in one document."""
    sizes = np.maximum(np.diff(offsets) - n + 1, 0)
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(offsets[:-1] - (ends - sizes), sizes)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each range offsets[d]..offsets[d + 1], 0 where it is empty."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[offsets[1:]] - c[offsets[:-1]]
