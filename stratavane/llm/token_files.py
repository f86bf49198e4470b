"""Token ids as Arrow IPC files of fixed-size-list batches.

``write`` encodes every text, appends an end id to each, cuts the stream of a shard into sequences of
``length`` ids and writes record batches of two fixed-size-list columns, ``ids`` and ``mask`` (false
on the padding of a shard's last sequence), so that a reader maps the file and takes any sequence
without copying.  Beside each shard stands a small Arrow index of its documents.  Shards follow
each other in ascending id order.  ``read`` gives the documents back from the files alone.

A text is split at white space and between letters and signs, which the tokenizer never crosses, and
each distinct word of a block is encoded by the library once; ids are then gathered in bulk.  Range partitioning by id and text is
the only shuffle.  A shard is written under a name of its own and moved into place when whole; the
manifest names the files that count, so retried or speculative tasks do no harm.  Files are written
with Arrow's file systems, which need to know the folder's scheme.

Defined results: null is the empty text (only the end id).  Rows with one id are ordered by a hash of
their texts, then by the texts; a null id comes first.  Other columns are ignored.  An empty table
gives no files.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
import types
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavane import storage
from stratavane.llm import _text as X

LENGTH = 2048
#: Sequences in a record batch.
BATCH = 128
#: Characters of text in a shard, at most, but for what range bounds differ.
SHARD_CHARS = 256 << 20
END_ID = 2
#: Bytes of text whose distinct words are encoded together.
BLOCK_BYTES = 8 << 20
#: Words whose ids a worker remembers (about 30 bytes each).
REMEMBERED = 1_500_000
#: The pre-tokenizer's pattern (a fixed value) under which letters and signs are always apart.
_CUTTING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_KINDS = np.zeros(256, np.uint8)
_KINDS[0x21:0x7F] = 2
_KINDS[0x41:0x5B] = _KINDS[0x61:0x7B] = 1
_KINDS[0x27] = 0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Known:
    """Words' ids by hash, in a few sorted tables; the oldest go when they hold too many words."""

    def __init__(self):
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def find(self, distinct: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """Ids (one word's after the other's) and their numbers for distinct sorted hashes; encode(k) gives
        both for those with numbers k, which then are remembered."""
        table, at = np.full(len(distinct), -1), np.zeros(len(distinct), np.int64)
        for k, (hashes, *_) in enumerate(self.tables):
            p = np.minimum(np.searchsorted(hashes, distinct), len(hashes) - 1)
            hit = hashes[p] == distinct
            table[hit], at[hit] = k, p[hit]
        new = np.flatnonzero(table < 0)
        if len(new):
            ids, sizes = encode(new)
            at[new], table[new] = np.arange(len(new)), len(self.tables)
            self.tables.append((distinct[new], np.cumsum(sizes) - sizes, sizes, ids))
        size, first = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        base, parts = 0, []
        for k, (_, own, sizes, ids) in enumerate(self.tables):
            some = np.flatnonzero(table == k)
            size[some], first[some] = sizes[at[some]], own[at[some]] + base
            base += len(ids)
            parts.append(ids)
        end = np.cumsum(size)
        total = int(size.sum())
        flat = np.concatenate([*parts, np.zeros(0, np.uint32)])[np.arange(total) - np.repeat(end - size, size) + np.repeat(first, size)]
        if len(self.tables) > 6:
            self.merge()
        return flat, size

    def merge(self) -> None:
        while len(self.tables) > 1 and sum(len(t[0]) for t in self.tables) > REMEMBERED:
            del self.tables[0]
        base = np.cumsum([0, *[len(t[3]) for t in self.tables[:-1]]])  # a merged table's ids aren't in the order of its hashes
        hashes, first, sizes, ids = (np.concatenate(x) for x in zip(*[(t[0], t[1] + b, t[2], t[3]) for t, b in zip(self.tables, base, strict=True)], strict=True))
        order = np.argsort(hashes)
        self.tables = [(hashes[order], first[order], sizes[order], ids)]


def _known(definition: str) -> Known:
    """What this worker process knows under the definition; processes outlive tasks, so words are
    encoded about once a worker."""
    name = "_stratavane_known_words"
    held = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    return held.setdefault(hashlib.sha256(definition.encode()).hexdigest(), Known())


class Encoder:
    """Encodes batches of texts with a tokenizers file, each distinct word once."""

    def __init__(self, definition: str, end_id: int | None = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_str(definition), end_id
        self.known = _known(definition)
        model = json.loads(definition)
        added = model.get("added_tokens") or []
        self.special = [t["content"].encode() for t in added]
        plain = [t for t in added if not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"])]
        self.mark = (plain[0]["content"].encode(), plain[0]["id"]) if plain else None
        # cutting at signs is only right for this kind of pre-tokenizer and normalizers that look at single characters
        first = ((model.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.cuts = first.get("type") == "Split" and first.get("pattern", {}).get("Regex") == _CUTTING

    def finer(self, b: X.Block) -> X.Block:
        """The block with its words also cut between letters and signs or digits, where the pre-tokenizer
        always cuts. Letters are those of ASCII and Latin-1; an apostrophe, which may begin a contraction,
        and all other characters stay with their neighbours. Blocks that name a special token stay whole."""
        if not self.cuts or any(t in b.data.tobytes() for t in self.special):
            return b
        kind = _KINDS[b.data]
        lead = np.flatnonzero(b.data[:-1] == 0xC3)
        lead = lead[(b.data[lead + 1] != 0x97) & (b.data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = 1
        change = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
        # those inside a word, not at its beginning
        at = np.searchsorted(b.start, change, "right") - 1
        change = change[(at >= 0) & (b.start[np.maximum(at, 0)] < change)]
        start, end = np.sort(np.concatenate([b.start, change])), np.sort(np.concatenate([b.end, change]))
        place = np.append(b.start, len(b.data))[b.offsets]
        return X.Block(b.first, b.last, b.data, start, end, np.searchsorted(start, place))

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after the other, and each word's number of ids. Many words are encoded in
        one call with a special token between them, on both sides of which the library starts afresh."""
        joined = b" ".join(texts)
        if self.mark is None or any(x in joined for x in self.special):
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
            return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))
        flat, sizes = [], []
        for lo in range(0, len(texts), 20_000):
            part = texts[lo : lo + 20_000]
            [e] = self.tokenizer.encode_batch_fast([(self.mark[0].join(part) + self.mark[0]).decode()], add_special_tokens=False)
            ids = np.array(e.ids, np.uint32)
            stop = ids == self.mark[1]
            at = np.flatnonzero(stop)
            if len(at) != len(part):
                raise ValueError("the tokenizer doesn't keep its special tokens apart")
            flat.append(ids[~stop])
            sizes.append(np.diff(at, prepend=-1) - 1)
        return np.concatenate([*flat, np.zeros(0, np.uint32)]), np.concatenate([*sizes, np.zeros(0, np.int64)])

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For blocks of the texts in order: all their ids, and each text's number of ids."""
        for b in X.blocks(texts, X.NOT_SPACE, False, BLOCK_BYTES):
            b = self.finer(b)
            h = X.word_hashes(b)
            s = np.sort(h)
            distinct = s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s
            inverse = np.searchsorted(distinct, h)
            example = np.zeros(len(distinct), np.int64)
            example[inverse] = np.arange(len(h))
            raw = b.data.tobytes()
            start, end = b.start[example], b.end[example]
            flat, size = self.known.find(distinct, lambda k: self.words([raw[x:y] for x, y in zip(start[k].tolist(), end[k].tolist(), strict=True)]))  # noqa: B023
            if self.end_id is not None:
                inverse = np.insert(inverse, b.offsets[1:], len(size))
                flat, size = np.append(flat, np.uint32(self.end_id)), np.append(size, 1)
                ends = b.offsets[1:] + np.arange(1, len(b.offsets))
            else:
                ends = b.offsets[1:]
            first = np.cumsum(size) - size
            n = size[inverse]
            at = np.cumsum(n) - n
            total = int(n.sum())
            out = flat[np.arange(total) - np.repeat(at, n) + np.repeat(first[inverse], n)]
            stops = np.append(at, total)[ends]
            yield out, np.diff(np.concatenate([[0], stops]))


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))


def _schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class _Shard:
    """One shard being written."""

    def __init__(self, fs: pafs.FileSystem, base: str, length: int, kind: pa.DataType):
        self.length, self.kind, self.type = length, kind, np.dtype(kind.to_pandas_dtype())
        self.out = fs.open_output_stream(f"{base}.part")
        self.writer = pa.ipc.new_file(self.out, _schema(length, kind))
        self.held, self.n_held, self.n = [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.type))
        self.n_held += len(ids)
        self.n += len(ids)
        if self.n_held >= self.length * BATCH:
            self.flush()

    def flush(self, last: bool = False) -> None:
        ids = np.concatenate([*self.held, np.zeros(0, self.type)])
        whole = len(ids) if last else len(ids) // (self.length * BATCH) * self.length * BATCH
        for lo in range(0, whole, self.length * BATCH):
            part = ids[lo : min(lo + self.length * BATCH, whole)]
            rows = -(-len(part) // self.length)
            mask = np.arange(rows * self.length) < len(part)
            part = np.concatenate([part, np.zeros(rows * self.length - len(part), self.type)])
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (part, mask)]
            self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=_schema(self.length, self.kind)))
        self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self.flush(True)
        self.writer.close()
        self.out.close()


def write(docs: DataFrame, path: str, *, id: str = "doc_id", text: str = "text", vocabulary: str | None = None, length: int = LENGTH, end_id: int | None = END_ID) -> list[tuple[str, int, int]]:
    """Write the documents' ids below ``path``. Returns the shards in order: (file, ids of all shards
    before it, ids); there are as many as shuffle partitions, and more for texts of more than ``SHARD_CHARS`` characters each.
    Ids are integers."""
    spark = docs.sparkSession
    if docs.schema[id].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id} must be an integer")
    X.bounded_batches(spark)
    path = storage.qualified(spark, path)
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        definition = f.read()
    from tokenizers import Tokenizer

    kind = pa.uint16() if Tokenizer.from_str(definition).get_vocab_size(with_added_tokens=True) <= 1 << 16 else pa.uint32()
    definition = docs.sparkSession.sparkContext.broadcast(definition)
    rows = docs.select(X.named(id).cast("long").alias("id"), F.coalesce(X.named(text), F.lit("")).alias("text"))
    h = F.xxhash64("text")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n_shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // SHARD_CHARS))
    ordered = rows.repartitionByRange(n_shards, F.col("id"), h).sortWithinPartitions("id", h, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _file_system(path)
        fs.create_dir(folder, recursive=True)
        base, shard = f"{folder}/{uuid.uuid4().hex}", None
        encoder, ids, sizes = Encoder(definition.value, end_id), [], []
        for batch in batches:
            shard = shard or (_Shard(fs, base, length, kind) if batch.num_rows else None)
            ids.append(batch.column("id"))
            for found, n in encoder.encode(batch.column("text")):
                shard.add(found)
                sizes.append(n)
        if shard is None:
            return
        shard.close()
        n = np.concatenate(sizes)
        index = pa.table({"id": pa.chunked_array(ids, pa.int64()), "n_ids": pa.array(n, pa.int64())})
        with fs.open_output_stream(f"{base}.docs.arrow") as out, pa.ipc.new_file(out, index.schema) as w:
            w.write_table(index)
        fs.move(f"{base}.part", f"{base}.arrow")
        yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "file": f"{base.rsplit('/', 1)[1]}.arrow", "n": int(n.sum())}], pa.schema([("part", pa.int32()), ("file", pa.string()), ("n", pa.int64())]))

    manifest = sorted(tuple(r) for r in ordered.mapInArrow(run, "part int, file string, n long").collect())
    out, start = [], 0
    for _, file, n in manifest:
        out.append((f"{path}/{file}", start, n))
        start += n
    return out


def sequences(file: str) -> pa.ipc.RecordBatchFileReader:
    """A shard for random access: ``get_batch(k)`` has sequences k * BATCH and on, not copied
    where the file is local."""
    fs, at = _file_system(file)
    return pa.ipc.open_file(pa.memory_map(at) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(at))


def documents(file: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """The documents of a shard, from its files: id, place of its first id in the shard, ids."""
    fs, at = _file_system(file)
    with fs.open_input_file(at.removesuffix(".arrow") + ".docs.arrow") as f:
        index = pa.ipc.open_file(f).read_all()
    reader = sequences(file)
    batches = (reader.get_batch(k) for k in range(reader.num_record_batches))
    held, begin = np.zeros(0, np.uint32), 0  # begin: of the held ids, their place
    place = 0
    for key, n in zip(index["id"].to_pylist(), index["n_ids"].to_pylist(), strict=True):
        parts, need = [], n
        while need:
            if not len(held):
                held = next(batches).column("ids").values.to_numpy()
            take = held[:need]
            parts.append(take)
            held, need = held[len(take) :], need - len(take)
        begin = place
        place += n
        yield key, begin, parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, np.uint32)])


def read(spark: SparkSession, shards: list[tuple[str, int, int]]) -> DataFrame:
    """One row per document, read back from the files: ``id``, ``start`` (ids of all documents
    before it), ``n_tokens`` and ``ids_crc32`` of its ids as little-endian 32-bit numbers."""
    schema = "id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)
    rows = spark.createDataFrame([(f, s) for f, s, _ in shards], "file string, start long").repartition(len(shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                out = [(key, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for key, at, ids in documents(file)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, schema)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read(spark, write(docs, storage.new_path(spark, "tokens"))).withColumnRenamed("id", "doc_id")
