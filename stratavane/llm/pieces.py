"""SentencePiece encoding and decoding on a relational lattice.

Texts are cut into words: a word ends where no piece of the vocabulary holds the two characters at the cut, so
pieces never cross words.  Each word that a task hasn't met yet is exploded into its substrings of bounded length, these
are equi-joined to the table of the pieces' prefixes, and the edges found are grouped by word; the three steps run
on whole Arrow batches of words, where a word's substrings are together from the start (as separate engine
operators they cost several times as much; the README has the figures).  The lattice is then folded with
Spark's higher-order functions:

* for a unigram model by Viterbi (``aggregate`` over the positions, best score first);
* for a BPE model by its merge order (``aggregate`` that joins two neighbouring segments along the best
  edge, the leftmost on ties, as often as there are characters).  Viterbi would be wrong there: a BPE
  model's scores are ranks of merges, and their best sum is often not the library's segmentation.

Characters without a piece become byte pieces.  Words longer than ``FOLD_CHARS`` are folded by the same
rule in Python (merges with a heap).

Words and documents travel through one task in one stream: the words that a block of documents needs come before it, and a
document refers to its words by their numbers in the task's vocabulary.  So nothing is shuffled, nothing about the corpus
passes the driver, and a lost task is simply run again.  Every task's vocabulary begins with the words that are frequent in a
bounded sample (at most ``FREQUENT_WORDS``, encoded once and broadcast); which ones these are changes no result, only
how often the same word is folded anew.  A task's vocabulary starts again once it holds ``TASK_WORDS`` words.

Defined results: null and empty texts have no ids.  Decoding gives back the text, but for a literal
word mark, which becomes a space as in the library.  Strings of control pieces in a text are ordinary
text.  Repeated rows each get a result; other columns pass through ``encode`` and ``decode``, and one with the name of
the new column is replaced by it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratavane.llm import _text as X

MARK = "▁"
FOLD_CHARS = 256
#: Characters of a word whose places are bits of one long.
MASK_CHARS = 61
#: Words that every task knows from the start (about 30 bytes each), and the characters of text they are counted in.
FREQUENT_WORDS, SAMPLE_CHARS = 200_000, 48_000_000
#: New words after which a task's vocabulary starts again (about 40 bytes each).
TASK_WORDS = 2_000_000
#: Words whose lattices are made at a time.
WORD_ROWS = 4_000
#: Documents that are decoded at a time.
DECODED_ROWS = 1000


@dataclass
class Pieces:
    """A model's normal pieces (text, id, score), byte pieces and kind."""

    rows: list[tuple[str, int, float]]
    bytes: list[int] | None
    unknown: int
    kind: str = "bpe"

    @property
    def joins(self) -> np.ndarray:
        """Whether some piece may hold two neighbouring characters of which the first ends with one byte and
        the second begins with the other. A space stands for the word mark."""
        out = np.zeros((256, 256), bool)
        forms = lambda c: (b" ", MARK.encode()) if c == MARK else (c.encode(),)
        for p, _, _ in self.rows:
            for x, y in zip(p, p[1:], strict=False):
                for v in forms(x):
                    for w in forms(y):
                        out[v[-1], w[0]] = True
        return out

    @property
    def longest(self) -> int:
        return max([1, *(len(p) for p, _, _ in self.rows)])


def load(path: str | None = None) -> Pieces:
    """The pieces of a sentencepiece model file; by default the public one."""
    import public_tokenizers
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    path = path or public_tokenizers.path("piece_bpe_32k.model")
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(p.serialized_model_proto())
    if proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.add_dummy_prefix or proto.normalizer_spec.name != "identity":
        raise ValueError("only identity normalisation with a leading word mark is supported")
    rows, byte = [], {}
    for i, x in enumerate(proto.pieces):
        if x.type in (1, 4):
            rows.append((x.piece, i, float(x.score)))
        elif x.type == 6:
            byte[int(x.piece[1:-1], 16)] = i
    return Pieces(rows, [byte[b] for b in range(256)] if len(byte) == 256 else None, p.unk_id(), "bpe" if proto.trainer_spec.model_type == 2 else "unigram")


# --- words -------------------------------------------------------------------------------------------


def _blocks(texts: pa.Array, joins: np.ndarray) -> Iterator[X.Block]:
    """Texts in blocks, each with a leading space if it isn't empty, cut into words."""
    data, off = X.buffers(texts)
    n, first = len(off) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + X.BLOCK_BYTES, "right")) - 1)
        own = off[first : last + 1] - off[first]
        d = np.insert(data[off[first] : off[last]], own[np.flatnonzero(np.diff(own))], np.uint8(32))
        own = own + np.concatenate([[0], np.cumsum(np.diff(own) > 0)])
        begins = np.zeros(len(d) + 1, bool)
        begins[1:-1] = ((d[1:] & 0xC0) != 0x80) & ~joins[d[:-1], d[1:]]
        begins[own] = True
        start = np.flatnonzero(begins[:-1])
        yield X.Block(first, last, d, start, np.append(start[1:], len(d)), np.searchsorted(start, own))
        first = last


def _distinct(b: X.Block, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """The block's distinct words: their hashes, a second hash that tells apart what shares the first, of each word its place among
    them, and of each distinct one an example; nothing if two of them share the first hash."""
    h, size = X.word_hashes(b, seed), b.end - b.start
    s = np.sort(h)
    d = s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s
    inverse = np.searchsorted(d, h)
    example = np.zeros(len(d), np.int64)
    example[inverse] = np.arange(len(h))
    # words of equal size and at most eight bytes never share a hash
    check = size.astype(np.uint64)
    long = np.flatnonzero(size > 8)
    check[long] += X.hash_ranges(b.data, b.start[long], b.end[long], seed + 1) << X.U(16)
    same = check == check[example][inverse]
    return (d, check[example], inverse, example) if same.all() else None


def _strings(b: X.Block, which: np.ndarray) -> pa.Array:
    size = b.end[which] - b.start[which]
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    index = np.arange(int(off[-1])) - np.repeat(off[:-1].astype(np.int64), size) + np.repeat(b.start[which], size)
    return pa.StringArray.from_buffers(len(which), pa.py_buffer(off.tobytes()), pa.py_buffer(b.data[index].tobytes()))


def _frequent(joins: np.ndarray):
    """Each batch's distinct words and how often they stand there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _blocks(batch.column("text"), joins):
                found = _distinct(b, 0)
                if found is not None:
                    _, _, inverse, example = found
                    yield pa.RecordBatch.from_arrays([_strings(b, example), pa.array(np.bincount(inverse, minlength=len(example)))], ["word", "n"])

    return run


# --- lattice and folds -------------------------------------------------------------------------------


_EDGE = pa.struct([("cost", pa.float64()), ("at", pa.int32()), ("size", pa.int32()), ("id", pa.int32())])
_SPAN = pa.struct([("ends", pa.int64()), ("inner", pa.int64()), ("id", pa.int32())])
EDGES = "array<struct<cost:double,at:int,size:int,id:int>>"
SPANS = "array<struct<ends:bigint,inner:bigint,id:int>>"


class Lattice:
    """The pieces and their prefixes, hashed for equi-joins with substrings."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        known: dict[str, int] = {}
        for k, (p, _, _) in enumerate(pieces.rows):
            for n in range(1, len(p)):
                known.setdefault(p[:n], -1)
            known[p] = k
        names = list(known)
        code = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).astype(np.uint64)
        size = np.fromiter(map(len, names), np.int64, len(names))
        at, h = np.cumsum(size) - size, np.zeros(len(names), np.uint64)
        for n in range(int(size.max(initial=0))):
            live = size > n
            h[live] = X.mix(h[live] * X.K1 + code[at[live] + n] + X.U(1))
        order = np.argsort(h)
        self.hashes, self.piece = h[order], np.fromiter(known.values(), np.int64, len(names))[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces share a hash")
        # a sieve of the hashes' upper bits spares most substrings the search
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[self.hashes >> X.U(42)] = True
        self.ids = np.array([i for _, i, _ in pieces.rows], np.int32)
        self.costs = np.array([-s for _, _, s in pieces.rows], np.float64)

    def _found(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """All substrings that are pieces: word, place in the word from 0, size and piece; and where each word's characters begin, with
        the id of each, or -1 - its code point where it isn't a piece."""
        code = np.frombuffer("".join(words).replace(" ", MARK).encode("utf-32-le"), np.uint32).astype(np.uint64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size)
        word = np.repeat(np.arange(len(words)), size)
        room = np.repeat(end, size) - np.arange(len(code))  # characters from here to the word's end
        h, at, n, found, single = np.zeros(len(code), np.uint64), np.arange(len(code)), 1, [], -1 - code.astype(np.int64)
        while len(at):  # substrings of n characters that some piece begins with
            h = X.mix(h * X.K1 + code[at + n - 1] + X.U(1))
            keep = np.flatnonzero(self.sieve[h >> X.U(42)])
            at, h = at[keep], h[keep]
            p = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            keep = self.hashes[p] == h
            at, h, p = at[keep], h[keep], self.piece[p[keep]]
            hit = np.flatnonzero(p >= 0)
            found.append((at[hit], np.full(len(hit), n), p[hit]))
            if n == 1:
                single[at[hit]] = self.ids[p[hit]]
            keep = room[at] > n
            at, h, n = at[keep], h[keep], n + 1
        begin, n, p = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        first = end - size
        return word[begin], begin - first[word[begin]], n, p, np.append(first, len(code)), single

    def spans(self, words: list[str]) -> list[pa.Array]:
        """Each word's edges of more than one character, the best first, then the leftmost, as bits of the places where they begin and
        end and of those between; and the ids of its characters."""
        word, at, n, p, first, single = self._found(words)
        some = np.flatnonzero(n > 1)
        some = some[np.lexsort((at[some], self.costs[p[some]], word[some]))]
        word, at, n, p = word[some], at[some], n[some], p[some]
        one = np.int64(1)
        lo, hi = one << at, one << (at + n)
        rows = pa.StructArray.from_arrays([pa.array(lo | hi), pa.array(hi - (lo << one)), pa.array(self.ids[p])], fields=list(_SPAN))
        return [
            pa.ListArray.from_arrays(pa.array(np.searchsorted(word, np.arange(len(words) + 1)), pa.int32()), rows),
            pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(single, pa.int32())),
        ]

    def edges(self, words: list[str]) -> pa.Array:
        """Each word's edges, the least cost first, then the leftmost; places count from 1."""
        word, at, n, p, _, _ = self._found(words)
        order = np.lexsort((at, self.costs[p], word))
        word, at, n, p = word[order], at[order], n[order], p[order]
        rows = pa.StructArray.from_arrays([pa.array(self.costs[p]), pa.array(at + 1, pa.int32()), pa.array(n, pa.int32()), pa.array(self.ids[p])], fields=list(_EDGE))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(word, np.arange(len(words) + 1)), pa.int32()), rows)

    def columns(self, word: pa.Array) -> list[pa.Array]:
        """Words' ``spans`` and ``chars`` (short words of a BPE model), ``edges`` (the others) or, beyond ``FOLD_CHARS``, ``ids``."""
        names = word.to_pylist()
        short, mid, ids, scores = [""] * len(names), [""] * len(names), [None] * len(names), None
        for k, w in enumerate(names):
            if len(w) > FOLD_CHARS:
                scores = scores or {t: (i, s) for t, i, s in self.pieces.rows}
                ids[k] = fold_long(w.replace(" ", MARK), self.pieces, scores)
            elif self.pieces.kind == "bpe" and len(w) <= MASK_CHARS:
                short[k] = w
            else:
                mid[k] = w
        return [*self.spans(short), self.edges(mid), pa.array(ids, pa.list_(pa.int32()))]


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """``word`` with its ``spans``, ``chars``, ``edges`` or ``ids`` (see ``Lattice.columns``)."""
    shared = X.share(words.sparkSession, Lattice(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("word"), *shared.value.columns(batch.column("word"))], ["word", "spans", "chars", "edges", "ids"])

    return words.select("word").mapInArrow(run, f"word string, spans {SPANS}, chars array<int>, edges {EDGES}, ids array<int>")


def mask_fold(n: Column, spans: Column, chars: Column) -> Column:
    """The ids of a word of a BPE model, after all merges.  The state is one long with a bit for each place where a segment begins or
    ends; a merge takes away the one bit between two neighbours whose union is a piece.  Once there is none, the
    state is turned over and stays."""

    def merge(mask: Column, _: Column) -> Column:
        joins = lambda e: (mask.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(mask.bitwiseAND(e["inner"])) == 1)
        best = F.get(F.filter(spans, joins), F.lit(0))["inner"]
        return F.when(mask < 0, mask).otherwise(F.coalesce(mask.bitwiseAND(F.bitwise_not(best)), F.bitwise_not(mask)))

    def spelt(mask: Column) -> Column:
        long = F.transform(F.filter(spans, lambda e: mask.bitwiseAND(e["ends"].bitwiseOR(e["inner"])) == e["ends"]), lambda e: F.struct(e["ends"].alias("ends"), e["id"].alias("id")))
        pair = lambda i: F.call_function("shiftleft", F.lit(3).cast("bigint"), i)
        short = F.transform(chars, lambda c, i: F.when(mask.bitwiseAND(pair(i)) == pair(i), F.struct(pair(i).alias("ends"), c.alias("id"))))
        return F.sort_array(F.concat(long, F.filter(short, lambda x: x.isNotNull())))["id"]

    start = F.expr("shiftleft(2L, length(word)) - 1")
    done = F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), start, merge, lambda mask: F.when(mask < 0, F.bitwise_not(mask)).otherwise(mask))
    return F.transform(F.array(done), spelt)[0]


def bpe_fold(n: Column, edges: Column) -> Column:
    """Ends of the segments by their first place (0 where none begins), after all merges."""
    start = F.concat(F.transform(F.sequence(F.lit(1), n), lambda i: i + 1), F.array(F.lit(0)))
    long = F.filter(edges, lambda e: e["size"] > 1)

    def merge(s: Column, _: Column) -> Column:
        joins = lambda e: (F.get(s["next"], e["at"] - 1) > 0) & (F.get(s["next"], F.get(s["next"], e["at"] - 1) - 1) == e["at"] + e["size"])
        best = F.get(F.filter(s["left"], joins), F.lit(0))
        return F.when(s["done"], s).otherwise(F.transform(F.array(F.struct(best.alias("e"))), lambda x: F.struct(
            F.when(x["e"].isNull(), s["next"]).otherwise(F.transform(s["next"], lambda v, k: F.when(k == x["e"]["at"] - 1, x["e"]["at"] + x["e"]["size"]).when((k >= x["e"]["at"]) & (k < x["e"]["at"] + x["e"]["size"] - 1), 0).otherwise(v))).alias("next"),
            s["left"].alias("left"),
            x["e"].isNull().alias("done"),
        ))[0])

    state = F.struct(start.alias("next"), long.alias("left"), (F.size(long) == 0).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), n), state, merge, lambda s: s["next"])


def viterbi_fold(n: Column, edges: Column, unknown_cost: float) -> Column:
    """As ``bpe_fold``, for the segmentation of the least cost; on ties the longer last piece wins."""
    # best[k]: (cost, place the last segment begins) of the first k characters
    start = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("at")))

    def extend(best: Column, k: Column) -> Column:
        ends = F.filter(edges, lambda e: e["at"] + e["size"] == k + 1)
        paths = F.transform(ends, lambda e: F.struct((F.get(best, e["at"] - 1)["cost"] + e["cost"]).alias("cost"), e["at"].alias("at")))
        single = F.when(F.exists(ends, lambda e: e["size"] == 1), F.array().cast("array<struct<cost:double,at:int>>")).otherwise(F.array(F.struct((F.get(best, k - 1)["cost"] + unknown_cost).alias("cost"), k.alias("at"))))
        return F.concat(best, F.array(F.array_min(F.concat(paths, single))))

    best = F.aggregate(F.sequence(F.lit(1), n), start, extend)
    # walk back: the segment that ends at the cursor begins at best[cursor].at
    def back(s: Column, k: Column) -> Column:
        at = F.get(s["best"], s["cursor"])["at"]
        return F.when(s["cursor"] != n - k + 1, s).otherwise(F.struct(s["best"].alias("best"), (at - 1).alias("cursor"), F.transform(s["next"], lambda v, j: F.when(j == at - 1, s["cursor"] + 1).otherwise(v)).alias("next")))

    state = F.struct(best.alias("best"), n.alias("cursor"), F.array_repeat(F.lit(0), n + 1).alias("next"))
    return F.aggregate(F.sequence(F.lit(1), n), state, back, lambda s: s["next"])


def _ids(pieces: Pieces, following: Column, edges: Column, word: Column) -> Column:
    """The ids of the segments; a character without a piece gives its bytes' ids."""
    table = F.array(*map(F.lit, pieces.bytes)) if pieces.bytes else None

    def unknown(i: Column) -> Column:
        if table is None:
            return F.array(F.lit(pieces.unknown))
        char = F.hex(F.encode(F.substr(F.translate(word, " ", MARK), i + 1, F.lit(1)), "utf-8"))
        return F.transform(F.sequence(F.lit(0), (F.length(char) / 2).cast("int") - 1), lambda j: F.get(table, F.conv(F.substr(char, j * 2 + 1, F.lit(2)), 16, 10).cast("int")))

    def of(v: Column, i: Column) -> Column:
        e = F.filter(edges, lambda e: (e["at"] == i + 1) & (e["size"] == v - i - 1))
        return F.when(v > 0, F.when(F.size(e) > 0, F.array(F.get(e, F.lit(0))["id"])).otherwise(unknown(i))).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(following, of))


def heap_bpe(word: str, scores: dict[str, tuple[int, float]]) -> list[str]:
    """The segments of a word by merge order, for words too long for the fold."""
    text = list(word)
    after, before = [*range(1, len(text)), -1], [*range(-1, len(text) - 1)]
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and text[i] + text[j] in scores:
            heapq.heappush(heap, (-scores[text[i] + text[j]][1], i, text[i], text[j]))

    for i in range(len(text)):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j < 0 or text[i] != a or text[j] != b:
            continue
        text[i], text[j] = a + b, ""
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        after[j] = -1
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [t for t in text if t]


def fold_long(word: str, pieces: Pieces, scores: dict[str, tuple[int, float]]) -> list[int]:
    """The ids of a long word, by the model's rule."""
    if pieces.kind == "bpe":
        cut = heap_bpe(word, scores)
    else:
        worst, longest = _unknown_cost(pieces), pieces.longest
        best: list[tuple[float, int]] = [(0.0, 0)]
        for k in range(1, len(word) + 1):
            paths = [(best[k - n][0] - scores[word[k - n : k]][1], k - n) for n in range(1, min(k, longest) + 1) if word[k - n : k] in scores]
            if word[k - 1] not in scores:
                paths.append((best[k - 1][0] + worst, k - 1))
            best.append(min(paths))
        cut, k = [], len(word)
        while k:
            cut.append(word[best[k][1] : k])
            k = best[k][1]
        cut.reverse()
    out: list[int] = []
    for t in cut:
        out += [scores[t][0]] if t in scores else [pieces.bytes[b] for b in t.encode()] if pieces.bytes else [pieces.unknown]
    return out


def _unknown_cost(pieces: Pieces) -> float:
    return max([0.0, *(-s for _, _, s in pieces.rows)]) + 10


def folded(pieces: Pieces) -> Column:
    """The ids of a ``word`` from its ``spans`` and ``chars``, ``edges`` or ``ids``; an id below 0 is a character without a piece."""
    n = F.length("word")
    if pieces.kind != "bpe":
        return F.when(F.col("ids").isNull(), _ids(pieces, viterbi_fold(n, F.col("edges"), _unknown_cost(pieces)), F.col("edges"), F.col("word"))).otherwise(F.col("ids"))
    middle = F.when(F.col("ids").isNull(), _ids(pieces, bpe_fold(n, F.col("edges")), F.col("edges"), F.col("word"))).otherwise(F.col("ids"))
    return F.when(n <= MASK_CHARS, mask_fold(n, F.col("spans"), F.col("chars"))).otherwise(middle)


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """``word`` and ``ids`` of each row."""
    spell = F.flatten(F.transform("ids", lambda i: F.when(i >= 0, F.array(i)).otherwise(_spelt(pieces, -1 - i))))
    found = lattice(words, pieces).select("word", folded(pieces).alias("ids"))
    return found.select("word", F.when(F.exists("ids", lambda i: i < 0), spell).otherwise(F.col("ids")).alias("ids"))


def _spelt(pieces: Pieces, code: Column) -> Column:
    """The ids that stand for a character without a piece, given its code point."""
    if not pieces.bytes:
        return F.array(F.lit(pieces.unknown))
    bits = lambda shift, lead: F.shiftright(code, shift).bitwiseAND(0x3F if lead is None else 0x7F) + (0x80 if lead is None else lead)
    utf8 = (
        F.when(code < 0x80, F.array(code))
        .when(code < 0x800, F.array(bits(6, 0xC0), bits(0, None)))
        .when(code < 0x10000, F.array(bits(12, 0xE0), bits(6, None), bits(0, None)))
        .otherwise(F.array(bits(18, 0xF0), bits(12, None), bits(6, None), bits(0, None)))
    )
    table = F.array(*map(F.lit, pieces.bytes))
    return F.transform(utf8, lambda b: F.get(table, b))


# --- texts -------------------------------------------------------------------------------------------


def frequent_words(texts: DataFrame, pieces: Pieces, *, words: int = FREQUENT_WORDS, chars: int = SAMPLE_CHARS) -> pa.Table:
    """``word`` and ``ids`` of at most ``words`` words that are frequent in a sample of about ``chars`` characters."""
    n = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    some = texts if n <= chars else texts.sample(fraction=chars / n, seed=1)
    counts = some.mapInArrow(X.lean(_frequent(pieces.joins)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    top = counts.orderBy(F.desc("n"), "word").limit(words).select("word")
    return encode_words(top.repartition(max(1, words // 8000)), pieces).toArrow().combine_chunks()


class _Vocabulary:
    """The words a task has met since its vocabulary last began: sorted hashes, their checks and their numbers."""

    def __init__(self, hashes: np.ndarray, checks: np.ndarray, seed: int = 0):
        order = np.argsort(hashes)
        self.hashes, self.checks, self.numbers, self.seed = hashes[order], checks[order], order, seed

    def add(self, found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray] | None:
        """The numbers of a block's words and examples of the new ones; nothing if a hash stands for two words."""
        hashes, checks, inverse, example = found
        at = np.searchsorted(self.hashes, hashes)
        near = np.minimum(at, max(len(self.hashes) - 1, 0))
        known = self.hashes[near] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        if (self.checks[near[known]] != checks[known]).any():
            return None
        number = np.zeros(len(hashes), np.int64)
        number[known] = self.numbers[near[known]]
        new = np.flatnonzero(~known)
        number[new] = np.arange(len(new)) + len(self.numbers)
        self.hashes, self.checks, self.numbers = (np.insert(x, at[new], y[new]) for x, y in ((self.hashes, hashes), (self.checks, checks), (self.numbers, number)))
        return number[inverse], example[new]


def _begin(frequent: pa.Array) -> _Vocabulary:
    data, off = X.buffers(frequent)
    b = X.Block(0, 1, data, off[:-1], off[1:], np.array([0, len(frequent)]))
    found = _distinct(b, 0)
    if found is None or len(found[0]) < len(frequent):
        raise ValueError("two of the words share a hash")
    hashes, checks, inverse, _ = found
    return _Vocabulary(hashes[inverse], checks[inverse])


def _stream(joins: np.ndarray, lat, frequent, text: str, task_words: int):
    """Each block's new words with their lattices, then its documents with the numbers of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, era, kind = _begin(frequent.value[0]), 0, None
        empty = lambda n: [pa.nulls(n, pa.string()), pa.nulls(n, pa.list_(_SPAN)), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(_EDGE)), pa.nulls(n, pa.list_(pa.int32()))]
        for batch in batches:
            row = batch.column("row")
            kind = row.type
            for b in _blocks(pa.compute.struct_field(row, [row.type.get_field_index(text)]), joins):
                got = None
                if len(words.hashes) < task_words:
                    found = _distinct(b, words.seed)
                    got = found and words.add(found)
                while got is None:  # begin again, with other hashes
                    era, words = era + 1, _Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.uint64), words.seed + 2)
                    found = _distinct(b, words.seed)
                    got = found and words.add(found)
                number, new = got
                for lo in range(0, len(new), WORD_ROWS):
                    word = _strings(b, new[lo : lo + WORD_ROWS])
                    n = len(word)
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.array(np.full(n, era)), pa.nulls(n, pa.binary()), word, *lat.value.columns(word)], ["row", "era", "numbers", "word", "spans", "chars", "edges", "ids"])
                own, n = row.slice(b.first, b.last - b.first), b.last - b.first
                numbers = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((b.offsets * 4).astype(np.int64).tobytes()), pa.py_buffer(number.astype(np.int32).tobytes())])
                yield pa.RecordBatch.from_arrays([own, pa.array(np.full(n, era)), numbers.cast(pa.binary()), *empty(n)], ["row", "era", "numbers", "word", "spans", "chars", "edges", "ids"])

    return run


class _Ids:
    """Words' ids by number."""

    def __init__(self, lists: list):
        self.waiting = lists
        self.flat, self.end = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def settle(self) -> None:
        if self.waiting:
            sizes = np.concatenate([x[0] for x in self.waiting])
            self.flat = np.concatenate([self.flat, *[x[1] for x in self.waiting]])
            self.end = np.concatenate([self.end, self.end[-1] + np.cumsum(sizes)])
            self.waiting = []

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words with these numbers, and each one's end among them."""
        self.settle()
        first = self.end[numbers]
        size = self.end[numbers + 1] - first
        end = np.cumsum(size)
        return self.flat[np.arange(int(end[-1]) if len(end) else 0) - np.repeat(end - size - first, size)], end


def _lists(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = ids.offsets.to_numpy()
    return np.diff(off), ids.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]


def _spell(ids: pa.Array, pieces_bytes: list[int] | None, unknown: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and ids of words, with the bytes of characters without a piece."""
    size, flat = _lists(ids)
    if (flat >= 0).all():
        return size, flat
    parts = [[int(i)] if i >= 0 else [pieces_bytes[x] for x in chr(-1 - i).encode()] if pieces_bytes else [unknown] for i in flat]
    grown = np.fromiter(map(len, parts), np.int64, len(parts))
    return X.sums(grown, np.concatenate([[0], np.cumsum(size)])), np.array([x for y in parts for x in y], np.int32)


def _assembled(frequent, pieces_bytes: list[int] | None, unknown: int, ids: str, names, decoded: str | None):
    """The documents with their ids, and the text of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        eras = {0: _Ids([_lists(frequent.value[1])])}
        for batch in batches:
            era = batch.column("era").to_numpy()
            word = ~batch.column("word").is_null().to_numpy(zero_copy_only=False)
            for e in np.unique(era[word]).tolist():
                mine = batch.column("ids").filter(pa.array(word & (era == e)))
                eras.setdefault(e, _Ids([])).waiting.append(_spell(mine, pieces_bytes, unknown))
            texts = np.flatnonzero(~word)
            for e in np.unique(era[texts]).tolist():
                which = pa.array(texts[era[texts] == e])
                data, off = X.buffers(batch.column("numbers").take(which))
                flat, end = eras[e].of(np.frombuffer(data, np.int32))
                off = np.concatenate([[0], end])[off // 4].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(flat, pa.int32()))
                rows = batch.column("row").take(which)
                if decoded is None:
                    yield pa.RecordBatch.from_arrays([rows, lists], ["row", ids])
                    continue
                for lo in range(0, len(lists), DECODED_ROWS):
                    part = lists.slice(lo, DECODED_ROWS)
                    yield pa.RecordBatch.from_arrays([rows.slice(lo, DECODED_ROWS), part, _texts(part, *names.value)], ["row", ids, decoded])
            for e in [e for e in eras if len(texts) and e < era[texts].max()]:
                del eras[e]

    return run


def _row(df: DataFrame, but: list[str]) -> DataFrame:
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in but]).alias("row"))


def _plain(df: DataFrame, kind: T.StructType, *new: str) -> DataFrame:
    return df.select(*[F.col("row").getField(f.name).alias(f.name) for f in kind.fields], *[F.col(f"`{c}`") for c in new])


def encode(docs: DataFrame, pieces: Pieces, *, text: str = "text", ids: str = "ids", decoded: str | None = None, frequent: int = FREQUENT_WORDS, task_words: int = TASK_WORDS) -> DataFrame:
    """The documents, with all their columns, and their ids in an array column ``ids``; with ``decoded``, also the text that these ids
    give, in a column of that name (as ``decode``, without another pass).  Columns of the new names are replaced."""
    if text in (ids, decoded) or ids == decoded:
        raise ValueError("text, ids and decoded text need different names")
    spark = docs.sparkSession
    X.bounded_batches(spark)
    known = frequent_words(docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")), pieces, words=frequent)
    lists = known["ids"].combine_chunks() if known.num_rows else pa.array([], pa.list_(pa.int32()))
    shared = X.share(spark, (known["word"].combine_chunks() if known.num_rows else pa.array([], pa.string()), lists))
    new = [ids] if decoded is None else [ids, decoded]
    rows = _row(docs, new)
    kind = rows.schema["row"].dataType
    blank = T.StructType([T.StructField("row", kind), *T._parse_datatype_string(f"era long, numbers binary, word string, spans {SPANS}, chars array<int>, edges {EDGES}, ids array<int>").fields])
    out = T.StructType([T.StructField("row", kind), T.StructField(ids, T.ArrayType(T.IntegerType())), *[T.StructField(c, T.StringType()) for c in new[1:]]])
    stream = rows.mapInArrow(X.lean(_stream(pieces.joins, X.share(spark, Lattice(pieces)), shared, text, task_words)), blank)
    coded = stream.select("row", "era", "numbers", "word", F.when(F.col("word").isNotNull(), folded(pieces)).alias("ids"))
    names = X.share(spark, _names(pieces)) if decoded is not None else None
    return _plain(coded.mapInArrow(X.lean(_assembled(shared, pieces.bytes, pieces.unknown, ids, names, decoded)), out), kind, *new)


def _names(pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids' texts, and where they begin."""
    size = max([i for _, i, _ in pieces.rows] + (pieces.bytes or []) + [pieces.unknown]) + 1
    names = [b""] * size
    for p, i, _ in pieces.rows:
        names[i] = p.replace(MARK, " ").encode()
    for b, i in enumerate(pieces.bytes or []):
        names[i] = bytes([b])
    return np.frombuffer(b"".join(names), np.uint8), np.cumsum([0, *map(len, names)])


def _texts(lists: pa.Array, flat: np.ndarray, off: np.ndarray) -> pa.Array:
    """The texts of lists of ids."""
    sizes, found = _lists(lists)
    cut = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    found = np.where((found >= 0) & (found < len(off) - 1), found, 0) if len(found) and (found.min() < 0 or found.max() >= len(off) - 1) else found
    n = off[found + 1] - off[found]
    end = np.cumsum(n)
    total = int(n.sum())
    data = flat[np.arange(total) - np.repeat(end - n - off[found], n)]
    at = np.concatenate([[0], end])[cut]
    # the leading space of each text that has one
    lead = np.flatnonzero((np.diff(at) > 0) & (np.append(data, 0)[np.minimum(at[:-1], total)] == 32))
    data = np.delete(data, at[lead])
    at[1:] -= np.cumsum(np.bincount(lead, minlength=len(at) - 1))
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
    try:
        return out.cast(pa.string())
    except pa.ArrowInvalid:  # ids that aren't an encoding can give anything
        return pa.array([x.as_py().decode(errors="replace") for x in out], pa.string())


def decode(tokens: DataFrame, pieces: Pieces, *, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows, with all their columns, and the text of their ids in a column ``text``, which replaces one of that name; ids
    that aren't pieces, and null, give nothing."""
    if ids == text:
        raise ValueError("the text can't take the place of the ids")
    spark = tokens.sparkSession
    X.bounded_batches(spark)
    names = X.share(spark, _names(pieces))
    rows = _row(tokens, [text])
    kind = rows.schema["row"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            lists = pa.compute.struct_field(row, [row.type.get_field_index(ids)])
            for lo in range(0, len(lists), DECODED_ROWS):
                part = lists.slice(lo, DECODED_ROWS)
                yield pa.RecordBatch.from_arrays([row.slice(lo, DECODED_ROWS), _texts(part, *names.value)], ["row", text])

    return _plain(rows.mapInArrow(run, T.StructType([T.StructField("row", kind), T.StructField(text, T.StringType())])), kind, text)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = load()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = encode(docs, pieces, decoded="decoded")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))
