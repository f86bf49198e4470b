"""Token counts by a linear longest-match automaton.

A trie over the vocabulary's bytes carries failure links and, for each node, how many pieces are
popped when its link is taken, precomputed.  Greedy longest-match-first segmentation then reads each
byte once and adds up popped counts; no piece is ever built.  The automaton steps through all
distinct words of a block of documents at once, and each word's count is summed over its places.
There is no shuffle.

A word is a maximal run of non-white characters, preceded by the word mark.  With ``byte_fallback``
each byte of a character that the vocabulary lacks is one token; else a word that can't be cut
into pieces is one unknown token.

Defined results: null and empty texts have no words and no tokens.  Repeated rows each get a result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavane.llm import _text as X

MARK = "▁"


def default_vocabulary() -> list[str]:
    """The normal pieces of the public sentencepiece model."""
    import public_tokenizers
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]


class Automaton:
    """Nodes are numbered, the root is 0; ``link`` is -1 where no segmentation goes on."""

    def __init__(self, vocabulary: Iterable[str], byte_fallback: bool = True, mark: str = MARK):
        child: list[dict[int, int]] = [{}]
        final = [False]
        pieces = [v.encode() for v in vocabulary if v] + ([bytes([b]) for b in range(256)] if byte_fallback else [])
        for piece in pieces:
            at = 0
            for b in piece:
                nxt = child[at].get(b)
                if nxt is None:
                    nxt = child[at][b] = len(child)
                    child.append({})
                    final.append(False)
                at = nxt
            final[at] = True
        link, pops = [-1] * len(child), [0] * len(child)
        queue = [0]
        for u in queue:
            for b, v in child[u].items():
                queue.append(v)
                if final[v]:
                    link[v], pops[v] = 0, 1
                    continue
                z, n = link[u], pops[u]
                while z >= 0 and b not in child[z]:
                    n += pops[z]
                    z = link[z]
                if z >= 0:
                    link[v], pops[v] = child[z][b], n
        keys = np.array(sorted((u << 8 | b, v) for u, c in enumerate(child) for b, v in c.items()), np.int64).reshape(-1, 2)
        self.keys, self.targets = keys[:, 0].copy(), keys[:, 1].copy()
        self.link, self.pops = np.array(link, np.int64), np.array(pops, np.int64)
        self.mark = np.frombuffer(mark.encode(), np.uint8)

    def step(self, node: np.ndarray, count: np.ndarray, byte: np.ndarray) -> None:
        """Read one byte in each live lane, in place; a lane that can't go on gets node -1."""
        live = np.flatnonzero(node >= 0)
        while len(live):
            want = node[live] << 8 | byte[live]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            good = self.keys[at] == want
            node[live[good]] = self.targets[at[good]]
            live = live[~good]
            count[live] += self.pops[node[live]]
            node[live] = self.link[node[live]]  # the root's link is -1
            live = live[node[live] >= 0]

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of tokens of each byte range, longest match first."""
        n = end - start
        order = np.argsort(-n, kind="stable")
        pos, n = start[order], n[order]
        node, count = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        if not len(self.keys):
            return np.ones(len(n), np.int64)
        for b in self.mark:
            self.step(node, count, np.full(len(n), b, np.int64))
        for k in range(int(n[0]) if len(n) else 0):
            live = int(np.searchsorted(-n, -k, "left"))  # ranges longer than k
            self.step(node[:live], count[:live], data[pos[:live] + k].astype(np.int64))
        rest = np.flatnonzero(node > 0)
        while len(rest):
            count[rest] += self.pops[node[rest]]
            node[rest] = self.link[node[rest]]
            rest = rest[node[rest] > 0]
        out = np.empty(len(n), np.int64)
        out[order] = np.where(node < 0, 1, count)
        return out


def count_tokens(docs: DataFrame, automaton: Automaton, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, ``n_words`` and ``n_tokens``."""
    X.bounded_batches(docs.sparkSession)
    shared = X.share(docs.sparkSession, automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        for batch in batches:
            for b in X.blocks(batch.column("text"), X.NOT_SPACE, False):
                h = X.word_hashes(b)
                s = np.sort(h)
                distinct = s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s
                inverse = np.searchsorted(distinct, h)
                example = np.zeros(len(distinct), np.int64)
                example[inverse] = np.arange(len(h))
                n = a.counts(b.data, b.start[example], b.end[example])
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(b.first, b.last - b.first), pa.array(b.n_words, pa.int64()), pa.array(X.sums(n[inverse], b.offsets), pa.int64())], ["id", "n_words", "n_tokens"])

    kind = docs.schema[id].dataType.simpleString()
    counted = docs.select(X.named(id).alias("id"), X.named(text).alias("text")).mapInArrow(run, f"id {kind}, n_words long, n_tokens long")
    return counted.withColumnRenamed("id", X.own_name(id, "n_words", "n_tokens"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), Automaton(default_vocabulary()))
