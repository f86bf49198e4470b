import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from stratavane.llm import language
from stratavane.llm import _text as X


def _plain(text: str | None) -> list[int]:
    """Buckets of a text's trigrams, one by one."""
    out = []
    for w in re.findall(rb"[A-Za-z\x80-\xFF]+", (text or "").encode()):
        w = b" " + bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in w) + b" "
        out += [(int.from_bytes(w[i : i + 3], "big") * int(X.K1) % 2**64) >> 49 for i in range(len(w) - 2)]
    return out


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1 << 18])
def test_pieces_cut_texts_anywhere(monkeypatch, size):
    """Whatever the pieces' size, each text has the trigrams of its words, in order; sums over pieces are those over texts."""
    monkeypatch.setattr(language, "PIECE_BYTES", size, raising=False)
    rng = random.Random(size)
    texts = [None, "", "a", "A b", " ", "", "für Straße", "x" * 40, "日本語のテキスト", "1 2", "ab", "cd", None]
    texts += ["".join(rng.choice("abAB é.-9") for _ in range(rng.randrange(30))) for _ in range(60)]
    got = [[] for _ in texts]
    for first, bucket, off in language.trigrams(pa.array(texts)[:]):
        for k in range(len(off) - 1):
            got[first + k] += bucket[off[k] : off[k + 1]].tolist()
    assert got == [_plain(t) for t in texts]
    m = language.TextModel([("aa", "abba bab"), ("bb", "für a b")])
    (ll, n), sliced = next(m.score(pa.array(texts))), next(m.score(pa.array(["zz zz", *texts])[1:]))
    assert n.tolist() == [len(g) for g in got] and (ll == sliced[0]).all()
    assert ll == pytest.approx(np.array([m.logs[g].astype(float).sum(0) if g else np.zeros(2) for g in got]))


def test_memory_follows_neither_the_rows_nor_the_longest_text():
    """Scoring holds a few bytes for each byte of a piece, not tens for each byte of a long text or a full batch."""
    m = language.TextModel([("aa", "alpha beta gamma"), ("bb", "delta epsilon zeta")])
    peaks = []
    for texts in (["alpha delta " * 200] * 1700, ["alpha delta " * 1_000_000]):
        arr = pa.array(texts, pa.large_string())
        tracemalloc.start()
        assert sum(len(n) for _, n in m.score(arr)) == len(texts)
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert max(peaks) < 30, peaks
