"""Decontamination of texts that repeat themselves: results against brute force, and work that follows the text's length."""

import random
import resource
import time

import numpy as np
import pyarrow as pa
import pytest

from stratavane.llm import _text, decontamination, near, token_counts


def plain(doc, items, window):
    """(position, words of the longest match with any item there) of the matches that don't only continue the one before, by windows' length."""
    out = set()
    for size in {min(window, len(w)) for w in items if w}:
        at = {}
        for w in items:
            if w and min(window, len(w)) == size:
                for p in range(len(doc)):
                    for q in range(len(w) - size + 1):
                        n = 0
                        while p + n < len(doc) and q + n < len(w) and doc[p + n] == w[q + n]:
                            n += 1
                        if n >= size:
                            at[p] = max(at.get(p, 0), n)
        out |= {(p, n) for p, n in at.items() if at.get(p - 1) != n + 1}
    return out


@pytest.mark.parametrize("seed", range(6))
def test_longest_matches_equal_brute_force(seed):
    r = random.Random(seed)
    text = lambda n, k: [r.choice("abcd"[:k]) for _ in range(n)]
    items = [text(r.choice([0, 2, 4, 9, 30, 60]), r.choice([1, 2, 3])) for _ in range(5)]
    docs = [text(r.choice([0, 3, 20, 80, 200]), r.choice([1, 2, 4])) for _ in range(8)] + [items[-1] * 2]
    probe = decontamination.Probe([(str(k), " ".join(w)) for k, w in enumerate(items)], 4)
    got = decontamination._annotated(pa.array([" ".join(d) for d in docs]), probe, None, True)["matches"].to_pylist()
    for d, found in zip(docs, got, strict=True):
        assert {(m["doc_start"], m["n_words"]) for m in found} == plain(d, items, 4)
        for m in found:
            w = items[int(m["item_id"])]
            assert d[m["doc_start"] : m["doc_start"] + m["n_words"]] == w[m["item_start"] : m["item_start"] + m["n_words"]]


def test_a_megabyte_of_one_word_is_linear():
    probe = decontamination.Probe([("a", "w " * 10_000), ("b", "x " + "w " * 50)], 13)
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    got = decontamination._annotated(pa.array(["w " * 500_000, "w x " * 20, None]), probe, None, True)
    assert time.time() - began < 30 and (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 800
    assert got["hits"].to_pylist() == [[0, 500_000], [], []] and got["items"].to_pylist() == [["a", "b"], [], []]
    first = got["matches"].to_pylist()[0]
    assert first[0]["n_words"] == 10_000 and len(first) <= 500_000 - 12


def test_shared_windows_of_many_items():
    same = [(f"{k:03}", "one two three four " * 3 + f"own{k}") for k in range(300)]
    got = decontamination._annotated(pa.array(["zero one two three four " + "one two three four " * 2 + "end"] * 3), decontamination.Probe(same, 12), None, True)
    assert got["items"].to_pylist() == [[f"{k:03}" for k in range(300)]] * 3
    assert all(len(m) == 1 and m[0]["n_words"] == 12 for m in got["matches"].to_pylist())
    assert np.array_equal(got["n_words"].to_numpy(), [14] * 3)
    assert list(_text.blocks(pa.array([], pa.string()), _text.ALNUM, True)) == []


def test_columns_may_have_any_name(spark):
    rows = [(k, f"some words of a text that goes on and on, number {k % 2}") for k in range(4)]
    docs = spark.createDataFrame(rows, "id long, text string").selectExpr("id AS `d.id`", "text AS `t``x`", "1 AS `a b`")
    bench = spark.createDataFrame([("1", "words of a text")], "`i.id` string, `t.t` string")
    found = near.classes(docs, id="d.id", text="t`x")
    assert found.columns == ["d.id", "class_id", "class_size"] and found.count() == 4
    named = docs.withColumnsRenamed({"d.id": "class_id", "t`x": "text"})
    assert near.classes(named, id="class_id").columns == ["id", "class_id", "class_size"]
    assert near.drop_near_copies(docs, id="d.id", text="t`x").columns == docs.columns
    assert decontamination.remove_contaminated(docs, bench, text="t`x", item_id="i.id", item_text="t.t").count() == 0
    counter = token_counts.Automaton({"some": 1, "##e": 2})
    assert token_counts.count_tokens(docs, counter, id="d.id", text="t`x").columns == ["d.id", "n_words", "n_tokens"]
    assert token_counts.count_tokens(docs.withColumnRenamed("d.id", "n_words"), counter, id="n_words", text="t`x").columns == ["id", "n_words", "n_tokens"]
