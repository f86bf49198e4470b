"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib

import pytest

from stratavane.llm import conversations as C

SF = "/root/testdata/sf0.001"


def plain(turns):
    """(turn, role, text) rows of one conversation after damage, in order, to the contract's columns; the cheapest way by states, every insertion tried."""
    seen, rows, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in turns:
        stripped = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            n[fault] += 1
        rows.append((role, text, fault))
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    initials = [r[:1] for r, _, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    follow = lambda state, i: {"u": "u" if state in "0sa" else None, "a": "a" if state == "u" else None, "s": "s" if state == "0" else None}.get(i)

    def inserted(ways):
        for _ in range(3):
            for state, (cost, audit, out) in list(ways.items()):
                for i, role in (("u", "user"), ("a", "assistant")):
                    to = follow(state, i)
                    new = (cost + 2, audit + "I", (*out, f"{role}:"))
                    if to and (to not in ways or new < ways[to]):
                        ways[to] = new
        return ways

    ways = {"0": (0, "", ())}
    for role, text, fault in rows:
        new = {}
        for state, (cost, audit, out) in inserted(ways).items():
            options = [(state, 3, "D", None)]
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                options += [(follow(state, role[:1]), extra, "K", role)] + [(follow(state, r[0]), 2 + extra, "R", r) for r in ("user", "assistant")]
            for to, more, edit, as_ in options:
                if to:
                    way = (cost + more, audit + edit, out if as_ is None else (*out, f"{as_}:{text}"))
                    new[to] = min(new.get(to, way), way)
        ways = new
    cost, audit, out = min(w for s, w in inserted(ways).items() if s in "0a")
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        code = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def expected(rows):
    after, found = damage(rows), {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in after if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode()))
        found[conv] = plain(own) if own else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return found


def got(spark, tmp_path, rows, monkeypatch=None):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS tag", "1 AS k", "2 AS n", "'y' AS same").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    out = C.op13_repair_conversations(spark, str(tmp_path))
    return {r.conv_id: tuple(r)[1:] for r in out.collect()}


def odd_rows():
    r = random.Random(5)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "unknown", None]
    texts = ["Yes.", "No!", "What?", "well", "", " \n", "Yes.", None, "long " * 300 + ".", "a\tb.\x0b", "é。"]
    rows = [(c, r.choice([t, t, t, t + 3, None]), r.choice(roles), r.choice(texts) if r.random() < 0.4 else f"Turn {t}.") for c in range(150) for t in range(r.randrange(9))]
    rows += [(None, None, None, None), (None, 1, "user", "x."), (None, None, "user", "x.")] + [(900, t, ["user", "assistant"][t % 2], f"t{t}.") for t in range(4)] * 2
    return rows


def test_repair_equals_a_plain_search(spark, tmp_path):
    rows = odd_rows() + [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert got(spark, tmp_path, rows) == expected(rows)


def test_long_conversations_go_by_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "SEGMENT", 4)
    monkeypatch.setattr(C, "FAN", 2)
    r = random.Random(7)
    rows = odd_rows() + [(c, t, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["Ok.", f"t{t}.", f"u{t}", " "])) for c in (1001, 1002, None) for t in range(150)]
    assert got(spark, tmp_path, rows) == expected(rows)


def test_one_conversation_of_equal_turns(spark, tmp_path):
    rows = [(1, None, "user", "same.")] * 3000 + [(1, 7, "assistant", "b.")] * 1000
    assert got(spark, tmp_path, rows) == expected(rows)


def test_no_conversations(spark, tmp_path):
    assert got(spark, tmp_path, []) == {}


@pytest.mark.parametrize("roles, audit", [("", ""), ("s", "D"), ("u", "KI"), ("ua", "KK"), ("sua", "KKK"), ("au", "IKKI"), ("uaua", "KKKK"), ("uu", "KR"), ("uaa", "KKIK"), ("ss", "DD"), ("sus", "KKR")])
def test_cheapest_audits(roles, audit):
    names = {"u": "user", "a": "assistant", "s": "system"}
    assert plain([(t, names[r], f"{t}.") for t, r in enumerate(roles)])[6] == audit
