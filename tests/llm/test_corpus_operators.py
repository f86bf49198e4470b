"""The corpus operators against brute force, on small tables with every odd case."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratavane import storage
from stratavane.llm import _text, decontamination, exact, language, licenses, near, pieces, pii, registry, substrings, token_counts, token_files

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n", "a", "é", "A b c d", "一 二 三 四 五 六", "x" * 4000, "1 " * 2500, "tab\tand\x0bmore", "dup text here now and then", "dup text here now and then"]


def words(text):
    return WORD.findall((text or "").translate(UPPER))


@pytest.fixture(scope="module")
def rows(spark):
    got = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    long = " ".join(t or "" for _, t in got[:40])
    return got + [(10_000 + k, t) for k, t in enumerate(ODD)] + [(20_000, long), (20_001, long), got[0], (None, "no id at all"), (10_005, "same id, other text")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "'x' AS n_words", "1 AS row", "2 AS kept", "'y' AS id", "3 AS n", "'z' AS hits").repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_words_equal_the_pattern(rows):
    texts = pa.array([t for _, t in rows], pa.string())
    got = []
    for b in _text.blocks(texts, _text.ALNUM, True, limit=5000):
        for d in range(b.last - b.first):
            got.append([b.data[s:e].tobytes().decode() for s, e in zip(b.start[b.offsets[d] : b.offsets[d + 1]], b.end[b.offsets[d] : b.offsets[d + 1]], strict=True)])
    assert got == [words(t) for _, t in rows]


def test_decontamination(spark, docs, rows, nothing):
    text = {d: t for d, t in rows if d is not None}
    some = words(text[3])
    bench = [(1, text[1][:200] if text[1] else ""), (2, " ".join(some[2:20]).upper()), ("3", "dup text"), (None, "here now and then"), (5, None), (6, "..."), (2, " ".join(some[2:20]))]
    bench = spark.createDataFrame([(None if i is None else str(i), t) for i, t in bench], "item_id string, text string")
    items = [(r.item_id, words(r.text)) for r in bench.collect()]
    windows = {}
    for i, w in items:
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    want = []
    for d, t in rows:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        want.append((d, len(w), len(hit), ",".join(sorted(x for x in ids if x is not None))))
    for chars in (1 << 20, 100):  # one block and several
        got = decontamination.annotate(docs, bench, block_chars=chars, keep=["doc_id"])
        got = got.select("row.doc_id", "n_words", decontamination.n_hit().alias("h"), F.array_join("items", ",").alias("i"))
        assert Counter(map(tuple, got.collect())) == Counter(want)
    kept = decontamination.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, n, h, _ in want if not (h and 20 * h >= n))
    assert decontamination.remove_contaminated(nothing, bench).count() == 0
    assert decontamination.remove_contaminated(docs, bench.limit(0)).count() == len(rows)
    match = decontamination.annotate(docs, bench).select("row.doc_id", F.explode("matches").alias("m")).where("doc_id = 3 AND m.item_id = '2'").first().m
    assert (match.item_start, match.doc_start, match.n_words) == (0, 2, 18)


def test_substring_dedup(docs, rows, nothing, monkeypatch):
    got = substrings.remove_repeats(docs, window=6).collect()
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    # rows with one id may follow each other either way, so compare them as a whole
    seen, want = set(), {}
    split = {k: re.findall(r"[^\x20\x09-\x0D]+", rows[k][1] or "") for k in order}
    unique = [k for k in order if sum(rows[j][0] == rows[k][0] for j in order) == 1]
    for k in order:
        w, gone = split[k], set()
        for i in range(len(w) - 5):
            key = tuple(w[i : i + 6])
            if key in seen:
                gone |= set(range(i, i + 6))
            seen.add(key)
        want[k] = (rows[k][0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    exactly = {want[k] for k in unique}
    assert {tuple(r) for r in got if sum(x[0] == r.doc_id for x in rows) == 1} == exactly
    assert len(got) == len(rows)
    assert substrings.remove_repeats(nothing).count() == 0


def test_exact_dedup(docs, rows, nothing, monkeypatch):
    by = {}
    for d, t in rows:
        by.setdefault(t or "", []).append(d)
    want = Counter()
    for d, t in rows:
        group = by[t or ""]
        keep = max((x for x in group if x is not None), default=None)
        want[d, keep, len(group), d == keep, hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, exact.groups(docs).collect())) == want
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(r.text or "" for r in kept.collect()) == Counter(dict.fromkeys(by, 1))
    assert exact.groups(nothing).count() == 0
    # chunks with one hash but different content are told apart
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: (F.length(c[0]) % 3).cast("long") if len(c) == 1 else F.hash(*c).cast("long"))
    assert Counter(map(tuple, exact.groups(docs).collect())) == want


def test_chunks_are_the_text(docs, rows):
    got = docs.select("text", exact.chunks(F.coalesce("text", F.lit(""))).alias("c")).collect()
    assert all("".join(r.c) == (r.text or "") and all(len(x) <= exact.MAX_CHUNK for x in r.c) for r in got)


def test_chunks_fall_into_step_behind_an_insertion(spark):
    import random

    rnd = random.Random(2)
    line = " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvw") for _ in range(7)) for _ in range(2000))  # no line end, no full stop
    df = spark.createDataFrame([(line,), ("something new " + line,)], "text string")
    a, b = (r.c for r in df.select(exact.chunks(F.col("text")).alias("c")).collect())
    assert len(a) > 20 and len(set(a) & set(b)) >= len(a) - 3


def _bags(rows):
    out = {}
    for k, (_, t) in enumerate(rows):
        w = words(t)
        if w:
            out[k] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    return out


def test_near_dedup_equals_brute_force(spark, docs, rows, nothing):
    base = words(rows[5][1])
    more = [(30_000 + k, " ".join(w if i != 7 * k + 3 else f"new{k}" for i, w in enumerate(base))) for k in range(8)]
    data = rows + more
    df = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    bags, parent = _bags(data), {k: k for k in range(len(data))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(bags)
    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            both = sum((bags[a] & bags[b]).values())
            if both and both * 5 >= 4 * sum((bags[a] | bags[b]).values()):
                parent[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(data):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    want = Counter((d, least.get(find(k), None)) for k, (d, _) in enumerate(data))
    assert Counter((r.doc_id, r.class_id) for r in near.classes(df).collect()) == want
    kept = near.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({find(k) for k in range(len(rows))})
    assert near.classes(nothing).count() == 0
    assert near.drop_near_copies(nothing).count() == 0


def test_bag_signatures_are_unbiased():
    rng = np.random.default_rng(4)
    errors = []
    for _ in range(150):
        n = 60
        a, ca = np.sort(rng.integers(0, 2**53, n)).astype(np.uint64), rng.integers(1, 20, n)
        b, cb = a.copy(), np.maximum(1, ca - rng.integers(0, 12, n))
        b[:8] = rng.integers(0, 2**53, 8)
        wa, wb = dict(zip(a.tolist(), ca.tolist(), strict=True)), dict(zip(b.tolist(), cb.tolist(), strict=True))
        both = sum(min(v, wb.get(k, 0)) for k, v in wa.items())
        j = both / (sum(ca) + sum(cb) - both)
        s = near.sign(np.repeat([0, 1], n), np.concatenate([a, b]), np.concatenate([ca, cb]), 2)
        errors.append((s[0] == s[1]).mean() - j)
    assert abs(np.mean(errors)) < 0.015


def test_sentencepiece_equals_the_library(docs, rows, nothing):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    p = pieces.load()
    want = Counter((d, tuple(sp.encode(t or ""))) for d, t in rows)
    for frequent, task_words in ((pieces.FREQUENT_WORDS, pieces.TASK_WORDS), (50, 1), (0, 300)):
        coded = pieces.encode(docs, p, frequent=frequent, task_words=task_words)
        assert coded.columns == [*docs.columns, "ids"]
        assert Counter((r.doc_id, tuple(r.ids)) for r in coded.collect()) == want
    # names that the operator uses itself, or that need quotes; a column of the new name is replaced
    clash = docs.selectExpr("doc_id", "text", "1 AS ids", "2 AS decoded", "3 AS `a.b`", "4 AS era", "5 AS word", "6 AS numbers", "7 AS row", "8 AS spans")
    back = pieces.decode(pieces.encode(clash, p), p)
    assert sorted(back.columns) == sorted(clash.columns)
    for r in back.collect():
        assert r.decoded == (r.text or "") and r["a.b"] == 3 and (r.era, r.word, r.numbers, r.row, r.spans) == (4, 5, 6, 7, 8)
    assert Counter((r.doc_id, tuple(r.ids)) for r in back.collect()) == want
    both = pieces.encode(clash, p, decoded="decoded")
    assert Counter((r.doc_id, r.decoded, tuple(r.ids)) for r in both.collect()) == Counter((d, t or "", tuple(sp.encode(t or ""))) for d, t in rows)
    odd = docs.limit(2).selectExpr("CAST(NULL AS array<int>) AS ids").union(docs.limit(1).selectExpr("array(-5, 10000000, 0)"))
    assert {r.decoded for r in pieces.decode(odd, p).collect()} == {""}
    assert pieces.encode(nothing, p).count() == 0


def test_words_that_share_a_hash_are_told_apart(docs, rows, monkeypatch):
    p, real = pieces.load(), pieces.X.word_hashes
    want = {(r.doc_id, tuple(r.ids)) for r in pieces.encode(docs, p).collect()}
    monkeypatch.setattr(pieces.X, "word_hashes", lambda b, seed=0: real(b, seed) if seed > 3 else real(b, seed) % np.uint64(97))
    assert {(r.doc_id, tuple(r.ids)) for r in pieces.encode(docs, p, frequent=0).collect()} == want


def test_folds_agree_on_a_bpe_model(spark, rows):
    """The fold over bits, the fold over arrays and the heap."""
    p = pieces.load()
    ws = sorted({" " + w for _, t in rows for w in re.findall(r"\S+", t or "") if len(w) < 60} | {"x" * 61, "x" * 62, "\u4e00\u0df4\U0001f9ff"})[:3000]
    df = spark.createDataFrame([(w,) for w in ws], "word string").repartition(4)
    got = {r.word: list(r.ids) for r in pieces.encode_words(df, p).collect()}
    scores = {t: (i, s) for t, i, s in p.rows}
    assert got == {w: pieces.fold_long(w.replace(" ", pieces.MARK), p, scores) for w in ws}
    half = [w for w in ws if len(w) < 8][:300]
    edges = pieces.Lattice(p).edges(half)
    ends = spark.createDataFrame([(w, e) for w, e in zip(half, edges.to_pylist(), strict=True)], f"word string, edges {pieces.EDGES}")
    n = F.length("word")
    old = ends.select("word", pieces._ids(p, pieces.bpe_fold(n, F.col("edges")), F.col("edges"), F.col("word")).alias("ids"))
    assert {r.word: list(r.ids) for r in old.collect()} == {w: got[w] for w in half}


def test_merge_order_differs_from_viterbi_on_a_bpe_model(spark):
    p = pieces.load()
    ws = spark.createDataFrame([(" " + w,) for w in ("thonoring", "erlythand", "reationshings", "unbelievable")], "word string")
    a = {r.word: list(r.ids) for r in pieces.encode_words(ws, p).collect()}
    v = {r.word: list(r.ids) for r in pieces.encode_words(ws, pieces.Pieces(p.rows, p.bytes, p.unknown, "unigram")).collect()}
    assert a != v


def test_viterbi_is_optimal(spark):
    score = {"▁a": -1.0, "a": -1.5, "b": -2.0, "ab": -2.2, "▁ab": -4.0, "ba": -1.2, "bab": -6.0}
    p = pieces.Pieces([(t, k + 5, s) for k, (t, s) in enumerate(score.items())], None, 0, "unigram")
    ws = [" abab", " babba", " aazb", " z", " bbbbb"]
    got = {r.word: list(r.ids) for r in pieces.encode_words(spark.createDataFrame([(w,) for w in ws], "word string"), p).collect()}
    cost_of = {k + 5: -s for k, s in enumerate(score.values())} | {0: 16.0}

    def best(t):
        return 0.0 if not t else min([best(t[n:]) - score[t[:n]] for n in range(1, 4) if t[:n] in score] + ([best(t[1:]) + 16] if t[:1] not in score else []))

    for w in ws:
        assert sum(cost_of[i] for i in got[w]) == pytest.approx(best(w.replace(" ", "▁")))


def test_language_id_held_out(spark, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    got = language.identify(test, language.fit(train), declares=None).join(test.select(F.col("doc_id").alias("id"), "lang"), "id")
    assert got.where("language = lang").count() >= 0.98 * got.count()


def test_language_id_odd_rows(spark, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "12 34 !!", "en", "s", 0), (3, "the and of " * 9, None, None, 0), (3, "the and of " * 9, None, None, 0)], docs.schema)
    m = language.fit(docs)
    got = language.identify(odd, m, id="doc_id").collect()
    assert len(got) == 5 and {r.id for r in got if r.language == "und"} == {1, 2, None} and {r.language for r in got if r.id == 3} == {"en"}
    kept = language.keep_identified(docs.union(odd), m)
    assert kept.columns == docs.columns and kept.count() == docs.count() + 2
    assert language.keep_identified(docs.limit(0), m).count() == 0
    empty = language.identify(odd, language.TextModel([]), id="doc_id")
    assert {r.language for r in empty.collect()} == {"und"}


def test_language_sample_covers_the_whole_table(spark):
    lang = F.when(F.col("doc_id") < 9000, "aa").when(F.col("doc_id") < 11997, "bb-XX").otherwise("cc")
    docs = spark.range(12000).select(F.col("id").alias("doc_id")).select("doc_id", F.format_string("text %d", "doc_id").alias("text"), lang.alias("lang"))
    odd = spark.createDataFrame([(None, "no id", "aa"), (1, None, "aa"), (2, "x", ""), (3, "y", None), (4, "z", "??"), (5, "x" * 20_001, "dd")], "doc_id long, text string, lang string")
    same = spark.range(500).selectExpr("7L AS doc_id", "'same row' AS text", "'ee' AS lang")
    docs = docs.coalesce(3).union(odd).union(same)
    by = {}
    for r in docs.select(F.split("lang", "-")[0].alias("lang"), "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11).alias("h")).collect():
        if r.lang in ("aa", "bb", "cc", "ee") and r.text is not None:
            by.setdefault(r.lang, []).append((r.h, r.text))
    want = Counter()
    for k, q in {"cc": 3, "ee": 499, "bb": 499, "aa": 499}.items():
        want.update((k, t) for _, t in sorted(by[k])[:q])
    assert Counter(language.sample(docs)) == want
    assert language.fit(docs).languages == ["aa", "bb", "cc", "ee"]
    assert language.sample(docs.limit(0)) == []


def test_declared_language_and_host_decide_short_texts(spark):
    train = [("aa", "alpha beta gamma"), ("bb", "delta epsilon zeta")]
    m = language.TextModel(train * 20)
    rows = [(k, "delta epsilon zeta", "bb", "h.bb") for k in range(40)] + [(100, "alpha delta", None, "h.bb"), (101, "alpha beta gamma alpha beta", "bb", "h.bb")]
    got = {r.id: r.language for r in language.identify(spark.createDataFrame(rows, "i int, text string, lang string, source string"), m, id="i").collect()}
    assert got[100] == "bb" and got[101] == "aa"


def test_pages_evidence(spark):
    page = [(1, "https://a.b.example.de:80/x", "<HTML lang='de-DE'><script>var q='en'</script><p>und der <b>die</b></p><!-- x -->")]
    r = language.page_evidence(spark.createDataFrame(page, "page_id long, url string, html string")).first()
    assert r.text.split() == ["und", "der", "die"] and r.declared == "de-DE" and r.host == "a.b.example.de"


def test_pages_use_domain_and_suffix(spark):
    """Posteriors of pages against brute force, with hosts that share a domain or only a suffix."""
    m = language.TextModel([("aa", "alpha beta gamma"), ("bb", "delta epsilon zeta")] * 20)
    hosts = ["a.x.de", "b.x.de", "c.y.de", "x.de", "d.com", "a.x.de", "de", ""] * 4
    texts = ["delta epsilon", "delta zeta", "epsilon zeta", "alpha delta", "alpha beta", "gamma delta", "zeta", "beta delta", "12 34"]
    says = ["aa", "bb-XX", "", "bb"]
    pages = [(k, f"https://{h}/p" if h else "none", f"<html lang='{says[k % 4]}'><p>{texts[k * 7 % 9]}</p>") for k, h in enumerate(hosts)]
    df = language.page_evidence(spark.createDataFrame(pages, "page_id long, url string, html string"))
    rows = sorted(df.collect(), key=lambda r: r.id)
    p = []
    for r in rows:
        ll, n = next(m.score(pa.array([r.text])))
        e = np.exp((ll[0] - ll[0].max()) * language.TEMPER)
        p.append(e / e.sum() if n[0] and ll[0].max() / n[0] > -np.log(language.BUCKETS) else e * 0)
    p, S = np.array(p), language.SMOOTHING
    corpus = (p.sum(0) + 1) / (p.sum() + 2)
    lang = [(r.declared or "").split("-")[0] for r in rows]
    dom = lambda h: ".".join(h.split(".")[-2:]) if "." in h else None
    suf = lambda h: h.split(".")[-1] if "." in h else None
    total = lambda f, h: p[[k for k, r in enumerate(rows) if f(r.host) == f(h)]].sum(0) if f(h) else np.zeros(2)
    mix = lambda own, above: (own + S * above) / (own.sum() + S)
    want = {}
    for k, r in enumerate(rows):
        above = mix(total(dom, r.host), mix(total(suf, r.host), corpus))
        own = total(lambda h: h, r.host) - p[k] if r.host else np.zeros(2)
        fused = p[k] * mix(own, above)
        if lang[k]:
            fused = fused * (p[[j for j in range(len(rows)) if lang[j] == lang[k]]].sum(0) + corpus) / (p.sum(0) + 1)
        want[r.id] = fused.max() / fused.sum() if fused.sum() else 0.0
    got = {r.id: r.posterior for r in language.identify(df, m, id="id", declares="declared", host="host").collect()}
    assert got == pytest.approx(want, abs=1e-9)
    flat = {r.id: r.posterior for r in language.identify(df.withColumn("host", F.translate("host", ".", "_")), m, id="id", declares="declared", host="host").collect()}
    assert flat != pytest.approx(want, abs=1e-4)


def test_language_of_pages_query(spark):
    """Every page, declared languages as the markup has them, posteriors above the threshold or none."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = registry.queries()["language_of_pages"](spark, SF).collect()
    assert {r.page_id for r in got} == set(pages) and len(got) == len(pages)
    for r in got:
        said = re.search(r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", pages[r.page_id].html or "")
        assert (r.declared or "") == (re.match("[A-Za-z]{2,8}", said[1])[0].lower() if said and re.fullmatch(r"[A-Za-z]{2,8}([-_].*)?", said[1]) else "")
        assert r.language == "und" or r.posterior >= language.LEAST


def test_token_counts_equal_greedy(docs, rows, nothing):
    vocab = token_counts.default_vocabulary()
    have, longest = {v.encode() for v in vocab}, max(len(v.encode()) for v in vocab)

    def greedy(w):
        b = ("▁" + w).encode()
        i = n = 0
        while i < len(b):
            i = next(j for j in range(min(len(b), i + longest), i, -1) if b[i:j] in have or j == i + 1)
            n += 1
        return n

    want = Counter()
    for d, t in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        want[d, len(ws), sum(map(greedy, ws))] += 1
    a = token_counts.Automaton(vocab)
    assert Counter(map(tuple, token_counts.count_tokens(docs, a).collect())) == want
    assert token_counts.count_tokens(nothing, a).count() == 0


def test_automaton_without_fallback():
    a = token_counts.Automaton(["ab", "abcd", "c", "d", "_", "_ab"], byte_fallback=False, mark="_")
    data = np.frombuffer(b"abcabcdxab", np.uint8)
    start, end = np.array([0, 3, 7, 8]), np.array([3, 7, 8, 10])
    # _ab c | _ab c d (the longest match takes _ab first) | unknown | _ab
    assert a.counts(data, start, end).tolist() == [2, 3, 1, 1]


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _valid(kind, m):
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    d = re.sub("[^0-9]", "", m)
    if kind == "card":
        total = sum(v if i % 2 == 0 else v * 2 - 9 if v > 4 else v * 2 for i, v in enumerate(map(int, reversed(d))))
        return 14 <= len(d) <= 19 and total % 10 == 0
    return kind != "phone" or 10 <= len(d) <= 15


def test_pii_base_spans(spark, docs, rows, nothing):
    tricky = ["a@b.c_d@e.f x@y..z 1.2.3.4.5.6.7.8 300.1.1.1 001.2.3.4", "4539 1488 0343 6467 +1 (017) 555-7713. call 555-123-4567 12  34", "é日本 +49 151 1234 5678 9 日a.b@c-d.e-f.g", "9" * 30, "+1 2+3 4567890123 4", "4111-1111-1111-1111 41111111111111111111", "ssn 123-45-6789 and token = \"" + "0f" * 20 + '"']
    data = rows + [(40_000 + k, t) for k, t in enumerate(tricky)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(data[len(rows) :], "doc_id long, text string"))
    model = pii.Model(spark)
    assert model.accuracy > 0.95
    got = pii.find(df, model=model).collect()
    want = Counter()
    for d, t in data:
        found = sorted((x.start(), k, x.end()) for k, p in enumerate(PII.values()) for x in re.finditer(p, t or "") if _valid(list(PII)[k], x.group()))
        want[d, tuple((list(PII)[k], a, b) for a, k, b in found)] += 1
    assert Counter((r.doc_id, tuple((x.kind, x.start, x.end) for x in r.spans if x.base)) for r in got) == want
    own = {x.kind for r in got if r.doc_id == 40_006 for x in r.spans if not x.base}
    assert own == {"national_id", "secret"}
    hidden = df.where("doc_id = 40006").select("text", F.lit(1).alias("k")).crossJoin(pii.find(df.where("doc_id = 40006"), model=model)).select(pii.redact(F.col("text"), F.col("spans")).alias("t")).first().t
    assert hidden == 'ssn [national_id] and token = "[secret]"'
    assert pii.find(nothing, model=model).count() == 0


def test_pii_secrets_without_digits(spark):
    texts = ["token = xKdjfQwErTyUiOpA", 'api_key: "GhTrEwQsDfLkJhGfDsAqZx"', "the password authentication and internationalization", "secret: CustomerAccountManager", "auth = RESET_TOKEN_NAME", "nothing but internationalization", "xKdjfQwErTyUiOpA"]
    got = {r.doc_id: [(x.kind, x.m) for x in r.spans] for r in pii.find(spark.createDataFrame([*enumerate(texts)], "doc_id int, text string")).collect()}
    assert got == {0: [("secret", "xKdjfQwErTyUiOpA")], 1: [("secret", "GhTrEwQsDfLkJhGfDsAqZx")]} | {k: [] for k in range(2, len(texts))}


def test_pii_own_spans_equal_a_plain_version(spark):
    """Generators, probabilities and the choice among spans, recomputed in Python from the model's trees."""
    model = pii.Model(spark)
    assert model.precision >= 0.9 and model.recall >= 0.9
    texts = [
        'token = "' + "0f" * 20 + '" and ssn 123-45-6789, call 555-123-4567 or (555) 123 4567',
        "tel 4539 1488 0343 6467 iban DE44500105175407324931 x 123-45-6789-1 secret: 123-45-6789",
        "order 555 123 4567 build=0123456789abcdef0123 " + "a-b_C9" * 9 + " api_key=ZZ11yy22XX33ww44 bearer abcDEF123ghiJKL456",
        "phone " + " ".join(f"555-{k:03d}-{k:04d}" for k in range(100, 300)),
        "\u00e9\U0001f600 iban FR1420041010050500013M02606 and +49 151 1234 5678 a@b.cd password=hunter2hunter2",
    ]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id int, text string")
    got = {r.doc_id: [(x.start, x.end, x.kind, x.base) for x in r.spans] for r in pii.find(df, model=model).collect()}
    ranks = {k: n for n, k in enumerate([*pii.KINDS, *pii.OWN])}
    plain = {"secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{12,}", "national_id": pii.OWN["national_id"][1], "phone_local": pii.OWN["phone_local"][1], "iban": pii.OWN["iban"][1]}
    for k, t in enumerate(texts):
        base = [(x.start(), x.end(), kind, 1.0) for kind, p in PII.items() for x in re.finditer(p, t) if _valid(kind, x.group())]
        asked = []
        for kind, p in plain.items():
            for x in re.finditer(p, t):
                behind = re.search("[=:]\\s?[\"']?$", t[: x.start()])
                if kind != "secret" or behind or not re.fullmatch("[A-Za-z]?[a-z]+", x.group()):
                    asked.append((x.start(), x.end(), kind, x.group(), t[max(0, x.start() - pii.CONTEXT) : x.start()]))
        frame = spark.createDataFrame([(n, a[3], a[4]) for n, a in enumerate(asked)], "n int, m string, before string")
        rows = {r.n: r.asDict() for r in frame.select("n", *[c.alias(f) for f, c in pii.features(F.col("m"), F.col("before")).items()]).collect()}
        own = []
        for n, (a, b, kind, _, _) in enumerate(asked):
            score = sum(pii.walk(tree, rows[n]) for tree in model.trees)
            q = 1 / (1 + np.exp(-(model.a * score + model.b)))
            if q >= model.least[kind] - 1e-12:
                own.append((a, b, kind, q))
        meets = lambda x, y: x[0] < y[1] and y[0] < x[1]
        stays = [x for x in own if not any(meets(x, y) for y in base) and not any(meets(x, y) and (y[3] > x[3] + 1e-12 or (abs(y[3] - x[3]) <= 1e-12 and ranks[y[2]] < ranks[x[2]])) for y in own if y is not x)]
        want = sorted([(a, ranks[kind], b, kind, True) for a, b, kind, _ in base] + [(a, ranks[kind], b, kind, False) for a, b, kind, _ in stays])
        assert got[k] == [(a, b, kind, is_base) for a, _, b, kind, is_base in want]


def test_running_folds_in_blocks(spark):
    n = 5 * pii.BLOCK + 3
    df = spark.createDataFrame([(list(range(k)),) for k in (0, 1, pii.BLOCK, n)], "x array<int>")
    sums = pii.running(F.col("x"), F.lit(0), lambda s, v: F.struct((s + v).alias("state"), (s + v).alias("out")), "int")
    assert sorted(len(r.s) for r in df.select(sums.alias("s")).collect()) == [0, 1, pii.BLOCK, n]
    assert all(list(r.s) == np.cumsum(r.x).tolist() for r in df.select("x", sums.alias("s")).collect())


def test_filters_pass_columns_whose_names_clash(spark, docs, rows):
    """The operators' own names, names that need quotes, and what they held."""
    odd = docs.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "1 AS _i", "2 AS _t", "3 AS _gone", "4 AS _key", "5 AS _row", "6 AS `a.b`", "7 AS recipe", "8 AS ids", "9 AS keep_id", "10 AS row", "11 AS rest")
    bench = spark.createDataFrame([("1", "dup text here now and then")], "item_id string, text string")
    for out in (exact.drop_copies(odd), language.keep_identified(odd, language.fit(odd)), near.drop_near_copies(odd), decontamination.remove_contaminated(odd, bench)):
        assert out.columns == odd.columns
        got = out.collect()
        assert got and all((r["_i"], r["_t"], r["_gone"], r["_key"], r["_row"], r["a.b"], r.recipe, r.ids, r.keep_id, r.row, r.rest) == tuple(range(1, 12)) for r in got)


def test_large_sides_are_shuffled_with_the_same_results(spark, docs, monkeypatch):
    small = [exact.drop_copies(docs), near.drop_near_copies(docs), near.classes(docs)]
    want = [Counter(map(str, df.collect())) for df in small]
    for module in (exact, near, language):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    assert [Counter(map(str, df.collect())) for df in (exact.drop_copies(docs), near.drop_near_copies(docs), near.classes(docs))] == want


def test_substring_ids_must_be_integers(docs):
    with pytest.raises(ValueError, match="integer"):
        substrings.remove_repeats(docs.selectExpr("CAST(doc_id AS string) AS doc_id", "text"))


def test_executors_need_no_installation(tmp_path):
    """A driver outside the repository, whose workers can't import the package."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    code = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
sys.path.insert(0, {str(root)!r})
def absent(_):
    import importlib.util
    return [importlib.util.find_spec("stratavane") is None]
assert all(spark.sparkContext.parallelize([0], 1).mapPartitions(absent).collect())
from stratavane.llm import registry
for name in ("op1_minhash_near_dedup", "op2_sentencepiece", "op3_language_id", "op4_token_counts", "op6_decontamination", "op8_token_files", "op10_substring_dedup"):
    assert registry.queries()[name](spark, {SF!r}).count() > 0, name
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert "all ran" in done.stdout, done.stderr[-2000:]


def test_license_scan(spark, docs, rows, nothing):
    lines = ["Licensed under CC BY-NC 4.0.", "under the GNU general PUBLIC license", "all rights, reserved; All Rights Reserved", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.", "cc by cc by"]
    data = rows + [(50_000 + k, t) for k, t in enumerate(lines)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(data[len(rows) :], "doc_id long, text string"))
    got = {}
    want = {}
    for r in licenses.scan(df).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, sorted((x.i, x.label) for x in r.base), {x.label for x in r.found}))
    for d, t in data:
        w = words(t)
        want.setdefault(d, []).append((len(w), sorted((i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())))
    assert {d: sorted(x[:2] for x in v) for d, v in got.items()} == {d: sorted(v) for d, v in want.items()}
    assert [got[50_000 + k][0][2] for k in (0, 3, 4)] == [{"cc-by-nc-4.0"}, {"gpl-3.0"}, {"mit"}]
    assert licenses.scan(nothing).count() == 0


def test_token_files(spark, docs, rows, nothing, tmp_path):
    from tokenizers import Tokenizer

    more = ["It's l'été, d'arc a.'s x.y-z×e÷f É.É ≠a 12ab3c! (ok) naïve.’s", "x <|endoftext|> y<|startoftext|>z I'LL ΣΑΣ", "a\u0085b ́x"]
    data = rows + [(60_000 + k, t) for k, t in enumerate(more)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(data[len(rows) :], "doc_id long, text string"))
    shards = token_files.write(df, f"file://{tmp_path}/t", length=64)
    got = sorted(token_files.read(spark, shards).collect(), key=lambda r: r.start)
    tok = Tokenizer.from_file(token_files.default_vocabulary())
    ids = [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for _, t in data]
    assert Counter((r.id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (d, _), x in zip(data, ids, strict=True))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    order = [(-1 if r.id is None else r.id) for r in got]
    assert order == sorted(order)
    reader = token_files.sequences(shards[0][0])
    batch = reader.get_batch(0)
    assert batch.column("ids").type == pa.list_(pa.uint16(), 64) and batch.column("mask").type == pa.list_(pa.bool_(), 64)
    real = sum(int(reader.get_batch(k).column("mask").values.to_numpy(zero_copy_only=False).sum()) for k in range(reader.num_record_batches))
    assert real == shards[0][2]
    assert token_files.read(spark, token_files.write(nothing, f"file://{tmp_path}/e")).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    a, b = registry.queries()[name](spark, SF).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)

    def value(v):
        if v is None or str(v) in ("<NA>", "nan"):
            return "null"
        return f"{float(v):.9g}" if isinstance(v, int | float | np.number) and not isinstance(v, bool) else str(v)

    as_rows = lambda df: Counter(tuple(value(r[c]) for c in cols) for r in df.to_dict("records"))
    assert as_rows(a) == as_rows(b)


def test_pipeline_stages(spark):
    """Each stage's decisions against a plain version."""
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "benchmark_decontamination", "sentencepiece_encoding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = storage.stage(stage(spark, held, SF), name)
        seen.append((name, held, out))
        if name != "sentencepiece_encoding":
            assert out.columns == docs.columns
        held = out
    by = {n: (a, b) for n, a, b in seen}
    a, b = by["language_id"]
    assert a.count() == b.count()
    a, b = by["exact_dedup"]
    assert {r.doc_id for r in b.collect()} == {max(x) for x in _groups(a).values()}
    a, b = by["near_dedup"]
    rows = [(r.doc_id, r.text) for r in a.collect()]
    bags = _bags(rows)
    link = {k: {k} for k in range(len(rows))}
    for x in bags:
        for y in bags:
            if x < y and sum((bags[x] & bags[y]).values()) * 5 >= 4 * sum((bags[x] | bags[y]).values()):
                both = link[x] | link[y]
                for z in both:
                    link[z] = both
    assert {r.doc_id for r in b.collect()} == {min(rows[z][0] for z in s) for s in link.values()}
    a, b = by["benchmark_decontamination"]
    flagged = decontamination.op6_decontamination(spark, SF).where("contaminated").select("doc_id")
    assert {r.doc_id for r in b.collect()} == {r.doc_id for r in a.select("doc_id").subtract(flagged).collect()}
    a, b = by["sentencepiece_encoding"]
    assert b.where("NOT round_trip").count() == 0 and b.count() == a.count()
    whole = corpus_pipeline.run(spark, SF)
    assert Counter((r.doc_id, tuple(r.ids)) for r in whole.collect()) == Counter((r.doc_id, tuple(r.ids)) for r in b.collect())


def _groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.text or "", []).append(r.doc_id)
    return out


def test_entry_survives_without_the_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    code = "import sys; sys.modules['stratavane.llm'] = None; import __spark_entry__ as e; n = e.queries(); assert n and not any(k.startswith('op') for k in n) and 'pipeline' not in n"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
