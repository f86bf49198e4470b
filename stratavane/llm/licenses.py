"""Licence scans with a positional index of rare licence words.

The index holds, for each template (a licence's own notice), its words by position.  One pass over the corpus
takes each file's words, notes which licence words it holds, and keeps the words of files that hold all words of some
phrase; counted over all files, that gives the licence words' document frequencies.  The postings (word, template, position) of
each template's ``RARE`` rarest words are then looked up for the places of such words in a file: each gives a template
and an offset at which the template would begin.  Where at least two of a template's places agree on one offset, its
mandatory key phrase is verified there, and its words that stand in place give the score.

DataFrame functions only, and no shuffle but for the counts of at most a few hundred licence words.  Templates,
not data, bound what is collected.  Agreement is found by sorting a file's candidates, so a very long file full of
licence words costs n log n.

Defined results: null and empty texts have no words, no labels and score 0.  Repeated rows each get
a result.  Ties in frequency fall to the earlier word of the template.  Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavane import storage

#: The contract's phrases and labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label, the licence's own notice, mandatory key phrase.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "except in compliance with the license"),
    ("mit", "Released under the MIT License", "mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "gnu general public license"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu general public license"),
    ("lgpl", "under the terms of the GNU Lesser General Public License", "gnu lesser general public license"),
    ("agpl", "under the terms of the GNU Affero General Public License", "gnu affero general public license"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc by nc"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", "cc by sa"),
    ("cc-by-4.0", "Licensed under CC BY 4.0", "cc by 4"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived all copyright"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license"),
    ("epl-2.0", "made available under the terms of the Eclipse Public License 2.0", "eclipse public license"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", "boost software license"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered software"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    ("reserved", "All rights reserved", "all rights reserved"),
]
#: A template's rarest distinct words, whose places are posted, and how many of those places must agree on one offset.
RARE, AGREE = 6, 2
#: The least share of a template's words that must stand at the offset.
LEAST_SCORE = 0.6
#: The score of a file in which only a contract phrase was found.
PHRASE_SCORE = 0.5
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split_words(text: str) -> list[str]:
    return re.findall(_WORD, text.translate({c: c + 32 for c in range(65, 91)}))


def words(text: Column) -> Column:
    # Of all other characters only U+212A has a lower case below 0x80; as a word character it may be another one.
    lower = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.array_remove(F.split(lower, _GAP, -1), "")


def _texts(xs: list[str]) -> Column:
    return F.array(*map(F.lit, xs))


def _phrases(templates) -> list[list[str]]:
    """The words of every phrase without which nothing is found."""
    return [list(x) for x in sorted({tuple(split_words(p)) for p in [*BASE, *(t[2] for t in templates)]})]


def shelved(docs: DataFrame, *, id: str = "doc_id", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """``doc_id``, ``n_words``, ``held``, the distinct licence words, and ``w``, all words, if some phrase's are among them."""
    vocab = sorted({w for _, t, _ in templates for w in split_words(t)} | {w for p in BASE for w in p.split()})
    df = docs.select(F.col(f"`{id}`").alias("doc_id"), words(F.col(f"`{text}`")).alias("w"))
    df = df.select("doc_id", "w", F.array_intersect("w", _texts(vocab)).alias("held"))
    may = F.lit(False)
    for p in _phrases(templates):
        need = F.lit(True)
        for x in dict.fromkeys(p):
            need = need & F.array_contains("held", x)
        may = may | need
    return df.select("doc_id", F.size("w").cast("long").alias("n_words"), "held", F.when(may, F.col("w")).alias("w"))


def postings(counts: dict[str, int], templates=TEMPLATES) -> dict[str, list[tuple[int, int]]]:
    """The places (template, position) of each template's rarest words, by word."""
    out: dict[str, list[tuple[int, int]]] = {}
    for k, (_, text, _) in enumerate(templates):
        w = split_words(text)
        first = {x: i for i, x in reversed([*enumerate(w)])}
        for x in sorted(first, key=lambda x: (counts.get(x, 0), first[x]))[:RARE]:
            out.setdefault(x, []).extend((k, i) for i, y in enumerate(w) if y == x)
    return out


def _standing(w: Column, at: Column, expected: Column) -> Column:
    """Whether the words stand from index ``at`` on."""
    return F.forall(F.transform(expected, lambda x, j: F.coalesce(F.get(w, at + j) == x, F.lit(False))), lambda ok: ok)


def _base(w: Column) -> Column:
    def phrase(p: list[str], label: str) -> Column:
        at = F.filter(F.transform(w, lambda x, i: F.when(x == p[0], i)), lambda i: i.isNotNull())
        return F.transform(F.filter(at, lambda i: _standing(w, i + 1, _texts(p[1:]))), lambda i: F.struct(i.alias("i"), F.lit(label).alias("label")))

    return F.flatten(F.array(*[phrase(p.split(), label) for p, label in BASE.items()]))


def _found(w: Column, index: dict[str, list[tuple[int, int]]], templates) -> Column:
    """Label and score of each template at each offset on which its postings agree."""
    place = lambda k, i: F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"))
    table = F.create_map(*[x for word, at in index.items() for x in (F.lit(word), F.array(*[place(*p) for p in at]))])
    starts = [next(i for i in range(len(split_words(t))) if split_words(t)[i : i + len(split_words(p))] == split_words(p)) for _, t, p in templates]
    keys, texts, labels = F.array(*map(F.lit, starts)), F.array(*[_texts(split_words(t)) for _, t, _ in templates]), _texts([t[0] for t in templates])
    phrases = F.array(*[_texts(split_words(p)) for _, _, p in templates])
    rare = F.filter(F.transform(w, lambda x, i: F.when(x.isin(list(index)), F.struct(x.alias("x"), i.alias("i")))), lambda h: h.isNotNull())
    asked = F.flatten(F.transform(rare, lambda h: F.transform(table[h["x"]], lambda p: F.struct(p["k"].alias("k"), (h["i"] - p["i"]).alias("at")))))

    def agreed(sorted_: Column) -> Column:
        # in a run of equal candidates, the one with exactly AGREE - 1 equals before it stands for the run
        same = lambda c, j: F.coalesce(F.get(sorted_, j) == c, F.lit(False))
        return F.filter(sorted_, lambda c, j: F.when(j >= AGREE - 1, same(c, j - (AGREE - 1))).otherwise(False) & ~F.when(j >= AGREE, same(c, j - AGREE)).otherwise(False))

    def score(c: Column) -> Column:
        words_ = F.get(texts, c["k"])
        right = F.filter(words_, lambda x, j: F.when(c["at"] + j >= 0, F.coalesce(F.get(w, c["at"] + j) == x, F.lit(False))).otherwise(False))
        return F.struct(F.get(labels, c["k"]).alias("label"), (F.size(right) / F.size(words_)).alias("score"))

    def verified(c: Column) -> Column:
        at = c["at"] + F.get(keys, c["k"])
        return F.when(at >= 0, _standing(w, at, F.get(phrases, c["k"]))).otherwise(False)

    hits = F.transform(F.array(F.sort_array(asked)), agreed)[0]
    return F.filter(F.transform(F.filter(hits, verified), score), lambda x: x["score"] >= LEAST_SCORE)


def scan(docs: DataFrame, *, id: str = "doc_id", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per document: ``n_words``; ``base`` (index and label of each contract phrase), and
    ``found`` (label and score of each place where a template stands)."""
    rows = storage.stage(shelved(docs, id=id, text=text, templates=templates), "shelved")
    counts = rows.select(F.explode("held").alias("x")).groupBy("x").count().collect()
    index = postings({r.x: r["count"] for r in counts}, templates)
    w = F.col("w")
    return rows.select(
        "doc_id",
        "n_words",
        F.when(w.isNotNull(), _base(w)).otherwise(F.array().cast("array<struct<i:int,label:string>>")).alias("base"),
        F.when(w.isNotNull(), _found(w, index, templates)).otherwise(F.array().cast("array<struct<label:string,score:double>>")).alias("found"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    label = lambda c: F.array_distinct(F.transform(c, lambda x: x.label))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x.i)).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda x: x.i)).cast("long").alias("last_word"),
        F.array_join(F.array_sort(label("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(label("base"), label("found"))), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("found", lambda x: x.score)), F.lit(0.0)), F.when(F.size("base") > 0, F.lit(PHRASE_SCORE)).otherwise(F.lit(0.0))).alias("score"),
    )


def _sql() -> str:
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    rows = []
    for k, (label, notice, phrase) in enumerate(TEMPLATES):
        w, key = split_words(notice), split_words(phrase)
        at = next(i for i in range(len(w)) if w[i : i + len(key)] == key)
        rows.append(f"({k}, '{label}', {quoted(w)}, {at}, {len(key)})")
    base = ", ".join(f"('{label}', {quoted(p.split())})" for p, label in BASE.items())
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(k, label, w, key_at, key_n) AS (VALUES {", ".join(rows)}),
tw AS (SELECT k, label, key_at, key_n, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS j FROM t),
p AS (SELECT doc_id, word, i FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d) WHERE word IN (SELECT word FROM tw) OR word IN ('cc', 'by')),
df AS (SELECT word, count(DISTINCT doc_id) AS df FROM p GROUP BY 1),
rare AS (SELECT k, word FROM (SELECT k, word, min(j) AS j FROM tw GROUP BY 1, 2) LEFT JOIN df USING (word) QUALIFY row_number() OVER (PARTITION BY k ORDER BY coalesce(df, 0), j) <= {RARE}),
a AS (SELECT p.doc_id, tw.k, p.i - tw.j AS o FROM rare JOIN tw USING (k, word) JOIN p USING (word) GROUP BY 1, 2, 3 HAVING count(*) >= {AGREE}),
m AS (SELECT a.doc_id, a.k, a.o, any_value(tw.label) AS label, count(p.i) / any_value(tw.n)::DOUBLE AS score, count(p.i) FILTER (tw.j >= tw.key_at AND tw.j < tw.key_at + tw.key_n) = any_value(tw.key_n) AS phrase
  FROM a JOIN tw ON tw.k = a.k LEFT JOIN p ON p.doc_id = a.doc_id AND p.word = tw.word AND p.i = a.o + tw.j GROUP BY 1, 2, 3),
f AS (SELECT doc_id, label, max(score) AS score FROM m WHERE phrase AND score >= {LEAST_SCORE} GROUP BY 1, 2),
b(label, ph) AS (VALUES {base}),
bw AS (SELECT label, len(ph) AS n, unnest(ph) AS word, unnest(range(len(ph))) AS j FROM b),
h AS (SELECT p.doc_id, bw.label, p.i - bw.j AS i FROM p JOIN bw ON bw.word = p.word GROUP BY 1, 2, 3 HAVING count(*) = any_value(bw.n)),
hs AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY 1),
ls AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM h UNION SELECT doc_id, label FROM f) GROUP BY 1),
fs AS (SELECT doc_id, max(score) AS score FROM f GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  greatest(coalesce(score, 0), CASE WHEN n_base > 0 THEN {PHRASE_SCORE} ELSE 0 END)::DOUBLE AS score
FROM d LEFT JOIN hs USING (doc_id) LEFT JOIN ls USING (doc_id) LEFT JOIN fs USING (doc_id)
"""


SQL = _sql()
