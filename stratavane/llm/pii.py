"""Personal data: candidate spans, boosted trees over their format and context, and calibrated
thresholds.

The contract's four kinds are matched by their patterns and checks; those spans always stay.
High-recall generators propose further, overlapping spans (secrets, identity numbers, telephone
numbers without a plus sign, bank accounts).  Each proposal becomes a row of format and context
features; gradient-boosted trees score it, a calibrated sigmoid turns the score into a probability,
and a span is added if that reaches the threshold of its kind and it overlaps no base span and no
likelier proposal.

Everything on the data's path is a DataFrame expression without a shuffle: matches and the text
between them (``regexp_extract_all`` and ``split``) give the spans, the trees become CASE
expressions.  The trees are fitted on the driver from ``SAMPLE`` labelled lines made by rule
(``labelled``), a fixed bound: half of them for the trees, a quarter for calibration and thresholds, a quarter for
the measured accuracy, precision and recall.  Patterns begin only where a run of their characters begins and
take runs possessively, so that matching is linear in the text; both keep the contract's matches.  Places are running
sums over blocks of matches, and overlaps are decided within groups of spans that touch, so a text full of
matches costs no more than its length.

Defined results: null and empty texts have no spans.  Offsets count code points, ends are
exclusive.  Repeated rows each get a result; other columns are ignored.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
#: kind: what a text with a match must contain, and the pattern
BASE = {
    "email": (r"@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: The method's own kinds, in the order in which they follow the base kinds.
OWN = {
    # a run of mere letters like a word's is proposed behind an assignment only
    "secret": (r"[A-Za-z0-9_-]{12}", r"(?<![A-Za-z0-9_-])(?:(?<=[=:]\s?[\"']?)|(?![A-Za-z]?[a-z]+(?![A-Za-z0-9_-])))[A-Za-z0-9_-]{12,}+"),
    "national_id": (r"[0-9]-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "phone_local": (r"[0-9][ .-][0-9]", r"(?<![0-9+.(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"),
    "iban": (r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3})?+)(?![A-Za-z0-9])"),
}
#: Code points before a candidate that count as its context.
CONTEXT = 32
#: Labelled lines the trees are fitted on, boosting rounds, step, and the least share of right spans.
SAMPLE, ROUNDS, STEP, PRECISION = 2000, 12, 0.4, 0.97
#: Items of an array that are folded at a time.
BLOCK = 64
WORDS = {
    "says_secret": r"(?i)(token|secret|passw|passwd|pwd|api.?key|access.?key|credential|bearer|auth)",
    "says_phone": r"(?i)(phone|tel|call|fax|mobile|contact)",
    "says_id": r"(?i)(ssn|social|identity|passport|tax|national)",
    "says_bank": r"(?i)(iban|bank|account|transfer|konto|cuenta|compte)",
    "says_other": r"(?i)(version|commit|sha|hash|md5|checksum|order|isbn|build|uuid|file|page|item|part)",
}


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def weighed(i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), weighed), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        # digits beyond the first significant three make a part too large
        return F.forall(F.split(m, r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        digits = F.translate(m, " -", "")
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.translate(m, "+ ().-", "")).between(10, 15)
    return F.lit(True)


def running(items: Column, state: Column, step, out: str) -> Column:
    """The outputs of step(state, item) -> (state, output) along an array; ``out`` is the output's type.  Items are folded in blocks,
    whose outputs are put together once, because each append copies what is there."""
    none = F.array().cast(f"array<{out}>")

    def one(acc: Column, x: Column) -> Column:
        return F.transform(F.array(step(acc["state"], x)), lambda got: F.struct(got["state"].alias("state"), F.concat(acc["out"], F.array(got["out"])).alias("out")))[0]

    def block(acc: Column, k: Column) -> Column:
        part = F.aggregate(F.slice(items, k * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return F.transform(F.array(part), lambda got: F.struct(got["state"].alias("state"), F.concat(acc["out"], F.array(got["out"])).alias("out")))[0]

    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
    start = F.struct(state.alias("state"), F.array().cast(f"array<array<{out}>>").alias("out"))
    return F.when(F.size(items) > 0, F.aggregate(blocks, start, block, lambda acc: F.flatten(acc["out"]))).otherwise(none)


SPAN = "struct<start:int,end:int,m:string,before:string>"


def spans(text: Column, sign: str, pattern: str, keep=lambda m: F.lit(True)) -> Column:
    """Non-overlapping matches, from left to right, as structs (start, end, m, before) in code points; ``before`` holds
    the ``CONTEXT`` code points before a match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(found, F.split(text, pattern, -1), lambda m, gap: F.struct(m.alias("m"), gap.alias("gap")))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        before = F.right(F.concat(state["tail"], x["gap"]), F.lit(CONTEXT))
        out = F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("m"), before.alias("before"))
        return F.transform(F.array(out), lambda o: F.struct(F.struct(o["end"].alias("at"), F.right(F.concat(o["before"], o["m"]), F.lit(CONTEXT)).alias("tail")).alias("state"), o.alias("out")))[0]

    got = F.transform(F.array(F.filter(pairs, lambda x: x["m"].isNotNull())), lambda real: running(real, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), step, SPAN))[0]
    return F.when(text.rlike(sign), F.filter(got, lambda x: keep(x["m"]))).otherwise(F.array().cast(f"array<{SPAN}>"))


def touching(sorted_: Column, kind: str) -> Column:
    """Spans in order of their starts, in groups; spans of different groups don't meet."""
    none = F.array().cast(f"array<{kind}>")
    far = F.struct(F.lit(2**31 - 1).alias("start"))

    def step(state: Column, x: Column) -> Column:
        new = x["start"] >= state["end"]
        return F.struct(
            F.struct(F.when(new, F.array(x)).otherwise(F.concat(state["open"], F.array(x))).alias("open"), F.when(new, x["end"]).otherwise(F.greatest(state["end"], x["end"])).alias("end")).alias("state"),
            F.when(new, state["open"]).otherwise(none).alias("out"),
        )

    # a last span beyond the text closes the last group
    last = F.transform(F.slice(sorted_, 1, 1), lambda x: x.withField("start", far["start"]).withField("end", far["start"]))
    groups = F.transform(F.array(F.concat(sorted_, last)), lambda all_: running(all_, F.struct(none.alias("open"), F.lit(0).alias("end")), step, f"array<{kind}>"))[0]
    return F.filter(groups, lambda g: F.size(g) > 0)


def features(m: Column, before: Column) -> dict[str, Column]:
    """Format and context features of a candidate."""
    n = F.length(m)
    share = lambda chars: F.length(F.regexp_replace(m, f"[^{chars}]", "")) / n
    return {
        "length": n.cast("double"),
        "digits": share("0-9"),
        "hex": share("0-9a-f"),
        "upper": share("A-Z"),
        "signs": share("_-"),
        "changes": (F.length(F.regexp_replace(m, r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", "#")) - n) / n,
        "cases": (F.length(F.regexp_replace(m, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])", "#")) - n) / n,
        "assigned": F.when(before.rlike("[=:]\\s?[\"']?$"), 1.0).otherwise(0.0),
        **{k: F.when(before.rlike(p), 1.0).otherwise(0.0) for k, p in WORDS.items()},
    }


def labelled(n: int = SAMPLE) -> list[tuple[str, str, str, int]]:
    """Labelled candidates made by rule: kind, candidate, the text before it, 1 for personal or secret."""
    rnd = random.Random(7)
    of = lambda chars, k: "".join(rnd.choice(chars) for _ in range(k))
    hexes, digits, letters = "0123456789abcdef", "0123456789", "abcdefghijklmnopqrstuvwxyz"
    filler = lambda: " ".join(of(letters, rnd.randint(2, 8)) for _ in range(3))
    out = []
    while len(out) < n:
        pick = rnd.randrange(13)
        if pick == 0:
            out.append(("secret", of(hexes, rnd.choice([16, 18, 20, 32, 40, 64])), f"{filler()} {rnd.choice(['token', 'secret', 'password', 'api_key', 'auth'])}{rnd.choice([' = ', '=', ': ', ':'])}" + rnd.choice(["", '"']), 1))
        elif pick == 1:
            out.append(("secret", of(letters + letters.upper() + digits, rnd.randint(16, 40)), f"{filler()} {rnd.choice(['bearer ', 'access key ', 'credential '])}", 1))
        elif pick == 2:
            out.append(("secret", of(hexes, rnd.choice([32, 40, 64])), f"{filler()} {rnd.choice(['commit ', 'sha ', 'checksum: ', 'md5 ', 'build=', 'file '])}", 0))
        elif pick == 3:
            out.append(("secret", of(letters, rnd.randint(12, 30)) + rnd.choice(["", "2", "-3", "_x"]), f"{filler()} ", 0))
        elif pick == 4:
            out.append(("secret", of(digits, rnd.randint(12, 24)), f"{filler()} {rnd.choice(['', 'order ', 'part ', 'item ', 'isbn '])}", 0))
        elif pick == 5:
            out.append(("national_id", f"{of(digits, 3)}-{of(digits, 2)}-{of(digits, 4)}", f"{filler()} {rnd.choice(['ssn ', 'ssn: ', 'social security ', 'identity no ', 'tax id ', ''])}", 1))
        elif pick == 6:
            out.append(("national_id", f"{of(digits, 3)}-{of(digits, 2)}-{of(digits, 4)}", f"{filler()} {rnd.choice(['part ', 'isbn ', 'order ', 'version '])}", 0))
        elif pick == 7:
            out.append(("phone_local", f"{rnd.choice(['', '('])}{of(digits, 3)}{rnd.choice([' ', '-', '.'])}{of(digits, 3)}{rnd.choice([' ', '-', '.'])}{of(digits, 4)}", f"{filler()} {rnd.choice(['phone ', 'tel: ', 'call ', 'fax '])}", 1))
        elif pick == 8:
            out.append(("phone_local", f"{of(digits, 3)} {of(digits, 3)} {of(digits, 4)}", f"{filler()} {rnd.choice(['', 'order ', 'page ', 'item '])}", 0))
        elif pick == 9:
            # without a digit: random letters of both cases
            out.append(("secret", of(letters + letters.upper(), rnd.randint(16, 40)), f"{filler()} {rnd.choice(['token = ', 'secret: ', 'password=', 'api_key: ', 'bearer ', 'access key ', 'credential '])}" + rnd.choice(["", '"']), 1))
        elif pick == 10:
            # without a digit: words, names and constants, often behind a secret word as well
            word = rnd.choice([of(letters, rnd.randint(12, 24)), of(letters, rnd.randint(11, 16)).capitalize(), "".join(of(letters, rnd.randint(4, 9)).capitalize() for _ in range(3)), "_".join(of(letters.upper(), rnd.randint(4, 9)) for _ in range(3)), of(letters.upper(), rnd.randint(12, 20)), "-".join(of(letters, rnd.randint(4, 9)) for _ in range(3))])
            out.append(("secret", word, f"{filler()} {rnd.choice(['', '', 'token ', 'password ', 'secret: ', 'auth = ', 'bearer ', 'authors ', 'name = '])}", 0))
        elif pick == 11:
            # random letters of both cases that nothing calls a secret
            out.append(("secret", of(letters + letters.upper(), rnd.randint(12, 40)), f"{filler()} {rnd.choice(['', '', 'order ', 'file ', 'name '])}", 0))
        else:
            good = rnd.random() < 0.6
            out.append(("iban", f"{of(letters.upper(), 2)}{of(digits, rnd.randint(15, 22))}", f"{filler()} {rnd.choice(['iban ', 'account ', 'bank ', '']) if good else rnd.choice(['part ', 'order ', 'version ', 'build '])}", int(good)))
    return out


def fit(rows: list[dict[str, float]], labels: list[int]) -> list[tuple]:
    """Gradient boosting with trees of depth two under logistic loss. A tree is a nested tuple
    (feature, threshold, below, above) with numbers as leaves."""
    names, f, trees = sorted(rows[0]), [0.0] * len(rows), []
    cuts = {k: sorted({r[k] for r in rows}) for k in names}
    cuts = {k: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)][:: max(1, len(v) // 16)] for k, v in cuts.items()}

    def grow(idx: list[int], g: list[float], h: list[float], depth: int):
        sg, sh = sum(g[i] for i in idx), sum(h[i] for i in idx)
        leaf = STEP * sg / (sh + 1.0)
        best = (1e-6, None, None)
        for k in names if depth else ():
            for c in cuts[k]:
                lg = lh = 0.0
                for i in idx:
                    if rows[i][k] < c:
                        lg += g[i]
                        lh += h[i]
                gain = lg * lg / (lh + 1) + (sg - lg) ** 2 / (sh - lh + 1) - sg * sg / (sh + 1)
                if gain > best[0]:
                    best = (gain, k, c)
        if best[1] is None:
            return leaf
        _, k, c = best
        return (k, c, grow([i for i in idx if rows[i][k] < c], g, h, depth - 1), grow([i for i in idx if rows[i][k] >= c], g, h, depth - 1))

    for _ in range(ROUNDS):
        p = [1 / (1 + math.exp(-x)) for x in f]
        tree = grow([*range(len(rows))], [y - q for y, q in zip(labels, p, strict=True)], [q * (1 - q) for q in p], 2)
        trees.append(tree)
        f = [x + walk(tree, r) for x, r in zip(f, rows, strict=True)]
    return trees


def walk(tree, row: dict[str, float]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree


def as_column(tree, x: dict[str, Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(x[tree[0]] < tree[1], as_column(tree[2], x)).otherwise(as_column(tree[3], x))


def calibrate(scores: list[float], labels: list[int]) -> tuple[float, float]:
    """Platt scaling: a and b of the probability 1 / (1 + exp(-(a * score + b)))."""
    a, b = 1.0, 0.0
    for _ in range(200):
        ga = gb = 0.0
        for s, y in zip(scores, labels, strict=True):
            d = y - 1 / (1 + math.exp(-max(-30.0, min(30.0, a * s + b))))
            ga += d * s
            gb += d
        a, b = a + 0.5 * ga / len(scores), b + 0.5 * gb / len(scores)
    return a, b


class Model:
    """Trees, calibration, and for each kind the least probability that was right often enough on the
    calibration part of the sample; ``accuracy``, ``precision`` and ``recall`` are those on the test part."""

    def __init__(self, spark: SparkSession, n: int = SAMPLE):
        lines = labelled(n)
        frame = spark.createDataFrame([(i, *x) for i, x in enumerate(lines)], "i int, kind string, m string, before string, y int")
        x = features(F.col("m"), F.col("before"))
        got = sorted(frame.select("i", *[c.alias(k) for k, c in x.items()]).collect(), key=lambda r: r.i)
        rows = [{k: r[k] for k in x} for r in got]
        y = [line[3] for line in lines]
        part = lambda xs, *which: [v for i, v in enumerate(xs) if i % 4 in which]
        self.trees = fit(part(rows, 0, 1), part(y, 0, 1))
        raw = lambda xs: [sum(walk(t, r) for t in self.trees) for r in xs]
        self.a, self.b = calibrate(raw(part(rows, 2)), part(y, 2))
        probable = lambda xs: [1 / (1 + math.exp(-(self.a * s + self.b))) for s in raw(xs)]
        self.least = {}
        for kind in OWN:
            own = sorted(((q, v) for q, v, line in zip(probable(part(rows, 2)), part(y, 2), part(lines, 2), strict=True) if line[0] == kind), reverse=True)
            self.least[kind], right = 1.1, 0
            for j, (q, v) in enumerate(own):
                right += v
                if right / (j + 1) >= PRECISION and q >= 0.5:
                    self.least[kind] = q
        said = [q >= self.least[line[0]] for q, line in zip(probable(part(rows, 3)), part(lines, 3), strict=True)]
        right = [*zip(said, part(y, 3), strict=True)]
        both = sum(a and b for a, b in right)
        self.accuracy = sum(a == bool(b) for a, b in right) / len(right)
        self.precision, self.recall = both / max(1, sum(said)), both / max(1, sum(part(y, 3)))

    def probability(self, m: Column, before: Column) -> Column:
        def score(x: Column) -> Column:
            total = F.lit(0.0)
            for tree in self.trees:
                total = total + as_column(tree, {k: x[k] for k in names})
            return 1 / (1 + F.exp(-(total * self.a + self.b)))

        named = features(m, before)
        names = list(named)
        # features are computed once
        return F.transform(F.array(F.struct(*[c.alias(k) for k, c in named.items()])), score)[0]


def find(docs: DataFrame, *, id: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """One row per document: its id and ``spans``, structs (start, end, kind, base, probability, m)
    ordered by start and kind."""
    model = model or Model(docs.sparkSession)
    t = F.col("_t")
    df = docs.select(F.col(f"`{id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    ranks = {k: r for r, k in enumerate([*KINDS, *OWN])}

    def row(x: Column, kind: str, base: bool, p: Column) -> Column:
        return F.struct(x["start"].alias("start"), F.lit(ranks[kind]).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(base).alias("base"), p.alias("probability"), x["m"].alias("m"))

    def certain(kind: str) -> Column:
        return F.transform(spans(t, *BASE[kind], keep=lambda m: valid(kind, m)), lambda x: row(x, kind, True, F.lit(1.0)))

    def proposed(kind: str) -> Column:
        scored = F.transform(spans(t, *OWN[kind]), lambda x: row(x, kind, False, model.probability(x["m"], x["before"])))
        return F.filter(scored, lambda x: x["probability"] >= model.least[kind])

    kind = "struct<start:int,rank:int,end:int,kind:string,base:boolean,probability:double,m:string>"
    df = df.select("doc_id", F.sort_array(F.flatten(F.array(*map(certain, KINDS), *map(proposed, OWN)))).cast(f"array<{kind}>").alias("all"))
    meets = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])
    better = lambda x, y: (y["probability"] > x["probability"]) | ((y["probability"] == x["probability"]) & (y["rank"] < x["rank"]))
    yields = lambda x, g: ~x["base"] & F.exists(g, lambda y: meets(x, y) & (y["base"] | better(x, y)))
    chosen = F.flatten(F.transform(touching(F.col("all"), kind), lambda g: F.filter(g, lambda x: ~yields(x, g))))
    return df.select("doc_id", chosen.alias("spans"))


def redact(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, x: F.when(x["start"] < a["at"], a).otherwise(F.struct(x["end"].alias("at"), F.concat(a["out"], F.substr(text, a["at"] + 1, x["start"] - a["at"]), F.lit("["), x["kind"], F.lit("]")).alias("out")))
    return F.aggregate(found, start, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [*map(count, KINDS)]
    return found.select("doc_id", *counts, F.size("spans").cast("long").alias("n_spans"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
