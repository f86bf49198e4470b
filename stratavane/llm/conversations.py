"""Repairing the structure of conversations at least cost.

Turns carry fault flags (blank, a repetition of an earlier turn, truncated).  A conversation is then edited so that its roles read
``(s?(ua)+)?`` in initials: Keep costs 0, Rerole to user or assistant 2, Delete 3 (blank and repeated turns must go), Insert an empty
turn of user or assistant 2, and a truncated turn that stays 1 more.  An ``aggregate`` over the sorted turn structs carries four
(cost, audit) structs, one for each state of the pattern (nothing yet, after system, after user, after assistant), each the least of what
leads to it: the cheapest edits, and among equally cheap ones the audit (the edits' initials) that is first in ASCII.

No fold sees more than ``SEGMENT`` turns.  Longer conversations are dealt out by range of their order and folded in segments, from each of the
four states; what a segment does to the states is again four (cost, audit) structs for each, and segments are put together ``FAN`` at a time.
Texts stay where they are meanwhile: turns go by digests, and only what is kept meets its text again, to be read in order.

Defined results: turns of a conversation are taken by turn (null first); those of equal turn by role, the first 64 characters of
the text, then its digest.  Null roles and texts are one space; a null conversation is one of its own.  Equal rows (same turn, role and text)
are repetitions of each other.  A conversation's audit and the digest of its text are one value each, however long it is: the audit is
put together in one row, the digest by one task that reads the turns as a stream.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratavane import storage
from stratavane.llm import _text
from stratavane.operators import ordered

#: Distinct turns that are folded at once, and segments that are put together at once.
SEGMENT, FAN = 256, 64
SPACE, STOPS = " \t\n\x0b\x0c\r", ".!?"
LEGAL = ("su", "ua", "au")
_STATES = range(4)


def tagged(column: Column) -> Column:
    """A conversation's or turn's id as a string that is never null."""
    return F.coalesce(F.concat(F.lit("+"), column.cast("string")), F.lit("-"))


def _rows(turns: DataFrame) -> DataFrame:
    """turns (tag, turn, role, text, copies): one row for each distinct one with its number ``n``, digests for its text, and flags: ``live`` if the
    first of the n isn't blank and no repetition, ``blank``, ``cut``."""
    text = F.rtrim(F.col("text"), F.lit(SPACE))
    digest = lambda *parts: F.unhex(F.sha2(F.concat_ws(":", *parts), 256))
    same = digest(F.length("tag"), "tag", F.length("role"), "role", F.sha2("text", 256))
    slim = turns.select("tag", "turn", tagged(F.col("turn")).alias("at"), "role", F.substring("text", 1, 64).alias("head"), same.alias("same"), (F.trim(F.col("text"), F.lit(SPACE)) == "").alias("blank"), (~F.substring(text, -1, 1).isin(*STOPS)).alias("cut"), "copies")
    rows = slim.groupBy("tag", "turn", "at", "role", "head", "same", "blank", "cut").agg(F.sum("copies").alias("n"))
    first = rows.groupBy("same").agg(F.min(F.struct("turn", "at")).alias("f")).select("same", F.col("f.at").alias("at"), F.lit(True).alias("first"))
    live = ~F.col("blank") & F.col("first").isNotNull()
    return rows.join(first, ["same", "at"], "left").withColumn("live", live).drop("first")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _add(way: Column, cost, edits) -> Column:
    return F.when(way.isNotNull(), F.struct((way["c"] + cost).alias("c"), F.concat(way["a"], edits).alias("a")))


def _step(s: Column, r: Column) -> Column:
    """The four ways after one more turn (and its ``more`` repetitions, which are deleted).  Insertions come right before a turn that stays,
    since behind deletions they make the audit smaller."""
    one = F.lit(1)
    stay = lambda way, role: _add(way, F.when(r["i"] == role, r["cut"]).otherwise(r["cut"] + 2), F.when(r["i"] == role, F.lit("K")).otherwise(F.lit("R")))
    gone = lambda way: _add(way, 3, F.lit("D"))
    to_user = F.least(s["s0"], s["s1"], s["s3"], _add(s["s2"], 2, F.lit("I")))
    to_assistant = F.least(s["s2"], _add(F.least(s["s0"], s["s1"], s["s3"]), 2, F.lit("I")))
    now = [
        gone(s["s0"]),
        F.least(gone(s["s1"]), F.when(r["i"] == "s", _add(s["s0"], r["cut"], F.lit("K")))),
        F.least(gone(s["s2"]), _let(to_user, lambda way: stay(way, "u"))),
        F.least(gone(s["s3"]), _let(to_assistant, lambda way: stay(way, "a"))),
    ]
    new = F.struct(*[F.when(r["live"], now[k]).otherwise(s[f"s{k}"]).alias(f"s{k}") for k in _STATES])
    more = r["n"] - F.when(r["live"], one).otherwise(0)
    deleted = lambda x: F.struct(*[_add(x[f"s{k}"], 3 * more, F.repeat(F.lit("D"), more.cast("int"))).alias(f"s{k}") for k in _STATES])
    return _let(new, lambda x: F.when(more > 0, deleted(x)).otherwise(x))


def _legal(a: Column, b: Column) -> Column:
    return F.concat(a, b).isin(*LEGAL)


def segments(rows: DataFrame) -> DataFrame:
    """One row per segment of a conversation: ``k``, its number, ``rows``, its turns in order, ``m``, the ways from each state (only from the first one at
    a conversation's beginning) to each, and the role initials at its ends with the number of illegal pairs between."""
    order = ["turn", "role", "head", "same"]
    dealt = ordered.carry(ordered.dealt(rows, ["tag"], order), ["tag"], {"_before": (F.sum, F.lit(1))})
    place = F.row_number().over(Window.partitionBy("_part", "tag").orderBy(*order)) - 1
    turn = F.struct(*order, "at", F.substring("role", 1, 1).alias("i"), "n", "live", F.col("cut").cast("int").alias("cut"))
    d = dealt.withColumn("_block", F.floor(place / SEGMENT)).groupBy("_part", "tag", "_block").agg(F.sort_array(F.collect_list(turn)).alias("rows"), F.max("_before").alias("_before"))
    none = F.lit(None).cast("struct<c:bigint,a:string>")
    here = F.struct(F.lit(0).cast("bigint").alias("c"), F.lit("").alias("a"))
    starts = [F.struct(*[(here if k == at else none).alias(f"s{k}") for k in _STATES]) for at in _STATES]
    begins = F.col("_before").isNull() & (F.col("_block") == 0)
    ways = F.aggregate("rows", F.when(begins, F.array(starts[0])).otherwise(F.array(*starts)), lambda acc, r: F.transform(acc, lambda s: _step(s, r)))
    lift = lambda way, k: F.when(way.isNotNull(), F.struct(way["c"].alias("c"), way["a"].alias("a"), F.array(F.lit(k)).alias("p")))
    m = F.transform(ways, lambda s: F.struct(*[lift(s[f"s{k}"], k).alias(f"s{k}") for k in _STATES]))
    pairs = F.filter(F.transform(F.sequence(F.lit(1), F.size("rows")), lambda j: (j > 1) & ~_legal(F.get("rows", j - 2)["i"], F.get("rows", j - 1)["i"])), lambda bad: bad)
    repeats = F.aggregate("rows", F.lit(0).cast("bigint"), lambda n, r: n + r["n"] - 1)
    d = storage.stage(d.select("tag", "_part", "_block", "rows", m.alias("m"), F.get("rows", F.lit(0))["i"].alias("i0"), F.element_at("rows", -1)["i"].alias("i1"), (F.size(pairs) + repeats).alias("illegal")), "segments")
    # one small row per SEGMENT turns
    k = F.row_number().over(Window.partitionBy("tag").orderBy("_part", "_block")) - 1
    return d.join(d.select("tag", "_part", "_block", k.alias("k")), ["tag", "_part", "_block"]).drop("_part", "_block")


def joined(parts: DataFrame) -> DataFrame:
    """Segments (tag, k, m, i0, i1, illegal) put together until there is one per conversation."""
    parts = parts.select("tag", "k", "m", "i0", "i1", "illegal")
    follow = lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.struct((x["c"] + y["c"]).alias("c"), F.concat(x["a"], y["a"]).alias("a"), F.concat(x["p"], y["p"]).alias("p")))
    through = lambda s, m: F.struct(*[F.least(*[follow(s[f"s{x}"], F.get(m, F.lit(x))[f"s{k}"]) for x in _STATES]).alias(f"s{k}") for k in _STATES])
    last = parts.agg(F.max("k")).first()[0] or 0
    while last:
        groups = parts.groupBy("tag", F.floor(F.col("k") / FAN).alias("k")).agg(F.sort_array(F.collect_list(F.struct("k", "m", "i0", "i1", "illegal"))).alias("g"))
        step = lambda a, b: F.struct(F.transform(a["m"], lambda s: through(s, b["m"])).alias("m"), a["i0"].alias("i0"), b["i1"].alias("i1"), (a["illegal"] + b["illegal"] + F.when(_legal(a["i1"], b["i0"]), 0).otherwise(1)).alias("illegal"))
        begin = F.get("g", F.lit(0))
        one = F.aggregate(F.slice("g", F.lit(2), F.size("g")), F.struct(begin["m"].alias("m"), begin["i0"].alias("i0"), begin["i1"].alias("i1"), begin["illegal"].alias("illegal")), step)
        parts, last = storage.stage(groups.select("tag", "k", one.alias("x")).select("tag", "k", "x.*"), "joined"), last // FAN
    return parts


def _finished(parts: DataFrame) -> DataFrame:
    """tag, cost, audit, illegal, and ``p``, the state behind each segment."""
    more = lambda way, cost, edits: F.when(way.isNotNull(), F.struct((way["c"] + cost).alias("c"), F.concat(way["a"], F.lit(edits)).alias("a"), way["p"].alias("p")))
    best = F.least(*[more(F.get("m", F.lit(0))[f"s{k}"], cost, edits) for k, cost, edits in ((0, 0, ""), (3, 0, ""), (2, 2, "I"), (1, 4, "II"))])
    return parts.select("tag", "illegal", best.alias("b")).select("tag", F.col("b.c").alias("cost"), F.col("b.a").alias("audit"), "illegal", "b.p")


def _pieces(parts: DataFrame, best: DataFrame) -> DataFrame:
    """The turns that the cheapest edits leave: tag, k, o (order), role, and same and at of the row they come from (null for inserted ones)."""
    behind = F.transform("p", lambda e, j: F.struct(j.cast("bigint").alias("k"), F.when(j > 0, F.get("p", j - 1)).otherwise(0).alias("start"), e.alias("end"), (j == F.size("p") - 1).alias("ends")))
    path = best.select("tag", F.explode(behind).alias("s")).select("tag", "s.*")
    way = lambda k: F.get("m", F.col("start"))[f"s{k}"]["a"]
    audit = F.coalesce(*[F.when(F.col("end") == k, way(k)) for k in _STATES])
    rest = F.when(F.col("ends") & (F.col("end") == 2), "I").when(F.col("ends") & (F.col("end") == 1), "II").otherwise("")
    # one token for each row: I?[KR] or D, and what is inserted at the end
    tokens = F.regexp_extract_all(F.concat(audit, rest), F.lit("I?[KR]|D|I+$"), F.lit(0))
    d = parts.join(path, ["tag", "k"]).select("tag", "k", "rows", tokens.alias("t"), (F.col("start") == 2).cast("int").alias("next"))
    role = lambda next_: F.when(next_ == 1, "assistant").otherwise("user")
    item = lambda r, same, at: F.struct(r.alias("role"), same.alias("same"), at.alias("at"))
    void = F.array().cast("array<struct<role:string,same:binary,at:string>>")
    added = lambda next_: item(role(next_), F.lit(None).cast("binary"), F.lit(None).cast("string"))

    def step(a: Column, r: Column) -> Column:
        token = F.get("t", a["pos"])
        put, act = token.startswith("I"), F.substring(token, -1, 1)
        then = F.when(put, 1 - a["next"]).otherwise(a["next"])
        stays = F.when(act == "K", F.array(item(r["role"], r["same"], r["at"]))).when(act == "R", F.array(item(role(then), r["same"], r["at"]))).otherwise(void)
        after = F.when(act == "D", a["next"]).when((act == "K") & (r["i"] == "s"), then).otherwise(1 - then)
        return F.struct((a["pos"] + r["n"].cast("int")).alias("pos"), after.alias("next"), F.concat(a["out"], F.when(put, F.array(added(a["next"]))).otherwise(void), stays).alias("out"))

    def finish(a: Column) -> Column:
        token = F.coalesce(F.get("t", a["pos"]), F.lit(""))
        return F.concat(a["out"], F.when(F.length(token) > 0, F.array(added(a["next"]))).otherwise(void), F.when(F.length(token) > 1, F.array(added(1 - a["next"]))).otherwise(void))

    start = F.struct(F.lit(0).alias("pos"), F.col("next").alias("next"), void.alias("out"))
    return d.select("tag", "k", F.posexplode(F.aggregate("rows", start, step, finish)).alias("o", "x")).select("tag", "k", "o", "x.*")


def repair(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Per conversation (tag; conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), and the repaired turns (tag, k, o, role,
    text; in order of k and o).  ``copies`` names a column that says how often a row is repeated."""
    col = lambda name: F.col(f"`{name}`")
    said = lambda name: F.coalesce(col(name).cast("string"), F.lit(" "))
    ids = turns.select(col(conversation).alias("conv_id"), tagged(col(conversation)).alias("tag"), col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"), (F.lit(1) if copies is None else col(copies)).cast("bigint").alias("copies"))
    rows = storage.stage(_rows(ids), "turns")
    faults = rows.groupBy("tag").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("bigint").alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - F.col("live").cast("int"))).alias("duplicate"),
        F.sum((F.col("live") & F.col("cut")).cast("bigint")).alias("truncated"),
    )
    parts = storage.stage(segments(rows), "parts")
    best = storage.stage(_finished(joined(parts)), "best")
    pieces = storage.stage(_pieces(parts, best), "pieces")
    texts = ids.select("tag", "turn", "role", "text").withColumns({"at": tagged(F.col("turn")), "same": F.unhex(F.sha2(F.concat_ws(":", F.length("tag"), "tag", F.length("role"), "role", F.sha2("text", 256)), 256))})
    texts = texts.groupBy("same", "at").agg(F.min("text").alias("text"))
    kept = pieces.where("same IS NOT NULL").join(texts, ["same", "at"]).select("tag", "k", "o", "role", "text")
    repaired = kept.unionByName(pieces.where("same IS NULL").select("tag", "k", "o", "role", F.lit("").alias("text")))
    names = ids.select("tag", "conv_id").distinct()
    return names.join(faults, "tag").join(best.drop("p"), "tag"), repaired


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (tag, role, text) rows to one digest per tag, whatever batches they come in."""
    tag, h, out = None, None, []
    for batch in batches:
        for t, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if t != tag:
                if h is not None:
                    out.append((tag, h.hexdigest()))
                tag, h = t, hashlib.sha256(line.encode())
            else:
                h.update(b"\n")
                h.update(line.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out]), pa.array([x for _, x in out])], ["tag", "sha"])
            out = []
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([tag]), pa.array([h.hexdigest()])], ["tag", "sha"])


def text_digests(repaired: DataFrame) -> DataFrame:
    """tag, sha: SHA-256 of a conversation's ``role:text`` lines, read in order as a stream."""
    _text.bounded_batches(repaired.sparkSession)
    lines = repaired.repartition("tag").sortWithinPartitions("tag", "k", "o").select("tag", F.concat_ws(":", "role", "text").alias("line"))
    return lines.mapInArrow(_digests, "tag string, sha string")


def damaged(turns: DataFrame) -> DataFrame:
    """conversations with faults planted by crc32(``conv_id:turn``) % 20."""
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    d = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), code.alias("code")).where("code <> 0")
    return d.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("code") == 3, 2).otherwise(1).alias("copies"))


def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    done, repaired = repair(damaged(turns), copies="copies")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    all_ = turns.select("conv_id", tagged(F.col("conv_id")).alias("tag")).distinct()
    out = all_.join(done.drop("conv_id"), "tag", "left").join(text_digests(repaired), "tag", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
