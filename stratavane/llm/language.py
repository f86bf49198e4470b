"""Language identification by fusing evidence.

A document's posterior combines

* the likelihood of its text under byte-trigram models of the languages, counted over all labelled rows and
  their whole texts (``learn``; ``fit`` is the same from a bounded, stratified sample, which no query takes);
* the language that its markup or metadata declares, weighed by how often each declared value went
  with each language over all documents;
* a prior from its host, smoothed hierarchically: the host's own text posteriors are mixed with its
  parent domain's, those with its address suffix's, and those with the whole corpus', each parent
  weighing as ``SMOOTHING`` documents.  A document's own posterior is left out of its host's count.

Counts are soft (sums of text posteriors) and cover all documents by grouped aggregation with partial
sums; a hot host's documents get the host's prior by broadcast.  Texts are read once and not
shuffled.

A document is rejected (language ``und``) if it has no letters, if even its best language explains
its letters no better than chance, or if no posterior reaches ``LEAST``.

Defined results: null and empty texts are ``und`` with posterior 0.  A null or empty declaration or host
is no evidence (the host level is then the suffix's, which is the corpus').  Repeated rows
each get a result; other columns are ignored, or kept by ``keep_identified``.  Without labelled rows
everything is ``und``.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratavane import storage
from stratavane.llm import _text as X
from stratavane.operators.skew import meet_groups

#: Labelled rows of a ``sample``, at most, and the longest text among them.
SAMPLE_DOCS, SAMPLE_CHARS = 1500, 20_000
#: Buckets of hashed trigrams, and the share of a trigram's evidence that counts (they overlap).
BUCKETS, TEMPER = 1 << 15, 1 / 3
#: Bytes of text whose trigrams are held at a time, and labels whose counts a task holds before it hands them on.
PIECE_BYTES, HELD_LABELS = 1 << 18, 64
SMOOTHING = 20.0
LEAST = 0.5
BROADCAST_ROWS = 1_000_000
LETTERS = X.byte_table((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_CLEAN = np.where(LETTERS, X.LOWER, np.uint8(32)).astype(np.uint8)


def trigrams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The texts in pieces of ``PIECE_BYTES``, whatever their lengths: a piece's first document, the buckets of its trigrams, and
    each of its documents' offsets in them. Every letter is the middle of a trigram; anything else, and a text's end, counts as a space."""
    data, off = X.buffers(texts)
    for lo in range(0, len(data), PIECE_BYTES):
        hi = min(lo + PIECE_BYTES, len(data))
        first, last = int(np.searchsorted(off, lo, "right")) - 1, int(np.searchsorted(off, hi))
        left, right = max(lo - 1, 0), min(hi + 1, len(data))
        text = np.full(hi - lo + 2, 32, np.uint8)
        text[left - lo + 1 : right - lo + 1] = _CLEAN[data[left:right]]
        before, own, after = text[:-2].copy(), text[1:-1], text[2:].copy()
        ends = off[first : last + 1] - lo
        before[ends[(ends >= 0) & (ends < hi - lo)]] = 32
        after[ends[(ends > 0) & (ends <= hi - lo)] - 1] = 32
        middle = np.flatnonzero(own != 32)
        code = before[middle].astype(np.uint64) << X.U(16) | own[middle].astype(np.uint64) << X.U(8) | after[middle]
        yield first, (code * X.K1 >> X.U(64 - 15)).astype(np.int64), np.searchsorted(middle, ends)


def counted(texts: pa.Array) -> np.ndarray:
    """How often each bucket's trigrams occur in the texts."""
    out = np.zeros(BUCKETS, np.int64)
    for _, bucket, _ in trigrams(texts):
        out += np.bincount(bucket, minlength=BUCKETS)
    return out


class TextModel:
    """Log probabilities of the buckets, one column per language, from rows (language, text)."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.languages = sorted({lang for lang, _ in rows})
        counts = np.zeros((BUCKETS, max(1, len(self.languages))))
        for k, lang in enumerate(self.languages):
            counts[:, k] = counted(pa.array([t for own, t in rows if own == lang], pa.large_string()))
        self._weigh(counts)

    @classmethod
    def of_counts(cls, counts: pa.Table) -> TextModel:
        """From the numbers ``n`` of the trigrams of each ``label`` and ``bucket``."""
        m = cls([])
        m.languages = sorted(counts.column("label").unique().to_pylist())
        at = {lang: k for k, lang in enumerate(m.languages)}
        table = np.zeros((BUCKETS, max(1, len(m.languages))))
        for batch in counts.to_batches():
            own = np.fromiter((at[x] for x in batch.column("label").to_pylist()), np.int64, len(batch))
            table[batch.column("bucket").to_numpy(), own] = batch.column("n").to_numpy()
        m._weigh(table)
        return m

    def _weigh(self, counts: np.ndarray) -> None:
        self.logs = np.log((counts + 0.1) / (counts.sum(0) + 0.1 * BUCKETS)).astype(np.float32)

    def score(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Log likelihoods of the texts, one column per language, and their numbers of trigrams."""
        out, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for first, bucket, off in trigrams(texts):
            own = slice(first, first + len(off) - 1)
            n[own] += np.diff(off)
            for k in range(len(self.languages)):
                c = np.concatenate([[0.0], np.cumsum(self.logs[:, k][bucket], dtype=np.float64)])
                out[own, k] += c[off[1:]] - c[off[:-1]]
        yield out, n


def quotas(counts: dict[str, int], size: int) -> dict[str, int]:
    """Equal shares of ``size`` rows; what small labels leave goes to the larger ones."""
    out = {}
    for k, label in enumerate(sorted(counts, key=lambda x: (counts[x], x))):
        out[label] = min(counts[label], (size - sum(out.values())) // (len(counts) - k))
    return out


def sample(docs: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "lang") -> list[tuple[str, str]]:
    """At most ``SAMPLE_DOCS`` labelled rows (label, text) of the whole table, dealt out among the labels
    by ``quotas``: of each label the rows with the lowest hashes of id and text.  Only beyond
    ``SAMPLE_DOCS`` labels the rarest get none.

    Rows below a hash that leaves each label a margin over its quota are ranked; a label that falls
    short all the same (equal rows share a hash) is asked again with a higher one."""
    h = F.shiftrightunsigned(F.xxhash64(X.named(id), X.named(text)), 11)  # 53 bits
    good = docs.where(F.length(X.named(text)) <= SAMPLE_CHARS).select(declared(X.named(label)).alias("label"), X.named(text).alias("text"), h.alias("h")).where("label <> ''")
    counts = {r.label: r.n for r in good.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(SAMPLE_DOCS).collect()}
    if not counts:
        return []
    quota = quotas(counts, SAMPLE_DOCS)
    share = {k: (q + 6 * q**0.5 + 20) / counts[k] for k, q in quota.items()}
    w = Window.partitionBy("label").orderBy("h")
    while True:
        cuts = docs.sparkSession.createDataFrame([(k, q, int(min(1.0, share[k]) * 2**53)) for k, q in quota.items()], "label string, quota int, cut long")
        ranked = good.join(F.broadcast(cuts), "label").where("h < cut").withColumn("rank", F.row_number().over(w)).where("rank <= quota")
        rows = [(r.label, r.text) for r in ranked.select("label", "text").collect()]
        got = Counter(k for k, _ in rows)
        short = [k for k, q in quota.items() if got[k] < q and share[k] < 1]
        if not short:
            return rows
        share |= {k: share[k] * 8 for k in short}


def fit(docs: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "lang") -> TextModel:
    """Text models from a bounded, stratified ``sample`` of the labelled rows, for a first look; the queries ``learn``."""
    return TextModel(sample(docs, id=id, text=text, label=label))


def _label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, text) to (label, bucket, n). A label's counts are added up within the task, those of ``HELD_LABELS`` at a time."""
    held: dict[str, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for label, n in held.items():
            at = np.flatnonzero(n)
            at = at if len(at) else np.zeros(1, np.int64)  # a label without trigrams is a language all the same
            yield pa.RecordBatch.from_arrays([pa.repeat(label, len(at)), pa.array(at, pa.int32()), pa.array(n[at])], ["label", "bucket", "n"])
        held.clear()

    for batch in batches:
        labels = batch.column("label").dictionary_encode()
        own = labels.indices.to_numpy()
        order = np.argsort(own, kind="stable")
        ends = np.searchsorted(own[order], np.arange(len(labels.dictionary) + 1))
        for k, label in enumerate(labels.dictionary.to_pylist()):
            if label not in held and len(held) >= HELD_LABELS:
                yield from out()
            n = counted(batch.column("text").take(pa.array(order[ends[k] : ends[k + 1]])))
            held[label] = held[label] + n if label in held else n
    yield from out()


def learn(docs: DataFrame, *, text: str = "text", label: str = "lang") -> TextModel:
    """Text models from every labelled row and its whole text: tasks count their rows' trigrams by label, and the counts, at most
    ``BUCKETS`` for each label, are summed by grouped aggregation. No text leaves its task."""
    X.bounded_batches(docs.sparkSession)
    rows = docs.select(declared(X.named(label)).alias("label"), X.named(text).alias("text")).where("label <> '' AND text IS NOT NULL")
    counts = rows.mapInArrow(X.lean(_label_counts), "label string, bucket int, n long")
    return TextModel.of_counts(counts.groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow())


def declared(value: Column) -> Column:
    """The primary subtag of a language tag."""
    return F.lower(F.regexp_extract(F.trim(value), "^([A-Za-z]{2,8})(?:[-_].*)?$", 1))


def page_evidence(pages: DataFrame, *, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Documents from raw pages: ``id``, ``text`` without markup, ``declared`` (the lang attribute of the
    html element) and ``host``."""
    body = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    return pages.select(
        F.col(id).alias("id"),
        body.alias("text"),
        F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1).alias("declared"),
        F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)).alias("host"),
    )


def identify(docs: DataFrame, model: TextModel, *, id: str = "doc_id", text: str = "text", declares: str | None = "lang", host: str | None = "source") -> DataFrame:
    """One row per document: ``id``, ``language`` (``und`` if rejected), ``posterior``, ``text_language``,
    ``declared`` and ``host``."""
    X.bounded_batches(docs.sparkSession)
    langs, n_lang = model.languages, len(model.languages)
    empty = F.lit("")
    rows = docs.select(
        F.col(f"`{id}`").alias("id"),
        F.col(f"`{text}`").alias("text"),
        (F.coalesce(declared(F.col(f"`{declares}`")), empty) if declares else empty).alias("declared"),
        (F.coalesce(F.lower(F.trim(F.col(f"`{host}`"))), empty) if host else empty).alias("host"),
    )
    shared = X.share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            at = 0
            for ll, n in m.score(batch.column("text")):
                part = batch.slice(at, len(n))
                at += len(n)
                best = ll.max(1) / np.maximum(n, 1) if n_lang else np.full(len(n), -np.inf)
                good = (n > 0) & (best > -np.log(BUCKETS))
                p = ll * TEMPER
                p = np.exp(p - p.max(1, keepdims=True)) if n_lang else p
                p = p / p.sum(1, keepdims=True) if n_lang else p
                p[~good] = 0
                flat = pa.array(p.ravel())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("declared"), part.column("host"), pa.array(good), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * n_lang, pa.int32()), flat)],
                    ["id", "declared", "host", "good", "p"],
                )

    kind = docs.schema[id].dataType.simpleString()
    scored = storage.stage(rows.mapInArrow(X.lean(run), f"id {kind}, declared string, host string, good boolean, p array<double>"), "scored")
    n = scored.count()
    p = lambda k: F.col("p")[k]
    totals = [F.sum(p(k)).alias(f"c{k}") for k in range(n_lang)] or [F.lit(0.0).alias("c0")]
    counted = lambda *keys: scored.groupBy(*keys).agg(*totals, F.count(F.lit(1)).alias("_n"))
    whole = counted().first() if n else None
    weights = [(whole[f"c{k}"] or 0.0) if whole else 0.0 for k in range(n_lang)]
    total = sum(weights) or 1.0
    corpus = [(w + 1) / (total + n_lang) for w in weights]

    # host, parent domain and suffix; a host without a dot has the corpus above it
    domain = F.regexp_extract("host", r"[^.]+\.[^.]+$", 0)
    suffix = F.regexp_extract("host", r"\.([^.]+)$", 1)
    hosts = storage.stage(counted("host"), "hosts").withColumn("domain", domain).withColumn("suffix", suffix)
    sums = [F.sum(f"c{k}").alias(f"c{k}") for k in range(n_lang)]

    def level(name: str) -> DataFrame:
        return hosts.where(F.col(name) != "").groupBy(name).agg(*sums, F.sum("_n").alias("_m"))

    def smoothed(above: list[Column], prefix: str) -> list[Column]:
        size = F.lit(SMOOTHING)
        for k in range(n_lang):
            size = size + F.coalesce(F.col(f"{prefix}{k}"), F.lit(0.0))
        return [(F.coalesce(F.col(f"{prefix}{k}"), F.lit(0.0)) + SMOOTHING * above[k]) / size for k in range(n_lang)]

    renamed = lambda df, name, prefix: df.select(name, *[F.col(f"c{k}").alias(f"{prefix}{k}") for k in range(n_lang)])
    above = smoothed([F.lit(x) for x in corpus], "s")
    above = smoothed(above, "d")
    prior = hosts.join(renamed(level("suffix"), "suffix", "s"), "suffix", "left").join(renamed(level("domain"), "domain", "d"), "domain", "left")
    prior = prior.select("host", F.array(*above).cast("array<double>").alias("above"), F.array(*[F.when(F.col("host") == "", 0.0).otherwise(F.col(f"c{k}")) for k in range(n_lang)]).cast("array<double>").alias("own"), F.col("_n").alias("_hn"))
    said = counted("declared").where("declared <> ''")
    # P(declared | language), up to a factor that all languages share
    said = said.select("declared", F.array(*[(F.col(f"c{k}") + corpus[k]) / (weights[k] + 1) for k in range(n_lang)]).cast("array<double>").alias("says"), F.col("_n").alias("_dn"))
    joined = meet_groups(scored, prior, ["host"], "_hn", max(1, n)).drop("_hn")
    joined = meet_groups(joined.where("declared <> ''"), said, ["declared"], "_dn", max(1, n)).drop("_dn").unionByName(joined.where("declared = ''").withColumn("says", F.lit(None).cast("array<double>")))
    if not n_lang:
        return scored.select("id", F.lit("und").alias("language"), F.lit(0.0).alias("posterior"), F.lit("und").alias("text_language"), "declared", "host")
    others = [F.col("own")[k] - F.when(F.col("host") == "", 0.0).otherwise(p(k)) for k in range(n_lang)]
    size = F.lit(SMOOTHING)
    for x in others:
        size = size + x
    fused = [F.greatest(p(k), F.lit(1e-300)) * (F.greatest(others[k], F.lit(0.0)) + SMOOTHING * F.col("above")[k]) / size * F.coalesce(F.col("says")[k], F.lit(1.0)) for k in range(n_lang)]
    ranked = lambda xs: F.array_max(F.array(*[F.struct(x.alias("p"), F.lit(lang).alias("lang")) for x, lang in zip(xs, langs, strict=True)]))
    out = joined.withColumn("best", ranked(fused)).withColumn("text_best", ranked([p(k) for k in range(n_lang)]))
    total_p = fused[0]
    for x in fused[1:]:
        total_p = total_p + x
    posterior = F.when(F.col("good"), F.col("best.p") / total_p).otherwise(0.0)
    return out.select(
        "id",
        F.when(posterior >= LEAST, F.col("best.lang")).otherwise("und").alias("language"),
        posterior.alias("posterior"),
        F.when(F.col("good"), F.col("text_best.lang")).otherwise("und").alias("text_language"),
        "declared",
        "host",
    )


def keep_identified(docs: DataFrame, model: TextModel | None = None, *, id: str = "doc_id", text: str = "text", declares: str | None = "lang", host: str | None = "source") -> DataFrame:
    """The documents that aren't rejected, with all their columns. Rows that agree in id, text,
    declaration and host share their fate, whatever else they hold."""
    model = model or learn(docs, text=text, label=declares)
    own, gone_ = f"key_{uuid.uuid4().hex}", f"gone_{uuid.uuid4().hex}"
    key = F.struct(F.col(f"`{id}`").alias("i"), F.xxhash64(F.col(f"`{text}`"), *[F.col(f"`{c}`") for c in (declares, host) if c]).alias("h"))
    named = docs.withColumn(own, key)
    found = identify(named, model, id=own, text=text, declares=declares, host=host)
    gone = storage.stage(found.where("language = 'und'").select(F.col("id").alias(gone_)).distinct(), "rejected")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return named.join(gone, (F.col(f"{own}.h") == F.col(f"{gone_}.h")) & F.col(f"{own}.i").eqNullSafe(F.col(f"{gone_}.i")), "left_anti").drop(own)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    found = identify(docs, learn(docs))
    return found.select(F.col("id").alias("doc_id"), "language", F.round("posterior", 6).alias("posterior"), "text_language", (F.col("language") != "und").alias("kept"))


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages by text, markup, host, domain and suffix, with the text models of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang")
    pages = page_evidence(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    found = identify(pages, learn(docs), id="id", declares="declared", host="host")
    return found.select(F.col("id").alias("page_id"), "language", F.round("posterior", 6).alias("posterior"), "text_language", "declared", "host")
