"""Language identification by Bayesian fusion of evidence.

log P(language | row) = text likelihood + P(declared language | language) + P(address suffix | language) + host prior. The text
model is fitted on a bounded sample of labelled rows; the tables of the other three are sums of text posteriors over all rows,
by declared language, suffix, host, and domain. A host's prior is smoothed towards its domain's, that towards all rows';
a row's own posterior is taken out of its host's sum.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from korpusmill.llm.skew import join_unique
from korpusmill.storage import Scratch

BUCKETS = 1 << 13
#: Of the text model: documents of each language, characters read of each document, languages of a dense table at most.
SAMPLE_DOCS, SAMPLE_CHARS, DENSE = 400, 20_000, 256
#: Weight of the text's log-likelihood (its 3-grams overlap), prior of a text in none of the languages, rows' worth of smoothing.
TEMPER, UNKNOWN, STRENGTH = 0.5, 0.01, 10.0
NONE = "und"
_MARKUP = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
_DECLARED = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b")
_PATH_LANGUAGE = re.compile(r"/([a-z]{2})(?:[/_-]|$)")


def grams(text: str) -> np.ndarray:
    """Buckets of the byte 3-grams of the lower-cased text, white space as one blank."""
    b = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode(), np.uint8).astype(np.uint32)
    return ((b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(13)) % np.uint32(BUCKETS)


class TextModel:
    """Smoothed log-probabilities of 3-grams by language; the last row is a text in none of them, with all 3-grams alike.

    Over ``DENSE`` languages they are kept as the value of an unseen 3-gram by language, and by 3-gram what those
    languages that have it are above that.
    """

    def __init__(self, languages: list[str], seen: list[tuple[np.ndarray, np.ndarray]]):
        """``seen``: of each language the buckets it has, in order, and their counts."""
        self.languages = [*languages, NONE]
        total = np.array([n.sum() for _, n in seen] or np.zeros(0), np.float64) + 0.2 * BUCKETS
        self.unseen = np.append(np.log(0.2 / total), -math.log(BUCKETS))
        above = [np.log((n + 0.2) / 0.2) for _, n in seen]
        self.table = None
        if len(languages) <= DENSE:
            self.table = np.repeat(self.unseen[:, None], BUCKETS, axis=1)
            for row, (b, _), x in zip(self.table, seen, above, strict=False):  # the last row has no counts
                row[b] += x
            return
        buckets = np.concatenate([b for b, _ in seen])
        order = np.argsort(buckets, kind="stable")
        self.start = np.searchsorted(buckets[order], np.arange(BUCKETS + 1))
        self.owner = np.repeat(np.arange(len(seen), dtype=np.int32), [len(b) for b, _ in seen])[order]
        self.above = np.concatenate(above)[order]

    def likelihood(self, text: str) -> np.ndarray:
        g = grams(text)
        if self.table is not None:
            return self.table @ np.bincount(g, minlength=BUCKETS) if len(g) > 512 else self.table[:, g].sum(axis=1)
        out = self.unseen * len(g)
        for b, n in zip(*(x.tolist() for x in np.unique(g, return_counts=True)), strict=True):
            lo, hi = self.start[b], self.start[b + 1]
            out[self.owner[lo:hi]] += n * self.above[lo:hi]  # a language has a bucket once
        return out


def _counted(sample: DataFrame) -> dict[str, np.ndarray]:
    """3-gram counts of (lang, text) rows by language, taken in tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = np.bincount(grams(text), minlength=BUCKETS)
                found[lang] = found[lang] + n if lang in found else n
        for lang, n in found.items():
            b = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([b.astype(np.int32).tobytes()], pa.binary()), pa.array([n[b].astype(np.int64).tobytes()], pa.binary())], names=["lang", "b", "n"])

    counts: dict[str, np.ndarray] = {}
    for r in sample.mapInArrow(count, "lang string, b binary, n binary").toLocalIterator():  # a language is in one task
        own = counts.setdefault(r.lang, np.zeros(BUCKETS, np.int64))
        own[np.frombuffer(r.b, np.int32)] += np.frombuffer(r.n, np.int64)
    return counts


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> TextModel:
    """From the first ``SAMPLE_CHARS`` characters of up to ``sample_docs`` rows, first by a hash of id and text, of every label; null labels and texts without a letter are left out.

    Labels are counted without their texts, which are read once; only labels of which the sample caught no text with a
    letter are looked for again. Rows of one label that are alike in id and text are one, so no id, null included, brings
    more rows into the sample than it has texts.
    """
    spark = docs.sparkSession
    known = docs.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("key"), F.col(text_col).alias("text")).where("lang IS NOT NULL")
    share = F.least(F.lit(1.0), 4.0 * sample_docs / F.count(F.lit(1))) * (1 << 30)
    bounds = [tuple(r) for r in known.groupBy("lang").agg(share).collect()]  # a row per label
    if not bounds:
        return TextModel([], [])
    small = spark.createDataFrame(bounds, "lang string, bound double")
    lettered = known.where(F.col("text").rlike(r"\p{L}")).withColumn("hash", F.xxhash64("key", "text"))
    rows = lettered.join(F.broadcast(small), "lang").where(F.pmod("hash", F.lit(1 << 30)) < F.col("bound"))
    rows = rows.select("lang", "hash", F.substring("text", 1, SAMPLE_CHARS).alias("text")).dropDuplicates(["lang", "hash"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    counts = _counted(rows.withColumn("nth", nth).where(F.col("nth") <= sample_docs).select("lang", "text"))
    if missing := [(x,) for x, *_ in bounds if x not in counts]:
        again = lettered.join(F.broadcast(spark.createDataFrame(missing, "lang string")), "lang")
        counts |= _counted(again.groupBy("lang").agg(F.min_by(F.substring("text", 1, SAMPLE_CHARS), F.col("hash")).alias("text")))
    languages = sorted(counts)
    return TextModel(languages, [(b := np.flatnonzero(counts[x]), counts[x][b]) for x in languages])


def address(url: str | None) -> tuple[str | None, str | None, str | None]:
    """Host, domain (its last two labels) and suffix (language segment of the path, else last label) of an address."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").rstrip(".").lower()
    except ValueError:
        return None, None, None
    if not host:
        return None, None, None
    m = _PATH_LANGUAGE.match(parts.path.lower())
    return host, ".".join(host.split(".")[-2:]), "/" + m[1] if m else "." + host.rsplit(".", 1)[-1]


def _normal(logs: np.ndarray) -> np.ndarray:
    """Probabilities of rows of log-weights."""
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def start(languages: list[str]) -> np.ndarray:
    """Prior before any row is seen; the last of ``languages`` is none of them."""
    return np.array([UNKNOWN if x == NONE else (1 - UNKNOWN) / max(len(languages) - 1, 1) for x in languages])


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


SCORED = "text_score array<double>, own array<double>, letters boolean, declared string, suffix string, host string, domain string"


def scored(rows: DataFrame, model: TextModel, keys: list[str]) -> DataFrame:
    """Evidence of rows (keys, text, url, source, markup): with ``markup`` the tags go and the declared language is read; without url, ``source`` is the host.

    ``text_score``: weighted log-likelihoods; ``own``: posterior by the text alone, of texts without a letter zero. Keys may name columns that
    are read as evidence.
    """
    evidence = ("text", "url", "source", "markup")
    inputs = [*keys, *(c for c in evidence if c not in keys)]
    at = [inputs.index(c) for c in evidence]
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        prior = np.log(start(own.languages))
        for batch in batches:
            score, columns = np.zeros((batch.num_rows, len(own.languages))), [[] for _ in range(5)]
            for i in range(batch.num_rows):
                text, url, source, markup = (batch.column(k)[i].as_py() for k in at)
                text, declared = text or "", None
                if markup:
                    m = _DECLARED.search(text)
                    declared, text = (m[1].lower() if m else None), unescape(_MARKUP.sub(" ", text))
                host, domain, suffix = address(url)
                if url is None:
                    host = domain = source
                if letters := any(map(str.isalpha, text)):
                    score[i] = own.likelihood(text)
                for c, v in zip(columns, (letters, declared, suffix, host, domain), strict=True):
                    c.append(v)
            score *= TEMPER
            alone = _normal(score + prior) * np.array(columns[0], float).reshape(-1, 1)
            made = [_lists(score), _lists(alone), pa.array(columns[0], pa.bool_()), *(pa.array(c, pa.string()) for c in columns[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), *made], names=[*keys, *(x.split()[0] for x in SCORED.split(", "))])

    return rows.select(*inputs).mapInArrow(run, f"{kinds}, {SCORED}")


def _filled(column: pa.Array, default: np.ndarray) -> np.ndarray:
    """Rows of lists of one length as a matrix, null lists as ``default``."""
    out = np.tile(default, (len(column), 1))
    some = column.is_valid().to_numpy(zero_copy_only=False)
    out[some] = column.drop_null().flatten().to_numpy().reshape(-1, len(default))
    return out


def fuse(evidence: DataFrame, languages: list[str], keys: list[str], scratch: Scratch) -> DataFrame:
    """(keys, lang, confidence, accepted) from a saved table of ``scored`` rows; see ``identify``.

    Sums of posteriors are aggregates that combine before their shuffle; a host or suffix that holds most rows is joined
    by broadcast (``join_unique``).
    """
    size, wide = len(languages), 16 * len(languages) + 100

    def sums(rows: DataFrame, by: str, column: str, *more: Column) -> DataFrame:
        return rows.groupBy(by).agg(F.array(*[F.sum(F.col(column)[i]) for i in range(size)]).alias(f"{by}_n"), *more)

    hosts = scratch.save(sums(evidence, "host", "own", F.min("domain").alias("domain"), F.count(F.lit(1)).alias("rows")), "hosts")  # rows without a host are one of these
    overall = hosts.agg(*[F.coalesce(F.sum(F.col("host_n")[i]), F.lit(0.0)) for i in range(size)]).first()
    total = sum(overall)
    base_ = (np.array(overall) + STRENGTH * start(languages)) / (total + STRENGTH)
    base, all_n = (F.array(*[F.lit(float(x)) for x in v]) for v in (base_, overall))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    domains = sums(hosts.where("domain IS NOT NULL"), "domain", "host_n", F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("hosts")).withColumn("all", add("domain_n"))
    smooth = F.zip_with("domain_n", base, lambda a, b: (a + STRENGTH * b) / (F.col("all") + STRENGTH))
    domains = scratch.save(domains.select("domain", smooth.alias("towards"), "hosts"), "domains")
    named = scratch.save(hosts.where("host IS NOT NULL"), "named-hosts")
    hosts = scratch.save(join_unique(named, domains, ["domain"], "hosts", "left", wide).select("host", "host_n", F.coalesce("towards", base).alias("towards"), "rows"), "priors")
    # P(value | language) of declared languages and suffixes, smoothed by STRENGTH rows at the value's share in all rows
    out, saved = evidence, {}
    for by in ("declared", "suffix"):
        counts = sums(evidence.where(F.col(by).isNotNull()), by, "own", F.count(F.lit(1)).alias("rows")).withColumn("share", add(f"{by}_n") / max(total, 1e-9))
        logs = F.zip_with(f"{by}_n", all_n, lambda a, b: F.log((a + STRENGTH * F.col("share")) / (b + STRENGTH)))
        saved[by] = scratch.save(counts.select(by, logs.alias(f"{by}_log"), "rows"), by)
    out = join_unique(out, hosts, ["host"], "rows", "left", wide)
    out = join_unique(out, saved["declared"], ["declared"], "rows", "left", wide)
    out = join_unique(out, saved["suffix"], ["suffix"], "rows", "left", wide)
    kinds = ", ".join(f"`{k}` {evidence.schema[k].dataType.simpleString()}" for k in keys)
    zero = np.zeros(size)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = len(keys)
            letters = batch.column(n).to_numpy(zero_copy_only=False)
            score, own, counts, declared, suffix = (_filled(batch.column(n + k), zero) for k in (1, 2, 3, 5, 6))
            towards = _filled(batch.column(n + 4), base_)
            counts = np.maximum(counts - own, 0)  # without the row itself; 0 at no host, which leaves the base
            prior = (counts + STRENGTH * towards) / (counts.sum(axis=1, keepdims=True) + STRENGTH)
            p = _normal(score + np.log(np.maximum(prior, 1e-9)) + declared + suffix)
            best = p.argmax(axis=1)
            lang = [languages[b] if ok else NONE for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            top = p[np.arange(len(p)), best]
            accepted = (np.array(lang, object) != NONE) & (top >= 0.5)
            made = [pa.array(lang, pa.string()), pa.array(np.round(top, 6)), pa.array(accepted.astype(bool))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), *made], names=[*keys, "lang", "confidence", "accepted"])

    wanted = out.select(*keys, "letters", "text_score", "own", "host_n", "towards", "declared_log", "suffix_log")
    return wanted.mapInArrow(decide, f"{kinds}, lang string, confidence double, accepted boolean")


def identify(rows: DataFrame, model: TextModel, keys: list[str]) -> DataFrame:
    """(keys, lang, confidence, accepted) of every row (keys, text, url, source, markup).

    A row is accepted if one of the languages has at least half of the posterior. Texts without a letter (null, empty, digits) are
    ``und`` and not accepted. Null urls, sources and undeclared languages leave that evidence out; rows with null or
    repeated keys are rows like others; of languages that are alike the first by name is taken. An empty table gives an
    empty result. Columns other than these are not read.

    Keys go with their row, so a caller that wants whole rows names all their columns and needs no join afterwards. Names of
    what is added (``lang``, ``confidence``, ``accepted`` and those in ``SCORED``) can't be keys.
    """
    if taken := {"lang", "confidence", "accepted", "host_n", "towards", "declared_log", "suffix_log", *(x.split()[0] for x in SCORED.split(", "))} & set(keys):
        raise ValueError(f"keys can't be named {sorted(taken)}")
    scratch = Scratch(rows.sparkSession, "language")
    return fuse(scratch.save(scored(rows, model, keys), "evidence"), model.languages, keys, scratch)
