"""Retrieval metrics and latency."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUTS, MRR_CUT, DIGITS = (1, 5, 10, 20), 10, 4
#: Numbers up to which percentiles are the built-in aggregate's, and bits that a pass narrows beyond.
BUFFER_ROWS, DIGIT_BITS = 1_000_000, 13


def first_hits(ranked: DataFrame, truth: DataFrame, doc_col: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, query_id, first_hit) of every query of ``truth`` (by, query_id, doc): rank of its first true document, else null."""
    keys = [*by, "query_id", doc_col]
    return truth.select(*keys).distinct().join(ranked.select(*keys, "rank"), keys, "left").groupBy(*by, "query_id").agg(F.min("rank").alias("first_hit"))


def _measures(cuts: tuple[int, ...], mrr_cut: int) -> list[Column]:
    hit = F.col("first_hit")
    recalls = [F.round(F.avg(F.coalesce(hit <= k, F.lit(False)).cast("double")), DIGITS).alias(f"recall@{k}") for k in cuts]
    mrr = F.round(F.avg(F.when(hit <= mrr_cut, 1.0 / hit).otherwise(0.0)), DIGITS).alias(f"mrr@{mrr_cut}")
    return [F.count(F.lit(1)).alias("queries"), *recalls, mrr]


def metrics(ranked: DataFrame, truth: DataFrame, doc_col: str, cuts: tuple[int, ...] = CUTS, mrr_cut: int = MRR_CUT) -> DataFrame:
    """One row: queries, recall@k (share of queries with a true document in the first k), mrr@k. Without queries the metrics are null.

    ``truth`` has a row per query and true document; a query that nothing was found for counts as a miss.
    """
    return first_hits(ranked, truth, doc_col).agg(*_measures(cuts, mrr_cut))


def compare(methods: dict[str, DataFrame], truth: DataFrame, doc_col: str, cuts: tuple[int, ...] = CUTS, mrr_cut: int = MRR_CUT) -> DataFrame:
    """A row of ``metrics`` per method, by one aggregate over all rankings; without queries there are no rows."""
    rows = [r.select(F.lit(name).alias("method"), "query_id", doc_col, "rank") for name, r in methods.items()]
    each = truth.select(F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"), "query_id", doc_col)
    return first_hits(reduce(DataFrame.unionByName, rows), each, doc_col, ("method",)).groupBy("method").agg(*_measures(cuts, mrr_cut))


def label_metrics(
    ranked: DataFrame, queries: DataFrame, corpus: DataFrame, id_col: str, doc_col: str, label: str = "label", cuts: tuple[int, ...] = CUTS, mrr_cut: int = MRR_CUT
) -> DataFrame:
    """One row as ``metrics`` gives: the true documents of a query (query_id, label) are those with a row of its label, other than the query's own.

    Queries times true documents grow with the square of the corpus, so they are not listed: of a label its least and largest id tell whether a query has any, and the ranked documents alone are looked up.
    """
    least = (F.min(id_col).alias("lo"), F.max(id_col).alias("hi"))
    other = (F.col("lo") != F.col("query_id")) | (F.col("hi") != F.col("query_id"))
    own, rows = queries.select("query_id", label), corpus.select(id_col, doc_col, label)
    asked = own.join(rows.groupBy(label).agg(*least), label).where(other).select("query_id").distinct()
    found = ranked.select("query_id", doc_col, "rank").join(own, "query_id").join(rows.groupBy(label, doc_col).agg(*least), [label, doc_col]).where(other)
    return asked.join(found.groupBy("query_id").agg(F.min("rank").alias("first_hit")), "query_id", "left").agg(*_measures(cuts, mrr_cut))


def explode_truth(queries: DataFrame, doc_col: str = "case_no") -> DataFrame:
    """(query_id, doc) of a query set's ``case_ids``."""
    return queries.select("query_id", F.explode("case_ids").alias(doc_col))


def _ordered(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 to 2^64 - 1 in the order of doubles; NaN comes last, as in Spark, and -0.0 is 0.0."""
    x = np.where(np.isnan(x), np.nan, x + 0.0)
    bits = x.view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _double(key: int) -> float:
    bits = key & ~(1 << 63) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _digit_counts(x: DataFrame, prefixes: list[int], above: int, bits: int) -> list:
    """Rows (prefix, digit, n) of the numbers whose leading ``above`` bits are one of the prefixes, by their next bits; at most 2^bits a prefix."""
    held = np.array(prefixes, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(held), 1 << bits), np.int64)
        for batch in batches:
            keys = _ordered(batch.column(0).to_numpy(zero_copy_only=False))
            lead = keys >> np.uint64(64 - above) if above else np.zeros(len(keys), np.uint64)
            at = np.minimum(np.searchsorted(held, lead), len(held) - 1)
            own = held[at] == lead
            digit = (keys[own] >> np.uint64(64 - above - bits)) & np.uint64((1 << bits) - 1)
            counts += np.bincount(at[own] << bits | digit.astype(np.int64), minlength=counts.size).reshape(counts.shape)
        p, d = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"prefix": pa.array(p, pa.int32()), "digit": pa.array(d, pa.int32()), "n": pa.array(counts[p, d])})

    return x.mapInArrow(run, "prefix int, digit int, n long").groupBy("prefix", "digit").agg(F.sum("n").alias("n")).orderBy("prefix", "digit").collect()


def _at_ranks(x: DataFrame, ranks: set[int]) -> dict[int, float]:
    """The numbers at places from 0 of a column's order, narrowed ``DIGIT_BITS`` bits at a time, all places in one pass."""
    lead, before, above = dict.fromkeys(ranks, 0), dict.fromkeys(ranks, 0), 0
    while above < 64:
        bits, prefixes = min(DIGIT_BITS, 64 - above), sorted(set(lead.values()))
        rows = _digit_counts(x, prefixes, above, bits)
        for r in ranks:
            own = prefixes.index(lead[r])
            for _, digit, n in (f for f in rows if f.prefix == own):
                if r < before[r] + n:
                    lead[r] = lead[r] << bits | digit
                    break
                before[r] += n
        above += bits
    return {r: _double(k) for r, k in lead.items()}


def _between(lo: float, hi: float, t: float) -> float:
    if lo == hi or t == 0:
        return lo
    return lo + (hi - lo) * t if math.isfinite(hi - lo) else lo * (1 - t) + hi * t


def percentiles(rows: DataFrame, col: str, shares: list[float], n: int | None = None) -> list[float | None]:
    """Exact percentiles, linear between neighbours, of the numbers in a column; nulls are left out, NaN is larger than all, of no numbers they are null.

    Up to ``BUFFER_ROWS`` numbers (``n`` of them, if it is known) take the built-in aggregate, which holds all distinct ones in one task. More are narrowed
    down on whole numbers in the order of the doubles' bits, so the number of passes does not depend on the numbers.
    """
    x = rows.select(F.col(col).cast("double").alias("x")).where("x IS NOT NULL")
    n = x.count() if n is None else n
    if not n:
        return [None] * len(shares)
    if n <= BUFFER_ROWS:
        return list(x.agg(F.percentile("x", F.array(*[F.lit(s) for s in shares]))).first()[0])
    at = [s * (n - 1) for s in shares]
    values = _at_ranks(x, {r for a in at for r in (math.floor(a), math.ceil(a))})
    return [_between(values[math.floor(a)], values[math.ceil(a)], a - math.floor(a)) for a in at]


def latency(samples: DataFrame, col: str) -> DataFrame:
    """One row: mean, median, 95th and 99th percentile (exact, linear between neighbours), rounded to two decimals."""
    names, shares = ["latency_p50_ms", "latency_p95_ms", "latency_p99_ms"], [0.5, 0.95, 0.99]
    mean, n = F.round(F.avg(col), 2).alias("latency_mean_ms"), samples.select(F.count(col)).first()[0]
    if n <= BUFFER_ROWS:  # one aggregate for all
        x = F.percentile(F.col(col).cast("double"), F.array(*[F.lit(s) for s in shares]))
        return samples.agg(mean, x.alias("p")).select("latency_mean_ms", *[F.round(F.col("p")[k], 2).alias(name) for k, name in enumerate(names)])
    at = percentiles(samples, col, shares, n)
    return samples.agg(mean).select("latency_mean_ms", *[F.round(F.lit(p).cast("double"), 2).alias(name) for p, name in zip(at, names, strict=True)])


def timed(retriever, queries: DataFrame, max_k: int = 20, batches: int = 8) -> DataFrame:
    """(batch, ms_per_query) of retrieving a query set in batches by a hash of the id: time of encoding and search, divided by the batch's queries."""
    spark, rows = queries.sparkSession, []
    batched = queries.withColumn("_batch", F.pmod(F.xxhash64("query_id"), F.lit(batches)))
    for b in range(batches):
        own = batched.where(F.col("_batch") == b).drop("_batch")
        if n := own.count():
            began = time.perf_counter()
            retriever.retrieve(own, max_k).write.format("noop").mode("overwrite").save()
            rows.append((b, (time.perf_counter() - began) * 1000 / n))
    return spark.createDataFrame(rows, "batch int, ms_per_query double")
