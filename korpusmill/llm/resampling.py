"""Importance resampling towards a target distribution over hashed n-grams.

Every task has a DuckDB of its own: SQL takes the words out of texts, forms n-grams by a window and counts them by a bucket, which a
registered function gives (zlib's CRC-32). Bucket counts of rows and of the whole partition are spilled to Parquet; Spark
merges the partitions' counts, and rows are scored from their stored counts without reading a text again.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korpusmill.llm.ranks import numbered
from korpusmill.storage import Scratch

#: What words are made of, and the letters that are lower-cased.
WORD, UPPER, LOWER = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of texts that one SQL statement takes; longer texts are cut between words.
SLICE_CHARS = 2 << 20


def _statement(n: int, buckets: int) -> str:
    """(row, bucket, c, words) of the table ``pieces`` (row, skip, text); the first ``skip`` words of a piece only begin features."""
    runs = ["word", *(" || ' ' || ".join([*(f"lag(word, {k}) OVER near" for k in range(m, 0, -1)), "word"]) for m in range(1, n))]
    return f"""
WITH texts AS (SELECT row, skip, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM pieces),
words AS (SELECT row, skip, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM texts),
features AS (SELECT row, skip, pos, unnest([{", ".join(runs)}]) AS feature, unnest(range(1, {n + 1})) AS m FROM words WINDOW near AS (PARTITION BY row ORDER BY pos)),
counted AS (SELECT row, feature, count(*) AS c, count(*) FILTER (WHERE m = 1) AS words FROM features WHERE pos > skip AND feature IS NOT NULL GROUP BY row, feature),
hashed AS (SELECT feature, zlib_crc32(feature) % {buckets} AS bucket FROM (SELECT DISTINCT feature FROM counted))
SELECT row, bucket, sum(c)::BIGINT AS c, sum(words)::BIGINT AS words FROM counted JOIN hashed USING (feature) GROUP BY row, bucket ORDER BY row, bucket
"""


def _crc32(features: pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(f.encode()) for f in features.to_pylist()], pa.int64())


def _slices(texts: pa.Array, n: int) -> Iterator[list[tuple[int, int, str]]]:
    """Lists of (row, skip, text) of about ``SLICE_CHARS`` characters: whole texts, or pieces of a long one, each after the n - 1 words before it."""
    gap, word, own, chars = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"), re.compile(WORD), [], 0
    for row, value in enumerate(texts):
        text = value.as_py() or ""
        if len(text) <= SLICE_CHARS:
            own.append((row, 0, text))
            chars += len(text)
        else:
            lo, before = 0, []
            while lo < len(text):
                end = gap.search(text, lo + SLICE_CHARS)
                piece = text[lo : end.start() if end else len(text)]
                lo += len(piece)
                yield [(row, len(before), " ".join([*before, piece]))]
                before = [*before, *word.findall(piece)][-(n - 1) :] if n > 1 else []
        if chars >= SLICE_CHARS:
            yield own
            own, chars = [], 0
    if own:
        yield own


def bucket_counts(docs: DataFrame, id_col: str, text_col: str, n: int = 1, buckets: int = 10_000) -> DataFrame:
    """(id, whole, n_words, n_features, buckets, counts): a row per row of ``docs`` and, marked ``whole`` and without id, one per partition with its sums.

    Features are all runs of 1 to ``n`` words, repeats counted. Null texts have none.
    """
    numbers = T.ArrayType(T.LongType())
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("whole", T.BooleanType()), T.StructField("n_words", T.LongType()),
            T.StructField("n_features", T.LongType()), T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("counts", numbers),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        def made(ids: pa.Array, whole: bool, words: np.ndarray, ends: np.ndarray, bucket: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            features = np.diff(np.append(0, np.cumsum(c))[ends])
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((bucket, pa.int32()), (c, pa.int64()))]
            return pa.RecordBatch.from_arrays([ids, pa.array([whole] * len(ids)), pa.array(words, pa.int64()), pa.array(features, pa.int64()), *lists], names=schema.names)

        con = duckdb.connect(":memory:", config={"threads": 1})
        con.create_function("zlib_crc32", _crc32, ["VARCHAR"], "BIGINT", type="arrow")
        sql, total, all_words, kind, any_rows = _statement(n, buckets), np.zeros(buckets, np.int64), 0, None, False
        for batch in batches:
            any_rows |= batch.num_rows > 0
            kind, found = batch.column(0).type, []
            for own in _slices(batch.column(1), n):
                rows, skips, texts = zip(*own, strict=True)
                con.register("pieces", pa.table({"row": pa.array(rows, pa.int64()), "skip": pa.array(skips, pa.int64()), "text": pa.array(texts, pa.string())}))
                got = con.execute(sql).fetchnumpy()
                con.unregister("pieces")
                found.append(np.stack([np.asarray(got[k], np.int64) for k in ("row", "bucket", "c", "words")]))
            row, bucket, c, words = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
            place, at = np.unique(row * buckets + bucket, return_inverse=True)  # pieces of a long text are brought together
            c, words = (np.bincount(at, x, len(place)).astype(np.int64) for x in (c, words))
            row, bucket = place // buckets, place % buckets
            np.add.at(total, bucket, c)
            all_words += int(words.sum())
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield made(batch.column(0), False, np.bincount(row, words, batch.num_rows), ends, bucket, c)
        if any_rows:
            held = np.flatnonzero(total)
            yield made(pa.nulls(1, kind), True, np.array([all_words]), np.array([0, len(held)]), held, total[held])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _merged(counts: DataFrame, name: str) -> DataFrame:
    """(bucket, name) of all partitions; at most as many rows as there are buckets."""
    each = counts.where("whole").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    return each.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias(name))


def _gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """By bucket floor(1000 * log-ratio) of the target's to the corpus's smoothed share."""
    spark = corpus.sparkSession
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(_merged(corpus, "s"), "bucket", "left").join(_merged(target, "t"), "bucket", "left").na.fill(0)
    rows = both.select("bucket", F.col("s").cast("double").alias("s"), F.col("t").cast("double").alias("t"))
    sums = corpus.where("whole").agg(F.coalesce(F.sum("n_features"), F.lit(0)).cast("double").alias("x")).first()[0], target.where("whole").agg(F.coalesce(F.sum("n_features"), F.lit(0)).cast("double")).first()[0]
    ratio = ((F.col("t") + 1) * F.lit(sums[0] + buckets)) / ((F.col("s") + 1) * F.lit(sums[1] + buckets))
    out = np.zeros(buckets, np.int64)
    for r in rows.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect():  # a row per bucket
        out[r.bucket] = r.gain
    return out


def _weighed(counts: DataFrame, id_col: str, gains: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight) of rows from their bucket counts."""
    shared = counts.sparkSession.sparkContext.broadcast(gains)  # a number per bucket
    schema = T.StructType([counts.schema[id_col], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, n = batch.column(3), batch.column(2).to_numpy()
            gain = shared.value[lists.flatten().to_numpy()] * batch.column(4).flatten().to_numpy()
            ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            weight = np.diff(np.append(0, np.cumsum(gain))[ends]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], names=schema.names)

    return counts.where("NOT whole").select(id_col, "n_words", "n_features", "buckets", "counts").mapInArrow(run, schema)


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text",
    n: int = 1, buckets: int = 10_000, min_words: int = 20, percent: int = 10, seed: int = 2024,
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of ``docs``; rank counts those drawn from 1, highest score first, ties to the smaller id, else it is null.

    A feature's gain is that of its bucket; a row's weight is the floored mean over its features, 0 without any. The score adds Gumbel noise from a
    hash of seed and id, so the drawn rows are a sample without replacement by weight. Drawn are floor(percent * N / 100) of the N rows with at least ``min_words`` words.
    Null texts are empty. A null id hashes as an empty one and comes first among ties. Rows are judged one by one, so
    rows that share an id may each be drawn; of equal rows any may be the one that is. Without a target, or without rows, counts are zero; an empty table gives an empty
    result. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    own = scratch.save(bucket_counts(docs, id_col, text_col, n, buckets), "counts", ["whole"])
    aim = scratch.save(bucket_counts(target, target_id, target_text, n, buckets), "target", ["whole"])
    rows = _weighed(own, id_col, _gains(own, aim, buckets))
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    fit = F.col("n_words") >= min_words
    placed = numbered(rows.select(id_col, "n_features", "weight", score.alias("score"), (~fit).alias("unfit")), [F.col("unfit"), F.col("score").desc(), F.col(id_col)], scratch)
    count = own.where(~F.col("whole") & fit).count()
    drawn = ~F.col("unfit") & (F.col("rank") <= percent * count // 100)
    return placed.select(id_col, "n_features", "weight", "score", F.when(drawn, F.col("rank")).alias("rank"))
