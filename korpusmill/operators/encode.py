"""Encoders: texts to dense or sparse vectors. Model weights are pluggable; hashing and counting encoders stand in for them."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHE_TOKENS = 500_000
#: Bytes of texts whose tokens are counted at once.
SLICE_BYTES = 1 << 20
#: Bytes a core of texts up to which they are dealt anew before they are encoded.
SMALL_BYTES = 8 << 20


class Encoder(Protocol):
    def encode(self, rows: DataFrame, text_col: str, out_col: str) -> DataFrame:
        """``rows`` with the column of vectors, array<float>."""


class BatchEncoder:
    """Any model that takes a batch of texts: ``load()`` runs once in a worker and returns texts -> (n, dim) float array.

    ``batch_size`` texts go to the model together, longest first within a partition so that they are of like length.
    """

    def __init__(self, load: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = 32):
        self.load, self.batch_size = load, batch_size

    def encode(self, rows: DataFrame, text_col: str, out_col: str) -> DataFrame:
        udf = predict_batch_udf(self.load, return_type=T.ArrayType(T.FloatType()), batch_size=self.batch_size)
        ordered = rows.sortWithinPartitions(F.length(text_col).desc())
        return ordered.withColumn(out_col, udf(F.coalesce(F.col(text_col), F.lit(""))))


def spread(rows: DataFrame, small: int = 0) -> DataFrame:
    """``rows`` over all cores: dealt anew where they have fewer partitions than cores, or are of at most ``small`` bytes a core by Spark's estimate, which may lie in one row group; else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) if small else 0
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores or small and size <= small * cores else rows


def _places(dim: int) -> Callable[[bytes], int]:
    """Twice the place of a token, and 1 more if its sign is minus, kept while there are few."""
    places: dict[bytes, int] = {}

    def place(token: bytes) -> int:
        found = places.get(token)
        if found is None:
            if len(places) > CACHE_TOKENS:
                places.clear()
            h = hashlib.md5(token).hexdigest()
            found = places[token] = int(h[:8], 16) % dim * 2 + int(h[8], 16) % 2
        return found

    return place


def _hashed(counts: list[dict[bytes, int]], place: Callable[[bytes], int], dim: int) -> np.ndarray:
    """Vectors of length 1 of counted tokens."""
    out = np.zeros((len(counts), dim))
    for row, own in zip(out, counts, strict=True):
        if own:
            at = np.fromiter(map(place, own), np.int64, len(own))
            row += np.bincount(at >> 1, (1 - 2 * (at & 1)) * np.fromiter(own.values(), np.float64, len(own)), dim)
    return (out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)).astype(np.float32)


class HashingEncoder(BatchEncoder):
    """Each token adds or takes 1 at one of ``dim`` places, both by its md5; the vector has length 1, or is zero without tokens."""

    def __init__(self, dim: int = 64, batch_size: int = 512):
        self.dim = dim

        def load() -> Callable[[np.ndarray], np.ndarray]:
            place = _places(dim)
            return lambda texts: _hashed([_counts(t) for t in texts.tolist()], place, dim)

        super().__init__(load, batch_size)


class LookupEncoder:
    """Vectors that are stored by text; texts without one get null."""

    def __init__(self, stored: DataFrame, text_col: str, vector_col: str):
        self.stored = stored.select(F.col(text_col).alias("_text"), F.col(vector_col).alias("_vector")).dropDuplicates(["_text"])

    def encode(self, rows: DataFrame, text_col: str, out_col: str) -> DataFrame:
        return rows.join(self.stored, rows[text_col] == F.col("_text"), "left").withColumn(out_col, F.col("_vector")).drop("_text", "_vector")


def words(text: str | None) -> list[str]:
    """The tokens that ``functions.text.tokens`` gives."""
    return [w.decode() for w in (text or "").encode().lower().split()]


def lexical_weights(rows: DataFrame, id_col: str, text_col: str, out_col: str = "weights") -> DataFrame:
    """(id, map<string, float>) of each text: its tokens' share of all its tokens. Null and blank texts have no tokens."""
    schema = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType), T.StructField(out_col, T.MapType(T.StringType(), T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), _weights(_counts(t.as_py()) for t in batch.column(1))], names=schema.names)

    return spread(rows.select(id_col, text_col), SMALL_BYTES).mapInArrow(run, schema)


def text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (id, text) cut into such of about ``SLICE_BYTES`` of text, or of one row: counted tokens take many times what their text does."""
    for batch in batches:
        before = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(before, (before[lo - 1] if lo else 0) + SLICE_BYTES, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _counts(text: str | None) -> dict[bytes, int]:
    return Counter((text or "").encode().lower().split())


def _weights(counts: Iterator[dict[bytes, int]]) -> pa.MapArray:
    """Each text's tokens' share of all its tokens."""
    keys, values, ends = [], [], [0]
    for own in counts:
        n = sum(own.values())
        keys += own
        values += [c / n for c in own.values()]
        ends.append(len(keys))
    return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.binary()).cast(pa.string()), pa.array(values, pa.float32()))


class HashingDual:
    """Dense vectors as ``HashingEncoder``'s and sparse ones as ``lexical_weights``'s in one pass over the texts.

    The stand-in for models that give both at once: ``encode(rows, id, text)`` -> (id, embedding array<float>, weights map<string, float>).
    """

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
        fields = [rows.schema[id_col], T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("weights", T.MapType(T.StringType(), T.FloatType()))]
        schema, dim = T.StructType(fields), self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place = _places(dim)
            for batch in text_slices(batches):
                counts = [_counts(t.as_py()) for t in batch.column(1)]
                flat, ends = pa.array(_hashed(counts, place, dim).ravel()), pa.array(np.arange(len(counts) + 1, dtype=np.int32) * dim)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat), _weights(iter(counts))], names=schema.names)

        return spread(rows.select(id_col, text_col), SMALL_BYTES).mapInArrow(run, schema)
