"""Sliding character chunks of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from korpusmill.functions.text import strip

#: Rows of chunks in a batch.
BATCH = 8192


def check(size: int, overlap: int) -> int:
    """The step between two starts."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to size - 1")
    return size - overlap


def chunk_text(text: str | None, size: int, overlap: int) -> list[tuple[int, int, str]]:
    """(index, start, chunk) of a stripped text; blank chunks go, and the index counts those that are left."""
    step, own = check(size, overlap), (text or "").strip()
    starts = [(i, own[i : i + size]) for i in range(0, len(own), step)]
    return [(k, i, c) for k, (i, c) in enumerate((i, c) for i, c in starts if c.strip())]


def chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 300, overlap: int = 100, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, chunk_index, char_offset, chunk_text, carried columns): characters are code points, the last chunk may be shorter.

    Null, empty and blank texts have no chunks. Rows are independent: null and repeated ids change nothing. Python slices
    in Arrow batches, which costs less than higher-order functions that strip again for every chunk.
    """
    check(size, overlap)
    own = docs.schema
    schema = T.StructType(
        [
            T.StructField(id_col, own[id_col].dataType), T.StructField("chunk_index", T.IntegerType()), T.StructField("char_offset", T.IntegerType()),
            T.StructField("chunk_text", T.StringType()), *(own[c] for c in carry),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            take = pa.array(row, pa.int64())
            made = [pa.array(index, pa.int32()), pa.array(start, pa.int32()), pa.array(text, pa.string())]
            return pa.RecordBatch.from_arrays([batch.column(0).take(take), *made, *(c.take(take) for c in batch.columns[2:])], names=schema.names)

        for batch in batches:
            row, index, start, text = [], [], [], []
            for i in range(batch.num_rows):
                for k, at, c in chunk_text(batch.column(1)[i].as_py(), size, overlap):
                    row.append(i)
                    index.append(k)
                    start.append(at)
                    text.append(c)
                    if len(row) >= BATCH:
                        yield flush()
                        row, index, start, text = [], [], [], []
            if row:
                yield flush()

    return docs.select(id_col, text_col, *carry).mapInArrow(run, schema)


def chunks_sql(docs: DataFrame, id_col: str, text_col: str, size: int = 300, overlap: int = 100) -> DataFrame:
    """The same rows by built-in functions; ids must be unique."""
    step = check(size, overlap)
    own = docs.select(F.col(id_col), strip(text_col).alias("text")).where(F.col("text") != "")
    starts = own.withColumn("char_offset", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(step))))
    cut = starts.select(id_col, "char_offset", F.substring("text", F.col("char_offset") + 1, F.lit(size)).alias("chunk_text")).where(strip("chunk_text") != "")
    index = (F.row_number().over(Window.partitionBy(id_col).orderBy("char_offset")) - 1).cast("int")
    return cut.select(id_col, index.alias("chunk_index"), "char_offset", "chunk_text")


def chunk_counts(docs: DataFrame, text_col: str, configs: list[tuple[int, int]]) -> DataFrame:
    """(chunk_size, overlap, n_chunks) of several configurations in one pass over the texts."""
    for c in configs:
        check(*c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [0] * len(configs)
        for batch in batches:
            for text in batch.column(0):
                own = (text.as_py() or "").strip()
                for k, (size, overlap) in enumerate(configs):
                    counts[k] += sum(not own[i : i + size].isspace() for i in range(0, len(own), size - overlap))
        sizes, overlaps = zip(*configs, strict=True)
        yield pa.RecordBatch.from_pydict({"chunk_size": pa.array(sizes, pa.int32()), "overlap": pa.array(overlaps, pa.int32()), "n": counts})

    parts = docs.select(text_col).mapInArrow(run, "chunk_size int, overlap int, n long")
    return parts.groupBy("chunk_size", "overlap").agg(F.sum("n").alias("n_chunks"))
