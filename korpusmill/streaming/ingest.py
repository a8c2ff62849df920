"""New case documents as a stream: what a folder receives is chunked, encoded and added to the store, each document once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from korpusmill.schema import CASE_FIELDS, CORRUPT, RAW_CASE
from korpusmill.sources.cases import corpus
from korpusmill.store import ChunkStore, chunk_rows


def ingest(
    spark: SparkSession, folder: str, store: ChunkStore, checkpoint: str, model: str, encoder, size: int = 300, overlap: int = 100, files_per_batch: int = 10_000
) -> StreamingQuery:
    """Start a query over the JSON files of ``folder`` that takes all that are there and ends.

    Batches that run again after a failure add only what the store lacks, so a chunk is stored once.
    """
    reader = spark.readStream.schema(RAW_CASE).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    raw = reader.option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.json").json(folder)
    rows = raw.select(
        *[F.col(f).alias(c) for f, c in CASE_FIELDS.items()], F.col("_metadata.file_name").alias("file_name"), F.lit(0).alias("split_ord"), F.col(CORRUPT).isNull().alias("readable")
    )

    def add(batch: DataFrame, _: int) -> None:
        store.append_missing(chunk_rows(corpus(batch), size, overlap), model, size, overlap, encoder)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
