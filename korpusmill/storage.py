"""Intermediate tables in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir`` of the session; only where it is unset and all tasks run in the driver's machine
(tests, a laptop) one below the system's temporary folder is taken.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI that Spark's readers and writers take."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/korpusmill-shared-{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def save_parts(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Write a table, by a few values of some columns if these are named: their folders are written at once, without a sort."""
    spark, files = df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    writer, before = df.write.mode("overwrite").option("compression", "zstd"), spark.conf.get(files, "0")
    spark.conf.set(files, "16" if by else before)
    try:
        (writer.partitionBy(*by) if by else writer).parquet(path)
    finally:
        spark.conf.set(files, before)


class Scratch:
    """Tables of one run of an operator, below a folder of their own.

    ``save`` writes a table and reads it back, which cuts the lineage: a lost executor costs no recomputation of
    what was saved. ``drop`` deletes tables that nothing reads any more; what the result reads stays until
    the shared folder is cleaned.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/korpusmill/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        path = self.path(name)
        save_parts(df, path, by)
        out = self.spark.read.schema(df.schema).parquet(path).select(*df.columns)
        out.saved_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *tables: DataFrame | str) -> None:
        for t in tables:
            delete(self.spark, t if isinstance(t, str) else t.saved_path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
