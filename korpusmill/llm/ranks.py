"""Places of rows in an order over a whole table or large groups, without a window over either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from korpusmill.llm.skew import join_unique
from korpusmill.storage import Scratch, shuffle_partitions

#: Bits of ``monotonically_increasing_id`` that count the rows of a partition.
ROW_BITS = 33


def numbered(rows: DataFrame, order: list[Column], scratch: Scratch, by: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """``rows`` with their place from 1 by ``order`` within ``by`` (columns without nulls); equal rows take neighbouring places.

    Rows are range-partitioned by group and order, sorted and saved, so that a group of any size lies in several partitions;
    of each only the counts go into a window, of which a group has at most a row for every partition.
    """
    spark = rows.sparkSession
    placed = rows.repartitionByRange(shuffle_partitions(spark), *by, *order).sortWithinPartitions(*by, *order)
    placed = scratch.save(placed.withColumn("_id", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("_part", F.shiftright("_id", ROW_BITS))
    counts = placed.groupBy("_part", *by).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("_before", F.coalesce(before, F.lit(0)))
    joined = join_unique(placed, scratch.save(counts, "counts"), ["_part", *by], "_n") if by else placed.join(F.broadcast(counts.drop("_n")), "_part")  # a row for every partition
    return joined.withColumn(name, F.col("_id") - F.col("_first") + F.col("_before") + 1).select(*rows.columns, name)
