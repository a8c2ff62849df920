"""Joins with a table of unique keys of which a few may hold most of the other side's rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusmill.storage import shuffle_partitions

#: Bytes up to which the whole table of keys is broadcast; rows that a key has at least to count as hot.
SMALL_BYTES, HOT_ROWS = 8 << 20, 256


def join_unique(rows: DataFrame, unique: DataFrame, keys: list[str], n_col: str, how: str = "inner", row_bytes: int = 100, at_most: int | None = None) -> DataFrame:
    """``rows`` joined (inner or left) with the columns of ``unique``, which has every key once and in ``n_col`` its number of rows.

    A small table is broadcast. Of a larger one only the keys with more than total / (8 * partitions) rows are, of which
    there are at most 8 * partitions; all other rows are shuffled by key. Rows with a null key match nothing and are not
    shuffled. ``rows`` and ``unique`` are read several times: pass saved tables, unless ``at_most`` rows, which ``unique`` is known
    not to exceed, make it small. ``n_col`` is not in the result.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is 'inner' or 'left'")
    if at_most is not None and at_most * row_bytes <= SMALL_BYTES:
        return rows.join(F.broadcast(unique.drop(n_col)), keys, how)
    count, total = unique.agg(F.count(F.lit(1)), F.coalesce(F.sum(n_col), F.lit(0))).first()
    if count * row_bytes <= SMALL_BYTES:
        return rows.join(F.broadcast(unique.drop(n_col)), keys, how)
    least = max(HOT_ROWS, total // (8 * shuffle_partitions(rows.sparkSession)))
    hot = unique.where(F.col(n_col) > least).drop(n_col).withColumn("_hot", F.lit(True))
    rest = unique.where(F.col(n_col) <= least).drop(n_col)
    marked = rows.join(F.broadcast(hot), keys, "left")
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    is_hot = F.coalesce(F.col("_hot"), F.lit(False))
    here = marked.where(is_hot if how == "inner" else is_hot | null).drop("_hot")
    cold = marked.where(~is_hot & ~null).select(*rows.columns).join(rest, keys, how)
    return here.unionByName(cold)
