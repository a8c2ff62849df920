"""Training pairs: best chunk of the true document, hard negatives, triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from korpusmill.functions.vector import dot, l2_normalize

DIGITS = 6


def positives(
    queries: DataFrame, chunks: DataFrame, doc_col: str = "case_no", id_col: str = "chunk_id", vector_col: str = "embedding", carry: tuple[str, ...] = (), same_id: bool = True
) -> DataFrame:
    """(query_id, id, doc, sim, carried columns): the chunk of the query's true document with the largest cosine, ties to the smaller id.

    ``queries``: (query_id, doc, vector). Queries whose document has no chunk give no row; ``same_id=False`` leaves out the
    chunk whose id is the query's.
    """
    q = queries.select("query_id", F.col(doc_col), l2_normalize(vector_col).alias("_q"))
    c = chunks.select(id_col, doc_col, *carry, l2_normalize(vector_col).alias("_v"))
    joined = q.join(c, doc_col)
    if not same_id:
        joined = joined.where(F.col("query_id") != F.col(id_col))
    scored = joined.withColumn("sim", dot("_q", "_v")).drop("_q", "_v")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("sim", DIGITS).desc(), id_col))
    return scored.withColumn("_nth", nth).where(F.col("_nth") == 1).select("query_id", id_col, doc_col, "sim", *carry)


def without_positive(queries: DataFrame, found: DataFrame) -> DataFrame:
    """(reason, n): queries for which no positive was found."""
    return queries.join(found.select("query_id"), "query_id", "left_anti").agg(F.lit("no_chunks").alias("reason"), F.count(F.lit(1)).alias("n"))


def without_negative(queries: DataFrame, found: DataFrame) -> DataFrame:
    """(reason, n): queries for which no negative was found."""
    return queries.join(found.select("query_id").distinct(), "query_id", "left_anti").agg(F.lit("no_negative").alias("reason"), F.count(F.lit(1)).alias("n"))


def hard_negatives(pool: DataFrame, truth: DataFrame, doc_col: str = "case_no", id_col: str = "chunk_id", skip_top: int = 5, num_negatives: int = 1) -> DataFrame:
    """Of each query's pool (query_id, id, doc, sim, ...) without its true documents the places skip_top + 1 to skip_top + num_negatives, as ``negative_rank`` from 1.

    All true documents of a query are left out; places count chunks, several of which may be of one document.
    """
    other = pool.join(truth.select("query_id", doc_col).distinct(), ["query_id", doc_col], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("sim", DIGITS).desc(), id_col))
    ranked = other.withColumn("_n", place).where(F.col("_n").between(skip_top + 1, skip_top + num_negatives))
    return ranked.withColumn("negative_rank", (F.col("_n") - skip_top).cast("int")).drop("_n", "rank")


def triples(queries: DataFrame, positive: DataFrame, negative: DataFrame, anchor: str, passage: str) -> DataFrame:
    """(query_id, anchor, positive, negative), a row per negative; queries without a positive or a negative give none."""
    a = queries.select("query_id", F.col(anchor).alias("anchor"))
    p = positive.select("query_id", F.col(passage).alias("positive"))
    n = negative.select("query_id", F.col(passage).alias("negative"), "negative_rank")
    return a.join(p, "query_id").join(n, "query_id").select("query_id", "anchor", "positive", "negative", "negative_rank")


def epoch(rows: DataFrame, seed: int, batch_size: int) -> DataFrame:
    """Rows in an order by a hash of ``query_id`` and the seed, with ``batch``, the last incomplete one dropped.

    The order is that of the hash's leading 16 bits, then of the rest, so ranks are taken within bins and no task holds all rows.
    """
    hashed = rows.withColumn("_h", F.md5(F.concat_ws(":", F.col("query_id").cast("string"), F.lit(seed)))).withColumn("_bin", F.substring("_h", 1, 4))
    bins = hashed.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"))  # at most 65,536 rows
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    bins = bins.select("_bin", before.alias("_before"), total.alias("_all"))
    ties = [c for c in rows.columns if c != "query_id"]
    nth = F.row_number().over(Window.partitionBy("_bin").orderBy("_h", "query_id", *ties)) - 1
    placed = hashed.withColumn("_nth", nth).join(bins, "_bin").withColumn("position", F.col("_nth") + F.col("_before"))
    kept = placed.withColumn("batch", F.floor(F.col("position") / batch_size)).where(F.col("batch") < F.floor(F.col("_all") / batch_size))
    return kept.select(*rows.columns, "position", "batch")
