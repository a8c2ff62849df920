"""Corpus preparation: filter, first-wins de-duplication, stratified split, question sets, reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from korpusmill.functions.text import case_type, strip


def usable(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows with a key and a text that is not blank, the text stripped."""
    return docs.withColumn(text, strip(text)).where(F.col(key).isNotNull() & (F.col(key).cast("string") != "") & (F.col(text) != ""))


def first_wins(docs: DataFrame, key: str | list[str], order: list[str | Column]) -> DataFrame:
    """Of rows with the same key the first by ``order``. Every task drops all but its own firsts before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    ranked = docs.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_nth") == 1).drop("_nth")


def split_of(docs: DataFrame, key: str, stratum: str, ratio: float = 0.85, seed: int = 42) -> DataFrame:
    """``docs`` with ``split``: in each stratum exactly round-half-even(n * ratio) rows are train, the rest val.

    The order within a stratum is that of md5(key:seed), so a row's place depends on its key and seed alone. Ranks are counted
    per stratum and leading hash digits first, so a stratum with most of the rows is ranked by many tasks. Keys are unique;
    a null stratum is one of its own.
    """
    if not 0 <= ratio <= 1:
        raise ValueError("ratio must be from 0 to 1")
    hashed = docs.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))).withColumn("_bin", F.substring("_h", 1, 3))
    bins = hashed.groupBy(stratum, "_bin").agg(F.count(F.lit(1)).alias("_n"))  # at most 4,096 rows a stratum
    here = Window.partitionBy(stratum)
    bins = bins.withColumn("_before", F.sum("_n").over(here.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))).withColumn("_all", F.sum("_n").over(here))
    bins = bins.withColumnsRenamed({stratum: "_stratum", "_bin": "_bin_"})
    rank = F.row_number().over(Window.partitionBy(stratum, "_bin").orderBy("_h", key)) + F.coalesce("_before", F.lit(0))
    joined = hashed.join(bins, hashed[stratum].eqNullSafe(bins["_stratum"]) & (F.col("_bin") == F.col("_bin_")))
    train = rank <= F.bround(F.col("_all") * F.lit(ratio))
    return joined.withColumn("split", F.when(train, "train").otherwise("val")).select(*docs.columns, "split")


def split_counts(split: DataFrame, stratum: str) -> DataFrame:
    """(stratum, n, train, val), largest stratum first."""
    n = F.count(F.lit(1))
    counts = split.groupBy(stratum).agg(n.alias("n"), F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "val").alias("val"))
    return counts.orderBy(F.desc("n"), stratum)


def histogram(docs: DataFrame, category: str) -> DataFrame:
    """(category, n), most frequent first; null and empty are one category."""
    return docs.groupBy(case_type(category).alias(category)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), category)


def length_stats(docs: DataFrame, length: Column) -> DataFrame:
    """One row: n, mean, median, min, max, p90 of a length (characters, or ``functions.text.n_tokens``); nulls over an empty table but n = 0.

    Lengths are whole numbers, so the percentiles are taken from the counts of each length.
    """
    counts = docs.select(length.cast("double").alias("x")).where("x IS NOT NULL").groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    weighted = lambda share: F.expr(f"percentile(x, {share}D, c)")
    return counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("n"), F.round(F.sum(F.col("x") * F.col("c")) / F.sum("c"), 4).alias("mean"), weighted(0.5).alias("median"),
        F.min("x").alias("min"), F.max("x").alias("max"), F.round(weighted(0.9), 4).alias("p90"),
    )


def questions(labels: DataFrame) -> DataFrame:
    """(case_no, pos, question) of label documents; lists that are null or empty give no rows, blank questions go."""
    rows = labels.select(F.col("info.caseNoID").alias("case_no"), F.posexplode("jdgmnInfo").alias("pos", "item"))
    return rows.select("case_no", "pos", strip("item.question").alias("question")).where(F.col("question") != "")


def route(queries: DataFrame, split: DataFrame, query_key: str, doc_key: str) -> DataFrame:
    """Queries with the split of their document; those of no document go."""
    side = split.select(F.col(doc_key).alias("_doc"), "split")
    return queries.join(side, queries[query_key] == side["_doc"]).drop("_doc")


def rejections(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str) -> DataFrame:
    """(reason, n): why documents and questions do not make it into the corpus and the query sets."""
    has_key = F.col(key).isNotNull() & (F.col(key).cast("string") != "")
    blank = strip(text) == ""
    kept = usable(docs, key, text).groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    known = kept.select(F.col(key).alias("_known"))
    routed = queries.join(known, queries[query_key] == F.col("_known"), "left")
    unknown = F.col("_known").isNull()

    def report(rows: DataFrame, **counts: Column) -> DataFrame:
        row = rows.agg(*[c.cast("long").alias(n) for n, c in counts.items()])
        return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("reason"), F.col(n).alias("n")) for n in counts])).alias("r")).select("r.reason", "r.n")

    parts = [
        report(docs, no_content=F.count_if(blank), no_key=F.count_if(~blank & ~has_key)),
        report(kept, duplicate=F.coalesce(F.sum(F.col("c") - 1), F.lit(0))),
        report(routed, no_match=F.count_if(unknown), empty_question=F.count_if(~unknown & (strip(query_text) == ""))),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def adjacent_same_rate(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row (n_pairs, n_same, rate): share of neighbouring rows by ``order`` with the same key.

    Rows are range-partitioned; a task reports its counts and its first and last key, so that only a row per task is put in
    one order. Null keys are like no other; fewer than two rows give a null rate.
    """
    keys = rows.select(F.col(key).cast("string").alias("key"), *order).repartitionByRange(*order).sortWithinPartitions(*order)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, last, n, same = None, None, 0, 0
        for batch in batches:
            own = batch.column(0).to_pylist()
            if own:
                first = own[0] if not n else first
                chain = [last, *own] if n else own
                same += sum(a is not None and a == b for a, b in zip(chain, chain[1:], strict=False))
                last, n = own[-1], n + len(own)
        if n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "first": pa.array([first], pa.string()), "last": pa.array([last], pa.string()), "n": [n], "same": [same]})

    parts = keys.select("key").mapInArrow(edges, "part int, first string, last string, n long, same long")
    joined = parts.withColumn("across", (F.col("first") == F.lag("last").over(Window.orderBy("part"))).cast("long"))
    total = joined.agg(F.greatest(F.coalesce(F.sum("n"), F.lit(0)) - 1, F.lit(0)).alias("n_pairs"), (F.coalesce(F.sum("same"), F.lit(0)) + F.coalesce(F.sum("across"), F.lit(0))).alias("n_same"))
    return total.withColumn("rate", F.when(F.col("n_pairs") > 0, F.round(F.col("n_same") / F.col("n_pairs"), 6)))


def part_files(files: DataFrame) -> DataFrame:
    """(target, parts, bytes, contiguous) of files (name, size) called ``<target>.part<offset>``: whether each part starts where those before it end."""
    pattern = r"^(.+)\.part(\d+)$"
    parts = files.where(F.col("name").rlike(pattern)).select(
        F.regexp_extract("name", pattern, 1).alias("target"), F.regexp_extract("name", pattern, 2).cast("long").alias("at"), F.col("size").cast("long").alias("size")
    )
    before = F.coalesce(F.sum("size").over(Window.partitionBy("target").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    checked = parts.withColumn("fits", F.col("at") == before)
    return checked.groupBy("target").agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("bytes"), F.bool_and("fits").alias("contiguous"))


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, n_missing): keys of one table that the other lacks; both counts are 0 if they agree."""
    count = lambda a, b, name: a.join(b, key, "left_anti").agg(F.count(F.lit(1)).alias("n_missing")).select(F.lit(name).alias("side"), "n_missing")
    one, two = left.select(key).distinct(), right.select(key).distinct()
    return count(one, two, "right").unionByName(count(two, one, "left"))
