"""JSON sources: case documents, label documents, query sets, training pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korpusmill.functions.text import case_type, file_stem, filled, strip
from korpusmill.operators.corpus import first_wins, usable
from korpusmill.schema import CASE_FIELDS, CORRUPT, LABEL, PAIR, QUERY_ITEM, RAW_CASE, TRIPLE


def _objects(spark: SparkSession, path: str, schema: T.StructType, strict: bool) -> DataFrame:
    """One JSON object per file with its file's name; hidden files (``._*``) are no rows."""
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("mode", "FAILFAST" if strict else "PERMISSIVE")
    if strict:
        schema = T.StructType([f for f in schema if f.name != CORRUPT])
    else:
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    rows = reader.schema(schema).json(path).select("*", F.col("_metadata.file_name").alias("file_name"))
    return rows.where(~F.col("file_name").startswith("._"))


def read_cases(spark: SparkSession, paths: list[str], strict: bool = False) -> DataFrame:
    """All rows of raw case documents: the six corpus columns, ``file_name``, ``split_ord`` (place in ``paths``), ``readable``.

    Files that are no JSON are rows with ``readable`` false; with ``strict`` they raise.
    """
    parts = []
    for k, path in enumerate(paths):
        rows = _objects(spark, path, RAW_CASE, strict)
        readable = F.lit(True) if strict else F.col(CORRUPT).isNull()
        parts.append(rows.select(*[F.col(f).alias(c) for f, c in CASE_FIELDS.items()], F.url_decode("file_name").alias("file_name"), F.lit(k).alias("split_ord"), readable.alias("readable")))
    return reduce(DataFrame.unionByName, parts)


def corpus(raw: DataFrame, id_from_file: bool = True) -> DataFrame:
    """The corpus of ``read_cases``: readable, not blank, stripped; a missing number is the file's stem (or, without ``id_from_file``, drops the row).

    Of rows with one number the first by (place of the path, file name) stays. A null or empty category is the default one.
    """
    number = filled("case_no", file_stem("file_name")) if id_from_file else F.col("case_no")
    rows = usable(raw.where("readable").withColumn("case_no", number), "case_no", "content")
    return first_wins(rows, "case_no", ["split_ord", "file_name"]).withColumn("case_type", case_type("case_type")).select(*CASE_FIELDS.values())


def write_corpus(rows: DataFrame, path: str) -> None:
    """The accepted corpus as a table, by category."""
    rows.write.mode("overwrite").partitionBy("case_type").parquet(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label documents (info, jdgmnInfo, file_name); unreadable files are left out."""
    return _objects(spark, path, LABEL, False).where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def read_queries(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(query_id, query, case_ids) of a JSON array of items; ``query_id`` is the place in the array, ``limit`` keeps the first ones. What is no such array raises."""
    whole = spark.read.text(path, wholetext=True)
    items = whole.select(F.posexplode(F.from_json("value", T.ArrayType(QUERY_ITEM), {"mode": "FAILFAST"})).alias("query_id", "item"))
    rows = items.select(F.col("query_id").cast("long").alias("query_id"), "item.query", "item.case_ids")
    return rows if limit is None else rows.where(F.col("query_id") < limit)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIR).json(path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(anchor, positive, negative), a row per negative, whichever of the two negative fields a line has; pairs have a null negative."""
    rows = spark.read.schema(TRIPLE).json(path)
    negatives = F.coalesce("hard_negative_chunks", F.array("hard_negative_chunk"))
    return rows.select(F.col("query").alias("anchor"), F.col("positive_chunk").alias("positive"), F.explode_outer(negatives).alias("negative"))


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One object per line, nulls left out, characters unescaped."""
    rows.write.mode("overwrite").json(path)


def json_array(rows: DataFrame, order: str, max_rows: int = 100_000) -> str:
    """A small table as one JSON array; raises beyond ``max_rows``, for which ``write_jsonl`` is the way."""
    own = rows.orderBy(order).limit(max_rows + 1).select(F.to_json(F.struct(*rows.columns)).alias("j")).collect()
    if len(own) > max_rows:
        raise ValueError(f"more than {max_rows} rows: write JSON lines")
    return "[" + ",\n".join(r.j for r in own) + "]"


def blank_rows(raw: DataFrame) -> DataFrame:
    """(reason, n) of files that do not reach the corpus: unreadable, without content, without a number."""
    readable, blank = F.col("readable"), strip("content") == ""
    row = raw.agg(
        F.count_if(~readable).alias("unreadable"), F.count_if(readable & blank).alias("no_content"),
        F.count_if(readable & ~blank & (F.coalesce("case_no", F.lit("")) == "")).alias("no_case_no"),
    )
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("reason"), F.col(n).alias("n")) for n in row.columns])).alias("r")).select("r.*")
