"""The documents table made ready for training: STAGES in order, each a function (spark, docs, sf_dir) -> DataFrame.

All stages but the last return the columns of ``documents``, with ``n_chars`` kept up to date.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusmill.llm import language_id, line_dedup, minhash, packing, suffix_dedup
from korpusmill.llm.batches import text_batches
from korpusmill.llm.queries import packer, tokenizer_file
from korpusmill.storage import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CARRY = ("lang", "source")


def _with_text(out: DataFrame, text) -> DataFrame:
    out = out.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labels name; those in none of them go, null, empty and letterless texts too.

    Decided on id, source and a hash of the text alone, so that texts are in no join with hosts; what is rejected is taken out of the
    documents by an anti-join, which broadcasts it while it is small. Rows alike in these three are decided alike, rows of one
    id (null included) and other texts or sources each by itself. Of an empty table nothing is left.
    """
    keys = ["doc_id", "source", "content"]
    content = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "source", content.alias("content"), "text", F.lit(None).cast("string").alias("url"), F.lit(False).alias("markup"))
    with text_batches(spark):
        found = language_id.identify(rows, language_id.fit(docs), keys).where("NOT accepted")
        gone = Scratch(spark, "language-stage").save(found.select(*[F.col(c).alias(f"gone_{c}") for c in keys]), "rejected")
    same = [docs["doc_id"].eqNullSafe(gone["gone_doc_id"]), docs["source"].eqNullSafe(gone["gone_source"]), content == gone["gone_content"]]
    return docs.join(gone, same, "left_anti").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines of ten characters or more that one of smaller id holds; null texts are empty. Of an empty table nothing is left."""
    return _with_text(line_dedup.line_dedup(docs, carry=CARRY), F.col("text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingles of five words are alike to 0.8 or more, that of the smallest id.

    The ids that go are taken out by an anti-join, which broadcasts them while they are few. Texts without words and null ids
    stay; rows that share an id stay or go together. Of an empty table nothing is left.
    """
    with text_batches(spark):
        found = minhash.near_duplicates(docs, words=5).where("NOT kept").select("doc_id").distinct()
        gone = Scratch(spark, "near-stage").save(found, "dropped")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the characters that a string of 100 bytes covers which also starts earlier (smaller id, or before in the same text); null texts are empty."""
    with text_batches(spark):
        out = suffix_dedup.suffix_dedup(docs, length=100, whole_characters=True, carry=CARRY)
    return _with_text(out, F.decode("kept", "UTF-8"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences of at most 4096 tokens; null and empty texts are a piece of the end token alone."""
    with text_batches(spark):
        return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), packer=packer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("best_fit_packing", pack_sequences),
]

#: The language stage, whose model is fitted, cannot be put in SQL, so the whole cannot; tests hold every stage against a brute-force version on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
