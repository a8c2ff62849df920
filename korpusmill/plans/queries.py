"""Registered queries over the test tables, and the same in DuckDB SQL.

Vectors come from ``embeddings``, whose document is ``vec_id div 4``; text queries are the passages of ``benchmark`` against
``documents``, with hashing and counting encoders for model weights. Searches take the vectors whose id 50 divides against all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusmill.functions import text as X
from korpusmill.functions import vector as V
from korpusmill.operators import chunk, codes, corpus, encode, evaluate, keywords, mining, search
from korpusmill.plans import sql
from korpusmill.storage import Scratch

CONFIGS = [(200, 0), (300, 0), (500, 0), (1000, 0), (200, 50), (300, 100)]
POOL, TOP = 100, 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus_filter_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", X.strip("text").alias("content"), X.case_type("lang").alias("case_type"))
    keyed = docs.where(F.col("content") != "").select(F.md5("content").alias("case_no"), "doc_id", "case_type", F.length("content").cast("long").alias("n_chars"))
    return corpus.first_wins(keyed, "case_no", ["doc_id"])


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.length_stats(_table(spark, sf_dir, "documents"), F.length("text"))


def corpus_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.length_stats(_table(spark, sf_dir, "documents").where("text IS NOT NULL"), X.n_tokens("text"))


def category_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.histogram(_table(spark, sf_dir, "documents"), "lang")


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.split_of(_table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang")


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.split_counts(stratified_split(spark, sf_dir), "lang")


def _user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").where(F.col("role") == "user")


def query_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _user_turns(spark, sf_dir).select("conv_id", "turn", X.strip("text").alias("query")).where(F.col("query") != "")
    return corpus.route(turns, stratified_split(spark, sf_dir), "conv_id", "doc_id").select("conv_id", "turn", "query", "split")


def rejection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _user_turns(spark, sf_dir).select("conv_id", F.col("text").alias("query"))
    return corpus.rejections(_table(spark, sf_dir, "documents"), "doc_id", "text", turns, "conv_id", "query")


def adjacent_same_case_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.adjacent_same_rate(_table(spark, sf_dir, "conversations"), "conv_id", ["conv_id", "turn"])


def _chunks(size: int, overlap: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: chunk.chunks(_table(spark, sf_dir, "documents"), "doc_id", "text", size, overlap)


def chunk_counts_by_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_counts(_table(spark, sf_dir, "documents"), "text", CONFIGS)


def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = _table(spark, sf_dir, "embeddings").select("vec_id", V.norm("embedding").alias("norm"), V.l2_normalize("embedding").alias("unit"))
    return unit.select("vec_id", F.round("norm", 6).alias("norm"), F.round(V.norm("unit"), 6).alias("unit_norm"), F.round(F.col("unit")[0], 6).alias("first"))


def vector_literal_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", V.to_literal("embedding").alias("literal"))
    near = F.forall(F.zip_with("embedding", V.from_literal("literal"), lambda a, b: F.abs(a - b) <= 1e-6), lambda x: x)
    return rows.select("vec_id", "literal", near.alias("same"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id div 4").alias("doc"), "embedding", "label")


def _queries(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "doc", "embedding", "label")


def _pool(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return search.top_k(vectors, _queries(vectors), k, id_col="vec_id", carry=("doc",))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir, TOP).select("query_id", "vec_id", F.round("sim", 6).alias("score"), "rank")


def dense_doc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.document_rank(_pool(spark, sf_dir, POOL), "doc", TOP).withColumn("score", F.round("score", 6))


def distinct_on_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = search.best_per_document(_pool(spark, sf_dir, POOL), "doc", "vec_id")
    return best.select("query_id", "doc", "vec_id", F.round(1 - F.col("sim"), 6).alias("distance"))


def cell_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate: the nearest 24 of 32 cells of each query."""
    vectors = _vectors(spark, sf_dir)
    index = search.CellIndex.fit(vectors, cells=32)
    found = search.top_k(index.assign(vectors), _queries(vectors), TOP, id_col="vec_id", probes=index.probes(24))
    return found.select("query_id", "vec_id", F.round("sim", 6).alias("score"), "rank")


def code_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact result by product codes: whole vectors are read for rows whose bound reaches a query's k-th largest lower bound."""
    vectors = _vectors(spark, sf_dir)
    index = codes.CodeIndex.fit(vectors, cells=32)
    coded = Scratch(spark, "coded").save(index.code(vectors, "vec_id"), "rows")
    found = codes.code_top_k(coded, vectors, index, _queries(vectors), TOP, id_col="vec_id", exact=True)
    return found.select("query_id", "vec_id", F.round("sim", 6).alias("score"), "rank")


def filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors among those of the query's label."""
    vectors = _vectors(spark, sf_dir)
    return search.top_k(vectors, _queries(vectors), TOP, id_col="vec_id", within="label").select("query_id", "vec_id", F.round("sim", 6).alias("score"), "rank")


def mmr_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten of the fifty nearest vectors of each query by marginal relevance at 0.9."""
    vectors = _vectors(spark, sf_dir)
    pool = search.top_k(vectors, _queries(vectors), 50, id_col="vec_id")
    found = search.diversify(pool.join(vectors.select("vec_id", "embedding"), "vec_id"), 10, 0.9, "vec_id")
    return found.select("query_id", "vec_id", "score", "rank")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the largest BM25 score with each passage; blocks of postings that cannot be among them are not read."""
    index = keywords.KeywordIndex.build(_table(spark, sf_dir, "documents"), Scratch(spark, "bm25").path("index"), near="lang")
    found = index.search(_passages(spark, sf_dir), TOP).ranking
    return found.select("query_id", "doc_id", F.round("sim", 6).alias("score"), "rank")


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _sparse(docs: DataFrame, passages: DataFrame) -> DataFrame:
    return search.sparse_top_k(docs, passages, POOL)


def _dense(docs: DataFrame, passages: DataFrame) -> DataFrame:
    return search.top_k(docs, passages, POOL, id_col="doc_id")


def _encoded(spark: SparkSession, sf_dir: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Documents and passages with dense and sparse vectors, from one pass over the texts and saved."""
    model = encode.HashingDual(64)
    docs = scratch.save(model.encode(_table(spark, sf_dir, "documents"), "doc_id", "text"), "documents")
    return docs, scratch.save(model.encode(_passages(spark, sf_dir), "query_id", "query"), "passages")


def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = encode.lexical_weights(_table(spark, sf_dir, "documents"), "doc_id", "text")
    found = _sparse(docs, encode.lexical_weights(_passages(spark, sf_dir), "query_id", "query"))
    return found.select("query_id", "doc_id", F.round("sim", 6).alias("score"), "rank")


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _encoded(spark, sf_dir, Scratch(spark, "hybrid"))
    return search.fuse([_dense(*both), _sparse(*both)], "doc_id", 60, TOP).withColumn("score", F.round("score", 9))


def verbatim_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.verbatim(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def eval_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true documents of a vector are those with another vector of its label; the vector itself is no hit."""
    vectors = _vectors(spark, sf_dir)
    pool = _pool(spark, sf_dir, 500).where(F.col("vec_id") != F.col("query_id"))
    return evaluate.label_metrics(search.document_rank(pool, "doc", TOP), _queries(vectors), vectors, "vec_id", "doc")


def eval_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "methods")
    both = _encoded(spark, sf_dir, scratch)
    dense, sparse = (scratch.save(x.select("query_id", "doc_id", "rank"), n) for x, n in ((_dense(*both), "dense"), (_sparse(*both), "sparse")))
    truth = scratch.save(verbatim_truth(spark, sf_dir).withColumnRenamed("item_id", "query_id"), "truth")
    first = lambda r: r.where(F.col("rank") <= TOP)
    return evaluate.compare({"dense": first(dense), "sparse": first(sparse), "hybrid": search.fuse([dense, sparse], "doc_id", 60, TOP)}, truth, "doc_id")


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.latency(_table(spark, sf_dir, "events"), "value")


def _positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return mining.positives(vectors.withColumnRenamed("vec_id", "query_id"), vectors, "doc", "vec_id", same_id=False)


def positive_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positive(spark, sf_dir).withColumn("sim", F.round("sim", 6))


def _negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = _queries(_vectors(spark, sf_dir)).select("query_id", "doc")
    return mining.hard_negatives(_pool(spark, sf_dir, POOL), truth, "doc", "vec_id", skip_top=5, num_negatives=2)


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _negative(spark, sf_dir).select("query_id", "vec_id", "doc", F.round("sim", 6).alias("sim"), "negative_rank")


def training_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.triples(_queries(_vectors(spark, sf_dir)), _positive(spark, sf_dir), _negative(spark, sf_dir), "query_id", "vec_id")


def epoch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.epoch(_vectors(spark, sf_dir).select(F.col("vec_id").alias("query_id"), "label"), 42, 16)


def vector_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"))
    return corpus.missing_keys(docs, _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key")), "key")


def part_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files in parts of 1,000 characters, of which some are missing by a rule, and one whole file beside them."""
    pieces = _table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", F.length("text").alias("n"), F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(1000))).alias("at"))
    kept = pieces.where((F.col("at") == 0) | ((F.col("doc_id") + F.col("at") / 1000) % 7 != 0))
    name = F.concat(F.lit("t"), F.col("doc_id").cast("string"), F.lit(".zip.part"), F.col("at").cast("string"))
    rows = kept.select(name.alias("name"), F.least(F.lit(1000), F.col("n") - F.col("at")).cast("long").alias("size"))
    return corpus.part_files(rows.unionByName(pieces.where("at = 0").select(F.concat(F.lit("w"), F.col("doc_id").cast("string"), F.lit(".zip")).alias("name"), F.col("n").cast("long").alias("size"))))


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/m/"), F.col("label").cast("string"), F.lit("/"), F.col("vec_id").cast("string"), F.lit("/"))
    spelled = F.format_string("%d.%02d.%02d", 2000 + F.col("label"), 1 + F.col("vec_id") % 12, 1 + F.col("vec_id") % 28)
    name = F.concat(F.lit("f"), F.col("vec_id").cast("string"), F.lit(".json"))
    rows = _table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", path.alias("path"), X.slug(path).alias("slug"), X.file_stem(name).alias("stem"), X.to_day(spelled).alias("day"), X.one_line(F.lit("a\tb\nc")).alias("line"), X.case_type(F.lit("")).alias("kind"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "corpus_filter_dedupe": corpus_filter_dedupe,
    "corpus_stats": corpus_stats,
    "corpus_token_stats": corpus_token_stats,
    "category_histogram": category_histogram,
    "stratified_split": stratified_split,
    "split_counts": split_counts,
    "query_sets": query_sets,
    "rejection_report": rejection_report,
    "adjacent_same_case_rate": adjacent_same_case_rate,
    "chunk_300_100": _chunks(300, 100),
    "chunk_200_0": _chunks(200, 0),
    "chunk_counts_by_config": chunk_counts_by_config,
    "l2_normalize": l2_normalize,
    "vector_literal_roundtrip": vector_literal_roundtrip,
    "dense_topk": dense_topk,
    "dense_doc_rank": dense_doc_rank,
    "distinct_on_dedupe": distinct_on_dedupe,
    "cell_topk": cell_topk,
    "code_topk": code_topk,
    "filtered_topk": filtered_topk,
    "mmr_rerank": mmr_rerank,
    "bm25_topk": bm25_topk,
    "sparse_topk": sparse_topk,
    "hybrid_rrf": hybrid_rrf,
    "verbatim_truth": verbatim_truth,
    "eval_dense": eval_dense,
    "eval_methods": eval_methods,
    "latency_percentiles": latency_percentiles,
    "positive_chunk": positive_chunk,
    "hard_negatives": hard_negatives,
    "training_triples": training_triples,
    "epoch_batches": epoch_batches,
    "vector_reconciliation": vector_reconciliation,
    "part_contiguity": part_contiguity,
    "scalar_functions": scalar_functions,
}

#: All but ``cell_topk``, which is approximate: tests hold its recall against exact search.
ORACLE_SQL: dict[str, str] = {
    "corpus_filter_dedupe": sql.CORPUS,
    "corpus_stats": sql.STATS,
    "corpus_token_stats": sql.TOKEN_STATS,
    "category_histogram": sql.HISTOGRAM,
    "stratified_split": sql.SPLIT,
    "split_counts": sql.SPLIT_COUNTS,
    "query_sets": sql.QUERY_SETS,
    "rejection_report": sql.REJECTIONS,
    "adjacent_same_case_rate": sql.ADJACENT,
    "chunk_300_100": sql.chunks(300, 100),
    "chunk_200_0": sql.chunks(200, 0),
    "chunk_counts_by_config": sql.chunk_counts(CONFIGS),
    "l2_normalize": sql.L2,
    "vector_literal_roundtrip": sql.LITERAL,
    "dense_topk": sql.dense_topk(TOP),
    "dense_doc_rank": sql.dense_doc_rank(POOL, TOP),
    "distinct_on_dedupe": sql.distinct_on(POOL),
    "code_topk": sql.dense_topk(TOP),
    "filtered_topk": sql.filtered_topk(TOP),
    "mmr_rerank": sql.mmr(50, 10),
    "bm25_topk": sql.bm25(TOP),
    "sparse_topk": sql.SPARSE,
    "hybrid_rrf": sql.HYBRID,
    "verbatim_truth": sql.VERBATIM,
    "eval_dense": sql.EVAL_DENSE,
    "eval_methods": sql.EVAL_METHODS,
    "latency_percentiles": sql.LATENCY,
    "positive_chunk": sql.POSITIVE,
    "hard_negatives": sql.NEGATIVE,
    "training_triples": sql.TRIPLES,
    "epoch_batches": sql.EPOCH,
    "vector_reconciliation": sql.RECONCILE,
    "part_contiguity": sql.PARTS,
    "scalar_functions": sql.SCALARS,
}
