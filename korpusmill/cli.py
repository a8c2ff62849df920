"""Command line: ``python -m korpusmill.cli build|load|evaluate|mine --help``."""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from korpusmill.operators import codes, evaluate, mining, search
from korpusmill.operators import corpus as prepare
from korpusmill.operators.encode import HashingEncoder
from korpusmill.sources import cases
from korpusmill.store import ChunkStore


def build(spark: SparkSession, a: argparse.Namespace) -> list[dict]:
    """Corpus table, split and question sets of raw and label documents; returns the rejection counts."""
    raw = cases.read_cases(spark, a.cases)
    rows = cases.corpus(raw, id_from_file=False)
    cases.write_corpus(rows, f"{a.out}/corpus")
    split = prepare.split_of(spark.read.parquet(f"{a.out}/corpus").select("case_no", "case_type"), "case_no", "case_type", a.train_ratio, a.seed)
    split.write.mode("overwrite").parquet(f"{a.out}/split")
    split = spark.read.parquet(f"{a.out}/split")
    labels = prepare.questions(cases.read_labels(spark, a.labels))
    routed = prepare.route(labels, split, "case_no", "case_no").select(F.col("question").alias("query"), F.array("case_no").alias("case_ids"), "split")
    routed.write.mode("overwrite").partitionBy("split").json(f"{a.out}/queries")
    return [r.asDict() for r in cases.blank_rows(raw).collect()]


def encoder_of(a: argparse.Namespace):
    """The encoder that ``--encoder package.module:name`` names, called with the dimension; the hashing one if none is named."""
    if not a.encoder:
        return HashingEncoder(a.dim)
    module, _, name = a.encoder.partition(":")
    if not name:
        raise ValueError("--encoder is package.module:name")
    return getattr(importlib.import_module(module), name)(a.dim)


def _rows(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows = ChunkStore(spark, a.store).read(a.model, a.chunk_size, a.overlap)
    return rows.withColumn("chunk_id", F.concat_ws("/", "case_no", F.lpad(F.col("chunk_index").cast("string"), 9, "0")))


def _index(rows: DataFrame, a: argparse.Namespace) -> tuple[codes.CodeIndex, DataFrame]:
    """Fit and save the index of a configuration below ``--index``."""
    made = codes.CodeIndex.fit(rows, cells=a.cells)
    made.save(rows.sparkSession, a.index)
    return made, made.save_rows(made.code(rows, carry=("case_no",)), a.index)


def load(spark: SparkSession, a: argparse.Namespace) -> list[dict]:
    """Chunks of a corpus table with vectors into a store, with ``--index`` their index as well; returns the store's report."""
    store = ChunkStore(spark, a.store)
    store.load(spark.read.parquet(a.corpus), a.model, a.chunk_size, a.overlap, encoder_of(a))
    if a.index:
        _index(_rows(spark, a), a)
    return [r.asDict() for r in store.report().collect()]


def _retriever(spark: SparkSession, a: argparse.Namespace) -> search.DenseExact:
    rows, options = _rows(spark, a), {"encoder": encoder_of(a), "pool_k": a.pool_k}
    if a.mode == "exact":
        return search.DenseExact(rows, **options)
    if a.mode == "cells":
        index = search.CellIndex.load(spark, f"{a.index}/centroids") if a.index else search.CellIndex.fit(rows, cells=a.cells)
        return search.DenseCells(index.assign(rows), index, a.probes, **options)
    if a.index:
        index, coded = codes.CodeIndex.load(spark, a.index), codes.CodeIndex.load_rows(spark, a.index)
    else:
        index = codes.CodeIndex.fit(rows, cells=a.cells)
        coded = index.code(rows, carry=("case_no",))
    return codes.DenseCodes(rows, index, coded, a.probes, **options)


def evaluation(spark: SparkSession, a: argparse.Namespace) -> list[dict]:
    """Metrics of a query set (one JSON array) against a stored configuration, with ``--latency`` those of the time a query takes as well."""
    queries, found = cases.read_queries(spark, a.queries, a.limit), _retriever(spark, a)
    own, most = queries.select("query_id", "query"), max(evaluate.CUTS)
    row = evaluate.metrics(found.retrieve(own, most), evaluate.explode_truth(queries), "case_no").first().asDict()
    if a.latency:
        row |= evaluate.latency(evaluate.timed(found, own, most, a.latency), "ms_per_query").first().asDict()
    return [row]


def mine(spark: SparkSession, a: argparse.Namespace) -> list[dict]:
    """Pairs and triples of a query set against a stored configuration, as JSON lines below ``--out``; returns how many there are and how many queries went without."""
    rows, found = _rows(spark, a), _retriever(spark, a)
    queries = cases.read_queries(spark, a.queries, a.limit)
    truth = evaluate.explode_truth(queries)
    vectors = found.vectors(queries.select("query_id", "query")).join(truth, "query_id")
    best = mining.positives(vectors, rows, carry=("chunk_text",))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("sim", 6).desc(), "chunk_id"))
    best = best.withColumn("nth", nth).where("nth = 1").drop("nth")
    pairs = best.join(queries.select("query_id", "query"), "query_id").select("query_id", "query", F.col("chunk_text").alias("positive_chunk"), "case_no", "sim")
    pairs.write.mode("overwrite").parquet(f"{a.out}/rows/pairs")
    pairs = spark.read.parquet(f"{a.out}/rows/pairs")
    negative = mining.hard_negatives(found.pool(queries.select("query_id", "query")), truth, skip_top=a.skip_top, num_negatives=a.negatives)
    texts = rows.select("chunk_id", F.col("chunk_text").alias("hard_negative_chunk"))
    triples = pairs.join(negative.join(texts, "chunk_id"), "query_id").select("query_id", "query", "positive_chunk", "hard_negative_chunk", "negative_rank")
    triples.write.mode("overwrite").parquet(f"{a.out}/rows/triples")
    triples = spark.read.parquet(f"{a.out}/rows/triples")
    for name, table in (("pairs", pairs), ("triples", triples)):
        table.drop("query_id", "negative_rank").write.mode("overwrite").json(f"{a.out}/{name}")
    counts = [{"reason": n, "n": t.count()} for n, t in (("pairs", pairs), ("triples", triples))]
    return counts + [r.asDict() for part in (mining.without_positive(queries, pairs), mining.without_negative(pairs, triples)) for r in part.collect()]


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="korpusmill")
    sub = out.add_subparsers(required=True)
    p = sub.add_parser("build", help="corpus, split and question sets")
    p.add_argument("cases", nargs="+", help="folders of raw documents, the first has precedence")
    p.add_argument("--labels", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--train-ratio", type=float, default=0.85)
    p.add_argument("--seed", type=int, default=42)
    p.set_defaults(run=build)
    for name, run, text in (("load", load, "chunks and vectors into a store"), ("evaluate", evaluation, "metrics of a query set"), ("mine", mine, "pairs and triples with hard negatives")):
        p = sub.add_parser(name, help=text)
        p.add_argument("--store", required=True)
        p.add_argument("--model", default="hashing", help="name of the vectors in the store")
        p.add_argument("--encoder", help="package.module:name of what makes them, called with the dimension")
        p.add_argument("--dim", type=int, default=64)
        p.add_argument("--chunk-size", type=int, default=300)
        p.add_argument("--overlap", type=int, default=100)
        p.add_argument("--index", help="folder of the configuration's index: written by load, read by the others")
        p.add_argument("--cells", type=int, default=64)
        p.set_defaults(run=run)
        if name == "load":
            p.add_argument("--corpus", required=True)
            continue
        p.add_argument("--queries", required=True)
        p.add_argument("--limit", type=int)
        p.add_argument("--mode", choices=("exact", "cells", "codes"), default="exact")
        p.add_argument("--pool-k", type=int, default=500)
        p.add_argument("--probes", type=int, default=48)
        if name == "evaluate":
            p.add_argument("--latency", type=int, metavar="BATCHES", help="also time the search, in so many batches")
        else:
            p.add_argument("--out", required=True)
            p.add_argument("--skip-top", type=int, default=5)
            p.add_argument("--negatives", type=int, default=1)
    return out


def main(argv: list[str] | None = None) -> list[dict]:
    a = parser().parse_args(argv)
    rows = a.run(SparkSession.builder.getOrCreate(), a)
    print(json.dumps(rows, ensure_ascii=False, default=str))
    return rows


if __name__ == "__main__":
    main()
