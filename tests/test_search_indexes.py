"""Product codes, inverted index, diversity, category filters, and one scan for any number of query blocks, against brute force."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from korpusmill.operators import codes, encode, keywords, search
from korpusmill.storage import Scratch

LARGE = "/root/testdata/sf0.1"


def unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def nearest(rows, queries, k):
    """{query: [(id, rounded cosine)]} by plain numpy, of (id, vector, category) rows; a category of None in a query is any."""
    out = {}
    for q, v, c in queries:
        sims = [(-round(float(unit(np.array(x)) @ unit(np.array(v))), 6), i) for i, x, d in rows if c is None or c == d]
        out[q] = [(i, -s) for s, i in sorted(sims)[:k]]
    return out


def as_dict(found, id_col="vec_id"):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r[id_col], round(r.sim, 6)))
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{LARGE}/embeddings.parquet").select("vec_id", F.expr("vec_id div 4").alias("doc"), "embedding", "label")


@pytest.fixture(scope="module")
def queries(vectors):
    return vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    """Fitted at the defaults, saved with its rows, and loaded again."""
    path = str(tmp_path_factory.mktemp("index"))
    made = codes.CodeIndex.fit(vectors)
    made.save(spark, path)
    loaded = codes.CodeIndex.load(spark, path)
    assert np.array_equal(loaded.words, made.words) and np.array_equal(loaded.centroids, made.centroids)
    return loaded, made.save_rows(made.code(vectors, "vec_id", carry=("doc", "label")), path)


@pytest.mark.parametrize("k", [20, 500])
def test_recall_and_whole_vectors_read_at_the_defaults(spark, vectors, queries, index, k):
    made, coded = index
    found = codes.code_top_k(coded, vectors, made, queries, k, id_col="vec_id").collect()
    exact = {(r.query_id, r.vec_id) for r in search.top_k(vectors, queries, k, id_col="vec_id").collect()}
    assert len(found) == len(exact) == 40 * k
    assert len(exact & {(r.query_id, r.vec_id) for r in found}) >= 0.9 * len(exact)
    assert sum({r.query_id: r.compared for r in found}.values()) <= 0.2 * 40 * vectors.count()


def test_certified_search_is_exact_and_reads_few_vectors(spark, vectors, queries, index):
    made, coded = index
    found = codes.code_top_k(coded, vectors, made, queries, 20, id_col="vec_id", exact=True)
    assert as_dict(found) == as_dict(search.top_k(vectors, queries, 20, id_col="vec_id"))
    assert sum({r.query_id: r.compared for r in found.collect()}.values()) <= 0.2 * 40 * vectors.count()
    inside = codes.code_top_k(coded, vectors, made, queries, 20, id_col="vec_id", exact=True, within="label")
    assert as_dict(inside) == as_dict(search.top_k(vectors, queries, 20, id_col="vec_id", within="label"))


def test_filtered_search_by_codes_has_k_rows_while_there_are_k(spark, vectors, queries, index):
    made, coded = index
    rare = coded.where("label = 3 AND vec_id < 300 OR label <> 3")
    counts = {r.label: r["count"] for r in rare.groupBy("label").count().collect()}
    found = codes.code_top_k(rare, vectors, made, queries, 50, id_col="vec_id", within="label", nprobe=4, carry=("label",)).collect()
    want = {r.query_id: min(50, counts[r.label]) for r in queries.collect()}
    assert Counter(r.query_id for r in found) == want and min(want.values()) < 50
    assert all(r.label == q.label for q in queries.collect() for r in found if r.query_id == q.query_id)
    wide = codes.code_top_k(coded, vectors, made, queries, 20, id_col="vec_id", within="label").collect()
    exact = {(r.query_id, r.vec_id) for r in search.top_k(vectors, queries, 20, id_col="vec_id", within="label").collect()}
    assert len(exact & {(r.query_id, r.vec_id) for r in wide}) >= 0.9 * len(exact)


def test_codes_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [float(k % 5), 1.0, k / 7], k % 2) for k in range(60)] + [(100, None, 0), (101, [1.0], 0), (102, [nan, 1.0, 1.0], 0), (103, [inf, 1.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 0), (105, [0.0, 0.0, 0.0], 0), (106, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    asked = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0), (2, [0.0, 0.0, 0.0], 1), (3, [1.0], 0), (4, None, 0), (None, [1.0, 1.0, 1.0], 0), (5, [1.0, 0.0, 0.0], None), (6, [-1.0, 5.0, 0.0], 7)], "query_id long, embedding array<double>, label int")
    made = codes.CodeIndex.fit(df, cells=4)
    coded = made.code(df, "vec_id", carry=("label",))
    assert coded.count() == 61
    usable = [(i, v, c) for i, v, c in rows if i is not None and (i < 100 or i == 105)]
    for k in (3, 80):
        want = nearest(usable, [(1, [1.0, 2.0, 3.0], None), (2, [0.0] * 3, None), (5, [1.0, 0.0, 0.0], None), (6, [-1.0, 5.0, 0.0], None)], k)
        assert as_dict(codes.code_top_k(coded, df, made, asked, k, id_col="vec_id", exact=True)) == want
        want = nearest(usable, [(1, [1.0, 2.0, 3.0], 0), (2, [0.0] * 3, 1)], k)
        assert as_dict(codes.code_top_k(coded, df, made, asked, k, id_col="vec_id", exact=True, within="label")) == want
        assert as_dict(search.top_k(df, asked.where("size(embedding) = 3"), k, id_col="vec_id", within="label")) == want
    assert codes.code_top_k(coded, df, made, asked.limit(0), 3, id_col="vec_id").count() == 0
    nothing = codes.CodeIndex.fit(df.limit(0))
    assert codes.code_top_k(nothing.code(df.limit(0), "vec_id"), df.limit(0), nothing, asked, 3, id_col="vec_id").count() == 0


def test_retriever_over_codes(spark, vectors, queries, index):
    made, coded = index
    exact = search.DenseExact(vectors, id_col="vec_id", doc_col="doc").retrieve(queries, 5).orderBy("query_id", "rank").collect()
    found = codes.DenseCodes(vectors, made, coded, id_col="vec_id", doc_col="doc", exact=True).retrieve(queries, 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc, r["rank"]) for r in found] == [(r.query_id, r.doc, r["rank"]) for r in exact]


def test_five_blocks_take_one_scan_and_encode_once(spark, monkeypatch, tmp_path):
    encoder, calls = encode.HashingEncoder(16), spark.sparkContext.accumulator(0)
    docs = spark.createDataFrame([(k, k // 2, f"w{k % 9} w{k % 5} v{k}") for k in range(200)], "chunk_id long, case_no long, chunk_text string").repartition(3)
    encoder.encode(docs, "chunk_text", "embedding").write.parquet(str(tmp_path / "docs"))
    corpus = spark.read.parquet(str(tmp_path / "docs"))

    class Counting(encode.HashingEncoder):
        def encode(self, rows, text, out):
            @F.udf("string")
            def seen(t):
                calls.add(1)
                return t

            return super().encode(rows.withColumn(text, seen(text)), text, out)

    asked = spark.createDataFrame([(k, f"w{k % 9} v{k}") for k in range(40)], "query_id long, query string")
    want = as_dict(search.DenseExact(corpus, encoder).pool(asked), "chunk_id")
    monkeypatch.setattr(search, "BLOCK_BYTES", 8 * 16 * 8)
    monkeypatch.setattr(search, "HELD_BYTES", 2000)
    found = search.DenseExact(corpus, Counting(16)).pool(asked)
    assert as_dict(found, "chunk_id") == want and calls.value == 40
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation ") == 1
    weights = encode.lexical_weights(docs, "chunk_id", "chunk_text")
    asked = encode.lexical_weights(asked, "query_id", "query")
    one = as_dict(search.sparse_top_k(weights, asked, 7, id_col="chunk_id"), "chunk_id")
    monkeypatch.setattr(search, "BLOCK_TERMS", 16)
    assert as_dict(search.sparse_top_k(weights, asked, 7, id_col="chunk_id"), "chunk_id") == one


def plain_bm25(docs, queries, k):
    counts = {i: Counter((t or "").lower().split()) for i, t in docs}
    mean, n = sum(c.total() for c in counts.values()) / len(counts), len(counts)
    df = Counter(t for c in counts.values() for t in c)
    out = {}
    for q, text in queries:
        scores = []
        for i, c in counts.items():
            own = [(m, t) for t, m in Counter((text or "").lower().split()).items() if t in c]
            if own:
                score = sum(m * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * c.total() / mean)) for m, t in own)
                scores.append((-round(score, 6), i))
        if scores:
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize(("k", "ranges", "near"), [(3, 4, "lang"), (100, 4, None), (1, 1, None), (5, 1000, "lang")])
def test_keyword_search_equals_full_scoring(spark, tmp_path, k, ranges, near):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(words[: 20 + i % 40], rng.integers(0, 30)))) for i in range(150)] + [(900, None), (901, " "), (902, "W1 w1 w1")]
    rows = spark.createDataFrame([(i, t, "a" if i % 3 else None) for i, t in docs] + [(None, "w1", "a")], "doc_id long, text string, lang string").withColumn("term", F.lit(1))
    queries = [(j, " ".join(rng.choice(words, 4))) for j in range(12)] + [(50, "w1 w1 zzz"), (51, "zzz"), (52, None), (None, "w1")]
    made = keywords.KeywordIndex.build(rows, str(tmp_path / "i"), near=near, range_docs=ranges)
    found = keywords.KeywordIndex(spark, made.path).search(spark.createDataFrame(queries, "query_id long, query string"), k)
    assert as_dict(found.ranking, "doc_id") == plain_bm25(docs, queries[:-1], k)
    report = found.report.first()
    assert report.queries == 13 and 0 < report.blocks_read <= report.blocks
    if k == 1:
        assert report.blocks_read < 0.8 * report.blocks
    empty = keywords.KeywordIndex.build(rows.limit(0), str(tmp_path / "e"), near=near)
    assert empty.search(spark.createDataFrame(queries, "query_id long, query string"), k).ranking.count() == 0


def test_ranges_give_the_best_rows_only_and_queries_go_in_blocks(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(40)]
    docs = [(f"d{i:03d}", " ".join(rng.choice(words, 12))) for i in range(400)]
    queries = [(f"q{j}", " ".join(rng.choice(words, 6))) for j in range(15)] + [("zz", "zz")]
    made = keywords.KeywordIndex.build(spark.createDataFrame(docs, "doc_id string, text string"), str(tmp_path / "i"), range_docs=200)
    asked = keywords.terms_of(spark.createDataFrame(queries, "query_id string, query string"), "query_id", "query").join(made.terms, "term").select("query_id", "term", F.col("idf").alias("w"))
    pairs = asked.select("query_id").distinct().crossJoin(made.ranges.select("range")).withColumn("least", F.lit(0.0))
    n = made.ranges.count()
    assert made._scores(pairs, asked, 3).count() <= 15 * n * 4 < 15 * 400 // 2  # ties of the third may stay
    assert made._scores(pairs.withColumn("least", F.lit(1e9)), asked, 3).count() == 0
    monkeypatch.setattr(keywords, "SMALL_ROWS", 30)
    monkeypatch.setattr(keywords, "SLICE", 1000)
    found = made.search(spark.createDataFrame(queries, "query_id string, query string"), 5).ranking
    assert as_dict(found, "doc_id") == plain_bm25(docs, queries, 5)


def test_blocks_are_skipped_on_the_test_table(spark, tmp_path):
    docs, asked = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    found = keywords.KeywordIndex.build(docs, str(tmp_path / "i"), near="lang").search(asked.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), 10)
    report = found.report.first()
    print(report)
    assert report.blocks_read < report.blocks


def plain_mmr(pool, k, weight):
    placed = []
    while len(placed) < min(k, len(pool)):
        rest = [(i, s, v) for i, s, v in pool if i not in [p[0] for p in placed]]
        score = lambda s, v: round(weight * s - (1 - weight) * max((float(unit(v) @ unit(p[2])) for p in placed), default=0), 6)
        i, s, v = min(rest, key=lambda r: (-score(r[1], r[2]), r[0]))
        placed.append((i, score(s, v), v))
    return [(i, s) for i, s, _ in placed]


def test_diversity_equals_plain_python(spark):
    rng = np.random.default_rng(2)
    pools = {q: [(i, float(rng.choice([0.5, 0.25, rng.random()])), rng.normal(size=4).round(1)) for i in range(n)] for q, n in ((1, 12), (2, 1), (3, 5))}
    pools[1][3] = (3, 0.9, pools[1][4][2])
    rows = [(q, i, s, v.tolist()) for q, own in pools.items() for i, s, v in own] + [(3, 99, 0.1, None), (3, None, 0.9, [1.0] * 4), (3, 98, -1.0, [1.0])]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, sim double, embedding array<double>")
    for k, weight in ((4, 0.9), (20, 0.5), (3, 0.0)):
        got = {}
        for r in search.diversify(df, k, weight).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
        assert {q: [i for i, _ in own] for q, own in got.items()} == {q: [i for i, _ in plain_mmr(own, k, weight)] for q, own in pools.items()}
        assert all(abs(a[1] - b[1]) < 1e-9 for q, own in pools.items() for a, b in zip(got[q], plain_mmr(own, k, weight), strict=True))
    assert search.diversify(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="weight"):
        search.diversify(df, 3, 1.5)


def test_spread_deals_few_partitions_only(spark):
    few, many = spark.range(100).coalesce(1), spark.range(0, 100, 1, 20)
    assert encode.spread(few).rdd.getNumPartitions() >= 8 and encode.spread(many) is many
    docs = spark.read.option("maxPartitionBytes", 1000).parquet(f"{LARGE}/documents.parquet").select("doc_id", "text")
    parts = encode.spread(docs, encode.SMALL_BYTES).groupBy(F.spark_partition_id()).count().count()
    assert parts == spark.sparkContext.defaultParallelism and encode.spread(docs, 1000).groupBy(F.spark_partition_id()).count().count() >= 1


def test_scratch_and_category_pruning(spark, vectors, queries):
    by = Scratch(spark, "t").save(vectors, "by", ["label"])
    asked = queries.where("label IN (1, 2)")
    found = search.top_k(by, asked, 9, id_col="vec_id", within="label")
    assert as_dict(found) == as_dict(search.top_k(vectors, asked, 9, id_col="vec_id", within="label"))
    assert "label" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
