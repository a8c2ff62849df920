from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF
from korpusmill.functions import text as X
from korpusmill.functions import vector as V
from korpusmill.operators import chunk, corpus, encode, evaluate, mining, search
from korpusmill.plans import queries as plans
from korpusmill.schema import WHITE


def test_strip_equals_python(spark):
    assert len(WHITE) == 29
    texts = [*(f"{w}a{w}b{w}" for w in WHITE), None, "", WHITE]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.strip("t").alias("s")).collect()
    assert {r.i: r.s for r in got} == {i: (t or "").strip() for i, t in enumerate(texts)}


def test_dates_names_defaults(spark):
    df = spark.createDataFrame([("20240131", "a.b.json", ""), ("2024.01.31", "x", None), ("2024. 1. 31.", ".hid", "c"), ("no date", "d.json", "c"), (None, "", "c")], "d string, f string, k string")
    rows = df.select(X.to_day("d").cast("string").alias("day"), X.file_stem("f").alias("stem"), X.case_type("k").alias("kind")).collect()
    assert [r.day for r in rows] == ["2024-01-31", "2024-01-31", "2024-01-31", None, None]
    assert [r.stem for r in rows] == ["a.b", "x", ".hid", "d", ""]
    assert [r.kind for r in rows] == ["기타", "기타", "c", "c", "c"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    rows = df.select(V.dot("a", "b").alias("dot"), V.l2_normalize("a").alias("u"), V.cosine_distance("a", "b").alias("d"), V.to_literal("a").alias("t")).collect()
    assert rows[0].dot == 24 and rows[0].u == [0.6, 0.8] and abs(rows[0].d - 0.04) < 1e-12 and rows[0].t == "[3.000000,4.000000]"
    assert rows[1].u == [0.0, 0.0] and rows[1].d is None and rows[2].dot is None
    back = spark.createDataFrame([("[1.5,-2]",), ("[]",), ("x",)], "t string").select(V.from_literal("t").alias("v")).collect()
    assert [r.v for r in back] == [[1.5, -2.0], [], None]
    maps = spark.createDataFrame([({"a": 1.0, "b": 2.0}, {"b": 3.0, "c": 1.0})], "a map<string,float>, b map<string,float>")
    assert maps.select(V.sparse_dot("a", "b").alias("d")).first().d == 6


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n　😀", max_size=80), st.integers(1, 12), st.integers(0, 11))
def test_chunks_cover_the_text(text, size, overlap):
    if overlap >= size:
        with pytest.raises(ValueError):
            chunk.chunk_text(text, size, overlap)
        return
    own, cut = text.strip(), chunk.chunk_text(text, size, overlap)
    step = size - overlap
    every = [own[i : i + size] for i in range(0, len(own), step)]
    assert len(every) == math.ceil(len(own) / step)
    assert [c for *_, c in cut] == [c for c in every if c.strip()]
    assert [k for k, *_ in cut] == list(range(len(cut)))
    assert all(own[i : i + size] == c for _, i, c in cut)


def test_chunk_forms_agree_and_golden_numbers(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " 　\n"), (-4, "x" * 300), (-5, "x" * 301), (-6, "a" + " " * 700 + "b")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(odd)
    names = ["doc_id", "chunk_index", "char_offset", "chunk_text"]
    one = {tuple(r) for r in chunk.chunks(both, "doc_id", "text").select(*names).collect()}
    assert one == {tuple(r) for r in chunk.chunks_sql(both, "doc_id", "text").select(*names).collect()}
    assert not {r for r in one if r[0] in (-1, -2, -3)} and len([r for r in one if r[0] == -4]) == 2
    assert [r[1:3] for r in sorted(r for r in one if r[0] == -6)] == [(0, 0), (1, 600)]
    counts = chunk.chunk_counts(both, "text", [(300, 100)]).first()
    assert counts.n_chunks == len(one)


def test_first_wins_and_split(spark):
    df = spark.createDataFrame([("k", 1, "f2"), ("k", 0, "f9"), ("k", 0, "f3"), ("m", 1, "f1")], "key string, ord int, file string")
    assert {(r.key, r.file) for r in corpus.first_wins(df, "key", ["ord", "file"]).collect()} == {("k", "f3"), ("m", "f1")}
    rows = [(i, "big" if i % 10 else None if i % 20 else "small") for i in range(400)]
    split = corpus.split_of(spark.createDataFrame(rows, "key long, kind string"), "key", "kind").collect()
    assert sorted(r.key for r in split) == list(range(400))
    for kind in ("big", "small", None):
        own = [r for r in split if r.kind == kind]
        assert sum(r.split == "train" for r in own) == round(len(own) * 0.85)
    again = corpus.split_of(spark.createDataFrame(rows[::-1], "key long, kind string").repartition(3), "key", "kind").collect()
    assert {(r.key, r.split) for r in again} == {(r.key, r.split) for r in split}


def test_adjacent_rate_over_partitions(spark):
    rng = np.random.default_rng(3)
    keys = [str(k) if k else None for k in rng.integers(0, 3, 500).tolist()]
    got = corpus.adjacent_same_rate(spark.createDataFrame(list(enumerate(keys)), "pos long, key string"), "key", ["pos"]).first()
    want = sum(a is not None and a == b for a, b in zip(keys, keys[1:]))
    assert (got.n_pairs, got.n_same) == (499, want)
    assert corpus.adjacent_same_rate(spark.createDataFrame([], "pos long, key string"), "key", ["pos"]).first().rate is None


def test_questions_and_rejections(spark):
    labels = spark.createDataFrame(
        [(("c1",), [("q1", "a"), (" ", "a"), (None, None)]), (("c2",), None), ((None,), [("q", "a")])],
        "info struct<caseNoID:string>, jdgmnInfo array<struct<question:string,answer:string>>",
    )
    assert {(r.case_no, r.pos, r.question) for r in corpus.questions(labels).collect()} == {("c1", 0, "q1"), (None, 0, "q")}
    docs = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "z"), ("", "z"), ("b", " ")], "key string, text string")
    queries = spark.createDataFrame([("a", "q"), ("a", " "), ("b", "q"), (None, "q")], "doc string, query string")
    got = {r.reason: r.n for r in corpus.rejections(docs, "key", "text", queries, "doc", "query").collect()}
    assert got == {"no_content": 1, "no_key": 2, "duplicate": 1, "no_match": 2, "empty_question": 1}


def _split_vectors(spark, sf):
    v = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").withColumn("doc", F.expr("vec_id div 4"))
    queries = v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    chunks = v.where("vec_id % 10 <> 0")
    truth = queries.join(chunks.select("label", F.col("doc")), "label").select("query_id", "doc")
    return queries, chunks, truth


@pytest.mark.parametrize(("sf", "want"), [("sf0.001", [50, 0.32, 0.76, 0.96, 1.0, 0.4902]), ("sf0.1", [200, 0.325, 0.825, 0.975, 1.0, 0.5346])])
def test_dense_evaluation_golden(spark, sf, want):
    queries, chunks, truth = _split_vectors(spark, sf)
    ranked = search.DenseExact(chunks, pool_k=500, id_col="vec_id", doc_col="doc").retrieve(queries, 20)
    assert list(evaluate.metrics(ranked, truth, "doc").first()) == want


def test_top_k_equals_brute_force_in_blocks_with_ties(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.integers(-1, 2, (300, 6)).astype(np.float32)  # many ties and some zero vectors
    corpus_rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0])]
    df = spark.createDataFrame(corpus_rows, "chunk_id long, embedding array<float>").repartition(5)
    q = df.where("chunk_id % 7 = 0").withColumnRenamed("chunk_id", "query_id")
    monkeypatch.setattr(search, "SLICE", 200)
    monkeypatch.setattr(search, "BLOCK_BYTES", 700)
    got = {(r.query_id, r["rank"]): r.chunk_id for r in search.top_k(df, q, 9).collect()}
    unit = x / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-12)
    for i in range(0, 300, 7):
        order = sorted(range(300), key=lambda j: (-round(float(unit[i] @ unit[j]), 6) + 0.0, j))[:9]
        assert [got[i, k + 1] for k in range(9)] == order
    assert search.top_k(df, q.limit(0), 3).count() == 0


def test_queries_of_several_lengths(spark):
    """A longer query vector is searched among the rows of its length and takes nothing from the others."""
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, None)], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.1]), (1, [1.0, 0.0, 0.0]), (2, [1.0]), (3, []), (4, None)], "query_id long, embedding array<float>")
    want = [(0, 1, 1), (0, 2, 2), (1, 3, 1)]
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in search.top_k(df, q, 5).collect()) == sorted((a, c, b) for a, b, c in want)
    index = search.CellIndex(np.eye(2))
    got = search.top_k(index.assign(df), q, 5, probes=index.probes(1)).collect()
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in got) == want


def test_cells_recall_at_the_parameters_in_use(spark):
    sf_dir = "/root/testdata/sf0.1"
    exact = {(r.query_id, r.vec_id) for r in plans.dense_topk(spark, sf_dir).collect()}
    near = {(r.query_id, r.vec_id) for r in plans.cell_topk(spark, sf_dir).collect()}
    assert len(near) == len(exact) and len(exact & near) / len(exact) >= 0.9
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.expr("vec_id div 4").alias("case_no"), "embedding")
    q = v.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    index = search.CellIndex.fit(v)
    exact, near = ({(r.query_id, r.chunk_id) for r in x.pool(q).collect()} for x in (search.DenseExact(v), search.DenseCells(index.assign(v), index)))
    assert len(near) == len(exact) == 40 * 500 and len(exact & near) / len(exact) >= 0.9


def test_cells_go_on_while_there_are_too_few_rows(spark):
    """Ten rows a cell, some of which cannot be ranked: a query for twelve goes on from its nearest cell."""
    index = search.CellIndex(np.eye(4))
    rows = [(10 * c + i, [float(c == j) + (i / 100) for j in range(4)]) for c in range(4) for i in range(10)] + [(None, [1.0, 0.0, 0.0, 0.0]), (90, [float("nan")] * 4), (91, [1.0])]
    df = index.assign(spark.createDataFrame(rows, "chunk_id long, embedding array<double>"))
    q = spark.createDataFrame([(0, [1.0, 0.2, 0.0, 0.0])], "query_id long, embedding array<double>")
    got = lambda k: {r.chunk_id for r in search.top_k(df, q, k, probes=index.probes(1)).collect()}
    assert got(5) <= set(range(10)) and len(got(12)) == 12 and got(12) <= set(range(20)) and got(99) == set(range(40))


def test_pool_is_cut_before_documents(spark):
    """A document whose chunks are all outside the pool is not ranked, and the order is by score, not by document."""
    rows = [(1, 9, [1.0, 0.0]), (2, 9, [0.9, 0.1]), (3, 1, [0.5, 0.5]), (4, 2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "chunk_id long, case_no long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r.case_no, r["rank"]) for r in search.DenseExact(df, pool_k=3).retrieve(q, 20).orderBy("rank").collect()] == [(9, 1), (1, 2)]
    assert [r.case_no for r in search.DenseExact(df, pool_k=2).retrieve(q, 20).collect()] == [9]


def test_fuse(spark):
    a = spark.createDataFrame([(0, "x", 1), (0, "y", 2)], "query_id long, doc string, rank int")
    b = spark.createDataFrame([(0, "y", 1), (0, "x", 2), (0, "z", 3)], "query_id long, doc string, rank int")
    got = search.fuse([a, b], "doc").orderBy("rank").collect()
    assert [r.doc for r in got] == ["x", "y", "z"]  # tie: the first ranking decides
    assert abs(got[0].score - (1 / 61 + 1 / 62)) < 1e-12
    assert [r.doc for r in search.fuse([b, a], "doc", top_n=1).collect()] == ["y"]


def test_metrics_of_nothing_and_misses(spark):
    ranked = spark.createDataFrame([(0, "a", 2), (0, "b", 1)], "query_id long, doc string, rank int")
    truth = spark.createDataFrame([(0, "a"), (0, "q"), (1, "a")], "query_id long, doc string")
    got = evaluate.metrics(ranked, truth, "doc").first()
    assert list(got) == [2, 0.0, 0.5, 0.5, 0.5, 0.25]
    empty = evaluate.metrics(ranked, truth.limit(0), "doc").first()
    assert empty.queries == 0 and empty["recall@1"] is None and empty["mrr@10"] is None


def test_latency_equals_numpy(spark):
    x = np.random.default_rng(0).exponential(10, 501)
    got = evaluate.latency(spark.createDataFrame([(float(v),) for v in x], "ms double"), "ms").first()
    assert np.allclose(list(got), [round(v, 2) for v in (x.mean(), *np.percentile(x, [50, 95, 99]))], atol=0.011)


def test_percentiles_in_passes_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "BUFFER_ROWS", 10)
    rng, inf = np.random.default_rng(4), float("inf")
    columns = (rng.exponential(10, 3001), rng.integers(0, 3, 500).astype(float), np.full(40, 2.5), np.append(rng.normal(size=300), [1e300, -1e300]), np.append(rng.normal(size=97), [inf, inf, -inf, 1.7e308, -1.7e308, 0.0, -0.0, 5e-324]))
    for x in columns:
        got = evaluate.percentiles(spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(3), "v", [0.0, 0.5, 0.95, 0.99, 1.0])
        want = np.percentile(x, [0, 50, 95, 99, 100]) if np.isfinite(x).all() else [-inf, np.median(x), np.percentile(np.sort(x)[1:-2], 100 * (0.95 * (len(x) - 1) - 1) / (len(x) - 4)), inf, inf]
        assert np.allclose(got, want, rtol=1e-12)
    odd = spark.createDataFrame([(v,) for v in [float("nan")] * 5 + [inf] * 20 + [1.0] * 9 + [-1.7e308, 1.7e308]], "v double")
    low, middle, high, top = evaluate.percentiles(odd, "v", [0.0, 0.5, 0.7, 1.0])
    assert (low, middle, high) == (-1.7e308, inf, inf) and np.isnan(top)
    wide = spark.createDataFrame([(v,) for v in [-1.7e308, 1.7e308] * 6], "v double")
    assert evaluate.percentiles(wide, "v", [0.5]) == [0.0]
    assert evaluate.percentiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]) == [None]
    got = evaluate.latency(spark.createDataFrame([(float(v),) for v in columns[0]], "ms double"), "ms").first()
    assert np.allclose(list(got), [round(v, 2) for v in (columns[0].mean(), *np.percentile(columns[0], [50, 95, 99]))], atol=0.011)


def test_sparse_search_and_verbatim_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_TERMS", 5)
    monkeypatch.setattr(search, "PASSAGE_CHARS", 6)
    monkeypatch.setattr(search, "SLICE", 8)
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 12))) for _ in range(80)] + [None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a b")], "doc_id long, text string").repartition(4)
    queries = [(i, texts[i * 7]) for i in range(9)] + [(None, "a"), (20, "a"), (21, "zz"), (22, None)]
    weigh = lambda t: {x: (t or "").split().count(x) / len(t.split()) for x in set((t or "").split())}
    found = search.sparse_top_k(encode.lexical_weights(docs, "doc_id", "text"), encode.lexical_weights(spark.createDataFrame(queries, "query_id long, query string"), "query_id", "query"), 10)
    want = set()
    for q, t in queries:
        if q is not None:
            sims = [(round(sum(w * weigh(d).get(x, 0) for x, w in weigh(t).items()), 6), i) for i, d in enumerate(texts)]
            want |= {(q, i, k + 1) for k, (s, i) in enumerate(sorted((x for x in sims if x[0]), key=lambda x: (-x[0], x[1]))[:10])}
    assert {(r.query_id, r.doc_id, r["rank"]) for r in found.collect()} == want
    passages = [(i, t) for i, t in enumerate([texts[0], "a b", "b c", "b", None, "", "a b"])]
    got = search.verbatim(docs, spark.createDataFrame(passages, "item_id long, text string"))
    assert sorted((r.item_id, str(r.doc_id)) for r in got.collect()) == sorted((p, str(i)) for p, x in passages if x for i, t in [*enumerate(texts), (None, "a b")] if t and x in t)
    dual = {r.query_id: r for r in encode.HashingDual(8).encode(spark.createDataFrame(queries[:3], "query_id long, query string"), "query_id", "query").collect()}
    for r in encode.HashingEncoder(8).encode(spark.createDataFrame(queries[:3], "query_id long, query string"), "query", "v").collect():
        assert dual[r.query_id].embedding == r.v and set(dual[r.query_id].weights) == set((r["query"] or "").split())


def test_mining(spark):
    chunks = spark.createDataFrame([(i, i // 3, [1.0, i / 10]) for i in range(30)], "chunk_id long, case_no long, embedding array<float>")
    queries = spark.createDataFrame([(0, 0, [1.0, 0.1]), (1, 99, [1.0, 0.0])], "query_id long, case_no long, embedding array<float>")
    positive = mining.positives(queries, chunks)
    assert [(r.query_id, r.chunk_id) for r in positive.collect()] == [(0, 1)]
    assert mining.without_positive(queries, positive).first().n == 1
    pool = search.top_k(chunks, queries, 20, carry=("case_no",))
    truth = spark.createDataFrame([(0, 0), (0, 1)], "query_id long, case_no long")
    negative = mining.hard_negatives(pool, truth, skip_top=2, num_negatives=2).where("query_id = 0").orderBy("negative_rank").collect()
    assert [(r.negative_rank, r.chunk_id) for r in negative] == [(1, 8), (2, 9)]
    batches = mining.epoch(spark.createDataFrame([(i, i) for i in range(70)], "query_id long, x long"), 1, 16).collect()
    assert sorted(r.position for r in batches) == list(range(64)) and {r.batch for r in batches} == {0, 1, 2, 3}


def test_encoders(spark):
    rows = spark.createDataFrame([(0, "a b a"), (1, None), (2, "c")], "query_id long, query string")
    out = {r.query_id: r.v for r in encode.HashingEncoder(8).encode(rows, "query", "v").collect()}
    assert abs(sum(x * x for x in out[0]) - 1) < 1e-6 and out[1] == [0.0] * 8
    weights = {r.query_id: r.weights for r in encode.lexical_weights(rows, "query_id", "query").collect()}
    assert abs(weights[0]["a"] - 2 / 3) < 1e-6 and weights[1] == {}
    stored = spark.createDataFrame([("c", [1.0])], "t string, v array<float>")
    assert {r.query_id: r.e for r in encode.LookupEncoder(stored, "t", "v").encode(rows, "query", "e").collect()} == {0: None, 1: None, 2: [1.0]}
    docs = spark.createDataFrame([(5, "c d"), (6, "a"), (7, None)], "doc_id long, text string")
    found = search.sparse_top_k(encode.lexical_weights(docs, "doc_id", "text"), encode.lexical_weights(rows, "query_id", "query"))
    assert {(r.query_id, r.doc_id, r["rank"]) for r in found.collect()} == {(0, 6, 1), (2, 5, 1)}


def test_retriever_with_encoder_and_timing(spark):
    encoder = encode.HashingEncoder(16)
    docs = spark.createDataFrame([(i, i // 2, f"w{i} w{i + 1}") for i in range(20)], "chunk_id long, case_no long, chunk_text string")
    retriever = search.DenseExact(encoder.encode(docs, "chunk_text", "embedding"), encoder)
    queries = spark.createDataFrame([(0, "w4 w5"), (1, "w8 w9")], "query_id long, query string")
    assert {(r.query_id, r.case_no) for r in retriever.retrieve(queries, 1).collect()} == {(0, 2), (1, 4)}
    assert evaluate.timed(retriever, queries, 5, 2).count() >= 1


def rows_between(plan):
    """The rows that each step of a plan that has run gave."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return rows_between(plan.executedPlan())
    inner = [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = [plan.metrics().apply("numOutputRows").value()] if plan.metrics().contains("numOutputRows") else []
    return own + [n for p in inner for n in rows_between(p)]


def test_label_metrics_equal_listed_truth_without_listing_it(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i // 4, int(rng.integers(0, 3)) if i % 11 else None) for i in range(2000)] + [(5000, 1250, 7), (5001, 1250, 8), (5050, 1262, 8), (None, None, 8), (100, 25, 1), (100, 25, 2)]
    table = spark.createDataFrame(rows, "vec_id long, doc long, label int")
    queries = table.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    ranked = spark.createDataFrame([(q, int(d), r + 1) for q in [*range(0, 2000, 50), 5000, 5050] for r, d in enumerate(rng.choice(500, 20, replace=False))], "query_id long, doc long, rank int")
    truth = queries.join(table, "label").where("vec_id <> query_id").select("query_id", "doc")
    found = evaluate.label_metrics(ranked, queries, table, "vec_id", "doc")
    assert found.collect() == evaluate.metrics(ranked, truth, "doc").collect() and found.first().queries == truth.select("query_id").distinct().count()
    assert max(rows_between(found._jdf.queryExecution().executedPlan())) <= len(rows) < truth.count() // 5


def test_dense_evaluation_does_not_list_the_truth(spark, tmp_path):
    """One label: the truth is 240 queries with 3,000 documents each, the pool has 500 rows a query."""
    rng = np.random.default_rng(4)
    rows = [(i, v, 1) for i, v in enumerate(rng.normal(size=(12_000, 2)).tolist())]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    df = plans.eval_dense(spark, str(tmp_path))
    assert [tuple(r)[:2] for r in df.collect()] == [(240, 1.0)]
    assert 100_000 < max(rows_between(df._jdf.queryExecution().executedPlan())) <= 240 * 500


def test_blocks_bound_the_rows_that_are_kept(spark, monkeypatch):
    rng = np.random.default_rng(6)
    table = spark.createDataFrame([(i, rng.normal(size=3).round(1).tolist()) for i in range(300)], "chunk_id long, embedding array<double>").repartition(2)
    asked = table.where("chunk_id < 30").withColumnRenamed("chunk_id", "query_id")
    want = search.top_k(table, asked, 10).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(search, "BLOCK_ROWS", 50)
    kept = [len(b.ids) for _, blocks in search._blocks(asked, "query_id", "embedding", None, 10) for b in blocks]
    assert sum(kept) == 30 and len(kept) >= 4
    assert [tuple(r)[:2] for r in search.top_k(table, asked, 10).orderBy("query_id", "rank").collect()] == [tuple(r)[:2] for r in want]


def test_products_of_sparse_search_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(search, "SLICE", 50)
    rng = np.random.default_rng(7)
    row = np.sort(rng.integers(0, 40, 200))
    n = rng.integers(0, 9, 200)
    n[row == 11] = 30  # a row of more than the bound
    ranges = list(search._products(row, n, 41))
    assert [a for a, _, _ in ranges] == [0, *(b for _, b, _ in ranges[:-1])] and ranges[-1][1] == 41
    assert [i for _, _, some in ranges for i in range(200)[some]] == list(range(200))
    assert all(((row[some] >= a) & (row[some] < b)).all() and (n[some].sum() <= 50 or b == a + 1) for a, b, some in ranges) and len(ranges) > 10
    assert [x[:2] for x in search._products(row[:0], n[:0], 7)] == [(0, 7)]
    docs = spark.createDataFrame([(i, {"a": 1.0, "b": float(i % 7)} if i % 5 else {}) for i in range(90)], "doc_id long, weights map<string,float>").coalesce(1)
    asked = spark.createDataFrame([(q, {"a": 0.5, "b": float(q)}) for q in range(3)], "query_id long, weights map<string,float>")
    got = {(r.query_id, r["rank"]): r.doc_id for r in search.sparse_top_k(docs, asked, 6).collect()}
    for q in range(3):
        best = sorted((-(0.5 + q * (i % 7)), i) for i in range(90) if i % 5)[:6]
        assert [got[q, k + 1] for k in range(6)] == [i for _, i in best]


def test_texts_are_counted_in_slices(spark, monkeypatch):
    texts = ["ab cd " * 50, None, "", "x", "ab " * 400, "y z", "Z ü"]
    monkeypatch.setattr(encode, "SLICE_BYTES", 320)
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(9)), "text": pa.array(["q", "q", *texts])}).slice(2)
    parts = list(encode.text_slices(iter([batch, batch.slice(0, 0)])))
    assert [p.column(0).to_pylist() for p in parts] == [[2, 3, 4, 5], [6], [7, 8]] and [t for p in parts for t in p.column(1).to_pylist()] == texts
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in encode.HashingDual(8).encode(rows, "doc_id", "text").collect():
        own = [w.lower() for w in (texts[r.doc_id] or "").split()]
        assert r.weights == {w: float(np.float32(own.count(w) / len(own))) for w in own}
        v = np.zeros(8)
        for w in own:
            h = hashlib.md5(w.encode()).hexdigest()
            v[int(h[:8], 16) % 8] += 1 if int(h[8], 16) % 2 == 0 else -1
        assert np.allclose(r.embedding, v / max(np.linalg.norm(v), 1e-12), atol=1e-6)
