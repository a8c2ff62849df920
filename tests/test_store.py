"""The store's documents: whole, newest, gone when a load is empty, and never half of one."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from korpusmill.operators import encode, search
from korpusmill.operators.chunk import chunks
from korpusmill.store import ChunkStore, chunk_rows
from korpusmill.streaming.ingest import ingest

CONFIG = ("m/1 %", 10, 0)


def cut(spark, **texts):
    docs = spark.createDataFrame(list(texts.items()), "case_no string, content string")
    return chunks(docs, "case_no", "content", 10, 0).drop("char_offset")


def held(store):
    rows = sorted((r.case_no, r.chunk_index, r.chunk_text) for r in store.read(*CONFIG).collect())
    return {c: "".join(t for n, _, t in rows if n == c) for c in {r[0] for r in rows}}


def test_a_newer_text_replaces_the_older_one(spark, tmp_path):
    store, encoder = ChunkStore(spark, str(tmp_path)), encode.HashingEncoder(4)
    assert store.read(*CONFIG).count() == 0 and not store.exists() and store.report().collect() == []
    store.append_missing(cut(spark, a="a" * 15, b="b" * 5), *CONFIG, encoder)
    store.append_missing(cut(spark, a="A" * 45, c="c"), *CONFIG, encoder)
    assert held(store) == {"a": "A" * 45, "b": "b" * 5, "c": "c"}
    store.append_missing(cut(spark, a="A" * 45), *CONFIG, encoder)  # nothing new
    store.append_missing(cut(spark, a="short"), *CONFIG, encoder)
    assert held(store) == {"a": "short", "b": "b" * 5, "c": "c"}
    assert [c.kind for c in store._commits(*CONFIG)] == ["add", "mend", "mend"]
    assert store.read(*CONFIG).where("size(embedding) = 4").count() == 3
    assert [tuple(r)[:5] for r in store.report().collect()] == [(*CONFIG, 3, 3)]
    store.append_missing(cut(spark, a="A" * 45), *CONFIG, encoder)  # a text that was there before
    assert held(store)["a"] == "A" * 45
    store.write(cut(spark, z="z"), *CONFIG)
    assert held(store) == {"z": "z"} and store.vacuum() == 8 and held(store) == {"z": "z"}


def test_an_empty_load_leaves_nothing(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path))
    cases = spark.createDataFrame([("1", "name", "court", "20240131", "civil", "text")], "case_no string, case_name string, court_name string, judgment_date string, case_type string, content string")
    assert tuple(store.load(cases, *CONFIG).first())[:2] == (1, 1)
    assert tuple(store.load(cases.limit(0), *CONFIG).first())[:2] == (0, 0)
    assert store.read(*CONFIG).count() == 0 and [tuple(r)[:5] for r in store.report().collect()] == [(*CONFIG, 0, 0)]
    assert store.documents(*CONFIG).count() == 0


def test_a_broken_run_leaves_whole_documents_only(spark, tmp_path):
    class Failing(encode.HashingEncoder):
        def encode(self, rows, text, out):
            self.calls = getattr(self, "calls", 0) + 1
            rows = super().encode(rows, text, out)
            return rows.withColumn("chunk_index", F.when(F.col("case_no") == "d7", F.raise_error(F.lit("lost"))).otherwise(F.col("chunk_index"))) if self.calls > 1 else rows

    store, texts = ChunkStore(spark, str(tmp_path)), {f"d{k}": f"{k}" * 35 for k in range(12)}
    store.write(cut(spark, d0="old text of this one", keep="k"), *CONFIG, )
    with pytest.raises(Exception, match="lost"):
        store.append_missing(cut(spark, **texts), *CONFIG, Failing(4), slice_rows=6)
    some = held(store)
    assert all(t == (texts | {"keep": "k", "d0": some["d0"]})[c] for c, t in some.items()) and some["d0"] in ("old text of this one", "0" * 35) and len(some) < 13
    store.append_missing(cut(spark, **texts), *CONFIG, encode.HashingEncoder(4), slice_rows=6)
    assert held(store) == texts | {"keep": "k"}
    assert store.vacuum() >= 1 and held(store) == texts | {"keep": "k"}


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path))
    store.write(cut(spark, a="a"), *CONFIG)
    commits = store._commits
    store._commits = lambda *c: commits(*c)[:0]  # as a writer sees it that began before
    with pytest.raises(RuntimeError, match="another writer"):
        store.append_missing(cut(spark, b="b"), *CONFIG)
    store._commits = commits
    assert held(store) == {"a": "a"}


def test_a_document_that_comes_again_in_the_stream_replaces(spark, tmp_path):
    from korpusmill.schema import CASE_FIELDS

    (tmp_path / "in").mkdir()
    store, encoder = ChunkStore(spark, str(tmp_path / "s")), encode.HashingEncoder(4)
    for name, text in (("1", "x" * 700), ("2", "y" * 50)):
        case = dict(zip(CASE_FIELDS, ("no", "n", "c", "20240131", "civil", text), strict=True))
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps(case))
        ingest(spark, str(tmp_path / "in"), store, str(tmp_path / "cp"), "m", encoder).awaitTermination()
    assert [r.chunk_text for r in store.read("m", 300, 100).collect()] == ["y" * 50]


def test_sparse_weights_are_stored_and_searched(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path))
    rows = cut(spark, a="red blue", b="blue sea", c="green")
    weights = encode.lexical_weights(rows, "case_no", "chunk_text")
    store.write(rows.join(weights, "case_no"), *CONFIG)
    asked = encode.lexical_weights(spark.createDataFrame([(1, "blue sea")], "query_id long, query string"), "query_id", "query")
    found = search.sparse_top_k(store.read(*CONFIG), asked, 5, id_col="case_no").orderBy("rank").collect()
    assert [(r.case_no, round(r.sim, 6)) for r in found] == [("b", 0.5), ("a", 0.25)]
    assert dict(store.read(*CONFIG).dtypes)["weights"] == "map<bigint,float>"
    assert sorted(r.token for r in store.tokens(*CONFIG).collect()) == ["blue", "green", "red", "sea"]
    assert sorted((r.case_no, r.token, r.weight) for r in store.terms(*CONFIG).collect()) == [("a", "blue", 0.5), ("a", "red", 0.5), ("b", "blue", 0.5), ("b", "sea", 0.5), ("c", "green", 1.0)]
    # a newer text brings its own tokens, null and empty weights have none, and what no load has any more goes with the next full one
    newer = cut(spark, a="teal", d="")
    newer = newer.join(encode.lexical_weights(newer, "case_no", "chunk_text"), "case_no").withColumn("weights", F.when(F.col("case_no") == "a", F.col("weights")))
    store.append_missing(newer, *CONFIG)
    assert sorted(r.token for r in store.tokens(*CONFIG).collect()) == ["blue", "green", "red", "sea", "teal"]
    assert sorted((r.case_no, r.token) for r in store.terms(*CONFIG).collect()) == [("a", "teal"), ("b", "blue"), ("b", "sea"), ("c", "green")]
    store.write(newer, *CONFIG)
    assert store.vacuum() == 2 * 3  # of the two loads before: rows, tokens, manifest
    assert [r.token for r in store.tokens(*CONFIG).collect()] == ["teal"]
    plain = ChunkStore(spark, str(tmp_path / "plain"))
    plain.write(cut(spark, a="x"), *CONFIG)
    assert plain.tokens(*CONFIG).count() == plain.terms(*CONFIG).count() == plain.tokens("none", 1, 0).count() == 0


def test_tokens_that_share_a_number_raise(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("korpusmill.store.token_id", lambda token: F.length(token).cast("long"))
    rows = cut(spark, a="red sea")
    with pytest.raises(Exception, match="one number for the tokens"):
        ChunkStore(spark, str(tmp_path)).write(rows.join(encode.lexical_weights(rows, "case_no", "chunk_text"), "case_no"), *CONFIG)
