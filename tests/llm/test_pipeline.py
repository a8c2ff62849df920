"""The pipeline's stages, each on what its predecessor kept, against brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from conftest import SF
from korpusmill.llm import queries as Q
from korpusmill.llm import batches, language_id, skew, suffix_dedup
from pyspark.sql import functions as F
from test_training_operators import TOKENIZER, _fused, _near

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _lines(rows: dict[int, str]) -> dict[int, str]:
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
    first = {}
    for i in sorted(rows):
        for x in rows[i].split("\n"):
            first.setdefault(key(x), i)
    return {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or first[key(x)] == i) for i, t in rows.items()}


def _pieces(rows: dict[int, str]) -> set[tuple]:
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(TOKENIZER), set()
    for i, t in rows.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        out |= {(i, p, lo, len(ids[lo : lo + 4096]), zlib.crc32(ids[lo : lo + 4096].tobytes())) for p, lo in enumerate(range(0, len(ids), 4096))}
    return out


def _in_a_language(spark, docs) -> list[int]:
    """Ids that the fusion, in plain Python, accepts."""
    model = language_id.fit(docs)
    rows = docs.select("doc_id", "text", "source", F.lit(None).cast("string").alias("url"), F.lit(False).alias("markup"))
    evidence = language_id.scored(rows, model, ["doc_id"]).collect()
    fused = _fused([(r.text_score, r.letters, r.declared, r.suffix, r.host, r.domain) for r in evidence], model.languages)
    return [r.doc_id for r, (*_, accepted) in zip(evidence, fused, strict=True) if accepted]


def test_rows_of_one_id_are_judged_each(spark):
    """Rows that share an id, null ids and null sources: each stays or goes by its own text; repeated rows are alike."""
    good = "the house and the garden with the long wall of stone " * 5
    rows = [(i, good + str(i), "en", "s", 1) for i in range(30)]
    odd = [(1, "12 34", None, "s", 2), (1, "12 34", None, "s", 2), (None, "5 6", "en", None, 3), (None, good, "en", None, 4), (None, good, "en", None, 4), (2, None, None, "12 34", 5), (2, good, None, None, 6)]
    out = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows + odd, SCHEMA), SF).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(str(r) for r in rows + odd if r[1] and r[1].startswith("the"))
    near = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows[:1] + [(5, good + "0", "en", "s", 1), (5, "else", "en", "t", 7), (None, good, "en", "s", 1)], SCHEMA), SF).collect()
    assert sorted(map(str, map(tuple, near))) == sorted(map(str, [rows[0], (None, good, "en", "s", 1)]))


def test_no_text_is_shuffled_to_drop_rows(spark, monkeypatch):
    """With host tables joined by shuffle too, the two stages that drop documents read texts once more and do not exchange them."""
    monkeypatch.setattr(skew, "SMALL_BYTES", 0)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.drop_near_duplicates):
        plan = stage(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange") == plan.count("BroadcastExchange")


def test_small_batches_change_no_result(spark, monkeypatch):
    """Batches of seven rows, which cut families and groups, give what batches of all rows give; the session's setting comes back, after errors too."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    before = spark.conf.get(batches.ROWS)
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.drop_near_duplicates):
        plain = stage(spark, docs, SF).collect()
        with monkeypatch.context() as m:
            m.setattr(corpus_pipeline, "text_batches", lambda s: batches.text_batches(s, 7))
            assert sorted(map(str, stage(spark, docs, SF).collect())) == sorted(map(str, plain))
        assert spark.conf.get(batches.ROWS) == before
    with pytest.raises(RuntimeError), batches.text_batches(spark, 7):
        assert spark.conf.get(batches.ROWS) == "7"
        raise RuntimeError
    assert spark.conf.get(batches.ROWS) == before


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # prose of no language and a text without letters are what the first stage is to reject
    odd = spark.createDataFrame([(10**6, "12 34 " * 50, None, "s", 300), (10**6 + 1, None, "en", None, None), (10**6 + 2, "", None, "s", 0)], SCHEMA)
    docs = docs.select(*corpus_pipeline.COLUMNS).unionByName(odd)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "minhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text or "" for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(f"file://{tmp_path}/{k}")
        out = spark.read.parquet(f"file://{tmp_path}/{k}")
        rows = out.collect()
        if k < 4:
            assert out.columns == corpus_pipeline.COLUMNS
            assert all(r.n_chars == len(r.text or "") for r in rows if k)
            after = {r.doc_id: r.text or "" for r in rows}
            assert len(after) == len(rows) and set(after) <= set(before)
        if name == "language_id":
            assert all(before[i] == t for i, t in after.items())
            rejected = set(before) - set(after)
            letters = {i: sum(map(str.isalpha, t)) for i, t in before.items()}
            assert {i for i, n in letters.items() if not n} <= rejected
            assert not {i for i in rejected if letters[i] >= 60}
            assert after == {i: before[i] for i in _in_a_language(spark, docs)}
        if name == "line_dedup":
            assert after == _lines(before)
        if name == "minhash_near_dedup":
            assert after == {i: before[i] for i, root in _near(before, 5).items() if i == root}
        if name == "suffix_array_dedup":
            assert set(after) == set(before)
            want = suffix_dedup.brute_force(before, 100)
            # whole characters are kept, so a few bytes at the ends of a run may stay
            assert all(0 <= len(t.encode()) - (want[i][0] - want[i][1]) <= 6 * want[i][2] for i, t in after.items())
        if name == "best_fit_packing":
            assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == _pieces(before) and len(rows) == len(_pieces(before))
            bins = defaultdict(list)
            for r in rows:
                bins[r.sequence_id].append((r.offset, r.length))
            for own in bins.values():
                own.sort()
                assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own[:-1])]).tolist() and sum(n for _, n in own) <= 4096
            assert len(bins) <= 1.001 * sum(r.length for r in rows) / 4096 + 1
        docs = out


def test_run_on_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated rows, one very long text, and no rows at all."""
    rows = [(1, None, None, None, None), (None, "eins zwei drei vier " * 30, "de", None, None), (2, "one two three four " * 30, "en", "s", 9), (2, "one two three four " * 30, "en", "s", 9), (3, "five six seven " * 20_000, "en", "s", 1)]
    for name, own in (("odd", rows), ("none", [])):
        spark.createDataFrame(own, SCHEMA).write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"file://{tmp_path}/{name}").collect()
        assert (len(out) > 0) == bool(own) and {r.doc_id for r in out} <= {r[0] for r in own}


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL) - {"op5_toxicity"}))
def test_queries_keep_every_row_and_their_contract(spark, name):
    """Queries without SQL, over the whole table."""
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = Q.QUERIES[name](spark, SF)
    rows = out.collect()
    ids = [r.doc_id for r in rows if "page_id" not in out.columns or r.page_id is None]
    if name == "op1_best_fit_packing":
        assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == _pieces({i: t.decode() for i, t in docs.items()})
    else:
        assert sorted(ids) == sorted(docs)
    if name == "op2_sentencepiece":
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=Q.tokenizer_file("piece_bpe_32k.model"))
        for r in rows:
            own = library.encode(docs[r.doc_id].decode())
            assert (r.n_ids, r.ids_crc32) == (len(own), zlib.crc32(np.array(own, "<u4").tobytes())) and r.decoded_sha256 == hashlib.sha256(library.decode(own).encode()).hexdigest()
    if name == "op6_media_columns":
        assert all(r.n_bytes == len(docs[r.doc_id]) and r.payload_bytes % 64 == 0 and 0 <= r.payload_bytes - max(r.n_bytes, 1) < 64 for r in rows)
    if name == "op10_language_id":
        assert len(rows) == len(docs) + spark.read.parquet(f"{SF}/pages.parquet").count()
