from __future__ import annotations

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from korpusmill import cli
from korpusmill.operators import encode, search
from korpusmill.operators.chunk import chunks
from korpusmill.operators.corpus import missing_keys
from korpusmill.sources import archives, arrays, cases
from korpusmill.storage import Scratch
from korpusmill.store import ChunkStore, chunk_rows, create_chunk_table
from korpusmill.streaming.ingest import ingest


def case(no, text, kind=None):
    return {"사건번호": no, "사건명": "n", "법원명": "c", "선고일자": "20240131", "사건종류명": kind, "판례내용": text, "판결유형": "x"}


@pytest.fixture
def folders(tmp_path):
    for name, files in {
        "train": {"b.json": case("1", " first "), "a.json": case("2", "two"), "bad.json": "{", "._x.json": "junk", "blank.json": case("3", " 　")},
        "val": {"c.json": case("1", "again"), "stem.json": case(None, "no number", ""), "d.json": case("4", "x" * 700, "civil")},
    }.items():
        (tmp_path / name).mkdir()
        for f, doc in files.items():
            (tmp_path / name / f).write_text(doc if isinstance(doc, str) else json.dumps(doc, ensure_ascii=False))
    return [str(tmp_path / "train"), str(tmp_path / "val")]


def test_cases(spark, folders):
    raw = cases.read_cases(spark, folders)
    rows = {r.case_no: r for r in cases.corpus(raw).collect()}
    assert set(rows) == {"1", "2", "4", "stem"}
    assert rows["1"].content == "first" and rows["stem"].case_type == "기타" and rows["4"].case_type == "civil"
    assert {r.case_no for r in cases.corpus(raw, id_from_file=False).collect()} == {"1", "2", "4"}
    assert {r.reason: r.n for r in cases.blank_rows(raw).collect()} == {"unreadable": 1, "no_content": 1, "no_case_no": 1}
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        cases.read_cases(spark, folders, strict=True).collect()


def test_query_sets_pairs_and_labels(spark, tmp_path):
    items = [{"query": "q0", "case_ids": ["1"]}, {"query": "q1", "case_ids": []}, {"query": None, "case_ids": None}]
    (tmp_path / "q.json").write_text(json.dumps(items))
    got = cases.read_queries(spark, str(tmp_path / "q.json"))
    assert [(r.query_id, r["query"], r.case_ids) for r in got.orderBy("query_id").collect()] == [(0, "q0", ["1"]), (1, "q1", []), (2, None, None)]
    assert cases.read_queries(spark, str(tmp_path / "q.json"), 0).count() == 0
    lines = [{"query": "q", "positive_chunk": "p", "hard_negative_chunks": ["n1", "n2"]}, {"query": "q", "positive_chunk": "p", "hard_negative_chunk": "n"}, {"query": "q", "positive_chunk": "p"}]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert sorted(str(r.negative) for r in cases.read_triples(spark, str(tmp_path / "t.jsonl")).collect()) == ["None", "n", "n1", "n2"]
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "l.json").write_text(json.dumps({"info": {"caseNoID": "1"}, "jdgmnInfo": [{"question": "q", "answer": "a"}]}))
    (tmp_path / "labels" / "bad.json").write_text("nope")
    assert [r.info.caseNoID for r in cases.read_labels(spark, str(tmp_path / "labels")).collect()] == ["1"]
    out = spark.createDataFrame([(1, "é")], "id long, t string")
    assert json.loads(cases.json_array(out, "id")) == [{"id": 1, "t": "é"}]
    with pytest.raises(ValueError):
        cases.json_array(out.union(out), "id", 1)
    cases.write_jsonl(out, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_arrays(spark, tmp_path):
    arrays.register(spark)
    x = np.random.default_rng(0).normal(size=(500, 7)).astype(np.float16)
    np.save(tmp_path / "v.npy", x)
    rows = spark.read.format("npy").option("range_bytes", "1000").load(str(tmp_path)).orderBy("row").collect()
    assert [r.row for r in rows] == list(range(500))
    assert np.array_equal(np.array([r.vector for r in rows], np.float32), x.astype(np.float32))
    dense = np.array([[0, 1.5, 0], [0, 0, 0], [2, 0, 3]], np.float32)
    r, c = np.nonzero(dense)
    np.savez(tmp_path / "s.npz", indptr=np.searchsorted(r, np.arange(4)), indices=c, data=dense[r, c], shape=dense.shape, format=np.array(b"csr"))
    got = spark.read.format("csr_npz").load(str(tmp_path)).orderBy("row").collect()
    assert [g.weights for g in got] == [{"1": 1.5}, {}, {"0": 2.0, "2": 3.0}]


@pytest.mark.parametrize("write", [np.savez, np.savez_compressed])
def test_a_sparse_matrix_is_read_by_several_tasks(spark, tmp_path, monkeypatch, write):
    """Rows without entries at the start, in between and at the end, one row that is longer than a range, in blocks of a few pointers."""
    arrays.register(spark)
    rng = np.random.default_rng(1)
    many = np.concatenate([[0, 0], rng.integers(0, 6, 700), [900], np.zeros(40, int), rng.integers(0, 6, 300), [0, 0, 0]])
    ends = np.append(0, np.cumsum(many)).astype(np.int32)
    columns = np.concatenate([rng.choice(5000, n, replace=False) for n in many]).astype(np.int32)
    data = rng.random(len(columns)).astype(np.float32)
    path = tmp_path / "m.npz"
    write(path, indptr=ends, indices=columns, data=data, shape=(len(many), 5000), format=np.array(b"csr"))
    own = spark.read.format("csr_npz").option("range_bytes", "2000").load(str(path))
    tasks = own.rdd.getNumPartitions()
    assert tasks == -(-len(columns) * 8 // 2000) if write is np.savez else tasks == arrays.DEFLATED_RANGES
    got = own.orderBy("row").collect()
    assert [r.row for r in got] == list(range(len(many)))
    for r, a, b in zip(got, ends, ends[1:], strict=False):
        assert r.weights == {str(c): float(v) for c, v in zip(columns[a:b], data[a:b], strict=True)}
    monkeypatch.setattr(arrays, "POINTERS", 7)
    monkeypatch.setattr(arrays, "BATCH_BYTES", 160)
    reader = arrays.CsrReader(str(path), 2000)
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert max(len(b.column(2).keys) for b in batches if b.num_rows > 1) <= 10
    assert [x for b in batches for x in b.column(1).to_pylist()] == list(range(len(many)))
    assert [dict(x) for b in batches for x in b.column(2).to_pylist()] == [r.weights for r in got]


def test_odd_sparse_files(spark, tmp_path):
    arrays.register(spark)
    none = np.zeros(0, np.int32)
    for name, ends in (("a", [0]), ("b", [0, 0, 0])):
        np.savez(tmp_path / f"{name}.npz", indptr=np.array(ends), indices=none, data=none.astype(np.float32), shape=(len(ends) - 1, 3), format=np.array(b"csr"))
    got = spark.read.format("csr_npz").load(str(tmp_path)).collect()
    assert sorted((r.file, r.row, r.weights) for r in got) == [("b.npz", 0, {}), ("b.npz", 1, {})]
    for name, ends, kind, message in (("other", [0, 0], b"csc", "compressed rows"), ("falls", [0, 2, 1, 2], b"csr", "pointers fall")):
        (tmp_path / name).mkdir()
        np.savez(tmp_path / name / "x.npz", indptr=np.array(ends), indices=np.zeros(2, int), data=np.ones(2), shape=(3, 3), format=np.array(kind))
        with pytest.raises(Exception, match=message):
            spark.read.format("csr_npz").load(str(tmp_path / name)).collect()


def test_zip_and_parts(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("/x/one.txt", b"1" * 10)
        z.writestr("dir/", b"")
        z.writestr("two.txt", b"22")
    members = archives.read_zip(spark, str(tmp_path))
    assert {(r.member, r["size"]) for r in members.collect()} == {("x/one.txt", 10), ("two.txt", 2)}
    archives.extract(members, str(tmp_path / "out")).collect()
    assert (tmp_path / "out" / "a" / "x" / "one.txt").read_bytes() == b"1" * 10
    for _ in range(2):  # the second time the files are there
        archives.extract(members).collect()
    assert (tmp_path / "x" / "one.txt").read_bytes() == b"1" * 10
    for name in ("../up", "a/../../b", ".", ""):
        with pytest.raises(ValueError):
            archives.inner_path(name)
    bad = zipfile.ZipInfo("link")
    bad.external_attr = 0o120777 << 16
    (tmp_path / "bad").mkdir()
    with zipfile.ZipFile(tmp_path / "bad" / "b.zip", "w") as z:
        z.writestr(bad, "target")
    with pytest.raises(Exception, match="symbolic link"):
        archives.read_zip(spark, str(tmp_path / "bad")).collect()
    parts = tmp_path / "parts"
    parts.mkdir()
    (parts / "f.bin.part0").write_bytes(b"abc")
    (parts / "f.bin.part3").write_bytes(b"de")
    assert [tuple(r)[1:] for r in archives.join_parts(spark, str(parts)).collect()] == [(2, 5)]
    assert (parts / "f.bin").read_bytes() == b"abcde" and not list(parts.glob("*.part*"))
    (parts / "g.part1").write_bytes(b"x")
    with pytest.raises(ValueError, match="missing"):
        archives.join_parts(spark, str(parts))


def test_archives_of_any_name_keep_their_members_apart(spark, tmp_path):
    import gzip

    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name in ("B.ZIP", "_c.zip", "deep/B.Zip", ".hidden.zip"):
        with zipfile.ZipFile(tmp_path / "in" / name, "w") as z:
            z.writestr("same.json.gz", gzip.compress(name.encode()))
    members = archives.read_zip(spark, str(tmp_path / "in"))
    assert members.count() == 3
    archives.extract(members, str(tmp_path / "out"), str(tmp_path / "in")).collect()
    for name in ("B", "_c", "deep/B"):
        assert gzip.decompress((tmp_path / "out" / name / "same.json.gz").read_bytes()).decode()[:-4].lower() == name.lower()
    with pytest.raises(Exception, match="there already"):
        archives.extract(members, str(tmp_path / "flat")).collect()  # two archives of one name


def test_parts_beside_other_files(spark, tmp_path):
    for name, data in {"x.zip.gz.part0": b"abc", "x.zip.gz.part3": b"de", "x.zip.partial": b"?", "x.part": b"?", "a.part0.txt": b"?"}.items():
        (tmp_path / name).write_bytes(data)
    assert [tuple(r)[1:] for r in archives.join_parts(spark, str(tmp_path)).collect()] == [(2, 5)]
    assert (tmp_path / "x.zip.gz").read_bytes() == b"abcde" and len(list(tmp_path.iterdir())) == 4


def test_vectors_by_row(spark, tmp_path):
    """Matrices in half precision, read back and joined with their chunks by place."""
    arrays.register(spark)
    rng = np.random.default_rng(1)
    rows = [(f"c{k // 3:03d}", k % 3, rng.normal(size=4).astype(np.float16).astype(float).tolist()) for k in range(200)]
    df = spark.createDataFrame(rows, "case_no string, chunk_index int, embedding array<float>").repartition(5)
    order, scratch = ["case_no", "chunk_index"], Scratch(spark, "rows")
    files = arrays.write_npy(df, str(tmp_path / "npy"), order=order).collect()
    assert sum(f.rows for f in files) == 200 and np.load(tmp_path / "npy" / files[0].file).dtype == np.float16
    first = spark.createDataFrame(files)
    stored = spark.read.format("npy").load(str(tmp_path / "npy")).join(first.select("file", "first_row"), "file").select((F.col("row") + F.col("first_row")).alias("row"), "vector")
    got = arrays.with_vectors(df.drop("embedding"), stored, order, scratch)
    assert sorted((r.case_no, r.chunk_index, r.embedding) for r in got.collect()) == rows
    with pytest.raises(ValueError, match="200 chunks but 199"):
        arrays.with_vectors(df.drop("embedding"), stored.where("row > 0"), order, scratch)


def test_store_of_whole_rows(spark, folders, tmp_path):
    """Name, court, date and category with every chunk; a broken run keeps its slices; partitions are the table's."""
    store = ChunkStore(spark, str(tmp_path / "store"))
    rows = cases.corpus(cases.read_cases(spark, folders))
    assert tuple(store.load(rows, "m", 300, 100, encode.HashingEncoder(4)).first())[:2] == (4, 7)
    one = store.read("m", 300, 100).where("case_no = '4'").orderBy("chunk_index").first()
    assert (one.case_name, one.court_name, str(one.judgment_date), one.case_type, len(one.embedding)) == ("n", "c", "2024-01-31", "civil", 4)
    assert store.report().first().bytes > 0
    with pytest.raises(ValueError, match="without chunk_index"):
        store.write(rows.select("case_no", F.col("content").alias("chunk_text")), "m", 1, 0)
    class Failing(encode.HashingEncoder):
        calls = 0

        def encode(self, *args):
            Failing.calls += 1
            if Failing.calls == 2:
                raise RuntimeError("lost")
            return super().encode(*args)

    cut = chunk_rows(rows, 50, 0)
    with pytest.raises(RuntimeError, match="lost"):
        store.append_missing(cut, "m", 50, 0, Failing(4), slice_rows=5)
    kept = store.read("m", 50, 0).count()
    assert 0 < kept < cut.count()
    store.append_missing(cut, "m", 50, 0, encode.HashingEncoder(4), slice_rows=5)
    assert store.read("m", 50, 0).count() == cut.count()
    create_chunk_table(spark, "same_partitions")
    assert spark.table("same_partitions").columns[-3:] == ["model", "chunk_size", "overlap"]
    both = encode.HashingDual(4).encode(rows, "case_no", "content")
    store.write(rows.select("case_no", F.lit(0).alias("chunk_index"), F.col("content").alias("chunk_text")).join(both, "case_no"), "dual", 0, 0)
    assert store.read("dual", 0, 0).where("size(weights) > 0").count() == 4


def test_index_is_saved(spark, tmp_path):
    index = search.CellIndex(np.random.default_rng(0).normal(size=(5, 3)))
    index.save(spark, str(tmp_path / "index"))
    assert np.array_equal(search.CellIndex.load(spark, str(tmp_path / "index")).centroids, index.centroids)


def test_command_line(spark, folders, tmp_path):
    (tmp_path / "labels").mkdir()
    for no in ("1", "4", "nowhere"):
        (tmp_path / "labels" / f"{no}.json").write_text(json.dumps({"info": {"caseNoID": no}, "jdgmnInfo": [{"question": "first" if no == "1" else "x", "answer": "a"}]}))
    rejected = cli.main(["build", *folders, "--labels", str(tmp_path / "labels"), "--out", str(tmp_path / "out")])
    assert {r["reason"]: r["n"] for r in rejected} == {"unreadable": 1, "no_content": 1, "no_case_no": 1}
    asked = spark.read.json(str(tmp_path / "out" / "queries"))
    assert sorted(r["query"] for r in asked.collect()) == ["first", "x"]
    report = cli.main(["load", "--corpus", str(tmp_path / "out" / "corpus"), "--store", str(tmp_path / "s"), "--dim", "8"])
    assert report[0]["n_documents"] == 3 and report[0]["bytes"] > 0
    (tmp_path / "q.json").write_text(json.dumps([{"query": "first", "case_ids": ["1"]}]))
    for mode in ("exact", "cells"):
        got = cli.main(["evaluate", "--store", str(tmp_path / "s"), "--queries", str(tmp_path / "q.json"), "--dim", "8", "--mode", mode, "--cells", "2", "--probes", "2"])
        assert got[0]["queries"] == 1 and got[0]["recall@1"] == 1.0
    common = ["--store", str(tmp_path / "s"), "--queries", str(tmp_path / "q.json"), "--dim", "8", "--index", str(tmp_path / "i"), "--probes", "2", "--mode"]
    cli.main(["load", "--corpus", str(tmp_path / "out" / "corpus"), "--store", str(tmp_path / "s"), "--dim", "8", "--index", str(tmp_path / "i"), "--cells", "2", "--encoder", "korpusmill.operators.encode:HashingEncoder"])
    fit = search.CellIndex.fit
    search.CellIndex.fit = None  # the saved index is used
    try:
        for mode in ("cells", "codes"):
            got = cli.main(["evaluate", *common, mode, "--latency", "1"])
            assert got[0]["recall@1"] == 1.0 and got[0]["latency_p99_ms"] >= got[0]["latency_p50_ms"] > 0
        mined = cli.main(["mine", *common, "codes", "--out", str(tmp_path / "mined"), "--skip-top", "0"])
    finally:
        search.CellIndex.fit = fit
    assert {r["reason"]: r["n"] for r in mined} == {"pairs": 1, "triples": 1, "no_chunks": 0, "no_negative": 0}
    triple = spark.read.json(str(tmp_path / "mined" / "triples")).first()
    assert triple["query"] == "first" and triple.positive_chunk != triple.hard_negative_chunk
    mined = cli.main(["mine", *common, "exact", "--out", str(tmp_path / "mined2"), "--skip-top", "99"])
    assert {r["reason"]: r["n"] for r in mined} == {"pairs": 1, "triples": 0, "no_chunks": 0, "no_negative": 1}
    with pytest.raises(ValueError, match="package.module:name"):
        cli.main(["evaluate", *common, "exact", "--encoder", "nowhere"])


def test_broken_query_set_raises(spark, tmp_path):
    (tmp_path / "q.json").write_text('[{"query": "q0", "case_ids": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        cases.read_queries(spark, str(tmp_path / "q.json")).collect()


def test_store_appends_only_what_is_missing(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    docs = spark.createDataFrame([("1", "a" * 450), ("2", "b")], "case_no string, content string")
    cut = chunks(docs, "case_no", "content", 200, 0).drop("char_offset")
    encoder = encode.HashingEncoder(4)
    store.append_missing(cut.where("chunk_index = 0"), "m", 200, 0, encoder)
    store.append_missing(cut, "m", 200, 0, encoder)
    store.append_missing(cut, "m", 200, 0, encoder)
    kept = store.read("m", 200, 0)
    assert kept.count() == 4 and {r.n_missing for r in missing_keys(kept.select(F.concat_ws("/", "case_no", "chunk_index").alias("k")), cut.select(F.concat_ws("/", "case_no", "chunk_index").alias("k")), "k").collect()} == {0}
    store.write(cut.limit(1), "m", 300, 0)
    assert {(r.chunk_size, r.n_chunks) for r in store.report().collect()} == {(200, 4), (300, 1)}
    assert store.of_document(docs.where("case_no = '1'"), "m", 200, 0).count() == 3
    with pytest.raises(Exception, match="is null"):
        store.write(cut.withColumn("chunk_text", F.lit(None).cast("string")), "m", 1, 0)
    store.as_table("chunks_table", 4)
    assert spark.table("chunks_table").count() == 5
    create_chunk_table(spark, "made")
    create_chunk_table(spark, "made")
    assert spark.table("made").count() == 0


def test_stream_ingests_each_document_once(spark, folders, tmp_path):
    store, encoder = ChunkStore(spark, str(tmp_path / "store")), encode.HashingEncoder(4)
    for _ in range(2):
        ingest(spark, folders[1], store, str(tmp_path / "cp"), "m", encoder).awaitTermination()
    first = store.read("m", 300, 100).count()
    (tmp_path / "val" / "new.json").write_text(json.dumps(case("9", "new one")))
    ingest(spark, folders[1], store, str(tmp_path / "cp"), "m", encoder).awaitTermination()
    assert store.read("m", 300, 100).count() == first + 1
