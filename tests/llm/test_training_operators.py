"""The training-data operators against brute force, round trips and odd rows."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF, rows_of, rows_of_sql
from pyspark.sql import functions as F

import korpusmill.llm.queries as Q
from korpusmill.llm import components, embedding_dedup, files, language_id, line_dedup, media, minhash, packing, piece_model, sentence_pieces, skew, suffix_dedup, toxicity, warc
from korpusmill.storage import Scratch

ODD = [(1, None), (2, ""), (3, "\n"), (4, "aa bb " * 400), (5, "aa bb " * 400), (5, "aa bb " * 400), (None, "aa bb " * 400), (7, "é漢😀 x\n" * 60), (8, " "), (9, "one two three")]
SCHEMA = "doc_id long, text string"
TOKENIZER = Q.tokenizer_file("word_bpe_49k.json")
PIECES = Q.tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, repeated rows, and other columns whose names the operators use themselves."""
    return spark.createDataFrame(ODD, SCHEMA).select("*", *[F.lit(None).cast("string").alias(c) for c in ("id", "at", "key", "kind", "lines", "batch", "n", "registers", "component", "score", "ids", "_n")])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows_of(Q.QUERIES[name](spark, SF)) == rows_of_sql(duck, Q.ORACLE_SQL[name])


# 1


def test_packing(spark, docs, odd, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = packing.pack_documents(docs, TOKENIZER).collect()
    pieces = {(r.doc_id, r.piece): r for r in rows}
    lengths = 0
    for d in docs.collect():
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        lengths += len(ids)
        for p, lo in enumerate(range(0, len(ids), 4096)):
            r, own = pieces.pop((d.doc_id, p)), ids[lo : lo + 4096]
            assert (r.start, r.length, r.ids_crc32) == (lo, len(own), zlib.crc32(own.tobytes()))
    assert not pieces
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own[:-1])]).tolist() and sum(n for _, n in own) <= 4096
    assert len(bins) <= 1.02 * lengths / 4096 + 1
    got = packing.pack_documents(odd, TOKENIZER).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got) == len(ODD)
    assert packing.pack_documents(empty, TOKENIZER).count() == 0


def test_packing_keeps_every_constraint():
    rng = np.random.default_rng(2)
    for rule in ("residual", "dot"):
        counts = {int(n): int(c) for n, c in zip(rng.choice(np.arange(1, 100), 30, replace=False), rng.integers(1, 40, 30), strict=True)}
        packer = packing.VectorBestFit(100, max_docs=5, max_cost=4000.0 + 99**2, weights=(1.0, 0.5, 0.5), rule=rule)
        bins = defaultdict(list)
        for length, rank, ranks, per, first, _ in packer.pack(counts).tolist():
            for k in range(ranks):
                bins[first + k // per].append(length)
            counts[length] -= ranks
            assert rank >= 0
        assert not any(counts.values()) and len(bins) == packer.bins
        assert all(sum(b) <= 100 and len(b) <= 5 and sum(x * x for x in b) <= 4000 + 99**2 for b in bins.values())


def _one_by_one(counts: dict[int, int], p: packing.VectorBestFit) -> list[list[int]]:
    """The packer's rule item by item."""
    bins, left = [], []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            item = p.item(length)
            scores = [
                (p.weights * ((r - item) / p.cap) ** 2).sum() if p.rule == "residual" else -(p.weights * (item / p.cap) * (r / p.cap)).sum() if (r >= item).all() else np.inf for r in left
            ]
            scores = [x if (r >= item).all() else np.inf for x, r in zip(scores, left, strict=True)]
            k = int(np.argmin(scores)) if scores and min(scores) < np.inf else len(bins)
            if k == len(bins):
                bins.append([])
                left.append(p.cap.astype(float))
            bins[k].append(length)
            left[k] = left[k] - item
    return bins


@pytest.mark.parametrize("rule", ["residual", "dot"])
def test_packing_follows_its_rule(rule):
    rng = np.random.default_rng(3)
    for trial in range(12):
        counts = {int(n): int(c) for n, c in zip(rng.choice(np.arange(1, 64), 14, replace=False), rng.integers(1, 30, 14), strict=True)}
        p = packing.VectorBestFit(64, max_docs=int(rng.integers(3, 9)), weights=(1.0, 0.3, 0.2), rule=rule, tile=8)
        bins = defaultdict(list)
        for length, _, ranks, per, first, _ in p.pack(counts).tolist():
            for k in range(ranks):
                bins[first + k // per].append(length)
        assert sorted(sorted(b) for b in bins.values()) == sorted(sorted(b) for b in _one_by_one(counts, p)), trial


def test_all_capacities_bind_and_choose(spark):
    """The query's capacities: many short documents fill one by documents or cost; the three residuals choose other bins than tokens alone, and as few."""
    lengths = [r.length for r in packing.token_pieces(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), TOKENIZER).select("length").collect()]
    counts = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
    own, plain = Q.packer(), packing.VectorBestFit(4096)
    a, b = own.pack(counts), plain.pack(counts)
    assert a.shape != b.shape or (a != b).any()
    assert own.bins <= 1.001 * sum(lengths) / 4096 + 1 and own.bins <= plain.bins
    short = packing.VectorBestFit(4096, max_docs=2048, weights=(1.0, 0.1, 0.1), tile=128)
    short.pack({1: 5000})
    assert short.bins == 5  # 1024 tiles of 128 squared are the cost of a sequence
    give = Q.packer()
    give.pack({1: 5000})
    assert give.bins == 2


def test_capacities_give_way_step_by_step():
    """Documents bind where all are short, cost where a long one is among them; only as many doublings as save bins."""
    for lengths, both, cost, none in (({4: 1024}, 2, 1, 1), ({3968: 1, 1: 128}, 2, 2, 1), ({129: 700}, 23, 23, 23)):
        found = [packing.VectorBestFit(4096, max_docs=d, max_cost=c, tile=128) for d, c in ((512, None), (None, None), (None, 1e12))]
        for p in found:
            p.pack(lengths)
        assert [p.bins for p in found] == [both, cost, none], lengths
    for lengths, bins, lifted in (({1: 500}, 1, 1), ({1: 1000}, 1, 2), ({1: 2000}, 1, 4), ({1: 4000}, 1, 8), ({4096: 3, 1: 1000}, 4, 2), ({3968: 1, 1: 128}, 1, 2), ({4096: 5}, 5, 1)):
        p = Q.packer()
        placed = p.pack(lengths)
        assert (p.bins, p.lifted) == (bins, lifted), lengths
        assert placed[:, 2].sum() == sum(lengths.values())
        once = packing.VectorBestFit(4096, max_docs=512 * lifted, max_cost=4096.0**2 * lifted, weights=(1.0, 0.1, 0.1), tile=128)
        once.pack(lengths)
        assert once.bins == bins


def test_word_ids_of_all_planes():
    """Texts of every plane, of combining marks and syllable parts, against the tokenizer on whole texts."""
    import unicodedata

    from tokenizers import Tokenizer

    tokenizer, words = Tokenizer.from_file(TOKENIZER), packing.WordIds(TOKENIZER)
    assert words.by_word
    rng = np.random.default_rng(1)
    marks = np.array([c for c in range(0x20000) if unicodedata.category(chr(c))[0] == "M"])
    texts = ["<|startoftext|> A", "x<|STARTOFTEXT|>", "ΑΣ ΟΔΟΣ.", "don't", "İ", "a b", "A.B. c.", *(f"a{chr(m)}\u0316" for m in marks.tolist())]
    pools = [np.arange(0x20, 0x250), np.arange(0x20, 0xD800), np.append(marks, [0x20, 0x61] * 900), np.arange(0xE000, 0x110000), np.array([*range(0x1100, 0x1200), *range(0xAC00, 0xB000), 0x3A3, 0x20, 0x2E, 0x27])]
    for k in range(10_000):
        texts.append("".join(map(chr, rng.choice(pools[k % 5], rng.integers(1, 30)).tolist())))
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    assert all(x.tolist() == y.ids for x, y in zip(words(texts), want, strict=True))


def test_other_tokenizer_files_take_whole_texts(docs):
    from tokenizers import Tokenizer

    path = Q.tokenizer_file("byte_bpe_50k.json")
    words, texts = packing.WordIds(path), [r.text or "" for r in docs.limit(20).collect()]
    assert not words.by_word
    assert [x.tolist() for x in words(texts)] == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_equal_rows_are_dealt(spark):
    """Thousands of rows equal in all keys are packed one by one."""
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    got = packing.pack_documents(rows, TOKENIZER, packer=Q.packer()).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 3000 and len({r.sequence_id for r in got}) == 1


# 2


def test_sentence_pieces(spark, docs, odd, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = np.random.default_rng(0)
    alphabet = list("abcdethe  \n▁ éß漢😀<0x.,-_ing\t　")
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 80))) for _ in range(400)] + ["x" * 5000, " " * 300, "the" + " " * 17 + "cat", "0" * 300]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(texts)], SCHEMA))
    encoded = sentence_pieces.encode(df, PIECES)
    want = {r.doc_id: library.encode(r.text or "") for r in df.collect()}
    for r in encoded.collect():
        assert r.ids == want[r.doc_id] and r.n_ids == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for r in sentence_pieces.decode(encoded.select("doc_id", "ids"), PIECES).collect():
        assert r.text == library.decode(want[r.doc_id])
    assert sorted(len(r.ids) for r in sentence_pieces.encode(odd, PIECES).collect()) == sorted(len(library.encode(t or "")) for _, t in ODD)
    assert sentence_pieces.encode(empty, PIECES).count() == 0
    lists = spark.createDataFrame([(1, None), (2, []), (3, [5, None]), (4, [99999]), (5, [3 + 0xFF, 3 + 0x41])], "doc_id long, ids array<int>")
    assert [r.text for r in sentence_pieces.decode(lists, PIECES).orderBy("doc_id").collect()] == [None, "", None, None, "�A"]


def test_unigram_shortest_path_equals_brute_force():
    rng = np.random.default_rng(4)
    pieces = [("<unk>", 0.0, piece_model.UNKNOWN), *((f"<0x{b:02X}>", 0.0, piece_model.BYTE) for b in range(256))]
    names = sorted({"".join(rng.choice(list("ab▁"), rng.integers(1, 5))) for _ in range(40)} | {"a", "b", "▁"})
    pieces += [(n, -float(rng.uniform(1, 9)), piece_model.NORMAL) for n in names]
    machine = piece_model.Transducer(piece_model.PieceModel(pieces, piece_model.UNIGRAM, dummy_prefix=False))
    score = {i: s for i, (_, s, _) in enumerate(pieces)}

    def best(text: str) -> float:
        least = [0.0] + [float("inf")] * len(text)
        for end in range(1, len(text) + 1):
            for n in range(1, end + 1):
                i = machine.ids.get(text[end - n : end])
                if i is not None:
                    least[end] = min(least[end], least[end - n] - score[i])
        return least[-1]

    texts = ["".join(rng.choice(list("ab "), rng.integers(1, 14))) for _ in range(200)]
    flat, sizes = machine.paths(texts)
    for text, ids in zip(texts, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
        assert "".join(machine.text_of[i] for i in ids.tolist()) == text
        assert abs(-sum(score[i] for i in ids.tolist()) - best(text)) < 1e-9
        assert abs(-sum(score[i] for i in machine.path(text)) - best(text)) < 1e-9
    assert machine.path("aéb") == [machine.ids["a"], machine.model.bytes[0xC3], machine.model.bytes[0xA9], machine.ids["b"]]


def _model_file(pieces, kind, fallback, prefix, extra) -> bytes:
    """A model file: its fields, written by hand."""
    import struct

    def number(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    plain = lambda k, v: number(k << 3) + number(v)
    nested = lambda k, v: number(k << 3 | 2) + number(len(v)) + v
    out = b"".join(nested(1, nested(1, p.encode()) + number(2 << 3 | 5) + struct.pack("<f", s) + plain(3, t)) for p, s, t in pieces)
    return out + nested(2, plain(3, kind) + plain(35, int(fallback))) + nested(3, nested(1, b"identity") + plain(3, int(prefix)) + plain(4, int(extra)))


@pytest.mark.parametrize("kind", [piece_model.UNIGRAM, piece_model.BPE])
@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize(("prefix", "extra"), [(True, True), (True, False), (False, True), (False, False)])
def test_small_models_equal_the_library(tmp_path, kind, fallback, prefix, extra):
    """Normaliser, pieces and fallback against the public library: unknown characters in a row, marks and blanks in a row, ends."""
    import sentencepiece

    rng = np.random.default_rng(17)
    letters = list("abcd▁é")
    names = sorted({"".join(rng.choice(letters, rng.integers(2, 5))) for _ in range(60)})
    names = [n for n in names if "▁" not in n[1:]]
    if kind == piece_model.BPE:  # pieces that merges can reach
        names = sorted({n[:k] for n in names for k in range(2, len(n) + 1)})
    names = [*names, *letters]
    scores = -rng.permutation(len(names)).astype(float) - 1 if kind == piece_model.BPE else -rng.uniform(1, 9, len(names))
    pieces = [("<unk>", 0.0, piece_model.UNKNOWN), ("<s>", 0.0, piece_model.CONTROL), ("</s>", 0.0, piece_model.CONTROL)]
    pieces += [(f"<0x{b:02X}>", 0.0, piece_model.BYTE) for b in range(256)] if fallback else []
    pieces += [(n, float(np.float32(s)), piece_model.NORMAL) for n, s in zip(names, scores, strict=True)]
    (tmp_path / "m.model").write_bytes(_model_file(pieces, kind, fallback, prefix, extra))
    library = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m.model"))
    encoder = sentence_pieces.Encoder(piece_model.PieceModel.load(str(tmp_path / "m.model")))
    texts = ["".join(rng.choice(list("aabbccdd  ▁éxyz漢😀\n"), rng.integers(0, 60))) for _ in range(300)] + ["", " ", "   ", "▁", " a ", "xyz", "xx yy", "a\n\nxx", "漢" * 90, "abcd" * 40]
    for text, ids in zip(texts, encoder(texts), strict=True):
        assert ids.tolist() == library.encode(text), ascii(text)


# 3


def test_suffix_dedup(spark, odd, empty):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdeé"), 5))
    shared = [" ".join(word() for _ in range(40)) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.integers(1, 60))) for _ in range(3)]
        for s in rng.choice(4, rng.integers(0, 3)):
            a, b = sorted(rng.integers(0, len(shared[s]), 2).tolist())
            parts.insert(int(rng.integers(0, 4)), shared[s][a:b])
        rows.append((i, "".join(parts)))
    rows += [(60, None), (61, "z" * 99), (62, "z" * 450), (63, "ab" * 120), (64, rows[0][1]), (65, rows[3][1] * 2)]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, SCHEMA)).select("*", F.sha2("kept", 256).alias("sha")).collect()
    want = suffix_dedup.brute_force(dict(rows), 100)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in got} == want
    whole = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, SCHEMA), whole_characters=True).collect()
    assert all(bytes(r.kept).decode() is not None for r in whole)
    out = suffix_dedup.suffix_dedup(odd)
    assert out.count() >= len({i for i, _ in ODD}) and {r.doc_id for r in out.collect()} == {i for i, _ in ODD}
    assert suffix_dedup.suffix_dedup(empty).count() == 0


@pytest.mark.parametrize("shared_id", [None, 5])
def test_suffix_dedup_of_texts_that_share_an_id(spark, shared_id):
    """Every text loses its own repeats at its own offsets, and keeps its own carried columns."""
    rng = np.random.default_rng(11)
    noise = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    passage = noise(150)
    texts = [noise(700) + passage + noise(30), noise(900), noise(300), passage + noise(40), noise(50) + passage[:130], ""]
    rows = [(-9, passage, "p"), *((shared_id, t, str(i)) for i, t in enumerate([*texts, texts[0]])), (77, "q" + passage[3:], "q"), (shared_id, None, "none")]
    smallest = -(2**63)
    docs = {(smallest if i is None else i, t) for i, t, _ in rows if t}
    hashes = {r.text: r.h for r in spark.createDataFrame([(t,) for _, t in docs], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(docs, key=lambda d: (d[0], hashes[d[1]]))
    want = {d: x for d, x in zip(order, suffix_dedup.brute_force(dict(enumerate(d[1] for d in order)), 100).values())}
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, f"{SCHEMA}, mark string"), carry=("mark",)).collect()
    assert len(got) == len(rows)
    text = {m: (smallest if i is None else i, t) for i, t, m in rows}
    for r in got:
        assert r.mark in text and (smallest if r.doc_id is None else r.doc_id) == text[r.mark][0]
        left = (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())
        assert left == (want[text[r.mark]] if text[r.mark][1] else (0, 0, 0, hashlib.sha256(b"").hexdigest()))


# 4


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (3, 2), (7, 3)])
def test_line_dedup(spark, docs, batches, fanout):
    lines = defaultdict(lambda: 10**9)
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    for i, t in rows.items():
        for x in t.split("\n"):
            lines[key(x)] = min(lines[key(x)], i)
    for r in line_dedup.line_dedup(docs, batches=batches, fanout=fanout).collect():
        own = rows[r.doc_id].split("\n")
        kept = [x for x in own if len(key(x)) < 10 or lines[key(x)] == r.doc_id]
        assert (r.text, r.n_lines, r.n_dropped) == ("\n".join(kept), len(own), len(own) - len(kept))


def test_line_runs_are_kept_merged_and_dropped(spark, docs, tmp_path):
    """Runs of a name serve later calls; without one no table stays; a merge sorts the batch but not the runs."""
    half = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    for d in half:
        runs = line_dedup.LineRuns(spark, f"file://{tmp_path}/runs", 2, "kept")
        out = line_dedup.line_dedup(d, runs=runs)
        out = {r.doc_id: (r.text, r.n_dropped) for r in out.collect()}
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
    earlier = {key(x) for r in half[0].collect() for x in (r.text or "").split("\n")}
    for r in half[1].collect():
        own = (r.text or "").split("\n")
        assert all(len(key(x)) < 10 or key(x) not in earlier for x in out[r.doc_id][0].split("\n")) and out[r.doc_id][1] >= sum(len(key(x)) >= 10 and key(x) in earlier for x in own)
    runs = line_dedup.LineRuns(spark, f"file://{tmp_path}/runs", 2, "kept")
    assert runs.number > 6 and sum(map(len, runs.levels)) <= 5
    keys = [r for run in runs.runs() for r in run.collect()]
    assert len(keys) == len(set(keys))
    with line_dedup._ordered_scans(spark):
        batch = spark.range(50).select(F.xxhash64("id").alias("h1"), F.xxhash64("id").alias("h2")).repartition(8, "h1", "h2")
        plan = batch.join(runs.runs()[0].hint("merge"), ["h1", "h2"], "left")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1
    runs.close(whole=True)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
    with pytest.raises(Exception, match="nowhere"):
        line_dedup.line_dedup(docs.withColumn("text", F.raise_error(F.lit("nowhere")))).collect()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_line_dedup_odd_rows(spark, odd, empty):
    out = line_dedup.line_dedup(odd).collect()
    assert len(out) == len(ODD)
    assert {r.n_lines for r in out if r.doc_id in (1, 2)} == {1}
    null = next(r for r in out if r.doc_id is None)
    assert null.n_dropped == 0 and all(r.n_dropped == 1 for r in out if r.doc_id in (4, 5))
    assert line_dedup.line_dedup(empty).count() == 0


# 5


def test_network_gradient():
    net = toxicity.Network(1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    tokens = ["alpha", "beta", "gamma", "delta"]
    index = np.zeros((2, toxicity.WINDOW), np.int64)
    index[0, :4], index[1, :2] = [1, 2, 3, 4], [4, 2]
    weight = np.array([0.7, -0.3])

    def loss() -> float:
        x, _ = net.inputs(tokens)
        return float(weight @ net.forward(net.gates(x.astype(np.float64)), index))

    x, back = net.inputs(tokens)
    x = x.astype(np.float64)
    gx = net.gates(x)
    net.forward(gx, index, keep=True)
    grads = net.backward(weight, gx, x, back)
    rng = np.random.default_rng(0)
    for k in ("w", "b", "u", "A", "Wf", "Wb", "Uf", "Ub", "cf", "cb"):
        flat = net.p[k].ravel()
        at = rng.integers(0, flat.size)
        before = flat[at]
        flat[at] = before + 1e-4
        up = loss()
        flat[at] = before - 1e-4
        down = loss()
        flat[at] = before
        assert abs((up - down) / 2e-4 - grads[k].ravel()[at]) < 1e-3, k
    for k in ("chars", "words"):
        used, grad = grads[k]
        r, c = int(rng.integers(0, len(used))), int(np.argmax(np.abs(grad).max(axis=0)))
        before = net.p[k][used[r], c]
        net.p[k][used[r], c] = before + 1e-5
        up = loss()
        net.p[k][used[r], c] = before - 1e-5
        down = loss()
        net.p[k][used[r], c] = before
        assert abs((up - down) / 2e-5 - grad[r, c]) < 1e-2, k


def test_scores_equal_a_plain_network():
    """All windows of a text, one step and one unit after the other, against ``Scorer``."""
    net, H = toxicity.Network(3), toxicity.HIDDEN
    net.scale, net.shift = 1.7, -0.2
    p = {k: v.astype(float) for k, v in net.p.items()}
    sig = lambda v: 1 / (1 + np.exp(-v))

    def of_word(token: str) -> np.ndarray:
        grams, _, whole = toxicity.spelled([token])
        rows = (grams % np.uint64(toxicity.BUCKETS)).astype(int)
        return np.concatenate([p["chars"][rows].max(axis=0), p["words"][int(whole[0] % np.uint64(toxicity.BUCKETS))]])

    def of_window(tokens: list[str]) -> float:
        states = []
        for d in "fb":
            h, out = np.zeros(H), []
            for t in tokens if d == "f" else tokens[::-1]:
                g, u = of_word(t) @ p[f"W{d}"] + p[f"c{d}"], h @ p[f"U{d}"]
                z, r = sig(g[:H] + u[:H]), sig(g[H : 2 * H] + u[H : 2 * H])
                n = np.tanh(g[2 * H :] + r * u[2 * H :])
                h = (1 - z) * n + z * h
                out.append(h)
            states.append(out if d == "f" else out[::-1])
        s = np.concatenate([np.array(x) for x in states], axis=1) if tokens else np.zeros((1, 2 * H))
        e = np.exp(np.tanh(s @ p["A"]) @ p["u"])
        return float((e * s).sum(axis=0) / e.sum() @ p["w"][:, 0] + p["b"][0])

    words = "alpha beta gamma delta «omega» Über 漢字 x . zz".split()
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(words, n)) for n in (1, 5, 31, 32, 33, 48, 49, 90)] + ["", "  ", "alpha", "alpha"]
    got = toxicity.Scorer(net)(texts)
    for text, score in zip(texts, got, strict=True):
        own = text.split()
        logit = max(of_window(own[lo : lo + toxicity.WINDOW]) for lo in range(0, max(len(own) - toxicity.STRIDE, 1), toxicity.STRIDE))
        assert abs(score - sig(net.scale * logit + net.shift)) < 1e-4
    assert got[-1] == got[-2] and got[8] == got[9]


def test_toxicity(spark, odd, empty):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = Q.op5_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    pos, neg = ([r.score for r in out if r.toxic == y] for y in (1, 0))
    assert np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) > 0.95
    net = toxicity.fit(spark.createDataFrame(ODD, SCHEMA), labels.limit(0))
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, net).collect()) and toxicity.score(empty, net).count() == 0


# 6, 8


def _png_samples(data: bytes) -> bytes:
    """A plain reader of greyscale images of filter type 0."""
    at, idat = 8, b""
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if data[at + 4 : at + 8] == b"IHDR":
            width, height = (int.from_bytes(data[at + 8 + k : at + 12 + k], "big") for k in (0, 4))
        if data[at + 4 : at + 8] == b"IDAT":
            idat += data[at + 8 : at + 8 + n]
        at += 12 + n
    raw = zlib.decompress(idat)
    assert len(raw) == height * (width + 1)
    return b"".join(raw[k * (width + 1) + 1 : (k + 1) * (width + 1)] for k in range(height))


def _feature(x: bytes) -> str:
    mean = sum(x) / len(x)
    shares = [x.count(v) / len(x) for v in set(x)]
    change = sum(a != b for a, b in zip(x[64:], x, strict=False)) / (len(x) - 64) if len(x) > 64 else 0.0
    return f"mean={mean:.4f};dev={(sum((v - mean) ** 2 for v in x) / len(x)) ** 0.5:.4f};bits={-sum(s * np.log2(s) for s in shares):.4f};change={change:.4f}"


def test_media(spark, tmp_path, odd, empty):
    folder = f"file://{tmp_path}/media"
    long = spark.createDataFrame([(70, "xyz é " * 200_000), (71, "a" * 64), (72, "b" * 65)], SCHEMA)
    rows_in = [*ODD, *[tuple(r) for r in long.collect()]]
    assert media.write_archives(odd.select("doc_id", "text").unionByName(long).repartition(2), folder).agg(F.sum("members")).first()[0] == len(rows_in)
    want = []
    for i, t in rows_in:
        data = (t or "").encode()
        own = data + bytes(64 * max(1, -(-len(data) // 64)) - len(data))
        want.append((str(i), len(data), len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-64:]), _feature(own)))
    stored = {}
    for range_bytes in (50, 300, 1 << 20):
        read = media.read_archives(spark, folder, range_bytes)
        rows = media.media_features(read).collect()
        assert sorted((str(r.id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) for r in rows) == sorted(want)
        stored = {bytes(r.media) for r in read.collect()}
        assert {(r.media_bytes, r.media_sha256) for r in rows} == {(len(m), hashlib.sha256(m).hexdigest()) for m in stored}
    assert {hashlib.sha256(_png_samples(m)).hexdigest() for m in stored} == {w[3] for w in want}
    path = sorted((tmp_path / "media").glob("*.zip"))[0]
    data = bytearray(path.read_bytes())
    data[60] ^= 255
    path.write_bytes(data)
    errors = [r.error for r in media.read_archives(spark, folder).collect()]
    assert sum(e is not None for e in errors) == 1 and len(errors) == len(rows_in)
    media.write_archives(empty, f"{folder}-empty").collect()
    assert media.read_archives(spark, f"{folder}-empty").count() == 0


def test_media_reader_reads_foreign_archives_and_retries(tmp_path):
    """Entries with comments and extras, archives in archives, deflated members; a member that fails once is read again by its offset."""
    import io
    import zipfile

    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        for k in range(30):
            z.writestr(f"inner{k}", bytes([k]) * 40)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for k in range(120):
            info = zipfile.ZipInfo(f"m{k}.PK\x01\x02")
            info.comment, info.compress_type = b"PK\x01\x02" * (k % 9), zipfile.ZIP_DEFLATED if k % 3 else zipfile.ZIP_STORED
            z.writestr(info, inner.getvalue() if k % 5 == 0 else bytes([k]) * k)
    want = sorted((f"m{k}.PK\x01\x02", inner.getvalue() if k % 5 == 0 else bytes([k]) * k) for k in range(120))
    for range_bytes in (100, 777, 5000, 1 << 20):
        reader = media.MediaReader(f"file://{tmp_path}", range_bytes, 2)
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert sorted((r["member"], r["media"]) for r in rows) == want and not any(r["error"] for r in rows)
    reader, plain, failed = media.MediaReader(f"file://{tmp_path}", 1 << 20, 2), media.MediaReader._member, []

    def once(stream, info):
        if info.offset % 2 and info.offset not in failed:
            failed.append(info.offset)
            raise OSError("connection lost")
        return plain(reader, stream, info)

    reader._member = once
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert failed and sorted((r["member"], r["media"]) for r in rows) == want


def test_warc(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    extra = spark.createDataFrame([(900, None, None), (901, "u", ""), (902, "v\n w", "same"), (903, None, "same"), (None, "x", "same")], pages.schema)
    every = pages.unionByName(extra)
    folder = f"file://{tmp_path}/warc"
    warc.write_warc(every.repartition(3), folder).collect()
    rows = warc.read_warc(spark, folder, payload=True).collect()
    source = [(r.page_id, (r.html or "").encode()) for r in every.collect()]
    last = {}
    for i, p in source:
        last[p] = max(last.get(p, -1), -1 if i is None else i)
    assert len(rows) == len(source)
    for r in rows:
        own = [p for i, p in source if i == r.page_id][0]
        assert (r.payload_bytes, r.payload_digest) == (len(own), warc.digest(own))
        revisit = r.page_id is not None and r.page_id != last[own]
        assert (r.record_type, r.refers_to) == (("revisit", last[own]) if revisit else ("response", None))
        assert revisit or bytes(r.payload) == own
    path = sorted((tmp_path / "warc").glob("*.warc.gz"))[0]
    path.write_bytes(path.read_bytes()[:-9])
    with pytest.raises(Exception, match="part-.*byte [0-9]+.*cut off"):
        warc.read_warc(spark, folder).collect()


def test_warc_odd_rows(spark, tmp_path):
    """An empty table, clashing columns, repeated ids, very long payloads."""
    schema = "page_id long, url string, html string"
    warc.write_warc(spark.createDataFrame([], schema), f"file://{tmp_path}/none").collect()
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0
    rows = [(1, "u", "x" * 3_000_000), (1, "u", "x" * 3_000_000), (1, "u", "other"), (2, "u", "é\r\n\r\n"), (3, None, None), (4, "u", None)]
    df = spark.createDataFrame(rows, schema).withColumns({c: F.lit("c") for c in ("d", "n", "refers_to", "path", "payload", "record_type")})
    warc.write_warc(df, f"file://{tmp_path}/odd").collect()
    got = warc.read_warc(spark, f"file://{tmp_path}/odd", payload=True).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == [
        (1, 5, "response", None), (1, 3_000_000, "response", None), (1, 3_000_000, "response", None), (2, 6, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None)
    ]
    assert {r.payload_digest for r in warc.read_warc(spark, f"file://{tmp_path}/odd").collect()} == {warc.digest((t or "").encode()) for *_, t in rows}


@pytest.mark.parametrize("small", [True, False])
def test_warc_record_ids(spark, tmp_path, monkeypatch, small):
    """Ids are unique whatever repeats, revisits name the record they mean, and one payload of most rows is the same in both joins."""
    if not small:
        monkeypatch.setattr(skew, "SMALL_BYTES", 0)
        monkeypatch.setattr(skew, "HOT_ROWS", 5)
    rows = [(k if k % 5 else None, "u", "") for k in range(300)] + [(7, "u", "seven")] * 3 + [(6, "v", "seven"), (8, "w", "pair"), (9, "w", "pair"), (9, "w", "other"), (None, None, None)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), f"file://{tmp_path}/w").collect()
    got = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    assert len(got) == len(rows)
    last = {t: max(i for i, _, x in rows if i is not None and (x or "") == t) for t in ("", "seven", "pair", "other")}
    want = sorted(str((i, warc.digest((t or "").encode()), last[t or ""] if i is not None and i < last[t or ""] else None)) for i, _, t in rows)
    assert sorted(str((r.page_id, r.payload_digest, r.refers_to)) for r in got) == want
    heads = [zlib.decompress(m, 31).split(b"\r\n\r\n")[0].decode() for path in (tmp_path / "w").glob("*.warc.gz") for m in _members(path.read_bytes())]
    fields = [dict(line.split(": ", 1) for line in h.split("\r\n")[1:]) for h in heads]
    ids = {f["WARC-Record-ID"]: f for f in fields}
    assert len(ids) == len(rows)
    for f in fields:
        if (target := f.get("WARC-Refers-To")) is not None:
            assert ids[target]["WARC-Type"] == "response" and ids[target]["X-Page-ID"] == f["X-Refers-To-Page-ID"] and ids[target]["WARC-Payload-Digest"] == f["WARC-Payload-Digest"]
        else:  # a response, or a revisit of a page_id that several rows have
            assert f["WARC-Type"] == "response" or f["X-Refers-To-Page-ID"] == "7"


def _members(data: bytes):
    while data:
        inflate = zlib.decompressobj(31)
        inflate.decompress(data)
        yield data[: len(data) - len(inflate.unused_data)]
        data = inflate.unused_data


@pytest.mark.parametrize(("old", "new", "message"), [
    (b"Content-Length: 9\r\n\r\n", b"\r\n", "Content-Length"), (b"Content-Length: 9\r\n\r\n", b"Content-Length: 8\r\n\r\n", "followed by"), (b"Content-Length: 9\r\n\r\n", b"Content-Length: 90\r\n\r\n", "block has"),
    (b"hello", b"hallo", "digest differs"), (b"WARC-Type: response\r\n", b"", "WARC-Type"), (b"WARC/1.1", b"WORC/1.1", "no WARC header"), (b"sha1:", b"md5:", None),
])
def test_warc_faults(old, new, message):
    import gzip
    import io

    block = b"\r\n\r\nhello"
    raw = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:{warc.digest(b'hello')}\r\nWARC-Block-Digest: sha1:{warc.digest(block)}\r\nContent-Length: 9\r\n\r\n".encode() + block + b"\r\n\r\n"
    good = list(warc.records(io.BytesIO(gzip.compress(raw) * 2)))
    assert [r["payload"] for r in good] == [b"hello"] * 2 and good[1]["offset"] == len(gzip.compress(raw))
    bad = gzip.compress(raw) + gzip.compress(raw.replace(old, new))
    if message is None:
        assert [r["payload"] for r in warc.records(io.BytesIO(bad))] == [b"hello"] * 2
    else:
        with pytest.raises(ValueError, match=f"byte {len(gzip.compress(raw))}: .*{message}"):
            list(warc.records(io.BytesIO(bad)))


# 7


def test_embedding_links(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 12))
    x = np.concatenate([centres[rng.integers(0, 40, 900)] + 0.25 * rng.normal(size=(900, 12)), np.repeat(centres[:1], 60, axis=0)]).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 7 > 0)) for i, v in enumerate(x)]
    rows += [(2000, None, 1), (2001, [0.0] * 12, 1), (2002, [float("nan")] * 12, 1), (2003, x[0].tolist(), None), (2004, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for name, blocks, pivots in (("plain", 8192, 1024), ("blocks", 64, 1024), ("inner cells", 16, 4)):
        monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", blocks)
        monkeypatch.setattr(embedding_dedup, "MAX_PIVOTS", pivots)
        got[name] = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_links(df.withColumns({c: F.lit("x") for c in ("id", "g", "v", "cell", "n", "links")})).collect()}
    assert got["plain"] == got["blocks"] == got["inner cells"]
    got = got["plain"]
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[: len(x)]])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(root, np.where(near, root[None, :], 10**9).min(axis=1))
        if (new == root).all():
            break
        root = new
    assert all(got[i] == (int(near[i].sum()), int(root[i])) for i in range(len(x)))
    assert all(got[i] == (0, i) for i in range(2000, 2005))
    assert embedding_dedup.embedding_links(df.limit(0)).count() == 0


def test_embedding_links_of_copies_and_doubles(spark):
    """50,000 equal vectors are one row; doubles keep their precision; repeated rows are one, other vectors of an id add up."""
    copies = spark.range(50_000).select(F.col("id").alias("vec_id"), F.array(F.lit(0.6), F.lit(0.8)).cast("array<float>").alias("embedding"), F.lit(1).alias("label"))
    out = embedding_dedup.embedding_links(copies).agg(F.min("n_links"), F.max("n_links"), F.max("component_id"), F.count_if("kept"), F.count(F.lit(1))).first()
    assert list(out) == [49_999, 49_999, 0, 1, 50_000]
    at = lambda cosine: [cosine, (1 - cosine * cosine) ** 0.5]
    rows = [(1, [1.0, 0.0], 1), (2, at(0.93 + 1e-12), 1), (3, at(0.93 - 1e-12), 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (5, [-1.0, 0.0], 1), (5, [0.0, -1.0], 1), (6, [-0.0, -1.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    # 2 and 3 are near each other
    assert got == {1: (2, 1, True), 2: (3, 1, False), 3: (1, 1, False), 4: (2, 1, False), None: (0, None, True), 5: (1, 5, True), 6: (1, 5, False)}


# 9


def _near(rows: dict[int, str], words: int) -> dict[int, int]:
    sets = {}
    for i, t in rows.items():
        own = (t or "").encode().lower().split()
        k = min(words, len(own))
        sets[i] = {tuple(own[a : a + k]) for a in range(len(own) - k + 1)} if own else set()
    root = {i: i for i in rows}
    inverse = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            inverse[g].append(i)
    pairs = {(a, b) for own in inverse.values() for a in own for b in own if a < b}
    for _ in range(len(rows)):
        before = dict(root)
        for a, b in pairs:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[a] = root[b] = min(root[a], root[b])
        if before == root:
            return root
    return root


def test_near_duplicates(spark, odd, empty, monkeypatch):
    rng = np.random.default_rng(7)
    base = [rng.integers(0, 500, 120).tolist() for _ in range(6)]
    rows = {}
    for i in range(240):
        own = list(base[i % 6])
        for at in rng.integers(0, 120, rng.integers(0, 9)):
            own[at] = int(rng.integers(0, 500))
        rows[i] = " ".join(f"W{x}" for x in own)
    rows |= {500: None, 501: " ", 502: "a b", 503: "A  b", 504: "b a"}
    monkeypatch.setattr(minhash, "SKETCHES", 16)
    monkeypatch.setattr(minhash, "TEXTS", 16)
    out = minhash.near_duplicates(spark.createDataFrame(list(rows.items()), SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in out} == _near(rows, 5)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    # one hub leaves members apart, which are compared with the whole family; keys count as hot from 2 rows on
    monkeypatch.setattr(minhash, "HUBS", 1)
    monkeypatch.setattr(minhash, "TEXTS", 4)
    monkeypatch.setattr(skew, "SMALL_BYTES", 0)
    monkeypatch.setattr(skew, "HOT_ROWS", 2)
    out = minhash.near_duplicates(spark.createDataFrame(list(rows.items()), SCHEMA), words=4).collect()
    assert {r.doc_id: r.component_id for r in out} == _near(rows, 4)
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id == 5} == {4} and {r.component_id for r in got if r.doc_id is None} == {None}
    assert minhash.near_duplicates(empty).count() == 0


def test_likelihood_is_near_the_similarity():
    rng = np.random.default_rng(8)
    for share in (0.5, 0.8, 0.95):
        pool = rng.integers(0, 2**63, 2000, dtype=np.uint64)
        a, b = np.unique(pool[: int(1000 * (1 + share))]), np.unique(pool[int(1000 * (1 - share)) :][: int(1000 * (1 + share))])
        regs = minhash.sketches([a, b])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = minhash.likely_jaccard(regs[:1], regs[1:], np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs(got - true) < 0.12
    assert (np.maximum(minhash.sketches([a])[0], minhash.sketches([b])[0]) == minhash.sketches([np.union1d(a, b)])[0]).all()


def test_components_of_hubs_and_chains(spark, monkeypatch):
    monkeypatch.setattr(skew, "SMALL_BYTES", 0)
    monkeypatch.setattr(skew, "HOT_ROWS", 4)
    star, chain = [(7, i) for i in range(100, 400)], [(i, i + 1) for i in range(1000, 1060)]
    rows = [*star, *star[:5], *chain, (3, 3), (None, 4), (5, None), (399, 400)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(rows, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: 7 for i in (7, *range(100, 401))} | {i: 1000 for i in range(1000, 1061)}
    assert components.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_unique_equals_join(spark, monkeypatch, how):
    monkeypatch.setattr(skew, "SMALL_BYTES", 0)
    monkeypatch.setattr(skew, "HOT_ROWS", 2)
    rows = spark.createDataFrame([("hot", i) for i in range(50)] + [(None, 1), ("a", 2), ("zz", 3)], "k string, x int")
    unique = spark.createDataFrame([("hot", 1.5, 50), ("a", 2.5, 1), ("b", 3.5, 1)], "k string, y double, n long")
    want = sorted(map(str, rows.join(unique.drop("n"), ["k"], how).collect()))
    assert sorted(map(str, skew.join_unique(rows, unique, ["k"], "n", how).collect())) == want


# 10


def test_language_id(spark, docs, odd, empty):
    found = Q.op10_language_id(spark, SF)
    truth = docs.select("doc_id", F.col("lang").alias("want")).where("want IS NOT NULL")
    got = found.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("want")).cast("int")), F.avg(F.col("accepted").cast("int"))).first()
    assert got[0] > 0.95 and got[1] > 0.95
    model = language_id.fit(docs)
    rows = lambda d: d.select("doc_id", "text", F.lit(None).cast("string").alias("url"), F.lit("h").alias("source"), F.lit(False).alias("markup"))
    out = language_id.identify(rows(odd), model, ["doc_id"]).collect()
    assert len(out) == len(ODD) and {(r.lang, r.accepted) for r in out if r.doc_id in (1, 2, 3, 8)} == {("und", False)}
    assert language_id.identify(rows(empty), model, ["doc_id"]).count() == 0
    assert language_id.address("http://[bad") == (None, None, None) and language_id.address("https://a.b.org/de/x") == ("a.b.org", "b.org", "/de")


def test_language_of_rows_that_were_not_fitted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = language_id.fit(docs.where(~out))
    rows = docs.where(out).select("doc_id", "text", F.lit(None).cast("string").alias("url"), "source", F.lit(False).alias("markup"))
    found = language_id.identify(rows, model, ["doc_id"]).join(docs.select("doc_id", F.col("lang").alias("want")), "doc_id").where("want IS NOT NULL")
    share, n = found.agg(F.avg((F.col("lang") == F.col("want")).cast("int")), F.count(F.lit(1))).first()
    assert n > 1500 and share > 0.97


def _fused(rows, languages):
    """The fusion in plain Python: rows (text scores, letters, declared, suffix, host, domain)."""
    L, S = len(languages), language_id.STRENGTH
    soft = lambda v: [np.exp(x - max(v)) / sum(np.exp(y - max(v)) for y in v) for x in v]
    first = [language_id.UNKNOWN if x == "und" else (1 - language_id.UNKNOWN) / (L - 1) for x in languages]
    own = [soft([s + np.log(f) for s, f in zip(r[0], first)]) if r[1] else [0.0] * L for r in rows]
    add = lambda k: [sum(o[i] for o, r in zip(own, rows) if k(r)) for i in range(L)]
    everything = add(lambda r: True)
    smooth = lambda n, to: [(a + S * b) / (sum(n) + S) for a, b in zip(n, to)]
    base, out = smooth(everything, first), []
    for r, o in zip(rows, own):
        towards = base if r[5] is None else smooth(add(lambda x: x[5] == r[5]), base)
        prior = base if r[4] is None else smooth([max(a - b, 0) for a, b in zip(add(lambda x: x[4] == r[4]), o)], towards)
        logs = [s + np.log(max(p, 1e-9)) for s, p in zip(r[0], prior)]
        for k in (2, 3):
            if r[k] is not None:
                n = add(lambda x: x[k] == r[k])
                share = sum(n) / max(sum(everything), 1e-9)
                logs = [x + np.log((a + S * share) / (b + S)) for x, a, b in zip(logs, n, everything)]
        p = soft(logs)
        lang = languages[p.index(max(p))] if r[1] else "und"
        out.append((lang, round(max(p), 5), lang != "und" and max(p) >= 0.5))
    return out


@pytest.mark.parametrize("small", [True, False])
def test_fusion_equals_plain_python(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(skew, "SMALL_BYTES", 0)
        monkeypatch.setattr(skew, "HOT_ROWS", 5)
    rng = np.random.default_rng(2)
    languages, rows = ["a", "b", "c", "und"], []
    pick = lambda *x: x[rng.integers(0, len(x))]
    for k in range(200):
        host, domain = pick(("x.d.org", "d.org"), ("y.d.org", "d.org"), ("z.e.com", "e.com"), (None, None), ("x.d.org", "d.org"))
        letters = bool(k % 9)
        rows.append((rng.normal(size=4).tolist() if letters else [0.0] * 4, letters, pick("a", "b", None), pick(".org", "/a", None), host, domain))
    rows += [([1.0, 1.0, 0.0, 0.0], True, None, None, None, None)] * 2  # a tie goes to the first name
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text_score array<double>, letters boolean, declared string, suffix string, host string, domain string")
    soft = lambda v: F.transform(F.transform("text_score", lambda x: F.exp(x)), lambda x: x)
    first = language_id.start(languages).tolist()
    weights = F.zip_with(soft(None), F.array(*[F.lit(x) for x in first]), lambda a, b: a * b)
    own = F.when(F.col("letters"), F.transform(weights, lambda x: x / F.aggregate(weights, F.lit(0.0), lambda a, b: a + b))).otherwise(F.array(*[F.lit(0.0)] * 4))
    scratch = Scratch(spark, "fusion")
    evidence = scratch.save(table.withColumn("own", own), "evidence")
    got = language_id.fuse(evidence, languages, ["doc_id"], scratch).orderBy("doc_id").collect()
    for r, (lang, top, accepted) in zip(got, _fused(rows, languages), strict=True):
        assert (r.lang, r.accepted) == (lang, accepted) and abs(r.confidence - top) < 2e-5


def test_language_of_odd_columns(spark, docs):
    """Columns with the names that the operator uses itself, repeated rows, labels whose sample has no letter."""
    rows = docs.limit(30).select("doc_id", "text", F.lit(None).cast("string").alias("url"), "source", F.lit(False).alias("markup"))
    clash = rows.withColumns({c: F.lit("x") for c in ("own", "letters", "host", "domain", "suffix", "declared", "rows", "towards", "lang", "text_score")})
    model = language_id.fit(docs)
    plain = sorted(map(tuple, language_id.identify(rows, model, ["doc_id"]).collect()))
    assert plain == sorted(map(tuple, language_id.identify(clash, model, ["doc_id"]).collect()))
    labelled = spark.createDataFrame([(i, "123", "num") for i in range(40)] + [(99, "abc", "num"), (1, "xyz uvw", "b"), (None, None, "c")], "doc_id long, text string, lang string")
    assert language_id.fit(labelled, sample_docs=1).languages == ["b", "num", "und"]
    assert language_id.fit(labelled.limit(0)).languages == ["und"]


def test_language_keeps_whole_rows(spark, docs):
    """Columns that are evidence go with their row as keys, of repeated ids each its own."""
    rows = docs.limit(40).select("doc_id", "text", F.lit(None).cast("string").alias("url"), "source", F.lit(False).alias("markup"))
    rows = rows.unionByName(spark.createDataFrame([(1, None, None, None, False), (1, " 7 ", None, "s", False), (None, "", None, "s", False)], rows.schema))
    model = language_id.fit(docs)
    whole = language_id.identify(rows, model, ["text", "doc_id", "source"])
    assert whole.columns == ["text", "doc_id", "source", "lang", "confidence", "accepted"]
    order = lambda out: sorted(out, key=str)
    assert order(map(tuple, whole.drop("text", "source").collect())) == order(map(tuple, language_id.identify(rows, model, ["doc_id"]).collect()))
    assert order(map(tuple, whole.select("doc_id", "text", "source").collect())) == order(map(tuple, rows.select("doc_id", "text", "source").collect()))
    with pytest.raises(ValueError, match="lang"):
        language_id.identify(rows.withColumn("lang", F.lit("x")), model, ["lang"])


def _tongues(n):
    """Labels with words of their own each: (label, text) of two rows a label; the second language's texts are all long."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(30)]
        rows += [(f"l{i:03d}", " ".join(rng.choice(words, 4000 if i == 1 else 60))) for _ in range(3 if i % 2 else 2)]
    return rows


def test_every_label_is_a_language(spark, monkeypatch):
    made = [(i, t, x) for i, (x, t) in enumerate(_tongues(40))] + [(None, " 12", "zz"), (None, None, "zy")]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    rows = docs.select("doc_id", "text", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("source"), F.lit(False).alias("markup"))
    model = language_id.fit(docs)
    assert model.languages == [*(f"l{i:03d}" for i in range(40)), "und"]
    found = {r.doc_id: (r.lang, r.accepted) for r in language_id.identify(rows, model, ["doc_id"]).collect()}
    assert all(found[i] == (x, True) for i, _, x in made if i is not None)
    monkeypatch.setattr(language_id, "DENSE", 8)
    joined = language_id.fit(docs)
    assert joined.table is None and all(np.allclose(joined.likelihood(t), model.likelihood(t)) for t in ("", "x", *(t for _, t, _ in made[:9])))


def test_a_label_of_one_id_is_sampled(spark):
    """All rows of a label share an id whose hash is over the sample's bound."""
    docs = spark.createDataFrame([(i, "one two three " * 3, "a") for i in range(50)] + [(7, "quatre cinq six " * 3, "b")] * 50, "doc_id long, text string, lang string")
    assert all(language_id.fit(docs, sample_docs=n).languages == ["a", "b", "und"] for n in (1, 2))


def test_a_shared_id_does_not_fill_the_sample(spark, monkeypatch):
    """Rows of null ids, a third of them copies, come into the sample like any others: about as many as asked for, not all."""
    texts = [(None, f"one two three w{i} w{i * 7}", "a") for i in range(4000)] + [(None, "copy of one text", "a")] * 2000
    seen = []
    monkeypatch.setattr(language_id, "_counted", lambda sample: seen.append(sample) or {})
    language_id.fit(spark.createDataFrame(texts, "doc_id long, text string, lang string"), sample_docs=10)
    plan = seen[0].collect()
    assert len(plan) == 10 and sum(r.text == "copy of one text" for r in plan) <= 1


def test_host_prior_decides_where_text_says_little(spark, docs):
    model = language_id.fit(docs)
    text = {r.lang: r.text for r in docs.where("lang IS NOT NULL AND n_chars BETWEEN 1500 AND 8000").collect()}
    rows = [(i, text["de"], "http://x.org/", None, False) for i in range(60)] + [(100, "z", "http://x.org/1", None, False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, url string, source string, markup boolean")
    assert {r.doc_id: r.lang for r in language_id.identify(df, model, ["doc_id"]).collect()}[100] == "de"


def test_committed_file_is_whole_or_absent(tmp_path):
    uri = f"file://{tmp_path}/x.bin"
    with pytest.raises(RuntimeError), files.Committed(uri, 1) as out:
        out.write(b"half")
        raise RuntimeError
    assert files.listed(f"file://{tmp_path}", ".bin") == []
    for attempt in (1, 2):
        with files.Committed(uri, attempt) as out:
            out.write(b"whole")
    assert files.listed(f"file://{tmp_path}", ".bin")[0][1] == 5
