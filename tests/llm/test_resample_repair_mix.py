"""Importance resampling, conversation repair and source mixing against plain Python and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import pytest
from conftest import SF
from pyspark.sql import functions as F

from korpusmill.llm import conversations, mixing, ranks, resampling
from korpusmill.storage import Scratch

CLASHING = ("id", "key", "rank", "row", "size", "h", "shard", "unfit", "present", "fault", "_n", "whole", "n_words", "initial")


def odd_columns(df):
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in CLASHING])


@pytest.mark.parametrize("by", [(), ("g",)])
def test_numbered_equals_window(spark, by):
    rows = [(random.Random(k).choice("aaab"), k % 7, k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, y int").repartition(5)
    got = ranks.numbered(df, [F.col("x").desc(), F.col("y")], Scratch(spark, "t"), by)
    want = defaultdict(list)
    for g, x, y in sorted(rows, key=lambda r: (-r[1], r[2])):
        want[g if by else ""].append((g, x, y))
    assert sorted((*r[:3], r.rank) for r in got.collect()) == sorted((*r, k) for own in want.values() for k, r in enumerate(own, 1))
    assert ranks.numbered(df.limit(0), [F.col("x")], Scratch(spark, "t"), by).collect() == []


# 11


def plain_resample(docs, target, n, buckets, min_words, percent, seed):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + m]).encode()) % buckets for m in range(1, n + 1) for i in range(len(words) - m + 1)]

    own, aim = [features(t) for _, t in docs], Counter(x for t in target for x in features(t)[1])
    s = Counter(x for _, f in own for x in f)
    big_s, big_t = sum(s.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)}
    rows = []
    for (i, _), (words, f) in zip(docs, own, strict=True):
        weight = sum(gain[x] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    fit = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = fit[: percent * len(fit) // 100]
    return sorted(((*r[:4], next((k for k, d in enumerate(drawn, 1) if d is r), None)) for r in rows), key=str)


@pytest.mark.parametrize(("n", "buckets"), [(1, 97), (2, 1000), (3, 50)])
def test_resampling_equals_plain_python(spark, monkeypatch, n, buckets):
    monkeypatch.setattr(resampling, "SLICE_CHARS", 60)  # several statements a batch, long texts in pieces
    pick = random.Random(n)
    words = ["Alpha", "beta", "gämma", "d'elta", "x2y", "ÉTÉ", "漢字", "z_z", "\x00q"]
    docs = [(k, " ".join(pick.choices(words, k=pick.randrange(60)))) for k in range(80)] + [(None, "beta " * 30), (900, None), (901, ""), (902, " \n"), (903, "a" * 500), (904, "beta\n" * 400)]
    target = ["beta x2y x2y", None, "ÉTÉ"]
    df = odd_columns(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    aim = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(df, aim, n=n, buckets=buckets, min_words=5, percent=30, seed=7)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_resample(docs, target, n, buckets, 5, 30, 7)


def test_resampling_of_nothing_repeats_and_no_target(spark):
    target = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert resampling.resample(spark.createDataFrame([], "doc_id long, text string"), target).collect() == []
    docs = spark.createDataFrame([(1, "one two " * 20), (1, "one two " * 20), (2, "three " * 30)] * 2, "doc_id long, text string")
    rows = resampling.resample(docs, target.limit(0), percent=50).collect()
    assert len(rows) == 6 and sorted(r.rank for r in rows if r.rank) == [1, 2, 3]
    assert len({(r.doc_id, r.weight, r.score) for r in rows}) == 2


# 12


def plain_repair(rows):
    """The cheapest edits by trying all, least string first."""
    seen, fault = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        fault.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    move = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    @cache
    def best(i, q, inserted=0):
        out = [(0, "", ())] if i == len(rows) and q in (0, 3) else []
        (given,) = [r for r in move[q] if r != "s"]
        name = {"u": "user", "a": "assistant"}[given]
        if inserted < 2:
            c, a, o = best(i, move[q][given], inserted + 1)
            out.append((c + 3, "I" + a, ((name, ""), *o)))
        if i < len(rows):
            c, a, o = best(i + 1, q)
            out.append((c + 4, "D" + a, o))
            _, role, text = rows[i]
            more = 3 if fault[i] == "truncated" else 0
            if fault[i] not in ("blank", "duplicate"):
                if role[:1] in move[q]:
                    c, a, o = best(i + 1, move[q][role[:1]])
                    out.append((c + more, "K" + a, ((role, text), *o)))
                c, a, o = best(i + 1, move[q][given])
                out.append((c + 3 + more, "R" + a, ((name, text), *o)))
        return min(out, key=lambda x: x[:2], default=(10**9, "", ()))

    cost, audit, out = best(0, 0)
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest, list(out)


def some_conversations():
    pick = random.Random(5)
    texts = ["Yes.", "No", "", " \n", "What?", "go on!", "hm", "né. "]
    roles = ["system", "user", "assistant", "tool", "", "s", "user", "assistant"]
    out = []
    for conv in range(120):
        for _ in range(pick.randrange(1, 14)):
            out.append((conv, pick.choice([None, 0, 1, 2, 3, 5, 9]), pick.choice([None, *roles]), pick.choice([None, *texts])))
    return out + [(None, 1, "user", "Null."), (None, 1, "user", "Null."), (None, 2, "assistant", "x.")]


@pytest.mark.parametrize("piece_rows", [4096, 1, 3])
def test_repair_equals_plain_python(spark, piece_rows):
    rows = some_conversations()
    gone = [(500 + k, k, "user", "x.", False) for k in range(2)] + [(600, k, "user", "x.", False) for k in range(5)]
    df = odd_columns(spark.createDataFrame([(*r, True) for r in rows] + gone, "conv_id long, turn long, role string, text string, there boolean").repartition(4))
    got = {r.conv_id: r for r in conversations.repair(df, present_col="there", piece_rows=piece_rows).collect()}
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn, " " if role is None else role, " " if text is None else text))
    assert len(got) == len(own) + 3
    for conv, r in got.items():
        ordered = sorted(own[conv], key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        *want, repaired = plain_repair(ordered)
        assert [r[c] for c in (*conversations.COUNTS, "audit", "repaired_sha256")] == want, conv
        assert r.repaired is None or [tuple(x) for x in r.repaired] == repaired
    assert (piece_rows == 4096) == all(r.repaired is not None for r in got.values())


def test_repair_of_nothing_names_and_blocks(spark, monkeypatch):
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert conversations.repair(empty).collect() == [] and conversations.repair(conversations.damage(empty), present_col="present").collect() == []
    monkeypatch.setattr(conversations, "BLOCK_ROWS", 2)
    rows = [(f"c{k % 5}", k, "user" if k % 2 else "assistant", f"t{k}.") for k in range(40)]
    got = conversations.repair(spark.createDataFrame(rows, empty.schema).withColumnsRenamed({"conv_id": "c", "turn": "t", "role": "r", "text": "x"}), "c", "t", "r", "x").collect()
    assert {r.c for r in got} == {f"c{k}" for k in range(5)} and sum(len(r.repaired) for r in got) >= 40


def test_damage(spark):
    rows = [(k, t, role, "A. b!") for k in range(30) for t, role in [(0, "system"), (1, None), (None, "user")]]
    got = defaultdict(list)
    for r in conversations.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got[r.conv_id, r.turn].append(r)
    kinds = set()
    for conv, turn, role, _ in rows:
        kind = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        kinds.add(kind)
        own = got[conv, turn]
        assert len(own) == (2 if kind == 3 else 1) and all(r.present == (kind != 0) for r in own)
        assert own[0].text == {1: "", 2: "A b"}.get(kind, "A. b!") and own[0].role == ("user" if kind == 4 else role or " ")
    assert kinds >= {0, 1, 2, 3, 4}


# 13


def plain_quotas(target, most, seats):
    quotients = sorted((-t / (2 * k + 1), i) for i, t in enumerate(target) for k in range(min(most[i], seats)))
    return [n[1] for n in sorted(Counter([i for _, i in quotients[:seats]] + list(range(len(target)))).items())]


@pytest.mark.parametrize("seed", range(4))
def test_apportionment_takes_the_highest_quotients(spark, seed):
    pick = random.Random(seed)
    rows, want = [], {}
    for g in range(3):
        n = pick.choice([1, 2, 9, 40])
        target = [pick.choice([0.0, 1.0, 7.0, 7.0, pick.random() * 10 ** pick.randrange(6)]) for _ in range(n)]
        seats = pick.choice([0, 1, 5, 400])
        rows += [(g, k, t, 10_000, seats) for k, t in enumerate(target)]
        want |= {(g, k): q - 1 for k, q in enumerate(plain_quotas(target, [10_000 if t else 0 for t in target], seats))}
    df = spark.createDataFrame(rows, "g long, k long, target double, most long, seats long")
    assert {(r.g, r.k): r.quota for r in mixing.apportion(df, "g", "k", Scratch(spark, "t")).collect()} == want


def mixed(df, **options):
    return mixing.mix(df, **options).collect()


def test_mix_of_hot_odd_and_empty_sources(spark):
    pick = random.Random(3)
    sources = ["hot"] * 200 + ["é", "z", "A", None, "", "tiny"] * 20
    docs = [(k, " ".join(["w"] * pick.randrange(80)), s) for k, s in enumerate(sources) if s != "tiny"] + [(1000, "one two three", "tiny"), (1001, None, "void"), (1002, " ", "void"), (None, "null id " * 9, "z"), (7, "same " * 40, "A"), (7, "same " * 40, "A"), (2000, "long " * 20_000, "é")]
    df = odd_columns(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(6))
    rows = mixed(df, shard_words=256)
    assert len(rows) == len(docs) and sum(r.size for r in rows) == sum(len((t or "").split()) for _, t, _ in docs)
    taken, size, target = Counter(), Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight, level = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 0.0
    while sum(min(3 * size[s], weight[s] * (level + 0.01)) for s in order) < sum(size.values()):
        level += 1
    for s in order:
        assert size[s] == next(r.source_size for r in rows if r.source == s)
        assert abs(min(3 * size[s], weight[s] * level) - target[s]) <= weight[s] + 1
        assert abs(taken[s] - target[s]) <= max(32, 0.05 * target[s]), s
    assert abs(sum(target.values()) - sum(size.values())) < 1e-3
    again = mixed(df.repartition(3), shard_words=256)
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert sorted(map(str, mixed(df, shard_words=256, seed=1))) != sorted(map(str, rows))


def test_mix_of_nothing_and_of_one_source(spark):
    kinds = "doc_id long, text string, source string"
    assert mixed(spark.createDataFrame([], kinds)) == []
    assert {(r.taken, r.target) for r in mixed(spark.createDataFrame([(1, "", "a"), (2, None, "b")], kinds))} == {(0, 0.0)}
    rows = mixed(spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.lit("all")), shard_words=999)
    assert all(0 <= r.taken <= 3 * r.size for r in rows) and abs(sum(r.taken for r in rows) / rows[0].target - 1) < 0.01
