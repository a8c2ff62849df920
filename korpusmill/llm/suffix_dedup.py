"""Exact removal of repeated byte strings by a depth-limited radix sort of suffixes.

Only the first ``length`` bytes of a suffix matter, so suffixes are never ordered further. Digits are taken most
significant first, and a group of one drops out after every pass:

1. The first digit of a suffix is its anchor: of the ``GRAM``-byte strings within its first ``length`` bytes the one with the
   least hash, and where that stands. Neighbouring suffixes share an anchor, so a run of them (a segment) is one row.
   Equal suffixes have equal anchors at equal places, hence segments whose anchor occurs once hold no repeat. The rest
   of the segment is compared with it: equal segments hold equal suffixes throughout.
2. Where segments with the same anchor differ, the next digit is what up to ``FEW`` neighbouring suffixes have in common, and
   these short segments are compared in the same way.
3. Where these differ as well, their suffixes are ordered one by one by all ``length`` bytes. Equal groups are then
   exactly the repeated strings.

A digit is a string of bytes, not a single one, and is compared by a 64-bit (anchor, segment) or 128-bit (suffix) hash. Every task
orders about ``FLUSH`` bytes of text at a time first and ships one row per key of these, so a string that a third of all
documents hold comes to one row for every ``FLUSH`` bytes of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from korpusmill.storage import Scratch, shuffle_partitions

GRAM = 32
FEW = 8
#: Bytes hashed at once, and bytes of text whose segments a task orders at once.
BLOCK = 1 << 17
FLUSH = 16 << 20
#: Rows of which a task holds texts, what is left of them and their Arrow form at once when it cuts them.
CUT_ROWS = 500
_RNG = np.random.default_rng(20240607)
_TABLES = [_RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASES = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_MASK = 2**64 - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = [_powers(b, BLOCK + 4096) for b in _BASES]
_INV = [_powers(pow(b, -1, 2**64), BLOCK + 4096) for b in _BASES]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(32)
    return x


class Rolling:
    """Hashes of any strings of a block of bytes, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray, which: int):
        self.inv = _INV[which]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[which][data] * _POW[which][: len(data)], out=self.sums[1:])

    def all(self, n: int) -> np.ndarray:
        """Of the strings of n bytes at every place."""
        at = len(self.sums) - n
        return _mix((self.sums[n:] - self.sums[:at]) * self.inv[:at])

    def some(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inv[start])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours."""
    n, span, out = len(x) - w + 1, 1, x
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[:n], out[w - span : w - span + n])


def blocks(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in blocks of about ``BLOCK`` bytes: (bytes, text and place in it of each byte).

    A text over a block's size is spread over several, which overlap by length - 1 bytes, so that each string of ``length`` bytes
    is whole in exactly one of them.
    """
    data, owner, place, size = [], [], [], 0
    for i, t in enumerate(texts):
        lo = 0
        while len(t) - lo >= length:
            part = np.frombuffer(t, np.uint8)[lo : lo + BLOCK]
            if size and size + len(part) > BLOCK:
                yield np.concatenate(data), np.concatenate(owner), np.concatenate(place)
                data, owner, place, size = [], [], [], 0
            data.append(part)
            owner.append(np.full(len(part), i, np.int32))
            place.append(np.arange(lo, lo + len(part), dtype=np.int64))
            size += len(part)
            if lo + len(part) >= len(t):
                break
            lo += len(part) - (length - 1)
    if data:
        yield np.concatenate(data), np.concatenate(owner), np.concatenate(place)


def _at(lo: np.ndarray, off: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A segment in one number: its first suffix, how far behind it the anchor is, how many suffixes."""
    return lo << 16 | off << 8 | n


def segments(texts: list[bytes], length: int) -> dict[str, np.ndarray]:
    """The suffixes with at least ``length`` bytes of their text left, as segments of one anchor.

    anchor: hash of its bytes; body: hash of all bytes and of the anchor's place; text; at: see ``_at``.
    """
    out: dict[str, list] = {k: [] for k in ("anchor", "body", "text", "at")}
    width = length - GRAM + 1
    low = np.uint64((1 << 20) - 1)
    for data, owner, place in blocks(texts, length):
        roll = Rolling(data, 0)
        grams = roll.all(GRAM)
        keyed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)  # ties go to the first
        anchor = (_sliding_min(keyed, width) & low).astype(np.int64)
        whole = owner[: len(anchor)] == owner[length - 1 :]
        change = np.ones(len(anchor) + 1, bool)
        change[1:-1] = (anchor[1:] != anchor[:-1]) | (owner[1 : len(anchor)] != owner[: len(anchor) - 1]) | (whole[1:] != whole[:-1])
        cut = np.flatnonzero(change)
        lo, hi = cut[:-1], cut[1:]
        keep = whole[lo]
        lo, hi = lo[keep], hi[keep]
        a = anchor[lo]
        body = roll.some(lo, hi - 1 + length) ^ _mix((a - lo).astype(np.uint64) * np.uint64(1 << 16) + (hi - lo).astype(np.uint64))
        for k, v in zip(out, (grams[a], body, owner[lo], _at(place[lo], a - lo, hi - lo)), strict=True):
            out[k].append(v)
    kinds = {"anchor": np.uint64, "body": np.uint64, "text": np.int32, "at": np.int64}
    return {k: np.concatenate(v).astype(kinds[k]) if v else np.zeros(0, kinds[k]) for k, v in out.items()}


def _runs(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted starts and lengths of intervals of suffixes with touching ones joined."""
    if not len(first):
        return first, n
    order = np.argsort(first, kind="stable")
    lo, hi = first[order], np.maximum.accumulate((first + n)[order])
    new = np.append(True, lo[1:] > hi[:-1])
    at = np.flatnonzero(new)
    return lo[at], np.append(hi[at[1:] - 1], hi[-1]) - lo[at]


#: A segment to compare with others; settled as repeated; settled as to be taken apart; both to be taken apart and to compare with.
KEY, REPEAT, LOOSE, WITNESS = 0, 1, 2, 3
SEGMENT = "kind byte, anchor long, body long, id long, sub long, at long"


def _compared(anchor: np.ndarray, body: np.ndarray, owner: np.ndarray, sub: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Segments ordered by (anchor, body, owner, sub, at): one row per anchor to compare with other tasks, and what is settled here."""
    order = np.lexsort((at, sub, owner, body, anchor))
    anchor, body, owner, sub, at = (x[order] for x in (anchor, body, owner, sub, at))
    new_a = np.append(True, anchor[1:] != anchor[:-1])
    new_b = new_a | np.append(True, body[1:] != body[:-1])
    first = np.flatnonzero(new_b)[np.cumsum(new_b) - 1]
    again = ~new_b & ((owner != owner[first]) | (sub != sub[first]) | (at != at[first]))  # a repeated row is no repeat of itself
    group = np.cumsum(new_a) - 1
    several = np.bincount(group[new_b]) > 1
    kind = np.full(len(anchor), KEY, np.int8)
    kind[new_b & several[group]] = LOOSE
    kind[new_a & several[group]] = WITNESS
    kind[again] = REPEAT
    take = np.flatnonzero(new_b | again)
    kind, anchor, body, owner, sub, at = (x[take] for x in (kind, anchor, body, owner, sub, at))
    alone = (kind == REPEAT) | (kind == LOOSE)  # these get a key of their own, so no key is hot
    anchor = np.where(alone, _mix(at.view(np.uint64) ^ _mix((owner ^ sub).view(np.uint64))), anchor)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (kind, anchor.view(np.int64), body.view(np.int64), owner, sub, at)], names=["kind", "anchor", "body", "id", "sub", "at"])


def _judged(rows: DataFrame) -> DataFrame:
    """(id, sub, at, kind) of segments that are REPEAT or LOOSE; a key has one row for every ``FLUSH`` bytes of text at most."""
    here = Window.partitionBy("compared", "anchor")
    kind = F.col("kind")
    return (
        rows.withColumn("compared", kind.isin(KEY, WITNESS)).withColumn("many", F.count(F.lit(1)).over(here))
        .withColumn("differ", (F.max(kind == WITNESS).over(here) | (F.min("body").over(here) != F.max("body").over(here))))
        .withColumn("nth", F.dense_rank().over(here.orderBy("body", "id", "sub", "at")))
        .select(
            "id", "sub", "at",
            F.when(~F.col("compared"), kind).when(kind == WITNESS, LOOSE).when(F.col("many") == 1, KEY).when(F.col("differ"), LOOSE)
            .when(F.col("nth") > 1, REPEAT).otherwise(KEY).cast("byte").alias("kind"),
        )
        .where(F.col("kind") != KEY)
    )


def _loads(batches: Iterator[pa.RecordBatch], extra: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], list]]:
    """(ids, subs, texts, values of a fourth column) of about ``FLUSH`` bytes."""
    ids, subs, texts, more, size = [], [], [], [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            text = (batch.column(2)[i].as_py() or "").encode()
            ids.append(batch.column(0)[i].as_py())
            subs.append(batch.column(1)[i].as_py())
            texts.append(text)
            if extra:
                more.append(batch.column(3)[i].as_py())
            size += len(text)
            if size >= FLUSH:
                yield np.array(ids, np.int64), np.array(subs, np.int64), texts, more
                ids, subs, texts, more, size = [], [], [], [], 0
    if ids:
        yield np.array(ids, np.int64), np.array(subs, np.int64), texts, more


def repeats(docs: DataFrame, length: int, parts: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Documents (id, text, carried columns) with ``sub``, dealt by key; (key, ats): of each document with any, its repeated suffixes (see ``_at``); the key.

    The key is the id, and where texts share one also ``sub``, a hash of the text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    others = [c for c in docs.columns if c not in ("id", "text")]
    whole = docs.withColumn("text", F.coalesce("text", F.lit("")))
    texts = whole.select("id", F.xxhash64("text").alias("h")).groupBy("id").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    shared = bool(texts.where("lo <> hi").limit(1).count())  # without it all subs are 0, which costs no disk
    key = ["id", "sub"] if shared else ["id"]
    whole = whole.select("id", (F.xxhash64("text") if shared else F.lit(0).cast("long")).alias("sub"), "text", *others)
    dealt = whole.repartition(parts, *key)  # used three times in one plan with the same columns, which shuffles it once

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, subs, texts, _ in _loads(batches):
            x = segments(texts, length)
            if len(x["at"]):
                yield _compared(x["anchor"], x["body"], ids[x["text"]], subs[x["text"]], x["at"])

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, subs, texts, ats in _loads(batches, 1):
            parts = [_short(text, np.array(at, np.int64), length) for text, at in zip(texts, ats, strict=True)]
            anchor, body, at = (np.concatenate([x[k] for x in parts]) for k in range(3))
            many = [len(x[2]) for x in parts]
            yield _compared(anchor, body, np.repeat(ids, many), np.repeat(subs, many), at)

    def last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, subs, texts, ats in _loads(batches, 1):
            keys, owner, sub, lo = [[], []], [], [], []
            for own, part, text, at in zip(ids, subs, texts, ats, strict=True):
                at = np.array(at, np.int64)
                for f, m in zip(*(x.tolist() for x in _runs(at >> 16, at & 255)), strict=True):
                    for b in range(f, f + m, BLOCK):
                        some = min(f + m - b, BLOCK)
                        data = np.frombuffer(text, np.uint8, some + length - 1, b)
                        for which in (0, 1):
                            keys[which].append(Rolling(data, which).all(length))
                        owner.append(np.full(some, own, np.int64))
                        sub.append(np.full(some, part, np.int64))
                        lo.append(np.arange(b, b + some))
            k1, k2, owner, sub, lo = (np.concatenate(x) for x in (*keys, owner, sub, lo))
            order = np.lexsort((lo, sub, owner, k2, k1))
            k1, k2, owner, sub, lo = (x[order] for x in (k1, k2, owner, sub, lo))
            same = np.append(False, np.logical_and.reduce([x[1:] == x[:-1] for x in (k1, k2, owner, sub, lo)]))
            k1, k2, owner, sub, lo = (x[~same] for x in (k1, k2, owner, sub, lo))
            new = np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))
            # the first of a group here ships its key; repeats of it are settled and get a key of their own
            k1, k2 = np.where(new, k1.view(np.int64), owner ^ sub), np.where(new, k2.view(np.int64), lo)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (~new, k1, k2, owner, sub, lo)], names=["settled", "k1", "k2", "id", "sub", "lo"])

    def taken_apart(judged: DataFrame) -> DataFrame:
        loose = judged.where(F.col("kind") == LOOSE).groupBy(*key).agg(F.collect_list("at").alias("ats"))
        return dealt.join(loose, key).select("id", "sub", "text", "ats", *others)

    segment = scratch.save(_judged(whole.select("id", "sub", "text").mapInArrow(first_pass, SEGMENT)), "segments", ["kind"])
    short = _judged(taken_apart(segment).mapInArrow(second_pass, SEGMENT))
    single = taken_apart(short).mapInArrow(last_pass, "settled boolean, k1 long, k2 long, id long, sub long, lo long")
    later = (
        single.withColumn("nth", F.dense_rank().over(Window.partitionBy("settled", "k1", "k2").orderBy("id", "sub", "lo")))
        .where(F.col("settled") | (F.col("nth") > 1)).select("id", "sub", (F.shiftleft(F.col("lo"), 16) + 1).alias("at"))
    )
    every = (
        later.unionByName(short.where(F.col("kind") == REPEAT).select("id", "sub", "at")).unionByName(segment.where(F.col("kind") == REPEAT).select("id", "sub", "at"))
        .groupBy(*key).agg(F.collect_list("at").alias("ats"))
    )
    return dealt, every, key


def _short(text: bytes, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a text cut where the distance of suffix and anchor is a multiple of ``FEW``: (hash of what the suffixes share, of all bytes, at)."""
    lo, off, n = at >> 16, (at >> 8) & 255, at & 255
    each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    back = np.repeat(off, n) - each  # of each suffix to its anchor
    new = np.flatnonzero((each == 0) | (back % FEW == FEW - 1))
    many = np.diff(np.append(new, len(each)))
    start, back = (np.repeat(lo, n) + each)[new], back[new]
    shared = start + back - back // FEW * FEW  # first byte that all suffixes of a whole cut have
    anchor, body = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    order = np.argsort(start, kind="stable")
    i = 0
    while i < len(order):
        first = start[order[i]]
        stop = i + np.searchsorted(start[order[i:]], first + BLOCK, side="right")
        own = order[i:stop]
        data = np.frombuffer(text, np.uint8, min(len(text) - first, BLOCK + 2 * length), first)
        roll = Rolling(data, 0)
        core, begin = shared[own] - first, start[own] - first
        anchor[own] = roll.some(core, core + length - FEW + 1) ^ _mix((back[own] // FEW).astype(np.uint64))
        body[own] = roll.some(begin, begin + many[own] - 1 + length) ^ _mix((back[own] * 256 + many[own]).astype(np.uint64))
        i = stop
    return anchor, body, _at(start, back, many)



def kept(text: bytes, ats: list[int], length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the maximal removed runs (start, end), given its repeated suffixes."""
    at = np.array(ats, np.int64)
    first, n = _runs(at >> 16, (at & 255) + length - 1)
    spans = [(int(f), int(f + m)) for f, m in zip(first, n, strict=True)]
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), spans


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, whole_characters: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove every byte of a text that a string of ``length`` UTF-8 bytes covers which also starts earlier.

    Earlier is a smaller id, of one id a smaller hash of the text, or the same document and a smaller offset; strings are judged on the input. With
    ``whole_characters`` a run's ends shrink to whole characters, so that what is left is valid text again.

    Returns (id, n_bytes, n_removed, n_spans, kept binary, spans array of (start, end)). Null text is empty; a text under
    ``length`` bytes loses nothing; an empty table gives an empty result. Ids are integers; a null id counts as the
    smallest integer. Rows that share an id and a text count as one document, and each loses what that does; different
    texts of one id are documents of their own. Columns named in ``carry`` are added to the result, to every row its own;
    others are not read.
    """
    if not GRAM <= length <= 255 - 1 + GRAM:
        raise ValueError(f"length must be from {GRAM} to {254 + GRAM}")
    smallest = -(2**63)
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(smallest)).alias("id"), F.col(text_col).alias("text"), *([F.struct(*[F.col(c) for c in carry]).alias("carried")] if carry else []))
    dealt, every, by = repeats(own, length, shuffle_partitions(docs.sparkSession))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, CUT_ROWS) for b in batches for lo in range(0, b.num_rows, CUT_ROWS)):
            rows = []
            for key, text, at in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                text = text.encode()
                left, spans = kept(text, at or [], length)
                if whole_characters and spans:
                    spans = [s for s in (_whole(text, *s) for s in spans) if s[0] < s[1]]
                    edges = [0, *(x for s in spans for x in s), len(text)]
                    left = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((None if key == smallest else key, len(text), len(text) - len(left), len(spans), left, [{"start": a, "end": b} for a, b in spans]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*made, *batch.columns[3:]], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept", "spans", *["carried"][: len(batch.columns) - 3]])

    schema = f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:bigint,end:bigint>>"

    joined = dealt.join(every, by, "left")
    if not carry:
        return joined.select("id", "text", "ats").mapInArrow(cut, schema)
    out = joined.select("id", "text", "ats", "carried").mapInArrow(cut, f"{schema}, carried {own.schema['carried'].dataType.simpleString()}")
    return out.select("*", *[F.col("carried")[c].alias(c) for c in carry]).drop("carried")


def _whole(text: bytes, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] & 0xC0 == 0x80:
        start += 1
    while end > start and end < len(text) and text[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def brute_force(docs: dict[int, str], length: int) -> dict[int, tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, sha256 of the rest) by id; for small fixtures."""
    seen, out = set(), {}
    for key in sorted(docs):
        text = (docs[key] or "").encode()
        covered = np.zeros(len(text), bool)
        for i in range(len(text) - length + 1):
            s = text[i : i + length]
            if s in seen:
                covered[i : i + length] = True
            seen.add(s)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], covered.astype(int), [0]])) == 1))
        left = bytes(np.frombuffer(text, np.uint8)[~covered])
        out[key] = (len(text), int(covered.sum()), spans, hashlib.sha256(left).hexdigest())
    return out
