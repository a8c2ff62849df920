"""Best-fit packing of token pieces into sequences.

Three steps: documents become pieces of at most ``max_tokens`` ids (Arrow batches inside tasks); the histogram of piece
lengths, whose size the capacity bounds, is packed by vector best-fit into runs of equal bins; every piece gets its
place from its rank among the pieces of its length. Ranks are taken over salted groups, so that one length held by a
third of all pieces is no large group.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from unicodedata import category, is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from korpusmill.storage import Scratch, shuffle_partitions

#: Words that a worker keeps the ids of; beyond it starts anew.
CACHE_WORDS = 500_000
#: Characters of text whose words are looked up at once.
LOOK_UP = 1 << 20
#: A full stop or comma that ends a word of letters; the tokenizer splits there in any case.
STOP = re.compile(r"(?<=[^\W\d_])([.,])(?=\s|$)")
PIECE_FIELDS = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]


#: The steps of a tokenizer file for which words may be looked up one by one.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def _plain_characters(tokenizer) -> list[int]:
    """Characters outside of ASCII that Python and the tokenizer take alike wherever they stand.

    Their normal form is themselves and they never join a neighbour, their lower case is one such character or more, and
    both see a letter or none. The two have Unicode tables of different age, so this is asked of the tokenizer itself.
    """
    joins = (range(0x1100, 0x1200), range(0xA960, 0xA980), range(0xD7B0, 0xD800))  # parts of Hangul syllables
    some = [c for c in (*range(0x80, 0xD800), *range(0xE000, 0x20000)) if category(chr(c))[0] not in "MC" and not any(c in r for r in joins) and is_normalized("NFC", chr(c))]
    marked = lambda x: any(category(k)[0] == "M" for k in x)
    lower = [chr(c).replace("\u03a3", "\u03c3").lower() for c in some]
    own = tokenizer.normalizer.normalize_str("\x00".join(map(chr, some))).split("\x00")
    some = [c for c, x, y in zip(some, own, lower, strict=True) if (x == y and not marked(y)) or (x == " " and chr(c).isspace())]
    pieces = tokenizer.pre_tokenizer.pre_tokenize_str(" ".join(f"x{chr(c)}x" for c in some))
    starts = np.zeros(4 * len(some), np.int64)
    starts[[lo for _, (lo, _) in pieces]] = 1
    many = starts.reshape(-1, 4).sum(axis=1)
    return [c for c, n in zip(some, many.tolist(), strict=True) if (n == 1) == chr(c).isalpha()]


def _class(codes: list[int]) -> str:
    """The codes as ranges of a regular expression's class."""
    at = np.array(codes)
    cut = np.flatnonzero(np.diff(at) > 1)
    pairs = zip(at[np.append(0, cut + 1)].tolist(), at[np.append(cut, len(at) - 1)].tolist(), strict=True)
    return "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in pairs)


class WordIds:
    """Ids of texts by a tokenizer file.

    If the file's own first steps are ``STEPS``, which lower-case and split at white space and between letters and other
    characters, a text's ids are those of its blank-separated chunks in order, and each chunk is encoded once while
    it is in the cache. A chunk of letters alone is one word to the tokenizer's model and goes to it directly. Texts
    with other characters than ``_plain_characters`` and what may spell a special token, and all texts of other files,
    take the tokenizer as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, added = file["model"], [t["content"] for t in file.get("added_tokens") or []]
        self.by_word = all(file.get(k) == v for k, v in STEPS.items()) and model.get("type", "BPE") == "BPE" and not model.get("dropout") and all("<|" in t for t in added)
        self.tokenizer = Tokenizer.from_file(path)
        if not self.by_word:
            return
        self.odd = re.compile(f"[^\\x00-\\x7f{_class(_plain_characters(self.tokenizer))}]|<\\|")
        spell = ByteLevel(add_prefix_space=False, use_regex=False)
        one = {b: spell.pre_tokenize_str(bytes([b]).decode()) for b in range(1, 128)}
        # bytes from 128 on occur inside characters only: their spelling shows in a character of two or more bytes
        self.spelling = {b: x[0][0] for b, x in one.items()}
        for c in (*range(0x80, 0x800), *range(0x800, 0x10000, 64), *range(0x10000, 0x110000, 4096)):
            if not 0xD800 <= c < 0xE000:
                self.spelling |= dict(zip(chr(c).encode(), spell.pre_tokenize_str(chr(c))[0][0], strict=True))
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.flat, self.offsets, self.used = np.zeros(1 << 18, np.uint32), np.zeros(1 << 17, np.int64), 0
        self.sizes = np.zeros(1 << 17, np.int64)

    def _ids(self, word: str) -> list[int]:
        if word.isalpha():
            return [t.id for t in self.tokenizer.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.spelling))]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _learn(self, word: str) -> int:
        k, ids = len(self.index), self._ids(word)
        if k >= len(self.sizes):
            self.sizes, self.offsets = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sizes, self.offsets))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.offsets[k], self.sizes[k] = self.used, len(ids)
        self.used += len(ids)
        self.index[word] = k
        return k

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if not self.by_word:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if len(self.index) > CACHE_WORDS:
            self._reset()
        words, ends, whole = [], [], {}
        for i, text in enumerate(texts):
            if "<|" in text if text.isascii() else self.odd.search(text):
                whole[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                own = text.lower() if text.isascii() else text.replace("\u03a3", "\u03c3").lower()
                words += STOP.sub(r" \1", own).replace("\n", " ").split(" ")
            ends.append(len(words))
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        for k in np.flatnonzero(at < 0).tolist():
            word = words[k]
            known = self.index.get(word)
            at[k] = self._learn(word) if known is None else known
        sizes = self.sizes[at]
        stops = np.append(0, np.cumsum(sizes))
        flat = self.flat[np.arange(stops[-1]) + np.repeat(self.offsets[at] - stops[:-1], sizes)]
        parts = np.split(flat, stops[np.array(ends[:-1], np.int64)]) if texts else []
        return [whole.get(i, x) for i, x in enumerate(parts)]


@lru_cache(2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, max_tokens: int = 4096, with_ids: bool = False
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, token_ids]) of every document's ids followed by ``end_id``.

    Null text counts as empty, which is one piece holding ``end_id`` alone. Documents over ``max_tokens`` are cut into
    pieces of that length, the last one shorter. Rows are independent: null or repeated ids and other columns change
    nothing.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField(id_col, id_type), *(T.StructField(n, t) for n, t in PIECE_FIELDS)]
        + ([T.StructField("token_ids", T.ArrayType(T.IntegerType()))] if with_ids else [])
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _word_ids(tokenizer_path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            row, piece, start, length, crc, tokens = [], [], [], [], [], []
            i = 0
            while i < len(texts):
                some, size = [], 0
                while i + len(some) < len(texts) and (not some or size < LOOK_UP):
                    some.append(texts[i + len(some)] or "")
                    size += len(some[-1])
                for own_ids in encode(some):
                    all_ids = np.append(own_ids, np.uint32(end_id)).astype("<u4")
                    for p, lo in enumerate(range(0, len(all_ids), max_tokens)):
                        own = all_ids[lo : lo + max_tokens]
                        row.append(i)
                        piece.append(p)
                        start.append(lo)
                        length.append(len(own))
                        crc.append(zlib.crc32(own.tobytes()))
                        if with_ids:
                            tokens.append(own.astype(np.int32))
                    i += 1
            columns = [ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            if with_ids:
                columns.append(pa.array(tokens, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(cut, schema)


class VectorBestFit:
    """Best-fit packing of a histogram of lengths under capacities for tokens, documents and attention cost.

    A document's attention cost is the square of its length, rounded up to whole tiles of ``tile`` tokens. Lengths are taken
    in descending order. Each item goes into the open bin, among those that every constraint lets it into, with the
    least weighted norm of what then remains (``rule="residual"``) or the largest weighted dot-product of item and remaining
    capacity (``rule="dot"``); ties go to the oldest bin; without one, a bin is opened. Equal bins are held as
    one entry with a count, so the work follows the number of lengths, not of items.

    With ``give_way`` the capacities for documents and cost are doubled, step by step, as long as there are more bins than tokens alone need and until neither can
    bind; of the steps with the fewest bins the first is taken (``lifted``: how many times the capacities it has). Weights stay.
    """

    def __init__(
        self, max_tokens: int = 4096, max_docs: int | None = None, max_cost: float | None = None, weights: tuple[float, float, float] = (1.0, 0.0, 0.0), rule: str = "residual",
        tile: int = 1, give_way: bool = False,
    ):
        if rule not in ("residual", "dot"):
            raise ValueError("rule is 'residual' or 'dot'")
        self.cap = np.array([max_tokens, max_docs or max_tokens, max_cost or float(max_tokens) ** 2])
        self.weights, self.rule, self.tile, self.give_way = np.array(weights, float), rule, tile, give_way

    def item(self, length: int) -> np.ndarray:
        """What a document takes of each capacity."""
        return np.array([length, 1, float(-(-length // self.tile) * self.tile) ** 2])

    def pack(self, counts: dict[int, int]) -> np.ndarray:
        """Rows (length, first rank, ranks, per bin, first bin, offset), in order of length and rank."""
        runs, self.lifted = self._pack(counts, self.cap), 1
        fewest = -(-sum(n * c for n, c in counts.items()) // self.cap[0])
        most, tile = float(self.cap[0]), float(self.tile)
        loose = np.maximum(self.cap, [most, most, most**2 + 2 * tile * most + tile**2 * most])  # neither of the last two can bind
        step, cap = 1, self.cap
        while self.give_way and self.bins > fewest and (cap < loose).any():
            step *= 2
            cap, bins = np.minimum(self.cap * [1, step, step], loose), self.bins
            more = self._pack(counts, cap)
            if self.bins < bins:
                runs, self.lifted = more, step
            else:
                self.bins = bins
        return runs

    def _pack(self, counts: dict[int, int], cap: np.ndarray) -> np.ndarray:
        left = np.zeros((0, 3))
        first, many, filled = (np.zeros(0, np.int64) for _ in range(3))
        runs, bins = [], 0
        for length in sorted(counts, reverse=True):
            item, rank, remain = self.item(length), 0, counts[length]
            if (item > cap).any():
                raise ValueError(f"a piece of {length} tokens fits no bin")
            while remain:
                fits = (left >= item).all(axis=1)
                if fits.any():
                    norm = (left - item) / self.cap
                    score = (self.weights * norm**2).sum(axis=1) if self.rule == "residual" else -(self.weights * (item / self.cap) * (left / self.cap)).sum(axis=1)
                    score[~fits] = np.inf
                    best = np.flatnonzero(score == score.min())
                    g = int(best[np.argmin(first[best])])
                    state, n_bins, at, used = left[g], int(many[g]), int(first[g]), int(filled[g])
                else:
                    g, state, used, at = -1, cap.astype(float), 0, bins
                    n_bins = remain  # opened as needed below
                most = int(min(state // item)) if self.rule == "residual" or g < 0 else 1
                full = min(n_bins, remain // most)
                take, per = (full, most) if full else (1, remain)
                runs.append((length, rank, take * per, per, at, used))
                rank, remain = rank + take * per, remain - take * per
                if g < 0:
                    bins += take
                elif take < n_bins:
                    first[g], many[g] = at + take, n_bins - take
                else:
                    keep = np.arange(len(first)) != g
                    left, first, many, filled = left[keep], first[keep], many[keep], filled[keep]
                state = state - per * item
                if (state >= 1).all():
                    left, first = np.vstack([left, state]), np.append(first, at)
                    many, filled = np.append(many, take), np.append(filled, used + per * length)
        runs.sort()
        self.bins = bins
        return np.array(runs, np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, packer: VectorBestFit, keys: list[str], length_col: str = "length") -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; ``keys`` tell pieces apart.

    Rows without a length (null or under 1) are left out of sequences: both columns are null. Rows equal in all keys are
    packed one by one, in no particular order. An empty table gives an empty result. ``pieces`` is read several times: pass a
    saved table. A column ``_row`` that numbers its rows is used to deal rows that are equal in all keys, and is left out.
    """
    row = ["_row"] if "_row" in pieces.columns else []
    kept = [c for c in pieces.columns if c not in row]
    spark = pieces.sparkSession
    usable = F.coalesce(F.col(length_col) >= 1, F.lit(False))
    counts = {int(r[0]): int(r[1]) for r in pieces.where(usable).groupBy(length_col).count().collect()}  # as many rows as lengths
    runs = packer.pack(counts)
    total, parts = sum(counts.values()), shuffle_partitions(spark)

    # Groups of about total / (4 * partitions) pieces: at most as many as lengths plus 4 * partitions.
    salts = {n: -(-c * 4 * parts // max(total, 1)) for n, c in counts.items()}
    small = spark.createDataFrame([(n, s) for n, s in salts.items()], "_n long, _salts long")
    salted = (
        pieces.where(usable).join(F.broadcast(small), F.col(length_col).cast("long") == F.col("_n"))
        .withColumn("_salt", F.pmod(F.xxhash64(*keys, *row), F.col("_salts"))).drop("_salts")
    )
    bases, at = [], {}
    for n, s, c in sorted(tuple(r) for r in salted.groupBy("_n", "_salt").count().collect()):
        bases.append((n, s, at.get(n, 0)))
        at[n] = at.get(n, 0) + c
    base = spark.createDataFrame(bases, "_n long, _salt long, _base long")
    ranked = (
        salted.withColumn("_rank", F.row_number().over(Window.partitionBy("_n", "_salt").orderBy(*keys, *row)) - 1)
        .join(F.broadcast(base), ["_n", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    )

    shared = spark.sparkContext.broadcast(runs)

    @F.pandas_udf("sequence_id long, offset long")
    def place(n, rank):
        import pandas as pd

        table = shared.value
        n, rank = n.to_numpy(np.int64), rank.to_numpy(np.int64)
        # ranks fall below 2**44 and lengths below 2**19
        run = table[np.searchsorted((table[:, 0] << 44) + table[:, 1], (n << 44) + rank, side="right") - 1] if len(n) else table[:0]
        k = rank - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 4] + k // run[:, 3], "offset": run[:, 5] + k % run[:, 3] * n})

    placed = ranked.withColumn("_place", place("_n", "_rank"))
    out = placed.select(*kept, F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset"))
    rest = pieces.where(~usable).select(*kept, F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    return out.unionByName(rest)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 4096,
    packer: VectorBestFit | None = None, with_ids: bool = False,
) -> DataFrame:
    """Tokenize, cut and pack: (id, piece, start, length, ids_crc32[, token_ids], sequence_id, offset); see the parts for odd rows."""
    pieces = token_pieces(docs, tokenizer_path, id_col, text_col, 1, max_tokens, with_ids)
    pieces = Scratch(docs.sparkSession, "packing").save(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    return pack(pieces, packer or VectorBestFit(max_tokens), [id_col, "piece", "ids_crc32"])
