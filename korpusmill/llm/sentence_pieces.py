"""SentencePiece encoding and decoding of whole texts by the transducer of ``piece_model``."""

from __future__ import annotations

import codecs
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from korpusmill.llm.piece_model import BYTE, CACHE_BYTES, CHUNK, CONTROL, MARK, SHORT, SIDE_BY_SIDE, PieceModel, Transducer

#: Characters of text whose chunks are looked up at once, and ids that are decoded at once.
LOOK_UP, IDS = 1 << 20, 1 << 19


class Encoder:
    """Ids of texts. Chunks between blanks and line ends, which no piece crosses, take their shortest path once while they are cached.

    A chunk's key is the chunk without the blank before it, so that most keys come from splitting at blanks.
    """

    def __init__(self, model: PieceModel):
        self.model, self.machine = model, Transducer(model)
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.held = 0  # bytes, about
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0
        self.offsets, self.sizes = np.zeros(1 << 17, np.int64), np.zeros(1 << 17, np.int64)

    def _learn(self, keys: list[str]) -> None:
        for lo in range(0, len(keys), SIDE_BY_SIDE):
            own = [k if k[:1] == "\n" else " " + k for k in keys[lo : lo + SIDE_BY_SIDE]]
            if max(map(len, own)) <= SHORT:
                self._keep(keys[lo : lo + SIDE_BY_SIDE], *self.machine.paths(own))
                continue
            short = [k for k, c in enumerate(own) if len(c) <= SHORT]
            if short:
                self._keep([keys[lo + k] for k in short], *self.machine.paths([own[k] for k in short]))
            for k, c in enumerate(own):
                if len(c) > SHORT:
                    ids = np.array(self.machine.path(c), np.uint32)
                    self._keep([keys[lo + k]], ids, np.array([len(ids)]))

    def _keep(self, keys: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        at = len(self.index)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while at + len(keys) > len(self.sizes):
            self.sizes, self.offsets = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sizes, self.offsets))
        self.flat[self.used : self.used + len(flat)] = flat
        self.sizes[at : at + len(keys)] = sizes
        self.offsets[at : at + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.index |= dict(zip(keys, range(at, at + len(keys)), strict=True))
        self.held += 190 * len(keys) + 2 * sum(map(len, keys)) + 4 * len(flat)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if self.held > CACHE_BYTES:
            self._reset()
        keys, ends, whole = [], [], {}
        for i, text in enumerate(texts):
            own = self.machine.read(text)
            if not own:
                pass
            elif not self.machine.cuts or own[0] not in f" {MARK}":
                whole[i] = np.array(self.machine.path(own), np.uint32)
            elif "  " in own or MARK in own:
                keys += [c[1:] if c[0] in f" {MARK}" else c for c in CHUNK.findall(own)]
            else:
                keys += own[1:].replace("\n", " \n").split(" ")
            ends.append(len(keys))
        at = np.fromiter(map(self.index.get, keys, repeat(-1)), np.int64, len(keys))
        if len(missing := np.flatnonzero(at < 0).tolist()):
            self._learn(list(dict.fromkeys(keys[k] for k in missing)))
            at[missing] = [self.index[keys[k]] for k in missing]
        sizes = self.sizes[at]
        stops = np.append(0, np.cumsum(sizes))
        flat = self.flat[np.arange(stops[-1]) + np.repeat(self.offsets[at] - stops[:-1], sizes)]
        parts = np.split(flat, stops[np.array(ends[:-1], np.int64)]) if texts else []
        return [self._joined(whole.get(i, x)) for i, x in enumerate(parts)]

    def _joined(self, ids: np.ndarray) -> np.ndarray:
        """Without byte fallback, unknown pieces in a row are one."""
        if self.model.byte_fallback or len(ids) < 2:
            return ids
        unknown = ids == self.model.unknown
        return ids[~np.append(False, unknown[1:] & unknown[:-1])]


def _one_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1  # type: ignore[attr-defined]


class Decoder:
    """Texts of ids: the transducer read backwards. Control pieces are empty, ids outside the model null the whole text."""

    def __init__(self, model: PieceModel):
        self.model = model
        own = [b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in model.pieces]
        own[model.unknown] = " ⁇ ".encode()
        self.sizes = np.array([len(x) for x in own])
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(own), np.uint8)
        codecs.register_error("korpusmill-one-byte", _one_byte)

    def __call__(self, ids: np.ndarray) -> str | None:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes)):
            return None
        out = []
        for lo in range(0, len(ids), IDS):
            sizes = self.sizes[own := ids[lo : lo + IDS]]
            starts = np.cumsum(sizes) - sizes
            out.append(self.flat[np.arange(sizes.sum()) + np.repeat(self.offsets[own] - starts, sizes)].tobytes())
        text = b"".join(out).decode("utf-8", "korpusmill-one-byte")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


@lru_cache(2)
def _model(path: str) -> PieceModel:
    return PieceModel.load(path)


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(_model(path))


@lru_cache(2)
def _decoder(path: str) -> Decoder:
    return Decoder(_model(path))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, n_ids, ids_crc32 of the ids as little-endian unsigned 32-bit numbers) of every row.

    Null and empty texts have no ids. Rows are independent of each other: null and repeated ids are rows like others; an
    empty table gives an empty result; other columns are not read. A piece mark in a text reads as a blank.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(model_path)
        for batch in batches:
            texts, i = batch.column(1), 0
            while i < len(texts):
                some, size, lo = [], 0, i
                while i < len(texts) and size < LOOK_UP:
                    some.append(texts[i].as_py() or "")
                    size += len(some[-1])
                    i += 1
                ids = own(some)
                ends = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(some)), lists, pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """All columns but ``ids_col``, and the text of its ids.

    Null ids give a null text, and so do lists with a null or an id that the model has not; bytes that are no UTF-8 become U+FFFD
    one by one.
    """
    kept = [c for c in rows.columns if c != ids_col]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _decoder(model_path)
        for batch in batches:
            lists = batch.column(0)
            if pa.types.is_list(lists.type) and not lists.flatten().null_count:
                values = lists.values.to_numpy()
                starts, stops = (lists.offsets.to_numpy()[k : len(lists) + k] for k in (0, 1))
                texts = [own(values[a:b]) if ok else None for a, b, ok in zip(starts.tolist(), stops.tolist(), lists.is_valid().to_pylist(), strict=True)]
            else:
                texts = [None if x is None or None in x else own(np.array(x, np.int64)) for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=schema.names)

    return rows.select(ids_col, *kept).mapInArrow(run, schema)
