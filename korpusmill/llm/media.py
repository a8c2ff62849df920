"""Media columns: lossless media members in archives, read through a data source over byte ranges.

Archives are ZIP files of stored or deflated members. The reader plans byte ranges of the archives' directories from the
archives' sizes alone: an archive of n times ``range_bytes`` has its directory cut in n. A task finds its part from the
archive's end, so that a directory is read once in all, takes the members whose entries start there, streams them in
Arrow batches and retries each by its offset.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from korpusmill.llm.files import Committed, at, listed, make_folder

WIDTH = 64
BATCH_BYTES = 4 << 20
#: Bytes of the longest entry of a directory.
LONGEST = 46 + 3 * 65535
PNG = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return data + bytes(WIDTH * max(1, -(-len(data) // WIDTH)) - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    """An 8-bit greyscale image, 64 samples a row, whose samples are the payload's bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row starts with filter type 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, 6)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> bytes:
    """Samples of an image as ``encode_png`` writes it; checks every chunk."""
    if not data.startswith(PNG):
        raise ValueError("not a PNG file")
    at_, idat, shape = len(PNG), [], None
    while at_ < len(data):
        (n,), kind = struct.unpack_from(">I", data, at_), data[at_ + 4 : at_ + 8]
        body = data[at_ + 8 : at_ + 8 + n]
        if struct.unpack_from(">I", data, at_ + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            idat.append(body)
        at_ += 12 + n
    if shape is None or shape[2:4] != (8, 0):
        raise ValueError("not an 8-bit greyscale image")
    lines = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("only filter type 0 is read")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation, entropy in bits, share of row-to-row change of the samples."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    level = np.arange(256)
    mean = float((share * level).sum())
    some = share[share > 0]
    change = float(np.count_nonzero(x[WIDTH:] != x[:-WIDTH]) / (len(x) - WIDTH)) if len(x) > WIDTH else 0.0
    return f"mean={mean:.4f};dev={float((share * (level - mean) ** 2).sum()) ** 0.5:.4f};bits={float(-(some * np.log2(some)).sum()):.4f};change={change:.4f}"


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every text as a PNG member ``<id>.<bytes of the text>.png`` of its partition's archive; returns (path, members), which runs the job when read.

    Null text is empty, which is one row of zeros. A null id leaves the name's id empty; repeated ids give members each. An
    empty table writes no member. Other columns are not read.
    """
    make_folder(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batch = next(batches, None)
        if batch is None:
            return
        task, n = TaskContext.get(), 0
        uri = f"{folder}/part-{task.partitionId():06d}.zip"
        with Committed(uri, task.taskAttemptId()) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
            while batch is not None:
                for i in range(batch.num_rows):
                    key, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                    data = (text or "").encode()
                    info = zipfile.ZipInfo(f"{'' if key is None else key}.{len(data)}.png", (1980, 1, 1, 0, 0, 0))
                    archive.writestr(info, encode_png(padded(data)))
                    n += 1
                batch = next(batches, None)
        yield pa.RecordBatch.from_pydict({"path": [uri], "members": [n]})

    return docs.select(id_col, text_col).mapInArrow(write, "path string, members long")


class Entry(NamedTuple):
    """A member as its archive's directory has it."""

    name: bytes
    method: int
    crc: int
    packed: int
    size: int
    offset: int


#: Signatures of a ZIP file's records, and the number that stands for one kept elsewhere.
LOCAL, CENTRAL, END, LOCATOR, END64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06"
ELSEWHERE = 0xFFFFFFFF


def _directory(stream, size: int) -> tuple[int, int]:
    """First byte of an archive's directory, and the one after its last."""
    tail_at = max(0, size - (1 << 16) - 100)
    stream.seek(tail_at)
    tail = stream.read(size - tail_at)
    end = tail.rfind(END)
    if end < 0:
        raise OSError("no end of an archive's directory")
    length, start = struct.unpack_from("<II", tail, end + 12)
    if ELSEWHERE in (length, start) and tail[end - 20 : end - 16] == LOCATOR:
        stream.seek(struct.unpack_from("<Q", tail, end - 12)[0])
        record = stream.read(56)
        if record[:4] != END64:
            raise OSError("no 64-bit end of an archive's directory")
        length, start = struct.unpack_from("<QQ", record, 40)
    return start, start + length


def _entry(data: bytes, at_: int) -> tuple[Entry, int] | None:
    """The entry at a place of a directory, and the next one's place; none if there is not a whole one."""
    if len(data) - at_ < 46 or data[at_ : at_ + 4] != CENTRAL:
        return None
    method, crc, packed, size, name, extra, comment = struct.unpack_from("<H4xIIIHHH", data, at_ + 10)
    (offset,) = struct.unpack_from("<I", data, at_ + 42)
    stop = at_ + 46 + name + extra + comment
    if stop > len(data):
        return None
    more, k = data[at_ + 46 + name : at_ + 46 + name + extra], 0
    while k + 4 <= len(more):
        kind, n = struct.unpack_from("<HH", more, k)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{n // 8}Q", more, k + 4))
            size, packed, offset = (next(wide) if x == ELSEWHERE else x for x in (size, packed, offset))
        k += 4 + n
    return Entry(data[at_ + 46 : at_ + 46 + name], method, crc, packed, size, offset), stop


class MediaSource(DataSource):
    """``spark.read.format("media_archive").load(folder)``: (path, member, offset, media, error), a row per member.

    Options: ``range_bytes`` (16 MiB), ``retries`` (3) for each member, after which media is null and ``error`` says why.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "path string, member string, offset long, media binary, error string"

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options["path"], int(self.options.get("range_bytes", 16 << 20)), int(self.options.get("retries", 3)))


class MediaReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int, retries: int):
        self.folder, self.range_bytes, self.retries = folder, range_bytes, retries

    def partitions(self) -> list[InputPartition]:
        parts = [(path, size, k, n) for path, size in listed(self.folder, ".zip") for n in [-(-size // self.range_bytes)] for k in range(n)]
        return [InputPartition(p) for p in parts] or [InputPartition(None)]

    def _entries(self, stream, size: int, k: int, n: int) -> Iterator[Entry]:
        """Entries that start in the k-th of n parts of the directory, which is read a part and a little on."""
        start, stop = _directory(stream, size)
        lo, hi = (start + (stop - start) * x // n for x in (k, k + 1))
        stream.seek(lo)
        data, at_, whole = stream.read(min(hi + LONGEST, stop) - lo), 0, min(hi + LONGEST, stop) == stop

        def is_start(found: tuple[Entry, int] | None) -> bool:
            """Whether an entry is one: another or the directory's end follows it, and its member is where it says."""
            if found is None or not (data[found[1] : found[1] + 4] == CENTRAL or (whole and found[1] == len(data))):
                return False
            stream.seek(found[0].offset)
            head = stream.read(30 + len(found[0].name))
            return head[:4] == LOCAL and head[30:] == found[0].name

        if k:
            while (at_ := data.find(CENTRAL, at_)) >= 0 and at_ < hi - lo and not is_start(_entry(data, at_)):
                at_ += 1
        while 0 <= at_ < hi - lo:
            found = _entry(data, at_)
            if found is None:
                raise OSError(f"the directory is damaged at byte {lo + at_}")
            yield found[0]
            at_ = found[1]

    def _member(self, stream, info: Entry) -> bytes:
        stream.seek(info.offset)
        head = stream.read(30)
        name, extra = struct.unpack_from("<HH", head, 26)
        stream.seek(info.offset + 30 + name + extra)
        data = stream.read(info.packed)
        if head[:4] != LOCAL or info.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise OSError(f"the member at byte {info.offset} is damaged or packed in another way")
        if info.method == zipfile.ZIP_DEFLATED:
            data = zlib.decompress(data, -15)
        if len(data) != info.size or zlib.crc32(data) != info.crc:
            raise OSError(f"the member at byte {info.offset} is damaged")
        return data

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        path, length, k, n = partition.value
        store, _ = at(self.folder)
        names = pa.schema([("path", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("error", pa.string())])
        with store.open_input_file(path) as stream:
            own = sorted(self._entries(stream, length, k, n), key=lambda e: e.offset)
        rows, size = [], 0
        stream = store.open_input_file(path)
        for info in own:
            media, error = None, None
            for attempt in range(self.retries + 1):
                try:
                    media, error = self._member(stream, info), None
                    break
                except (OSError, struct.error, zlib.error) as e:
                    error = str(e)
                    time.sleep(0.05 * attempt)
                    stream.close()
                    stream = store.open_input_file(path)
            rows.append((path, info.name.decode("utf-8", "replace"), info.offset, media, error))
            size += len(media or b"")
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), names.types, strict=True)], schema=names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), names.types, strict=True)], schema=names)
        stream.close()


def read_archives(spark, folder: str, range_bytes: int = 16 << 20) -> DataFrame:
    spark.dataSource.register(MediaSource)
    return spark.read.format("media_archive").option("range_bytes", str(range_bytes)).load(folder)


def media_features(media: DataFrame) -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of read members; a member with an error raises."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for member, data, error in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if error is not None:
                    raise OSError(f"{member}: {error}")
                payload, (key, size) = decode_png(data), member.removesuffix(".png").split(".")
                rows.append(
                    (int(key) if key else None, int(size), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload))
                )
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("member", "media", "error").mapInArrow(features, schema)
