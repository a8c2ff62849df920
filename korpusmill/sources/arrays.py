"""Data sources for stored vectors: ``npy`` (dense matrices) and ``csr_npz`` (sparse matrices)."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from korpusmill.sources.files import at, found
from korpusmill.storage import Scratch

BATCH_BYTES = 4 << 20
#: Row pointers read at once, and ranges of a sparse file whose members are deflated.
POINTERS, DEFLATED_RANGES = 1 << 16, 8


class NpySource(DataSource):
    """``spark.read.format("npy").load(path)``: (row, vector array<float>) of .npy matrices in C order; with several files, ``file`` tells them apart.

    Option ``range_bytes`` (32 MiB): bytes of a matrix that a task reads.
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "file string, row long, vector array<float>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("range_bytes", 32 << 20)))


class NpyReader(DataSourceReader):
    def __init__(self, uri: str, range_bytes: int):
        self.uri, self.range_bytes = uri, range_bytes

    def partitions(self) -> list[InputPartition]:
        store, _ = at(self.uri)
        out = []
        for path, _size in found(self.uri, ".npy"):
            with store.open_input_file(path) as f:
                head = io.BytesIO(f.read(1 << 16))
            read = np.lib.format.read_array_header_1_0 if np.lib.format.read_magic(head) == (1, 0) else np.lib.format.read_array_header_2_0
            shape, fortran, kind = read(head)
            if len(shape) != 2 or fortran or kind.kind != "f":
                raise ValueError(f"{path}: not a matrix of floats in C order")
            width = shape[1] * kind.itemsize
            step = max(1, self.range_bytes // max(width, 1))
            out += [InputPartition((path, head.tell() + lo * width, lo, min(step, shape[0] - lo), shape[1], kind.str)) for lo in range(0, shape[0], step)]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        path, start, first, rows, dim, kind = partition.value
        store, _ = at(self.uri)
        step = max(1, BATCH_BYTES // max(dim * 4, 1))
        with store.open_input_file(path) as f:
            f.seek(start)
            for lo in range(0, rows, step):
                n = min(step, rows - lo)
                data = f.read(n * dim * np.dtype(kind).itemsize)
                x = np.frombuffer(data, kind).astype(np.float32)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[-1]] * n), pa.array(np.arange(first + lo, first + lo + n)), vectors], names=["file", "row", "vector"])


class CsrSource(DataSource):
    """``spark.read.format("csr_npz").load(path)``: (file, row, weights map<string, float>) of compressed-row .npz matrices; a weight's key is its column's number.

    Option ``range_bytes`` (32 MiB): bytes of columns and values that a task reads. A matrix is cut by entries, and a row goes where its first
    entry is; members that are deflated can only be read from their start, so such a file is cut in ``DEFLATED_RANGES`` at most.
    """

    @classmethod
    def name(cls) -> str:
        return "csr_npz"

    def schema(self) -> str:
        return "file string, row long, weights map<string,float>"

    def reader(self, schema) -> CsrReader:
        return CsrReader(self.options["path"], int(self.options.get("range_bytes", 32 << 20)))


class _Member:
    """A vector of an .npz archive, read in parts: by offset where it is stored, as a stream where it is deflated."""

    def __init__(self, file: pa.NativeFile, archive: zipfile.ZipFile, name: str):
        info = archive.getinfo(f"{name}.npy")
        self.name, self.stored, self.file, self.stream = info.filename, info.compress_type == zipfile.ZIP_STORED, file, archive.open(info)
        read = np.lib.format.read_array_header_1_0 if np.lib.format.read_magic(self.stream) == (1, 0) else np.lib.format.read_array_header_2_0
        self.shape, _, self.kind = read(self.stream)
        self.start = self.stream.tell()
        if self.stored:  # behind the member's own header, whose name and extra field tell their lengths
            self.start += info.header_offset + 30 + sum(struct.unpack("<HH", file.read_at(4, info.header_offset + 26)))

    def take(self, first: int, n: int) -> np.ndarray:
        size, place = int(n) * self.kind.itemsize, self.start + int(first) * self.kind.itemsize
        if self.stored:
            data = self.file.read_at(size, place)
        else:
            self.stream.seek(place)
            data = self.stream.read(size)
        if len(data) < size:
            raise ValueError(f"{self.name}: shorter than its header says")
        return np.frombuffer(data, self.kind)


class CsrReader(DataSourceReader):
    def __init__(self, uri: str, range_bytes: int):
        self.uri, self.range_bytes = uri, range_bytes

    def partitions(self) -> list[InputPartition]:
        """Ranges of entries (file, first, end), from the members' headers alone."""
        store, _ = at(self.uri)
        out = []
        for path, _size in found(self.uri, ".npz"):
            with store.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
                if np.lib.format.read_array(io.BytesIO(archive.read("format.npy")), allow_pickle=False).item() not in (b"csr", "csr"):
                    raise ValueError(f"{path}: not a matrix in compressed rows")
                members = [_Member(f, archive, name) for name in ("indptr", "indices", "data")]
            n, width = members[2].shape[0], members[1].kind.itemsize + members[2].kind.itemsize
            ranges = max(1, -(-n * width // self.range_bytes))
            step = max(1, -(-n // (ranges if all(m.stored for m in members) else min(ranges, DEFLATED_RANGES))))
            # rows without entries at the end begin at entry n
            out += [InputPartition((path, lo, lo + step if lo + step < n else n + 1)) for lo in range(0, max(n, 1), step)]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        path, lo, hi = partition.value
        name, (store, _) = path.rsplit("/", 1)[-1], at(self.uri)
        with store.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
            ends, columns, data = (_Member(f, archive, m) for m in ("indptr", "indices", "data"))
            for first, own in _pointers(ends, lo, hi):
                i = 0
                while i < len(own) - 1:
                    j = max(i + 1, int(np.searchsorted(own, own[i] + BATCH_BYTES // 16, side="right")) - 1)
                    n = own[j] - own[i]
                    keys = pa.array(columns.take(own[i], n)).cast(pa.string())
                    maps = pa.MapArray.from_arrays(pa.array((own[i : j + 1] - own[i]).astype(np.int32)), keys, pa.array(data.take(own[i], n).astype(np.float32)))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * (j - i)), pa.array(np.arange(first + i, first + j)), maps], names=["file", "row", "weights"])
                    i = j


def _pointers(ends: _Member, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, where it and those after it begin, and the last ends) of the rows that begin at entries lo to hi, in blocks."""
    rows = ends.shape[0] - 1
    row, beyond = 0, rows
    while ends.stored and beyond - row > POINTERS:
        middle = (row + beyond) // 2
        row, beyond = (row, middle) if ends.take(middle, 1)[0] >= lo else (middle, beyond)
    held = ends.take(row, 1).astype(np.int64)
    while row < rows:
        more = ends.take(row + 1, min(POINTERS, rows - row)).astype(np.int64)
        own = np.append(held, more)
        if (own[1:] < own[:-1]).any():
            raise ValueError(f"{ends.name}: pointers fall")
        a, b = np.searchsorted(own[:-1], [lo, hi])
        if a < b:
            yield row + int(a), own[a : b + 1]
        if b < len(more):
            return
        held, row = more[-1:], row + len(more)


def write_npy(rows: DataFrame, folder: str, vector_col: str = "embedding", order: list[str] | None = None, half: bool = True) -> DataFrame:
    """Write vectors of one length as .npy matrices, one a partition, in half or single precision; returns (file, first_row, rows).

    With ``order`` the files hold the rows in that order, one file after the other, as ``numbered`` numbers them.
    """
    store, root = at(folder)
    store.create_dir(root, recursive=True)
    own = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    kind = np.float16 if half else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, (store, root) = TaskContext.get(), at(folder)
        parts = [np.stack(b.column(0).to_numpy(zero_copy_only=False)).astype(kind) for b in batches if b.num_rows]
        if parts:
            name, matrix = f"part-{task.partitionId():06d}.npy", np.concatenate(parts)
            with store.open_output_stream(f"{root}/._{task.taskAttemptId()}-{name}", compression=None) as out:
                np.lib.format.write_array(_Plain(out), matrix, allow_pickle=False)
            store.move(f"{root}/._{task.taskAttemptId()}-{name}", f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "rows": [len(matrix)]})

    done = sorted((r.file, r.rows) for r in own.select(vector_col).mapInArrow(run, "file string, rows long").collect())  # a row per file
    first = np.cumsum([0, *(n for _, n in done)]).tolist()
    return rows.sparkSession.createDataFrame([(f, a, n) for (f, n), a in zip(done, first, strict=False)], "file string, first_row long, rows long")


class _Plain:
    """What numpy needs of a stream that is no file of the system's."""

    def __init__(self, out):
        self.out = out

    def write(self, data) -> int:
        return self.out.write(bytes(data)) or len(data)


def numbered(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """Rows with ``row``, their place from 0 in the given order; every task counts its own range, so no task holds all."""
    own = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    own = scratch.save(own, "numbered").withColumn("_part", F.shiftright("_m", 33))
    counts = sorted(tuple(r) for r in own.groupBy("_part").count().collect())  # a row per task
    first = np.cumsum([0, *(n for _, n in counts)]).tolist()
    starts = rows.sparkSession.createDataFrame([(p, a) for (p, _), a in zip(counts, first, strict=False)], "_part long, _first long")
    placed = own.join(F.broadcast(starts), "_part").withColumn("row", F.col("_first") + F.col("_m").bitwiseAND((1 << 33) - 1))
    return placed.drop("_m", "_part", "_first")


def with_vectors(chunks: DataFrame, vectors: DataFrame, order: list[str], scratch: Scratch, out_col: str = "embedding") -> DataFrame:
    """Chunks in their order joined with the rows (row, vector) of a stored matrix; raises if their numbers differ."""
    own, n = numbered(chunks, order, scratch), vectors.count()
    if (m := own.count()) != n:
        raise ValueError(f"{m} chunks but {n} vectors")
    return own.join(vectors.select("row", F.col("vector").alias(out_col)), "row").drop("row")


def register(spark) -> None:
    for source in (NpySource, CsrSource):
        spark.dataSource.register(source)
