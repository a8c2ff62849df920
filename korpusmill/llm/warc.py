"""WARC archives: a writer with revisit records and a sequential reader as a Spark data source.

One gzip member per record; the reader inflates members incrementally, frames records by Content-Length as they are
inflated and verifies block and payload digests on the way, so that it holds a payload only if it is asked for. An archive
is one task's work and is read from front to back.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from korpusmill.llm.files import Committed, at, listed, make_folder
from korpusmill.llm.skew import join_unique
from korpusmill.storage import Scratch

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 18
BATCH_BYTES = 4 << 20


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, id_: str, target_id: str | None = None) -> bytes:
    """One record as a gzip member; with ``refers_to`` a revisit, which keeps the HTTP headers and leaves the payload out.

    ``id_`` is the record's id, ``target_id`` that of the record it revisits, if that is known.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": id_,
        "WARC-Date": DATE,
        "WARC-Target-URI": "".join((url or "about:blank").split()),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if page_id is not None:
        fields["X-Page-ID"] = str(page_id)
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "X-Refers-To-Page-ID": str(refers_to)} | ({"WARC-Refers-To": target_id} if target_id else {})
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(head.encode()) + deflate.compress(block + b"\r\n\r\n") + deflate.flush()


def repeated(pages: DataFrame) -> DataFrame:
    """(d, refers_to, named, rows) of payloads (by their hash ``d``) that several rows hold: the largest page_id, whether one row alone has it, their number."""
    own = pages.select("page_id", _payload_hash().alias("d")).groupBy("d", "page_id").agg(F.count(F.lit(1)).alias("n"))
    last = own.groupBy("d").agg(F.max(F.struct("page_id", "n")).alias("last"), F.sum("n").alias("rows")).where("rows > 1")
    return last.select("d", F.col("last.page_id").alias("refers_to"), (F.col("last.n") == 1).alias("named"), "rows")


def _payload_hash() -> Column:
    return F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write (page_id, url, html) as one archive per partition below ``folder``; returns (path, records, bytes), which runs the job when read.

    Null html is an empty payload, null url ``about:blank``. Of equal payloads the largest page_id is the response. A null
    page_id is always a response and read back as null; repeated rows of one page_id are records each. An empty
    table writes no record. Other columns are not read.

    Record ids are unique: one made of page_id and payload where one row alone has these and others may refer to it,
    else one made of the record's place. A revisit of a page_id that several rows share names it by page_id alone.
    Payloads of very many rows (empty pages) meet their response by broadcast, see ``join_unique``.
    """
    make_folder(folder)
    html = F.coalesce("html", F.lit(""))
    last = Scratch(pages.sparkSession, "warc").save(repeated(pages), "repeated")
    rows = join_unique(pages.select("page_id", "url", html.alias("html"), _payload_hash().alias("d")), last, ["d"], "rows", "left", 80)
    is_last = F.col("page_id") == F.col("refers_to")
    alone = F.col("page_id").isNotNull() & (F.col("named").isNull() | (is_last & F.col("named")))
    revisit = (F.octet_length("html") >= min_bytes) & (F.col("page_id") < F.col("refers_to"))
    rows = rows.select("page_id", "url", "html", F.when(revisit, F.col("refers_to")).alias("refers_to"), alone.alias("alone"), "named")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        uri, n, size = f"{folder}/part-{task.partitionId():06d}.warc.gz", 0, 0
        first = next(batches, None)
        if first is None:
            return
        with Committed(uri, task.taskAttemptId()) as out:
            batch = first
            while batch is not None:
                for i in range(batch.num_rows):
                    page_id, url, text, refers_to, alone, named = (batch.column(k)[i].as_py() for k in range(6))
                    payload = text.encode()
                    body = digest(payload)
                    own = record_id(f"page:{page_id}:{body}" if alone else f"{uri}:{n}")
                    target = record_id(f"page:{refers_to}:{body}") if refers_to is not None and named else None
                    member = record(page_id, url, payload, refers_to, own, target)
                    out.write(member)
                    n, size = n + 1, size + len(member)
                batch = next(batches, None)
        yield pa.RecordBatch.from_pydict({"path": [uri], "records": [n], "bytes": [size]})

    return rows.mapInArrow(write, "path string, records long, bytes long")


class Member:
    """The inflated bytes of the gzip member that starts where a stream stands, a bounded piece at a time."""

    def __init__(self, stream, data: bytes, offset: int):
        self.stream, self.data, self.offset, self.used = stream, data, offset, 0
        self.inflate, self.rest = zlib.decompressobj(31), b""

    def more(self) -> bytes:
        """The next piece, empty at the member's end."""
        while not self.inflate.eof:
            if not self.data and not (data := self.stream.read(CHUNK)):
                raise ValueError("the member is cut off")
            data = self.data or data
            try:
                out = self.inflate.decompress(data, CHUNK)
            except zlib.error as e:
                raise ValueError(f"the member is damaged: {e}") from e
            self.data = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            self.used += len(data) - len(self.data)
            if out:
                return out
        return b""

    def until(self, mark: bytes) -> bytes | None:
        """All up to and with ``mark``; none if it does not come."""
        at_ = 0
        while (found := self.rest.find(mark, at_)) < 0:
            at_ = max(0, len(self.rest) - len(mark) + 1)
            if not (piece := self.more()):
                return None
            self.rest += piece
        out, self.rest = self.rest[: found + len(mark)], self.rest[found + len(mark) :]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next n bytes, or fewer at the member's end."""
        while n:
            piece, self.rest = self.rest or self.more(), b""
            if not piece:
                return
            self.rest, piece = piece[n:], piece[:n]
            n -= len(piece)
            yield piece


def _digests(said: str | None, made) -> bool:
    """Whether a field's digest agrees; those of other algorithms than SHA-1 are not judged."""
    name, _, value = (said or "").partition(":")
    return name.lower() != "sha1" or value.upper() == base64.b32encode(made.digest()).decode()


def parse(member: Member, payload: bool = True) -> dict:
    """Fields, payload (if wanted) and size of one record; raises ValueError for a fault."""
    head = member.until(b"\r\n\r\n")
    if head is None or not head.startswith(b"WARC/"):
        raise ValueError("no WARC header")
    fields = {}
    for line in head[:-4].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    number = lambda k: int(fields[k]) if fields.get(k, "").lstrip("-").isdigit() else None
    length, kind = number("content-length"), fields.get("warc-type")
    if length is None or length < 0 or kind is None:
        raise ValueError(f"no {'Content-Length' if kind else 'WARC-Type'}")
    block, body, http, parts, size, seen = hashlib.sha1(), hashlib.sha1(), b"", [], 0, 0
    inside = False  # the payload starts behind the block's own header
    for piece in member.pieces(length):
        seen += len(piece)
        block.update(piece)
        if not inside:
            http += piece
            at_ = http.find(b"\r\n\r\n")
            if at_ < 0:
                continue
            inside, piece, http = True, http[at_ + 4 :], http[:at_]
        body.update(piece)
        size += len(piece)
        if payload:
            parts.append(piece)
    if seen != length:
        raise ValueError(f"the block has {seen} bytes, Content-Length says {length}")
    if (tail := b"".join(member.pieces(5))) != b"\r\n\r\n":
        raise ValueError(f"the block of Content-Length {length} is followed by {tail!r}")
    if not _digests(fields.get("warc-block-digest"), block):
        raise ValueError("the block's digest differs")
    data = b"".join(parts) if payload else None
    if kind == "response":
        if not _digests(fields.get("warc-payload-digest"), body):
            raise ValueError("the payload's digest differs")
    else:  # a revisit's payload is elsewhere; its HTTP headers still tell the length
        sizes = [line.partition(b":")[2].strip() for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        size, data = (int(sizes[0]) if sizes and sizes[0].isdigit() else None), None
    return {
        "record_type": kind, "page_id": number("x-page-id"), "url": fields.get("warc-target-uri"), "payload_bytes": size,
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"), "refers_to": number("x-refers-to-page-id"), "payload": data,
    }


def records(stream, payload: bool = True) -> Iterator[dict]:
    """Records of an archive with their ``offset``, one after the other."""
    offset, data = 0, b""
    while data := data or stream.read(CHUNK):
        member = Member(stream, data, offset)
        try:
            row = parse(member, payload)
            while member.more():  # nothing is left but the member's own checksum
                pass
        except ValueError as e:
            raise ValueError(f"byte {offset}: {e}") from e
        yield row | {"offset": offset}
        offset, data = offset + member.used, member.data


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``; option ``payload`` (default false) adds the payload column."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        base = "path string, offset long, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long"
        return base + ", payload binary" * (str(self.options.get("payload", "false")).lower() == "true")

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema)


class WarcReader(DataSourceReader):
    def __init__(self, folder: str, schema):
        self.folder, self.names = folder, schema.names

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(path) for path, _ in listed(self.folder, ".warc.gz")] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        want = _arrow_schema(self.names)
        store, _ = at(self.folder)
        rows, size, path = [], 0, partition.value
        with store.open_input_stream(path, compression=None) as stream:
            try:
                for row in records(stream, "payload" in self.names):
                    rows.append(row | {"path": path})
                    size += 1000 + len(row["payload"] or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, want)
                        rows, size = [], 0
            except ValueError as e:
                raise ValueError(f"{path}, {e}") from e
        if rows:
            yield pa.RecordBatch.from_pylist(rows, want)


def _arrow_schema(names: list[str]) -> pa.Schema:
    kinds = {"offset": pa.int64(), "page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    return pa.schema([(n, kinds.get(n, pa.string())) for n in names])


def read_warc(spark, folder: str, payload: bool = False) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)
