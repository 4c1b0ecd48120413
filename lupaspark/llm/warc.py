"""WARC archives as a chunked record table."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lupaspark.llm.common import looked_up, scratch_path, written

#: Payloads under this size are always stored: a revisit record would save nothing.
MIN_REVISIT_BYTES = 100
CHUNK_BYTES = 256 << 10
#: A task starts another file once one has so many bytes.
FILE_BYTES = 256 << 20
DATE = "2024-01-31T00:00:00Z"
#: Chunk rows that a task gathers before it hands them on.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20

RECORDS = "page_id long, url string, record_type string, refers_to long, chunk_no int, data binary, payload_bytes long, payload_digest string, last boolean"
_FIELDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int32()), ("data", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("last", pa.bool_())])


def open_output(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(path, compression=None)


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(header: str | None) -> int | None:
    n = (header or "").removeprefix("<urn:page:").rstrip(">")
    return None if n in ("", "null") else int(n)


def _member(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """One gzip member, piece by piece."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    for p in pieces:
        if out := z.compress(p):
            yield out
    yield z.flush()


def _record(page_id: int | None, url: str | None, payload: memoryview, digest: str, refers_to: int | None) -> Iterator[bytes]:
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else len(payload))}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if revisit:
        head += [f"WARC-Refers-To: {_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    yield ("\r\n".join(head) + "\r\n\r\n").encode() + http
    if not revisit:
        for at in range(0, len(payload), CHUNK_BYTES):
            yield bytes(payload[at : at + CHUNK_BYTES])
    yield b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each row; returns (path, records): the files that count. Null html is an empty payload.

    Of the records with equal payloads of at least 100 bytes, that with the smallest page_id is a response and the others
    revisit it. Repeated rows of that page_id are responses too. Rows without page_id never serve as the response of
    others. Each task attempt writes files of its own name, so a lost executor's half-written file is never listed.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    ids = rows.where(F.length("payload") >= MIN_REVISIT_BYTES).select("page_id", "digest")
    firsts = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    revisits = looked_up(ids, firsts, ["digest"], "page_id").where("not page_id <=> first").select(F.col("page_id").alias("revisit_id"), F.col("digest").alias("revisit_digest"), F.col("first").alias("refers_to")).distinct()
    ready = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("revisit_id")) & (F.col("digest") == F.col("revisit_digest")), "left")

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        out, name, records, size = None, "", 0, 0
        for b in it:
            for i in range(b.num_rows):
                page_id, url, body, digest, refers = (c[i] for c in b.columns)
                if out is None:
                    name, records, size = f"{path}/part-{task.partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = open_output(name)
                view = memoryview(body.as_buffer())
                for piece in _member(_record(page_id.as_py(), url.as_py(), view, digest.as_py(), refers.as_py())):
                    out.write(piece)
                    size += len(piece)
                records += 1
                if size >= FILE_BYTES:
                    out.close()
                    yield pa.record_batch([pa.array([name]), pa.array([records], pa.int64())], names=["path", "records"])
                    out = None
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([name]), pa.array([records], pa.int64())], names=["path", "records"])

    return written(ready.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, "path string, records long"), "warc-files")


class _Bytes:
    """Uncompressed bytes of a file, plain or of gzip members, a bounded piece at a time."""

    def __init__(self, stream) -> None:
        self.stream, self.raw, self.buf, self.zip = stream, stream.read(CHUNK_BYTES), b"", None
        self.zipped = self.raw[:2] == b"\x1f\x8b"

    def more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.stream.read(CHUNK_BYTES)
                if not self.raw:
                    if self.zip is not None:
                        raise EOFError("the archive ends within a record")
                    return False
            if not self.zipped:
                self.buf, self.raw = self.buf + self.raw, b""
                return True
            self.zip = self.zip or zlib.decompressobj(31)
            got = self.zip.decompress(self.raw, CHUNK_BYTES)
            ended = self.zip.eof
            self.raw = self.zip.unused_data if ended else self.zip.unconsumed_tail
            self.zip = None if ended else self.zip
            if got:
                self.buf += got
                return True

    def line(self) -> bytes | None:
        while (end := self.buf.find(b"\n")) < 0:
            if not self.more():
                return None
        out, self.buf = self.buf[: end + 1], self.buf[end + 1 :]
        return out

    def piece(self, most: int) -> bytes:
        if not self.buf and not self.more():
            raise EOFError("the archive ends within a record")
        out, self.buf = self.buf[:most], self.buf[most:]
        return out


def records(stream, with_data: bool = True) -> Iterator[tuple]:
    """Rows of RECORDS in the order of the file; a payload is never held whole.

    The digest and byte count of a chunk's row cover the payload up to and with it; those of the last are the record's. A revisit has one
    row, with the digest and size of the payload that it refers to. Other kinds of record are passed over.
    """
    src = _Bytes(stream)
    while (first := src.line()) is not None:
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a record: {first[:40]!r}")
        head = {}
        while line := (src.line() or b"").strip():
            k, _, v = line.partition(b":")
            head[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
        left, kind = int(head["content-length"]), head.get("warc-type")
        digest = head.get("warc-payload-digest", "").rpartition(":")[2]
        base = (_page(head.get("warc-record-id")), head.get("warc-target-uri"), kind, _page(head.get("warc-refers-to")))
        if kind != "response":
            while left:
                left -= len(src.piece(left))
            if kind == "revisit":
                yield (*base, 0, b"" if with_data else None, int(head.get("x-payload-length", -1)), digest, True)
            continue
        while line := src.line():  # the HTTP header
            left -= len(line)
            if not line.strip():
                break
        hashed, size, no = hashlib.sha256(), 0, 0
        while True:
            data = src.piece(min(left, CHUNK_BYTES)) if left else b""
            left -= len(data)
            size += len(data)
            hashed.update(data)
            if not left and hashed.hexdigest() != digest:
                raise ValueError(f"payload of {base[0]} does not have its digest")
            if with_data or not left:
                yield (*base, no, data if with_data else None, size, hashed.hexdigest(), not left)
            no += 1
            if not left:
                break


def read_archives(files: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunk rows (RECORDS) of files(path). Each file is one task's; with_data=False leaves the payloads and all but the last chunk's row out."""
    n = max(1, min(files.count(), 10_000))

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for uri in b.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_stream(path, compression=None) as stream:
                    rows, size = [], 0
                    for r in records(stream, with_data):
                        rows.append(r)
                        size += len(r[5] or b"")
                        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield _batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows)

    return files.select("path").repartition(n).mapInArrow(read, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS)
