"""WARC archives as a PySpark Python data source named ``warc``.

Reading. The driver plans partitions of whole files, small ones together. Predicates on the record type and on other
header columns are pushed down: a record's headers are parsed first, and a record that they rule out is passed over
without decoding its payload. Compressed members carry their length in the gzip extra field ``sl``, so most of a
passed-over record is not even inflated. With option ``payload`` = ``false`` no payload is decoded.

Writing. Each task writes its own files (gzip, one member a record, at most ``file_bytes`` each) under hidden names;
the commit on the driver renames those of the tasks that won, so retried tasks and lost executors leave no record
twice. The path must be one that driver and executors share; any scheme that pyarrow's file systems know will do.

Defined cases: null payloads are empty; null headers are left out and read as null; line breaks in header values are
percent-encoded; an empty table writes no file and an archive without files reads as no rows; files without ``sl`` or
without compression, and records that are not HTTP, are read too; unknown record types are kept; a file that breaks
off in a record raises in every format, also in a record that is passed over; only the two line ends that close the
last record may lack. Repeated rows are records of their own; columns of other names are not written.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: WARC header of each column (fixed values; the last is an extension for the size of a payload kept elsewhere).
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "X-Payload-Length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
FILE_BYTES, PARTITION_BYTES, BATCH_BYTES, LEVEL = 64 << 20, 64 << 20, 8 << 20, 4


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def encode_record(row: dict) -> bytes:
    """A record's bytes: headers, block, and the two line ends that close it."""
    block = HTTP_HEAD + (row["payload"] or b"") if row["record_type"] in ("response", "revisit") else row["payload"] or b""
    lines = ["WARC/1.1"]
    for column, header in HEADERS.items():
        if (value := row[column]) is not None:
            value = str(value).replace("\r", "%0D").replace("\n", "%0A")
            lines.append(f"{header}: <{value}>" if column in ("record_id", "refers_to") else f"{header}: sha1:{value}" if column == "payload_digest" else f"{header}: {value}")
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    lines.append("Content-Type: " + ("application/http;msgtype=response" if row["record_type"] in ("response", "revisit") else "application/octet-stream"))
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member whose extra field ``sl`` has its own length and that of the data."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 12 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _member_length(head: bytes) -> int | None:
    """Length of a member from its extra field, if it has one."""
    if len(head) < 24 or head[:3] != b"\x1f\x8b\x08" or not head[3] & 4:
        return None
    extra, at = head[12 : 12 + struct.unpack_from("<H", head, 10)[0]], 0
    while at + 4 <= len(extra):
        name, n = struct.unpack_from("<2sH", extra, at)
        if name == b"sl" and n == 8:
            return struct.unpack_from("<I", extra, at + 4)[0]
        at += 4 + n
    return None


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record where one should begin")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:]) if k}


def row_of(headers: dict[str, str]) -> dict:
    row = {column: headers.get(header.lower()) for column, header in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        row[c] = row[c].strip("<>") if row[c] is not None else None
    if row["payload_digest"] is not None:
        row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
    row["payload_bytes"] = int(row["payload_bytes"]) if row["payload_bytes"] is not None else None
    return row


BROKEN = "the file breaks off in a record"


class _Plain:
    """A stream of bytes behind an uncompressed file or one member after another."""

    def __init__(self, read, skip):
        self.read_some, self.skip_some, self.held = read, skip, b""

    def until(self, mark: bytes) -> bytes:
        """Bytes up to and without the mark; empty at the end of the stream."""
        while (at := self.held.find(mark)) < 0:
            more = self.read_some()
            if not more:
                if self.held.strip(b"\r\n"):
                    raise ValueError(BROKEN)
                return b""
            self.held += more
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n:
            more = self.read_some()
            if not more:
                raise ValueError(BROKEN)
            parts.append(more)
            have += len(more)
        data = b"".join(parts)
        self.held = data[n:]
        return data[:n]

    def drop(self, n: int) -> None:
        have = min(n, len(self.held))
        self.held = self.held[have:]
        if n > have:
            self.skip_some(self, n - have)

    def close(self) -> None:
        """Pass the two line ends that close a record."""
        while len(self.held) < 4 and (more := self.read_some()):
            self.held += more
        self.held = self.held[4:] if self.held.startswith(b"\r\n\r\n") else self.held


def _drop_by_reading(stream: _Plain, n: int) -> None:
    while n > 0:
        more = stream.read_some()
        if not more:
            raise ValueError(BROKEN)
        stream.held = more[n:]
        n -= len(more)


def _inflated(f) -> _Plain:
    state = {"z": zlib.decompressobj(31), "raw": b""}

    def read() -> bytes:
        while True:
            z = state["z"]
            if z.eof:
                rest = z.unused_data or f.read(1 << 18)
                if not rest:
                    return b""
                state["z"], state["raw"] = zlib.decompressobj(31), rest
                continue
            raw = state["raw"] or f.read(1 << 18)
            if not raw:
                raise ValueError(BROKEN)  # the member has not ended
            out = z.decompress(raw, 1 << 20)
            state["raw"] = z.unconsumed_tail
            if out:
                return out

    return _Plain(read, _drop_by_reading)


def read_records(f, wanted, payload: bool) -> Iterator[dict]:
    """Rows of an open archive whose headers pass ``wanted``; others are passed over without decoding."""
    start = f.read(24)
    if _member_length(start) is not None:
        yield from _read_members(f, start, wanted, payload)
        return
    f.seek(0)

    whole = f.size()

    def skip(stream: _Plain, n: int) -> None:
        if f.tell() + n > whole:
            raise ValueError(BROKEN)
        f.seek(n, 1)

    stream = _inflated(f) if start[:2] == b"\x1f\x8b" else _Plain(lambda: f.read(1 << 18), skip)
    while head := stream.until(b"\r\n\r\n"):
        headers = parse_headers(head.lstrip(b"\r\n"))
        n = int(headers.get("content-length", 0))
        row = row_of(headers)
        if wanted(row):
            block = stream.take(n) if payload else stream.drop(n)
            yield row | {"payload": _payload(headers, block)}
        else:
            stream.drop(n)
        stream.close()


def _read_members(f, start: bytes, wanted, payload: bool) -> Iterator[dict]:
    whole = f.size()
    while start:
        size = _member_length(start)
        if len(start) < 24 or size is not None and f.tell() - len(start) + size > whole:
            raise ValueError(BROKEN)
        if size is None:
            raise ValueError("a member without its length follows members that have one")
        f.seek(-len(start), 1)
        at = f.tell()
        inflate, head, data = zlib.decompressobj(31), b"", b""
        while b"\r\n\r\n" not in head:
            data = data or f.read(min(2048, at + size - f.tell()))
            if not data:
                raise ValueError(BROKEN)
            head += inflate.decompress(data, 2048)
            data = inflate.unconsumed_tail
        head, _, block = head.partition(b"\r\n\r\n")
        headers = parse_headers(head)
        row = row_of(headers)
        if wanted(row):
            if payload:
                block += inflate.decompress(data + f.read(at + size - f.tell())) + inflate.flush()
                length = int(headers.get("content-length", 0))
                if not inflate.eof or len(block) < length:
                    raise ValueError(BROKEN)
                block = block[:length]
            yield row | {"payload": _payload(headers, block if payload else None)}
        f.seek(at + size)
        start = f.read(24)


def _payload(headers: dict[str, str], block: bytes | None) -> bytes | None:
    if block is not None and headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]
    rows: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.most = int(options.get("partition_bytes", PARTITION_BYTES))
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list) -> Iterable:
        """Takes equality, membership, prefix and null tests of header columns; leaves the rest to Spark."""
        for x in filters:
            column = x.attribute[0] if len(getattr(x, "attribute", ())) == 1 else None
            if column not in HEADERS:
                yield x
            elif isinstance(x, EqualTo | In | StringStartsWith | IsNull | IsNotNull):
                self.filters.append((column, type(x).__name__, tuple(x.value) if isinstance(x, In) else getattr(x, "value", None)))
            else:
                yield x

    def wanted(self, row: dict) -> bool:
        for column, kind, value in self.filters:
            have = row[column]
            if kind == "IsNull":
                if have is not None:
                    return False
            elif have is None:
                return False
            elif kind == "EqualTo" and have != value or kind == "In" and have not in value or kind == "StringStartsWith" and not have.startswith(value):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        store, path = open_store(self.path)
        files = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        out, held = [], 0
        for x in sorted((x for x in files if x.is_file and x.base_name[0] not in "._" and x.base_name.endswith((".warc", ".warc.gz"))), key=lambda x: x.path):
            if not out or held + x.size > self.most:
                out.append(Files([]))
                held = 0
            out[-1].paths.append(x.path)
            held += x.size
        return out or [Files([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with store.open_input_file(path) as f:
                for row in read_records(f, self.wanted, self.payload):
                    rows.append(row)
                    held += len(row["payload"] or b"") + 500
                    if held >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in COLUMNS], names=COLUMNS)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.most = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, path = open_store(self.path)
        store.create_dir(path, recursive=True)
        paths, rows, f, size = [], 0, None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if f is None or size >= self.most:
                        if f:
                            f.close()
                        paths.append(f"{path}/.{uuid.uuid4().hex}.warc.gz")
                        f, size = store.open_output_stream(paths[-1], compression=None), 0
                    member = gzip_member(encode_record(row))
                    f.write(member)
                    size += len(member)
                    rows += 1
        finally:
            if f:
                f.close()
        return Written(paths, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = open_store(self.path)
        if self.overwrite:
            for x in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if x.is_file and x.base_name[0] != ".":
                    store.delete_file(x.path)
        for p in (p for m in messages if m for p in m.paths):
            folder, _, name = p.rpartition("/")
            store.move(p, f"{folder}/part-{name[1:]}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = open_store(self.path)
        for p in (p for m in messages if m for p in m.paths):
            store.delete_file(p)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to the session and let Spark push filters to Python sources, which that needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def archive_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Records of pages: of equal payloads of at least ``least`` bytes, the one with the largest id is the response.

    Payload owners are aggregated before the shuffle and only of payloads that repeat, so a payload held by very many
    pages costs one row a task; Spark splits the join's hot partitions as owners are unique by payload. Rows without
    an id are revisits where an owner exists; rows that share the owner's id are all responses.
    """
    pages = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("target_uri"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    pages = pages.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    owners = (
        pages.where(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("size"))
        .agg(F.max("page").alias("owner"), F.count("*").alias("copies")).where("copies > 1 and owner is not null").drop("copies")
    )
    joined = pages.join(owners, (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") == F.col("size")), "left")
    again = F.col("owner").isNotNull() & ~F.col("page").eqNullSafe(F.col("owner"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.col(c).cast("string"))
    return joined.select(
        F.coalesce(urn("page"), F.lit("urn:page:")).alias("record_id"), F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), "target_uri", F.lit(date).alias("date"),
        F.when(again, urn("owner")).alias("refers_to"), "payload_digest", "payload_bytes", F.when(~again, F.col("payload")).alias("payload"),
    )


def write_archive(records: DataFrame, path: str, mode: str = "append") -> None:
    register(records.sparkSession)
    records.select(*COLUMNS).write.format("warc").mode(mode).save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
