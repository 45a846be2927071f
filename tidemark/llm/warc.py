"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans byte ranges of files as partitions, takes predicates on the record type and on other headers,
parses a record's headers first and passes over the payloads of records nobody wants: compressed records of
this writer say how long they are, so they are not even inflated.

Each record is one gzip member. Files named .warc without .gz are read too, each by one task.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains,
    StringEndsWith, StringStartsWith, WriterCommitMessage,
)

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, content_type string, "
    "http_status int, digest_ok boolean, payload binary, file string, offset long"
)
# WARC header names and the columns they fill.
HEADERS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest",
}
MANIFEST = "_manifest.json"
SPLIT_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
READ_BYTES = 1 << 20
EPOCH = "1970-01-01T00:00:00Z"


def _files(path: str):
    """File system and path of any address that pyarrow knows (local, hdfs, s3, gs)."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# Writing


def _member(record: bytes) -> bytes:
    """A gzip member whose extra field 'sl' holds its own length and the record's."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = 12 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(record) & 0xFFFFFFFF) if size < 1 << 32 and len(record) < 1 << 32 else b"xx" + struct.pack("<HII", 8, 0, 0)
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _line(value: str | None) -> str | None:
    """A header value on one line."""
    return None if value is None else " ".join(value.split("\r")).replace("\n", " ")


def response_record(row: dict) -> bytes:
    """A response, or a revisit that leaves its payload out; both keep the length and the digest of the whole payload."""
    payload = row["payload"] or b""
    payload = payload.encode() if isinstance(payload, str) else payload
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {_line(row.get('content_type')) or 'text/html; charset=utf-8'}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    fields = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{_line(row['record_id'])}>"), ("WARC-Date", row.get("date") or EPOCH), ("WARC-Target-URI", _line(row.get("target_uri"))),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("WARC-Refers-To", f"<{_line(row['refers_to'])}>" if row.get("refers_to") is not None else None),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None), ("Content-Type", "application/http; msgtype=response"),
    ]
    return _record(fields, http if revisit else http + payload)


@dataclass
class Written(WriterCommitMessage):
    name: str
    records: int


class WarcWriter(DataSourceArrowWriter):
    """A file per task under a name of its own; the manifest lists the files of tasks that were committed."""

    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator) -> Written:
        files, root = _files(self.path)
        files.create_dir(root, recursive=True)
        name, records = f"part-{self.job}-{uuid.uuid4().hex}.warc.gz", 0
        with files.open_output_stream(f"{root}/{name}", compression=None) as out:
            info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", EPOCH), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
            out.write(_member(_record(info, b"format: WARC File Format 1.1\r\n")))
            for batch in iterator:
                for row in batch.to_pylist():
                    out.write(_member(response_record(row)))
                    records += 1
        return Written(name, records)

    def commit(self, messages) -> None:
        files, root = _files(self.path)
        files.create_dir(root, recursive=True)
        kept = {m.name: m.records for m in messages if m is not None}
        known = _manifest(files, root) or {}
        with files.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(known | kept).encode())

    def abort(self, messages) -> None:
        files, root = _files(self.path)
        for m in messages:
            if m is not None:
                files.delete_file(f"{root}/{m.name}")


def _manifest(files, root: str) -> dict | None:
    from pyarrow import fs

    if files.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.NotFound:
        return None
    with files.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


# Reading


class _Bytes:
    """A file read forward in large pieces, with places by absolute offset."""

    def __init__(self, file, at: int):
        self.file, self.base, self.data, self.size = file, at, b"", file.size()

    def take(self, at: int, n: int) -> bytes:
        """Up to n bytes at an offset; earlier bytes are let go."""
        if at < self.base or min(at + n, self.size) > self.base + len(self.data):
            self.file.seek(at)
            self.base, self.data = at, self.file.read(max(n, READ_BYTES))
        here = at - self.base
        return self.data[here : here + n]


def _parse(head: bytes) -> dict[str, str]:
    """Headers by lower-case name, folded lines joined."""
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


class _Gzip:
    """One gzip member, inflated as far as asked."""

    def __init__(self, source: _Bytes, at: int):
        self.source, self.at, self.next = source, at, at
        self.inflater, self.out, self.tail = zlib.decompressobj(31), bytearray(), b""

    def upto(self, n: int | None) -> bytearray:
        """The member's first n bytes, or all."""
        while not self.inflater.eof and (n is None or len(self.out) < n):
            data = self.inflater.unconsumed_tail or self.source.take(self.next, 1 << 16)
            if not data:
                raise EOFError(f"a record is cut off at {self.at}")
            fresh = not self.inflater.unconsumed_tail
            self.out += self.inflater.decompress(data, 0 if n is None else max(1024, n - len(self.out)))
            if fresh:
                self.next += len(data)
        return self.out

    def end(self) -> int:
        """Where the next member begins; the written length saves inflating the rest."""
        head = self.source.take(self.at, 24)
        if len(head) == 24 and head[3] & 4 and head[12:14] == b"sl":
            return self.at + struct.unpack("<I", head[16:20])[0]
        while not self.inflater.eof:
            self.upto(len(self.out) + (1 << 16))
            del self.out[:]
        return self.next - len(self.inflater.unused_data)


def _first_member(source: _Bytes, at: int) -> int:
    """The first member that begins at or after an offset."""
    while at < source.size:
        piece = source.take(at, READ_BYTES)
        found = piece.find(b"\x1f\x8b\x08")
        if found < 0:
            at += max(1, len(piece) - 2)
            continue
        at += found
        try:
            if bytes(_Gzip(source, at).upto(5)[:5]) == b"WARC/":
                return at
        except (zlib.error, EOFError):
            pass
        at += 1
    return source.size


@dataclass
class Ranges(InputPartition):
    """(file, from, to) pieces that one task reads."""

    pieces: list[tuple[str, int, int]]


#: Tests by filter class, on the values of a header column and of the filter.
TESTS = {
    EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b, StringStartsWith: lambda a, b: a.startswith(b), StringEndsWith: lambda a, b: a.endswith(b), StringContains: lambda a, b: b in a, IsNotNull: lambda a, b: True,
}


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, split: int):
        self.path, self.payload, self.split = path, payload, split
        self.wanted: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) in TESTS and column in HEADERS:
                self.wanted.append((column, type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Ranges]:
        from pyarrow import fs

        files, root = _files(self.path)
        info = files.get_file_info(root)
        if info.type == fs.FileType.File:
            found = [info]
        else:
            known = _manifest(files, root)
            every = files.get_file_info(fs.FileSelector(root, recursive=True))
            found = [i for i in every if i.type == fs.FileType.File and (i.base_name.endswith((".warc", ".warc.gz")) if known is None else i.base_name in known)]
        out: list[Ranges] = []
        held, room = [], self.split
        for i in sorted(found, key=lambda i: i.path):
            step = self.split if i.path.endswith(".gz") else max(1, i.size)
            for at in range(0, i.size, step):
                piece = (i.path, at, min(i.size, at + step))
                if held and piece[2] - piece[1] > room:
                    out.append(Ranges(held))
                    held, room = [], self.split
                held.append(piece)
                room -= piece[2] - piece[1]
        return [*out, Ranges(held)] if held else out

    def read(self, partition: Ranges) -> Iterator:
        import pyarrow as pa

        files, _ = _files(self.path)
        tests = [(c, next(t for k, t in TESTS.items() if k.__name__ == kind), v) for c, kind, v in self.wanted]
        schema = pa.schema([
            *[(n, pa.string()) for n in HEADERS], ("payload_bytes", pa.int64()), ("content_type", pa.string()), ("http_status", pa.int32()), ("digest_ok", pa.bool_()), ("payload", pa.binary()),
            ("file", pa.string()), ("offset", pa.int64()),
        ])
        rows, size = [], 0
        for path, start, stop in partition.pieces:
            with files.open_input_file(path) as file:
                for row in self.records(file, path, start, stop, tests):
                    rows.append(row)
                    size += 512 + len(row["payload"] or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def records(self, file, path: str, start: int, stop: int, tests) -> Iterator[dict]:
        source, packed = _Bytes(file, start), path.endswith(".gz")
        at = _first_member(source, start) if packed and start else start
        while at < min(stop, source.size):
            if packed:
                member = _Gzip(source, at)
                read, end = member.upto, member.end
            else:
                read, end = (lambda n, at=at: bytearray(source.take(at, n))), None
            want = 2048
            while (cut := read(want).find(b"\r\n\r\n")) < 0:
                if len(read(want)) < want:
                    raise EOFError(f"no end of headers at {at} of {path}")
                want *= 2
            head = _parse(bytes(read(want)[:cut]))
            length, begin = int(head.get("content-length", 0)), cut + 4
            fields = {c: head.get(h) for c, h in HEADERS.items()}
            for c in ("record_id", "refers_to"):
                fields[c] = fields[c].strip("<>") if fields[c] else None
            if fields["payload_digest"]:
                fields["payload_digest"] = fields["payload_digest"].removeprefix("sha1:")
            if all(fields[c] is not None and test(fields[c], v) for c, test, v in tests):
                yield fields | self.content(head, fields, read, begin, length) | {"file": path, "offset": at}
            at = end() if packed else at + begin + length + 4

    def content(self, head: dict, fields: dict, read, begin: int, length: int) -> dict:
        """The columns of a wanted record's block; its payload is taken only when asked for."""
        out = {"payload_bytes": length, "content_type": head.get("content-type"), "http_status": None, "digest_ok": None, "payload": None}
        from_http = (head.get("content-type") or "").startswith("application/http")
        skip = 0
        if from_http:
            want = 1024
            while (cut := bytes(read(begin + min(want, length))[begin : begin + length]).find(b"\r\n\r\n")) < 0 and want < length:
                want *= 2
            if cut >= 0:
                raw = bytes(read(begin + cut)[begin : begin + cut])
                http, skip = _parse(raw), cut + 4
                status = raw.split(b" ", 2)[1:2]
                out |= {"content_type": http.get("content-type"), "http_status": int(status[0]) if status and status[0].isdigit() else None}
                told = http.get("content-length", "")
                out["payload_bytes"] = int(told) if fields["record_type"] == "revisit" and told.isdigit() else length - skip
        if self.payload and fields["record_type"] != "revisit":
            out["payload"] = bytes(read(begin + length)[begin + skip : begin + length])
            if fields["payload_digest"]:
                out["digest_ok"] = base32_sha1(out["payload"]) == fields["payload_digest"]
        return out


class WarcSource(DataSource):
    """Options: path; payload (true), whether payloads are decoded; split_bytes, the size of a task's part."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true", int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only added to; name a new folder")
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Records for pages: record_id, record_type, target_uri, refers_to, payload.

    Of pages with equal payloads of ``least_bytes`` or more, that of the smallest page_id is the response and the
    others revisit it. ``pages`` needs page_id, url and html; other columns are not read. A null html is an empty
    payload and a null url leaves the header out. A null page_id comes after all others, so it is a response only if
    no page with an id has its payload; rows repeated with one page_id and payload are of one type. An empty table
    gives no records.
    """
    payload = F.coalesce("html", F.lit(""))
    hashed = pages.select("page_id", F.col("url").alias("target_uri"), payload.alias("payload"), F.sha2(payload, 256).alias("same"))
    groups = pages.select("page_id", F.sha2(payload, 256).alias("same"), F.octet_length(payload).alias("n")).groupBy("same")
    firsts = groups.agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("pages"), F.first("n").alias("n")).where((F.col("pages") > 1) & (F.col("n") >= least_bytes)).drop("pages", "n")
    both = hashed.join(firsts.withColumnRenamed("same", "__same"), F.col("same") == F.col("__same"), "left")
    response = F.col("__same").isNull() | F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    return both.select(
        urn("page_id").alias("record_id"), F.when(response, "response").otherwise("revisit").alias("record_type"), "target_uri", F.when(~response, urn("first")).alias("refers_to"), "payload"
    )


def write_archives(records: DataFrame, folder: str) -> None:
    """Adds records to a folder: record_id, record_type, target_uri, refers_to, payload, and date or content_type where they are there."""
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(folder)

