"""WARC files as a Spark data source.

Writing: one gzip member per record, with the `sl` extra field that holds the member's compressed and full length. Every
task attempt writes a file of its own; the commit lists the files that count in `_manifest`, so a lost or
repeated attempt leaves nothing behind that a reader would see.

Reading: the plan packs the files of the manifest (or all *.warc.gz files of a foreign folder) into partitions. Predicates on the record
type, the target address and the page number are taken over from Spark and tested on the record's headers, of which only the
first bytes are inflated; a record that is not wanted is skipped by its stored length. Payloads are inflated only
if the schema asks for them. Members without lengths (other writers) are inflated to find their end.

The folder can be on any file system that pyarrow can open by URI.

Defined cases of `archived`: a null html is an empty payload; equal payloads of 100 bytes or more are written once, by the smallest
page_id (rows that repeat this id are responses as well), all others revisit it; rows with a null page_id revisit
like others, and are responses if nobody with an id has the payload; a null url leaves out the address header.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage,
)

LEAST_SHARED_BYTES = 100
PARTITION_BYTES = 64 << 20
FILE_BYTES = PARTITION_BYTES  # a file is read by one task
_DATE = "1970-01-01T00:00:00Z"
_ID = "urn:x-page-id:"
RECORD_SCHEMA = ("page_id bigint, target_uri string, record_type string, refers_to bigint, payload_digest string, "
                 "payload_bytes bigint, payload binary")


def _open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else re.sub("^file:/*", "file:///", f"file:{path}"
                                    if not path.startswith("file:") else path))


def gzip_member(data: bytes) -> bytes:
    """One gzip member with its compressed and full length in the `sl` extra field (left out from 4 GB on: readers then inflate)."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    if max(size, len(data)) >= 1 << 32:
        tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
        return b"".join([b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff", body, tail])
    return b"".join([
        b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff", struct.pack("<H", 12), b"sl", struct.pack("<HII", 8, size, len(data) & 0xFFFFFFFF),
        body, struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF),
    ])


def record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, digest: str, size: int, payload: bytes) -> bytes:
    """A response or revisit record; a revisit has the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    number = lambda n: f"<{_ID}{'' if n is None else n}>"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {number(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {number(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, folder = _open_folder(self.path)
        fs.create_dir(folder, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in zip(*[batch.column(n).to_pylist() for n in (
                    "page_id", "target_uri", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload")]):
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{folder}/{files[-1]}", compression=None), 0
                page_id, url, kind, refers_to, digest, length, payload = row
                member = gzip_member(record(page_id, url, kind, refers_to, digest, length, payload or b""))
                out.write(member)
                size += len(member)
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, folder = _open_folder(self.path)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/_manifest") as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        """Files of a failed job are in no manifest; readers do not see them."""


class WarcReader(DataSourceReader):
    def __init__(self, path: str, fields: list[str]):
        self.path, self.fields, self.tests = path, fields, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNotNull)) and f.attribute in (("record_type",), ("target_uri",), ("page_id",)):
                wanted = None if isinstance(f, IsNotNull) else {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tests.append((f.attribute[0], wanted))
            else:
                yield f

    def partitions(self) -> list[_Files]:
        fs, folder = _open_folder(self.path)
        names = {i.base_name: i.size for i in fs.get_file_info(pafs.FileSelector(folder)) if i.is_file}
        if "_manifest" in names:
            with fs.open_input_stream(f"{folder}/_manifest") as f:
                listed = json.loads(f.read())
        else:
            listed = sorted(n for n in names if n.endswith(".warc.gz"))
        packs: list[list[str]] = []
        room = 0
        for name in sorted(listed):
            if room < names[name]:
                packs.append([])
                room = PARTITION_BYTES
            packs[-1].append(name)
            room -= names[name]
        return [_Files(p) for p in packs]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, folder = _open_folder(self.path)
        types = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            columns = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), types.get(n, pa.string())) for n, c in zip(self.fields, columns)], self.fields)

        for name in partition.paths:
            with fs.open_input_file(f"{folder}/{name}") as f:
                for found in self._records(f):
                    rows.append(tuple(found[n] for n in self.fields))
                    size += len(found.get("payload") or b"") + 200
                    if size > 8 << 20:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()

    def _records(self, f) -> Iterator[dict]:
        at, end = 0, f.size()
        while at < end:
            f.seek(at)
            lead = f.read(4096)
            extra = struct.unpack_from("<H", lead, 10)[0] if lead[3] & 4 else 0
            length = 0
            if extra >= 12 and lead[12:14] == b"sl":
                length = struct.unpack_from("<I", lead, 16)[0]
            inflate = zlib.decompressobj(31)
            data = inflate.decompress(lead, 4096)
            taken = len(lead)
            while b"\r\n\r\n" not in data:
                more = inflate.unconsumed_tail
                if not more:
                    more = f.read(4096)
                    taken += len(more)
                if not more or inflate.eof:
                    raise ValueError(f"no record header at byte {at}")
                data += inflate.decompress(more, 4096)
            head, _, block = data.partition(b"\r\n\r\n")
            fields = parse_head(head)
            found = described(fields)
            wanted = all(found[n] is not None and (w is None or found[n] in w) for n, w in self.tests)
            if wanted or not length:
                if length > taken:
                    f.seek(at + taken)
                    rest = f.read(length - taken)
                    # The HTTP head holds the payload's size; where it is cut off, the rest is needed as well.
                    if self._needs(found) or b"\r\n\r\n" not in block:
                        block += inflate.decompress(inflate.unconsumed_tail + rest)
                elif length:
                    block += inflate.decompress(inflate.unconsumed_tail)
                else:
                    f.seek(at + taken)
                    block += inflate.decompress(inflate.unconsumed_tail)
                    while not inflate.eof:
                        piece = f.read(1 << 16)
                        if not piece:
                            break
                        taken += len(piece)
                        block += inflate.decompress(piece)
                    length = taken - len(inflate.unused_data)
            if wanted:
                http, _, payload = block[: int(fields["content-length"])].partition(b"\r\n\r\n")
                sizes = parse_head(http)
                found["payload_bytes"] = int(sizes["content-length"]) if "content-length" in sizes else len(payload)
                found["payload"] = payload if found["record_type"] == "response" else None
                yield found
            at += length

    def _needs(self, found: dict) -> bool:
        return "payload" in self.fields and found["record_type"] == "response"


def parse_head(head: bytes) -> dict[str, str]:
    """Header lines after the first one, names in lower case."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {n.strip().lower(): v.strip() for n, s, v in (line.partition(":") for line in lines) if s}


def described(fields: dict[str, str]) -> dict:
    def number(name: str) -> int | None:
        value = fields.get(name, "").strip("<>")
        return int(value[len(_ID):]) if value.startswith(_ID) and value != _ID else None

    return {
        "page_id": number("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "record_type": fields.get("warc-type"),
        "refers_to": number("warc-refers-to"),
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha256:") or None,
        "payload_bytes": None, "payload": None,
    }


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, fields: str = RECORD_SCHEMA) -> DataFrame:
    """Records of an archive folder; name only the columns needed."""
    register(spark)
    return spark.read.format("warc").schema(fields).load(path)


def records_of(pages: DataFrame) -> DataFrame:
    """The records to write for page_id, url, html rows."""
    pages = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    pages = pages.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("bigint")})
    shared = (
        pages.filter(F.col("payload_bytes") >= LEAST_SHARED_BYTES).groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
        .select("payload_digest", "first")
    )
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return pages.join(shared, "payload_digest", "left").select(
        "page_id", F.col("url").alias("target_uri"), F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"), "payload_digest", "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def archived(pages: DataFrame, path: str) -> DataFrame:
    """Write the pages to an archive folder and return its records as read back."""
    register(pages.sparkSession)
    records_of(pages).write.format("warc").mode("append").save(path)
    return read(pages.sparkSession, path)


def report(pages: DataFrame, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest (of what was read; of revisits as the headers say), record_type, refers_to."""
    rows = archived(pages, path)
    own = F.col("payload").isNotNull()
    return rows.select(
        "page_id", F.when(own, F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to",
    )
