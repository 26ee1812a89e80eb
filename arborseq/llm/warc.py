"""WARC archives as a PySpark data source.

``spark.read.format("warc").load(folder)`` plans one partition for each group of
archive files, pushes predicates on record type and headers into the scan, reads
a record's headers before anything else and leaves its payload undecoded unless
the record passed the predicates and the payload column is asked for
(``option("payload", "false")`` leaves it out).  ``df.write.format("warc")``
writes archives of bounded size, each record a gzip member of its own whose
header tells its length, so a reader passes over unwanted records without
decompressing them.  An archive counts only once it stands in a manifest; every
write commits one of its own, so attempts of lost or doubled tasks are never
read, and what is appended to a folder later adds to what is there.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from .common import shared_dir, ship, stored

#: Columns of a record; each header column stands for one WARC header (fixed by the format).
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "source_id": "WARC-Source-Id",
    "full_bytes": "WARC-Full-Payload-Length",
}
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in HEADERS] + [T.StructField("payload_bytes", T.LongType()), T.StructField("payload", T.BinaryType())])
#: Manifests, one for each write: their names begin with this.
MANIFEST = "_manifest"
BATCH_BYTES = 8 << 20
#: A gzip header with one extra field, "RL": the member's length in bytes, 64 bits.
MEMBER = struct.Struct("<4sIBBHccHQ")


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def clean(value: object) -> str:
    """A header value on one line."""
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def record(headers: dict[str, object], payload: bytes) -> bytes:
    """One record as a gzip member; headers by their WARC names, null ones left out.

    A response's block is an HTTP message around the payload; other blocks are the payload itself.
    """
    block = payload
    if headers.get("WARC-Type") == "response":
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    lines = ["WARC/1.1"] + [f"{k}: {clean(v)}" for k, v in headers.items() if v is not None] + [f"Content-Length: {len(block)}"]
    data = "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    engine = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = engine.compress(data) + engine.flush()
    head = MEMBER.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"R", b"L", 8, MEMBER.size + len(body) + 8)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class Member:
    """Reads gzip members of a stream one after another, no further than asked."""

    def __init__(self, stream: io.RawIOBase):
        self.stream, self.rest = stream, b""
        self.engine: zlib._Decompress | None = None

    def start(self) -> bool:
        while len(self.rest) < MEMBER.size and (new := self.stream.read(1 << 16)):
            self.rest += new
        self.engine, self.buffer, self.end = zlib.decompressobj(31), b"", None
        if self.rest[:4] == b"\x1f\x8b\x08\x04" and self.rest[10:16] == b"\x0c\x00RL\x08\x00" and len(self.rest) >= MEMBER.size:
            self.end = self.stream.tell() - len(self.rest) + MEMBER.unpack_from(self.rest)[-1]
        return bool(self.rest)

    def more(self) -> bool:
        """Decode a bit further; False at the member's end."""
        if self.engine.eof:
            return False
        if not self.rest:
            self.rest = self.stream.read(1 << 16)
            if not self.rest:
                raise EOFError("an archive ends within a record")
        self.buffer += self.engine.decompress(self.rest, 1 << 14)
        self.rest = self.engine.unconsumed_tail or self.engine.unused_data
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.buffer.find(mark)) < 0:
            if not self.more():
                raise ValueError("a record has no end of headers")
        out, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        self.buffer = b""
        while have < n and self.more():
            parts.append(self.buffer)
            have += len(self.buffer)
            self.buffer = b""
        data = b"".join(parts)
        if len(data) < n:
            raise EOFError("a record is shorter than it says")
        self.buffer = data[n:]
        return data[:n]

    def skip(self) -> None:
        """To the next member: by its length where the header tells it, else by decompressing piecewise and keeping nothing."""
        at = self.stream.tell() - len(self.rest)
        if self.end is None or self.engine.eof:
            while self.more():
                self.buffer = b""
        elif self.end <= at + len(self.rest):
            self.rest = self.rest[self.end - at :]
        else:
            self.stream.seek(self.end - 1)
            if not self.stream.read(1):
                raise EOFError("an archive ends within a record")
            self.rest = b""
        self.buffer = b""


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.target = int(options.get("partitionBytes", str(32 << 20)))
        self.wanted: list[tuple[str, set | None]] = []

    def pushFilters(self, filters: list) -> Iterator:
        """Takes equality, IN and IS NOT NULL on header columns; others go back to Spark."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else ""
            if name in HEADERS and isinstance(f, EqualTo):
                self.wanted.append((name, {f.value}))
            elif name in HEADERS and isinstance(f, In):
                self.wanted.append((name, set(f.value)))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.wanted.append((name, None))
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, root = open_path(self.path)
        root = root.rstrip("/")
        manifests = sorted(f.path for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.startswith(MANIFEST))
        if not manifests:
            raise FileNotFoundError(f"no write to {self.path} was committed")
        files = []
        for path in manifests:
            with system.open_input_stream(path, compression=None) as f:
                files += json.loads(f.read())
        groups, size = [[]], 0
        for name, n in files:
            if groups[-1] and size + n > self.target:
                groups.append([])
                size = 0
            groups[-1].append(f"{self.path.rstrip('/')}/{name}")
            size += n
        return [Files(g) for g in groups if g] or [Files([])]

    def passes(self, head: dict[str, str]) -> bool:
        for name, values in self.wanted:
            value = head.get(HEADERS[name].lower())
            if value is None or values is not None and value not in values:
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in SCHEMA]
        held = 0

        def batch() -> pa.RecordBatch:
            kinds = [pa.string()] * len(HEADERS) + [pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=SCHEMA.names)

        for path in partition.paths:
            system, name = open_path(path)
            with system.open_input_file(name) as stream:
                member = Member(stream)
                while member.start():
                    lines = member.until(b"\r\n\r\n").decode("utf-8", "surrogatepass").split("\r\n")
                    head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
                    if not self.passes(head):
                        member.skip()
                        continue
                    left = int(head["content-length"])
                    if head.get("warc-type") == "response":
                        http = member.until(b"\r\n\r\n")
                        left -= len(http) + 4
                    payload = member.take(left) if self.payload else None
                    member.skip()
                    for c, h in zip(columns, HEADERS.values(), strict=False):
                        c.append(head.get(h.lower()))
                    columns[-2].append(left)
                    columns[-1].append(payload)
                    held += 1000 + (left if self.payload else 0)
                    if held >= BATCH_BYTES:
                        yield batch()
                        columns, held = [[] for _ in SCHEMA], 0
        if columns[0]:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.target = int(options.get("fileBytes", str(1 << 30)))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = open_path(self.path)
        system.create_dir(root, recursive=True)
        files: list[tuple[str, int]] = []
        out = None
        for batch in iterator:
            names = batch.schema.names
            heads = [(h, batch.column(names.index(c)).to_pylist()) for c, h in HEADERS.items() if c in names]
            payloads = batch.column(names.index("payload"))
            for i in range(batch.num_rows):
                if out is None:
                    name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                data = record({h: v[i] for h, v in heads}, payloads[i].as_py() or b"")
                out.write(data)
                size += len(data)
                if size >= self.target:
                    out.close()
                    files.append((name, size))
                    out = None
        if out:
            out.close()
            files.append((name, size))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = open_path(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing to undo: without a manifest nothing is read."""


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def base32(hex_digest):
    """Bare upper-case base32 of a SHA-1 in hex, as a column expression."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def archive_pages(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, file_bytes: int = 1 << 30) -> None:
    """Add a record per row to the archives at ``path``: ``response``, or ``revisit`` of the row with the smallest key among equal payloads.

    Payloads smaller than ``least_bytes`` are all responses.  Null html is an empty payload.  Equality is that of SHA-1
    and length.  Rows that repeat the smallest key of a group are all responses; rows with a null key are responses if
    their group has no other key, else revisits.  The smallest key for each payload that occurs more than once is
    stored first, so Spark knows its size when it chooses how to join it; payloads themselves are never grouped.  Pages
    that are written later don't refer to earlier ones.  Archives end at about ``file_bytes``.
    """
    register(pages.sparkSession)
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("target_uri"), F.encode(body, "UTF-8").alias("payload"))
    rows = rows.withColumn("_sha1", F.sha1("payload")).withColumn("_n", F.octet_length("payload").cast("long"))
    first = stored(
        rows.where(F.col("_n") >= least_bytes).groupBy("_sha1", "_n").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_copies")).where("_copies > 1").drop("_copies"),
        "payloads",
    )
    revisit = F.col("_first").isNotNull() & ~F.col("_key").eqNullSafe(F.col("_first"))
    out = rows.join(first, ["_sha1", "_n"], "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("|", F.col("_key").cast("string"), "_sha1", "target_uri")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">")).alias("record_id"),
        "target_uri",
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.concat(F.lit("sha1:"), base32(F.col("_sha1"))).alias("payload_digest"),
        F.when(revisit, F.col("_first").cast("string")).alias("refers_to"),
        F.col("_key").cast("string").alias("source_id"),
        F.col("_n").cast("string").alias("full_bytes"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    out.write.format("warc").option("fileBytes", str(file_bytes)).mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame, key: str = "page_id", least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared storage, read them back, and return the digest columns by page.

    A response's digest and length are taken from the payload read back, a revisit's from its headers.
    """
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    archive_pages(pages, path, key, least_bytes=least_bytes)
    back = read_archives(spark, path)
    kind = dict(pages.dtypes)[key]
    is_response = F.col("record_type") == "response"
    return back.select(
        F.col("source_id").cast(kind).alias(key),
        F.when(is_response, F.col("payload_bytes")).otherwise(F.col("full_bytes").cast("long")).alias("payload_bytes"),
        F.when(is_response, base32(F.sha1("payload"))).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
