"""WARC archives as a PySpark data source, for writing and reading.

Reading plans partitions from file sizes (small files together, PARTITION_BYTES each), takes predicates on record_type
and other header columns as pushed filters, parses a record's headers first and passes over the block of records that
are not wanted: uncompressed blocks by a seek, compressed ones without being kept or decoded.  With option
payload=false no block is decoded at all.

Writing makes files of about FILE_BYTES, one gzip member per record (option compress=false: none).  A task's files count
only once the commit lists them in the manifest, so retried and speculative tasks leave no records twice.  Paths go
through pyarrow's file systems (file, hdfs, s3, gs), at a place that driver and executors share.
"""

from __future__ import annotations

import contextlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .common import column, new_path

MANIFEST = "_MANIFEST"
FILE_BYTES = 64_000_000
PARTITION_BYTES = 32_000_000
BATCH_BYTES = 4_000_000
LEAST_SHARED = 100
BROADCAST_DIGESTS = 300_000

SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("record_type", "record_id", "target_uri", "date", "payload_digest", "refers_to")]
    + [T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("payload", T.BinaryType())]
)
#: Columns that are one header each; predicates on them are decided before a block is read.
HEADER_OF = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in headers if v is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""])
    return head.encode() + block + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


class _Stream:
    """The bytes of an archive, inflated where gzip members stand; skip() keeps nothing."""

    def __init__(self, raw: io.RawIOBase | pa.NativeFile, packed: bool):
        self.raw, self.packed, self.held, self.over = raw, packed, bytearray(), False
        self.inflate = zlib.decompressobj(31) if packed else None
        self.rest = b""

    def _more(self) -> bool:
        if not self.packed:
            data = self.raw.read(1 << 16)
            self.held += data
            return bool(data)
        while True:
            data = self.rest or self.raw.read(1 << 16)
            self.rest = b""
            if not data:
                return False
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            got = self.inflate.decompress(data)
            self.rest = self.inflate.unused_data
            if got:
                self.held += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark))
            if not self._more():
                return None
        out = bytes(self.held[:found])
        del self.held[: found + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def skip(self, n: int) -> None:
        while n:
            if not self.held:
                if not self.packed:
                    self.raw.seek(self.raw.tell() + n)
                    return
                if not self._more():
                    return
            step = min(n, len(self.held))
            del self.held[:step]
            n -= step


def records(raw: io.RawIOBase | pa.NativeFile, packed: bool, wanted: dict[str, frozenset[str]], payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload) of the records whose headers pass wanted; of HTTP messages the payload is the body."""
    stream = _Stream(raw, packed)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        headers = parse_headers(head.lstrip(b"\r\n"))
        if "content-length" not in headers:
            raise ValueError("not a WARC record: no Content-Length")
        n = int(headers["content-length"])
        keep = all(headers.get(k) in v for k, v in wanted.items())
        body = None
        if keep and payload:
            body = stream.take(n)
            if len(body) < n:
                raise ValueError("the archive ends inside a record")
            if headers.get("content-type", "").startswith("application/http"):
                body = body.partition(b"\r\n\r\n")[2]
        else:
            stream.skip(n)
        stream.skip(4)
        if keep:
            yield headers, body


@dataclass
class Files(InputPartition):
    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.payload = options["path"], options.get("payload", "true") != "false"
        self.wanted: dict[str, frozenset[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            values = frozenset([f.value] if isinstance(f, EqualTo) else f.value) if name in HEADER_OF else frozenset()
            if values and all(isinstance(v, str) for v in values):
                key = HEADER_OF[name]
                self.wanted[key] = self.wanted.get(key, values) & values
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, root = open_fs(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.File:
            return [Files([root])]
        if store.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            with store.open_input_stream(f"{root}/{MANIFEST}") as f:
                listed = [line.split("\t") for line in f.read().decode().splitlines()]
            sizes = [(f"{root}/{name}", int(size)) for name, size in listed]
        else:
            sizes = [(x.path, x.size) for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.path.endswith((".warc", ".warc.gz"))]
        out: list[Files] = []
        room = 0
        for name, size in sorted(sizes):
            if size > room:
                out.append(Files([]))
                room = PARTITION_BYTES
            out[-1].names.append(name)
            room -= size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = open_fs(self.path)
        rows: list[tuple] = []
        size = 0
        for name in partition.names:
            with store.open_input_file(name) as f:
                for h, body in records(f, name.endswith(".gz"), self.wanted, self.payload):
                    rows.append((*(h.get(k) for k in HEADER_OF.values()), list(h.items()), body))
                    size += 500 + len(body or b"")
                    if size > BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * len(HEADER_OF) + [pa.map_(pa.string(), pa.string()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=SCHEMA.names)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceWriter):
    """Takes rows with column `record`: the finished record (record_bytes)."""

    def __init__(self, options: dict[str, str]):
        self.path, self.packed = options["path"], options.get("compress", "true") != "false"

    def write(self, iterator: Iterator) -> Written:
        store, root = open_fs(self.path)
        store.create_dir(root, recursive=True)
        done: list[tuple[str, int]] = []
        out = None
        size = 0
        try:
            for row in iterator:
                if out is None:
                    name, size = f"part-{uuid.uuid4().hex}.warc{'.gz' * self.packed}", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)  # else the name alone would compress again
                data = bytes(row["record"])
                if self.packed:
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = z.compress(data) + z.flush()
                out.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    out.close()
                    done.append((name, size))
                    out = None
        finally:
            if out is not None:
                out.close()
        if out is not None:
            done.append((name, size))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = open_fs(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write("".join(f"{name}\t{size}\n" for m in messages if m for name, size in m.files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = open_fs(self.path)
        for name, _ in (x for m in messages if m for x in m.files):
            with contextlib.suppress(FileNotFoundError):
                store.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes format("warc") known and lets filters reach Python readers."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def record_id(page_id: int | str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def write_pages(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Archives pages under path: equal payloads of LEAST_SHARED bytes or more once, as the response of the smallest page_id,
    the others as revisits of it.

    Null html is the empty payload; a null url leaves out the target header.  A null page_id is never the smallest; where
    all ids of equal payloads are null, or where rows repeat the smallest id, each of those rows is a response.  Page ids
    of revisits can be any number: only digests and ids are grouped, and html is shuffled only if there are over
    BROADCAST_DIGESTS repeated digests (a row is some 100 bytes, counted first)."""
    spark = pages.sparkSession
    register(spark)
    source = pages.select(column(page_id).alias("page_id"), column(url).alias("url"), F.coalesce(column(html), F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    shared = source.filter(F.octet_length("html") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select(F.col("digest").alias("again"), "first")
    shared = shared.hint("broadcast") if shared.count() <= BROADCAST_DIGESTS else shared
    made = source.join(shared, source["digest"] == shared["again"], "left").select("page_id", "url", "html", "digest", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("first"))
    now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                out = []
                for r in whole.slice(at, 256).to_pylist():
                    data, revisit = r["html"].encode(), r["first"] is not None
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n\r\n".encode()
                    uri = None if r["url"] is None else "".join(r["url"].splitlines())
                    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(r["page_id"])), ("WARC-Date", now), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{r['digest']}"), ("Content-Type", "application/http; msgtype=response")]
                    headers += [("X-Page-ID", None if r["page_id"] is None else str(r["page_id"]))]
                    if revisit:
                        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(r["first"])), ("X-Refers-To-Page-ID", str(r["first"]))]
                    out.append(record_bytes(headers, http if revisit else http + data))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    made.mapInArrow(run, "record binary").write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str, id_type: T.DataType | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: digests and sizes come from the payloads read back,
    a revisit's from the response it refers to."""
    register(spark)
    kind = id_type or T.LongType()
    read = spark.read.format("warc").load
    payload = read(path).filter(F.col("record_type") == "response")
    own = payload.select("record_id", F.col("headers")["x-page-id"].cast(kind).alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    again = spark.read.format("warc").option("payload", "false").load(path).filter(F.col("record_type") == "revisit")
    again = again.select(F.col("headers")["x-page-id"].cast(kind).alias("page_id"), F.col("refers_to").alias("to"), F.col("headers")["x-refers-to-page-id"].cast(kind).alias("refers_to"))
    answered = again.join(own.drop("page_id").dropDuplicates(["record_id"]), F.col("to") == F.col("record_id"), "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    first = own.withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast(kind)).select(columns)
    return first.unionByName(answered.withColumn("record_type", F.lit("revisit")).select(columns))


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the archives to the shared folder and reads them back."""
    spark = pages.sparkSession
    write_pages(pages, path := new_path(spark, "warc"), page_id, url, html)
    return read_pages(spark, path, pages.schema[page_id].dataType)
