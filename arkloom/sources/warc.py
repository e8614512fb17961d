"""WARC files: a byte parser, and Spark's ``warc`` data source and sink.

    spark.dataSource.register(WarcDataSource)
    spark.read.format("warc").load("hdfs-mounted/path/*.warc.gz")
    df.write.format("warc").option("compression", "gzip").save(path)

Options of the reader: ``includeContent`` (true) reads no content if false,
``mode`` says what a truncated record does: DROPREST of the file, or FAILFAST.
Only the columns of a given schema are made, so one without ``content`` skips it.
Plain files are cut into record-aligned ranges of ``rangeBytes``; compressed ones
are one partition each.  ``warc_type`` equality is pushed into the reader.
"""

from __future__ import annotations

import bz2
import contextlib
import ctypes
import glob
import gzip
import io
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

VERSIONS = (b"WARC/1.0", b"WARC/0.18")
SCHEMA = "warcRecordId string, contentLength int, date string, warc_type string, optionalHeaderFlds map<string,string>, content binary"
_COLUMNS = ("warcRecordId", "contentLength", "date", "warc_type", "optionalHeaderFlds", "content")
_MANDATORY = ("warc-record-id", "content-length", "warc-date", "warc-type")
RANGE = 64 << 20
#: Records pass between Python and the JVM in batches of about so many bytes, and of so many records at most.
BATCH_BYTES = 1 << 20
BATCH_ROWS = 256


class TruncatedRecord(ValueError):
    """A record that ends before its content does, or has no valid length."""


def read_records(f: io.BufferedIOBase, content: bool = True, mode: str = "DROPREST", stop: int | None = None) -> Iterator[tuple]:
    """Records from where ``f`` stands on, up to the last that begins before ``stop``.

    Lines that begin no record are skipped; a header is split at its first colon,
    its name taken in lower case, and the last of a repeated header counts.
    Content is skipped by its length even when it isn't wanted, so a line of it
    that looks like a record is none.
    """
    while True:
        at = f.tell() if stop is not None else 0
        line = f.readline()
        if not line or (stop is not None and at >= stop):
            return
        if not line.startswith(VERSIONS):
            continue
        heads: dict[str, str] = {}
        for raw in iter(f.readline, b""):
            raw = raw.rstrip(b"\r\n")
            if not raw:
                break
            key, colon, value = raw.decode("utf-8", "replace").partition(":")
            if colon:
                heads[key.strip().lower()] = value.strip()
        length = heads.get("content-length", "")
        body = b""
        if not length.isdigit():
            if mode == "FAILFAST":
                raise TruncatedRecord("record without a valid Content-Length")
            return
        n = int(length)
        if content or not f.seekable():
            body = f.read(n)
            short = len(body) < n
        else:
            here = f.tell()
            f.seek(n - 1, io.SEEK_CUR) if n else None
            short = bool(n) and not f.read(1)
            if short:
                f.seek(here)
        if short:
            if mode == "FAILFAST":
                raise TruncatedRecord(f"record of {n} bytes is cut off")
            return
        rest = {k: v for k, v in heads.items() if k not in _MANDATORY}
        yield heads.get("warc-record-id"), n, heads.get("warc-date"), heads.get("warc-type"), rest, body if content else None


def batches_of(records: Iterator[tuple], names: tuple[str, ...] = _COLUMNS) -> Iterator:
    """Arrow batches of these columns of records, so small that a worker's memory depends on its largest record only."""
    import pyarrow as pa

    kinds = {"contentLength": pa.int32(), "optionalHeaderFlds": pa.map_(pa.string(), pa.string()), "content": pa.binary()}
    kinds = [kinds.get(n, pa.string()) for n in names]
    at = [_COLUMNS.index(n) for n in names]

    def batch() -> pa.RecordBatch:
        columns = ([list(r[i].items()) if isinstance(r[i], dict) else r[i] for r in rows] for i in at)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))

    rows, size = [], 0
    for r in records:
        rows.append(r)
        size += len(r[5] or b"") + sum(len(v) for v in r[4].values())
        if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def _trim() -> None:
    """Gives back what this worker's allocators keep of memory freed already; idle workers stay."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def open_any(path: str) -> io.BufferedIOBase:
    """The file's bytes, decompressed if they begin as gzip (of any number of members) or bzip2 does."""
    f = open(path, "rb")  # noqa: SIM115
    magic = f.read(3)
    f.seek(0)
    if magic[:2] == b"\x1f\x8b":
        return io.BufferedReader(gzip.GzipFile(fileobj=f), 1 << 16)
    if magic == b"BZh":
        return io.BufferedReader(bz2.BZ2File(f), 1 << 16)
    return f


def write_record(f, record_id: str | None, date: str | None, kind: str | None, heads: dict[str, str] | None, content: bytes | None) -> None:
    """One WARC/1.0 record; its length is the content's, in bytes."""
    body = bytes(content or b"")
    lines = [b"WARC/1.0", f"WARC-Record-ID: {record_id or ''}".encode(), f"Content-Length: {len(body)}".encode(), f"WARC-Date: {date or ''}".encode(), f"WARC-Type: {kind or ''}".encode()]
    lines += [f"{k}: {v}".encode() for k, v in (heads or {}).items()]
    f.write(b"\r\n".join(lines) + b"\r\n\r\n" + body + b"\r\n\r\n")


def files_of(path: str) -> list[str]:
    path = path.removeprefix("file://").removeprefix("file:")
    found = [path] if os.path.isfile(path) else sorted(glob.glob(f"{path}/**", recursive=True) if os.path.isdir(path) else glob.glob(path))
    return [p for p in found if os.path.isfile(p) and not os.path.basename(p).startswith(("_", "."))]


@dataclass
class WarcRange(InputPartition):
    path: str
    start: int
    stop: int | None


class WarcReader(DataSourceReader):
    def __init__(self, options, names: tuple[str, ...] = _COLUMNS):
        self.names = names
        self.content = str(options.get("includeContent", "true")).lower() == "true" and "content" in names
        self.mode = str(options.get("mode", "DROPREST")).upper()
        self.range = int(options.get("rangeBytes", RANGE))
        self.files = files_of(options["path"])
        self.kinds: list[str] = []

    def partitions(self):
        out = []
        for path in self.files:
            size = os.path.getsize(path)
            with open(path, "rb") as f:
                magic = f.read(3)
            packed = magic[:2] == b"\x1f\x8b" or magic == b"BZh"
            if packed or size <= self.range:
                out.append(WarcRange(path, 0, None))
            else:
                out += self._cut(path, size)
        return out

    def _cut(self, path: str, size: int) -> list[WarcRange]:
        """Ranges that begin with records: headers are followed from record to record, content is sought over."""
        starts, goal = [0], self.range
        with open(path, "rb") as f:
            for _ in read_records(f, content=False, stop=size):
                at = f.tell()
                if goal <= at < size:
                    starts.append(at)
                    goal = at + self.range
        return [WarcRange(path, a, b) for a, b in zip(starts, [*starts[1:], size], strict=True)]

    def read(self, partition):
        with open_any(partition.path) as f:
            if partition.start:
                f.seek(partition.start)
            records = read_records(f, self.content, self.mode, partition.stop)
            yield from batches_of((r for r in records if all(r[3] == k for k in self.kinds)), self.names)
        _trim()


class PushingWarcReader(WarcReader):
    """Takes in filters on the type; Spark lets a reader do so only where it is configured to."""

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("warc_type",):
                self.kinds.append(f.value)
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class WarcWriter(DataSourceArrowWriter):
    """One file a task, written under another name and moved into place when the job commits.

    Of a batch, one record at a time is made a Python object.
    """

    def __init__(self, options, schema: StructType, overwrite: bool):
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        self.gzip = options.get("compression", "none") == "gzip" or self.path.endswith(".gz")
        self.names = schema.names
        if os.path.exists(self.path) and not overwrite and os.listdir(self.path):
            raise FileExistsError(f"{self.path} exists")
        self.old = files_of(self.path) if overwrite and os.path.isdir(self.path) else []

    def write(self, iterator):
        os.makedirs(self.path, exist_ok=True)
        name = f"{self.path}/_part-{uuid.uuid4().hex}.warc" + (".gz" if self.gzip else "")
        f = None
        for batch in iterator:
            columns = dict(zip(self.names, batch.columns, strict=True))
            for i in range(batch.num_rows):
                if f is None:
                    f = open(name, "wb")  # noqa: SIM115
                get = lambda k: columns[k][i].as_py() if k in columns else None  # noqa: E731, B023
                content, heads = get("content"), get("optionalHeaderFlds")
                content = content.encode() if isinstance(content, str) else content
                record = get("warcRecordId"), get("date"), get("warc_type"), dict(heads or ()), content
                if self.gzip:
                    with gzip.GzipFile(fileobj=f, mode="wb") as member:
                        write_record(member, *record)
                else:
                    write_record(f, *record)
        if f is not None:
            f.close()
        _trim()
        return Written(name if f is not None else None)

    def commit(self, messages):
        for path in self.old:
            os.remove(path)
        for m in messages:
            if m is not None and m.path:
                folder, name = os.path.split(m.path)
                os.rename(m.path, f"{folder}/{name[1:]}")

    def abort(self, messages):
        for m in messages:
            if m is not None and m.path and os.path.exists(m.path):
                os.remove(m.path)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        pushing = str(self.options.get("pushFilters", "false")).lower() == "true"
        return (PushingWarcReader if pushing else WarcReader)(self.options, tuple(schema.names))

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, schema, overwrite)


def _parse_files(batches, content: bool, mode: str):
    for batch in batches:
        for raw in batch.column(0):
            data = raw.as_py()
            data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else bz2.decompress(data) if data[:3] == b"BZh" else data
            yield from batches_of(read_records(io.BytesIO(data), content, mode))


def read_warc(spark, path: str, columns: list[str] | None = None, **options):
    """Records of the WARC files at ``path``: by the data source where it is a mounted folder, else by Spark's file reader.

    With ``columns`` only these are made.
    """
    scheme = path.partition("://")[0] if "://" in path else ""
    if scheme in ("", "file"):
        spark.dataSource.register(WarcDataSource)
        pushing = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
        reader = spark.read.format("warc").options(**{"pushFilters": pushing} | options)
        if columns:
            kinds = {c.strip().split(" ")[0]: c for c in SCHEMA.replace("string,string", "string;string").split(",")}
            reader = reader.schema(",".join(kinds[c].replace(";", ",") for c in columns))
        return reader.load(path)
    content, mode = str(options.get("includeContent", "true")).lower() == "true", str(options.get("mode", "DROPREST")).upper()
    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(lambda it: _parse_files(it, content, mode), SCHEMA)
    return rows.select(*columns) if columns else rows


@contextlib.contextmanager
def small_batches(spark):
    """Rows go to Python in batches of at most BATCH_ROWS and BATCH_BYTES meanwhile; lower settings stay."""
    conf, before = spark.conf, {}
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        before[name] = conf.get(name, None)
        now = (before[name] or "").removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(name, str(most))
    try:
        yield
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def write_warc(df, path: str, mode: str = "append", **options) -> None:
    """Writes (warcRecordId, date, warc_type[, optionalHeaderFlds], content); a folder with files in it is an error unless overwritten."""
    df.sparkSession.dataSource.register(WarcDataSource)
    with small_batches(df.sparkSession):
        df.write.format("warc").options(**options).mode(mode).save(path)
