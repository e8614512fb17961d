"""WARC archives written from pages and read back by boundary-chain verification.

Writing: of records with equal payloads the one with the smallest page_id is a
response, others revisit it.  That is settled on thin rows (page_id, digest); the
pages join it by their own key, so a payload shared by a third of all pages is in
no one's hands, and payloads that more than HOT pages share, of which there can't be
many, are joined apart.  Each task writes archives of at most ARCHIVE bytes, one gzip
member a record (or plain records).

Reading: archives are cut into byte ranges.  The task of a range looks for record
magic in it and emits, for each place that parses as a record, the offset and
that of its successor, where the record ends.  Magic inside payloads yields such
places too.  Pointer jumping from the start of the file keeps what the chain of
records reaches, and only this is read.  The chain of a file is followed in one
task; its length is bounded by ARCHIVE.  A chain that does not end where the file
does is an error: nothing is lost without a word.  Records are then read in as many
tasks as there are ranges.  Headers have no bound; one ends at an empty line, and a
line without a colon rules it out.  A record is held in memory as a whole.

Defined results: a null html is an empty payload; a null page_id is a record
without page id, after all others in order; of repeated rows (same page_id and
html, and if their URLs differ any of these) one is the response and the others
revisit it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded, cut, lean, open_store, work_dir

ARCHIVE = 128 << 20
RANGE = 8 << 20
VERSION = b"WARC/1.0\r\n"
GZIP = b"\x1f\x8b\x08"
GAP = b"\r\n\r\n"
#: Payloads of more pages than this are at most one in so many pages.
HOT = 100_000


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, n: int, refers: int | None, revisit: bool) -> bytes:
    """A WARC record; a revisit has no block."""
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').encode('unicode_escape').decode()}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {n}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers is None else refers}>"]
        payload = b""
    lines += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


class Blocks:
    """The bytes of a file, read in blocks; the last few stay in memory."""

    SIZE = 1 << 20

    def __init__(self, file, size: int):
        self.file, self.size, self.held = file, size, {}

    def block(self, i: int) -> bytes:
        if i not in self.held:
            if len(self.held) > 7:
                self.held.pop(next(iter(self.held)))
            self.held[i] = self.file.read_at(max(0, min(self.SIZE, self.size - i * self.SIZE)), i * self.SIZE)
        return self.held[i]

    def get(self, a: int, b: int) -> bytes:
        a, b = max(a, 0), min(b, self.size)
        return b"".join(self.block(i)[max(a - i * self.SIZE, 0) : b - i * self.SIZE] for i in range(a // self.SIZE, -(-b // self.SIZE))) if a < b else b""

    def find(self, what: bytes, a: int, b: int) -> int:
        """The first place in [a, b) where ``what`` begins, or -1."""
        while a < b:
            # Up to the block's end, and on for what may begin in its last bytes.
            stop = min(b, (a // self.SIZE + 1) * self.SIZE)
            at = self.get(a, stop + len(what) - 1).find(what)
            if at >= 0:
                return a + at
            a = stop
        return -1


def parse(data: Blocks, at: int = 0) -> tuple[dict[str, str], int, int] | None:
    """(headers, block start, record end) of a plain record at ``at``, or None."""
    if data.get(at, at + len(VERSION)) != VERSION:
        return None
    heads, at = {}, at + len(VERSION)
    while True:
        stop = data.find(b"\r\n", at, data.size)
        if stop < 0:
            return None
        if stop == at:
            break
        key, colon, value = data.get(at, stop).decode("utf-8", "replace").partition(":")
        if not colon:
            return None
        heads[key.strip().lower()] = value.strip()
        at = stop + 2
    length = heads.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None
    end = at + 2 + int(length) + len(GAP)
    return (heads, at + 2, end) if data.get(end - len(GAP), end) == GAP else None


class Held:
    """A file that is in memory."""

    def __init__(self, raw: bytes):
        self.raw = raw

    def read_at(self, n: int, at: int) -> bytes:
        return self.raw[at : at + n]


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@lean
def _write(batches: Iterator[pa.RecordBatch], folder: str, most: int, gzipped: bool) -> Iterator[pa.RecordBatch]:
    out, name, size, done = None, "", 0, []
    store = path = None
    for batch in batches:
        if store is None:
            store, path = open_store(folder)
            store.create_dir(path, recursive=True)
        for page_id, url, html, n, sha, refers, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "n", "sha", "first_id", "revisit")), strict=True):
            payload = (html or "").encode("utf-8", "surrogatepass")
            raw = record(page_id, url, payload, base64.b32encode(bytes.fromhex(sha)).decode(), n, refers, revisit)
            if gzipped:
                z = zlib.compressobj(4, zlib.DEFLATED, 31)
                raw = z.compress(raw) + z.flush()
            if out is not None and size + len(raw) > most:
                out.close()
                done.append((name, size))
                out = None
            if out is None:
                name, size = f"{uuid.uuid4().hex}.warc" + (".gz" if gzipped else ""), 0
                out = store.open_output_stream(f"{path}/{name}", compression=None)
            out.write(raw)
            size += len(raw)
    if out is not None:
        out.close()
        done.append((name, size))
    yield pa.RecordBatch.from_pydict({"file": [n for n, _ in done], "bytes": [s for _, s in done]}, pa.schema([("file", pa.string()), ("bytes", pa.int64())]))


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, n, sha, first_id, revisit): what is to be written; html is null for revisits."""
    own = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select("page_id", "url", own.alias("html"), F.octet_length(own).cast("long").alias("n"), F.sha1(own.cast("binary")).alias("sha"))
    # Repeated rows are counted here, so they need not meet below.
    thin = pages.where(F.col("n") >= min_bytes).groupBy("page_id", "sha").agg(F.count(F.lit(1)).alias("copies"))
    thin = cut(thin, "payloads")
    firsts = cut(thin.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("pages")), "firsts")
    owned = thin.join(firsts.where(F.col("pages") <= HOT), "sha").unionByName(thin.join(bounded(firsts.where(F.col("pages") > HOT)), "sha"))
    owned = owned.select(F.col("page_id").alias("pid"), F.col("sha").alias("psha"), "first_id", "copies")
    rows = pages.join(owned, pages["page_id"].eqNullSafe(owned["pid"]) & (pages["sha"] == owned["psha"]), "left")
    rows = rows.select("page_id", "url", "html", "n", "sha", "first_id", F.coalesce("copies", F.lit(1)).alias("copies"), F.col("copies").isNotNull().alias("shared"))
    first = F.col("page_id").eqNullSafe(F.col("first_id"))
    once = rows.where("copies = 1").withColumn("i", F.lit(1))
    if not thin.where("copies > 1").isEmpty():
        names = ("url", "html", "n", "first_id", "copies", "shared")
        many = rows.where("copies > 1").groupBy("page_id", "sha").agg(*[F.first(c).alias(c) for c in names])
        once = once.unionByName(many.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))
    revisit = F.col("shared") & ~(first & (F.col("i") == 1))
    return once.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "n", "sha", "first_id", revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive: int = ARCHIVE, gzipped: bool = True) -> DataFrame:
    """Writes (page_id, url, html) below ``folder``; returns (file, bytes) of the archives."""
    rows = records(pages, min_bytes)
    return cut(rows.mapInArrow(lambda it: _write(it, folder, archive, gzipped), "file string, bytes long"), "archives")


def member_end(data: Blocks, at: int) -> int | None:
    """Where the gzip member at ``at`` ends, if it is one and holds a record."""
    z, pos, head = zlib.decompressobj(31), at, b""
    try:
        while not z.eof:
            fed = z.unconsumed_tail
            if not fed:
                fed = data.get(pos, pos + (1 << 16))
                pos += len(fed)
                if not fed:
                    return None
            got = z.decompress(fed, 1 << 20)
            if len(head) < len(VERSION):
                head += got[: len(VERSION)]
                if not VERSION.startswith(head[: len(VERSION)]):
                    return None
    except zlib.error:
        return None
    return pos - len(z.unused_data) if head[: len(VERSION)] == VERSION else None


def candidates(store, path: str, start: int, end: int, size: int) -> Iterator[tuple[int, int]]:
    """(offset, successor) of places in [start, end) that parse as a record."""
    with store.open_input_file(path) as f:
        data = Blocks(f, size)
        gz = data.get(0, 2) == GZIP[:2]
        magic = GZIP if gz else VERSION
        at = data.find(magic, start, end)
        while at >= 0:
            if gz:
                after = member_end(data, at)
                if after is not None:
                    yield at, after
            elif at == 0 or data.get(at - len(GAP), at) == GAP:  # records end in an empty line
                found = parse(data, at)
                if found:
                    yield at, found[2]
            at = data.find(magic, at + 1, end)


CHAIN = "file string, at long, next long, bytes long"


@lean
def _scan(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """The candidates of each range, and of a file's first range also the file's end."""
    for batch in batches:
        store, path = open_store(folder)
        for file, start, end, size in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "end", "bytes")), strict=True):
            found = list(candidates(store, f"{path}/{file}", start, end, size)) + ([(size, size)] if start == 0 else [])
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            rows = [[file] * len(found), [a for a, _ in found], [b for _, b in found], [size] * len(found)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], ["file", "at", "next", "bytes"])


def reachable(at: np.ndarray, after: np.ndarray, start: int = 0) -> np.ndarray:
    """Mask of the sorted offsets ``at`` that the chain from ``start`` reaches.

    Pointer jumping: after round k every marked place has marked those up to 2**k
    records on, so a chain of n records takes log2(n) rounds.
    """
    n = len(at)
    jump = np.searchsorted(at, after)
    jump[(jump < n) & (at[np.minimum(jump, n - 1)] != after)] = n
    jump = np.append(jump, n)
    mark = np.append(at == start, False)
    while True:
        more = mark.copy()
        more[jump[mark]] = True
        more[n] = False
        if (more == mark).all():
            return mark[:n]
        mark, jump = more, jump[jump]


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of one file's chain; an error if it does not reach the file's end."""
    pdf = pdf.sort_values("at")
    at, size = pdf["at"].to_numpy(), int(pdf["bytes"].iloc[0])
    keep = reachable(at, pdf["next"].to_numpy())
    if not keep[-1] or at[-1] != size:
        last = pdf["next"].to_numpy()[keep].max(initial=0)
        raise ValueError(f"{pdf['file'].iloc[0]}: no record follows at {last}, and the file has {size} bytes")
    return pdf[keep & (at < size)]


@lean
def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, path = open_store(folder)
    name = f = None
    for batch in batches:
        rows = []
        for file, a, b in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "next")), strict=True):
            if file != name:
                if f is not None:
                    f.close()
                name, f = file, store.open_input_file(f"{path}/{file}")
            raw = f.read_at(b - a, a)
            if raw[:2] == GZIP[:2]:
                raw = zlib.decompress(raw, 31)
            heads, block, end = parse(Blocks(Held(raw), len(raw)))
            ident = heads["warc-record-id"].removeprefix("<urn:page:").rstrip(">")
            kind, digest, n, refers = heads["warc-type"], heads["warc-payload-digest"].removeprefix("sha1:"), int(heads["x-payload-length"]), None
            if kind == "response":
                payload = raw[block : end - len(GAP)]
                if digest32(payload) != digest or len(payload) != n:
                    raise ValueError(f"record {ident}: payload does not match its digest")
            else:
                refers = heads["warc-refers-to"].removeprefix("<urn:page:").rstrip(">")
            rows.append((int(ident) if ident else None, n, digest, kind, int(refers) if refers else None))
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    if f is not None:
        f.close()


def read_archives(archives: DataFrame, folder: str, span: int = RANGE) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records in archives (file, bytes)."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(span).cast("long"))
    ranges = archives.where("bytes > 0").select("file", "bytes", F.explode(starts).alias("start"))
    ranges = ranges.select("file", "bytes", "start", F.least(F.col("start") + span, "bytes").alias("end"))
    # Rows say little of the bytes behind them, so tasks are counted by ranges and Spark doesn't unite them.
    tasks = max(1, ranges.count())
    found = ranges.repartition(tasks, "file", "start").mapInArrow(lambda it: _scan(it, folder), CHAIN)
    kept = found.groupBy("file").applyInPandas(_chain, CHAIN)
    kept = kept.repartition(tasks, "file", F.floor(F.col("at") / span)).sortWithinPartitions("file", "at")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return kept.mapInArrow(lambda it: _read(it, folder), schema)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes the pages and reads the archives back."""
    folder = work_dir(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)
