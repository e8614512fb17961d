"""Media columns: content-addressed payloads in tar shards.

A text's UTF-8 bytes, padded with 255 to whole lines of WIDTH samples, are the
samples of an 8-bit grey PNG image.  A task appends the images that it makes to
tar shards of its own, each under the name of its digest and once a shard, so
that copies in one task share an entry.  Rows carry digest, shard, offset and
length.  A second pass, by shard, fills the metadata columns from range reads of
the 33 bytes that hold an image's header, then decodes the stored image and
computes its features.  A shard of a task that was lost is in no row.

Defined results: null and empty texts are one line of padding; equal texts have
equal images; repeated rows and null doc_ids are rows like others; a text of any
length is one image; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, lean, open_store, work_dir

WIDTH = 576
SHARD = 64 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEAD = 33


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(raw: bytes, width: int = WIDTH) -> bytes:
    lines = max(1, -(-len(raw) // width))
    return raw + b"\xff" * (lines * width - len(raw))


def to_png(payload: bytes, width: int = WIDTH) -> bytes:
    """An 8-bit grey image, a line for each ``width`` samples, filter 0."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 5)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from an image's first HEAD bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return (*struct.unpack(">II", head[16:24]), head[24])


def from_png(image: bytes) -> bytes:
    """The samples of an image made by to_png; checks every chunk."""
    width, height, _ = png_header(image[:HEAD])
    at, data = 8, []
    while at < len(image):
        n = struct.unpack(">I", image[at : at + 4])[0]
        body = image[at + 4 : at + 8 + n]
        if zlib.crc32(body) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("PNG chunk does not match its checksum")
        if body[:4] == b"IDAT":
            data.append(body[4:])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("unknown PNG filter")
    return lines[:, 1:].tobytes()


@lean
def _write(batches: Iterator[pa.RecordBatch], folder: str, most: int) -> Iterator[pa.RecordBatch]:
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    out, shard, at, known = None, "", 0, {}
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            payload = padded(raw)
            digest = hashlib.sha256(payload).hexdigest()
            if digest not in known:
                image = to_png(payload)
                if out is not None and at + len(image) > most:
                    out.write(bytes(1024))
                    out.close()
                    out = None
                if out is None:
                    shard, at, known = f"{uuid.uuid4().hex}.tar", 0, {}
                    out = store.open_output_stream(f"{path}/{shard}", compression=None)
                info = tarfile.TarInfo(f"{digest}.png")
                info.size = len(image)
                head = info.tobuf(tarfile.PAX_FORMAT)
                out.write(head + image + bytes(-len(image) % 512))
                known[digest] = (shard, at + len(head), len(image))
                at += len(head) + len(image) + -len(image) % 512
            rows.append((doc_id, len(raw), digest, *known[digest]))
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
    if out is not None:
        out.write(bytes(1024))
        out.close()


def write_shards(docs: DataFrame, folder: str, shard: int = SHARD) -> DataFrame:
    """(doc_id, n_bytes, digest, shard, offset, length); the shards are below ``folder``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = docs.mapInArrow(lambda it: _write(it, folder, shard), "doc_id long, n_bytes long, digest string, shard string, offset long, length long")
    return cut(rows, "shards")


def features(samples: np.ndarray) -> str:
    """Mean, deviation, entropy and share of padding of an image's samples."""
    counts = np.bincount(samples, minlength=256)
    share = counts / counts.sum()
    entropy = -(share[counts > 0] * np.log2(share[counts > 0])).sum()
    mean = (share * np.arange(256)).sum()
    return f"{mean:.3f},{np.sqrt(max(0.0, (share * (np.arange(256) - mean) ** 2).sum())):.3f},{entropy:.4f},{share[255]:.4f}"


@lean
def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    from functools import lru_cache

    store, path = open_store(folder)
    name = file = None

    @lru_cache(maxsize=256)
    def entry(shard: str, offset: int, length: int) -> tuple:
        width, height, bits = png_header(file.read_at(HEAD, offset))
        image = file.read_at(length, offset)
        payload = from_png(image)
        facts = features(np.frombuffer(payload, np.uint8))
        return (
            len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), length, hashlib.sha256(image).hexdigest(),
            f"{width}x{height}x{bits}:{facts}", width, height,
        )

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"]
    for batch in batches:
        if not batch.num_rows:
            continue
        found = []
        for digest, shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")), strict=True):
            if shard != name:
                if file is not None:
                    file.close()
                name, file = shard, store.open_input_file(f"{path}/{shard}")
            got = entry(shard, offset, length)
            if got[1] != digest:
                raise ValueError(f"{shard} at {offset}: payload does not match its digest")
            found.append(got)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", *names]
        )


def read_shards(rows: DataFrame, folder: str) -> DataFrame:
    """Metadata, digests and features of the stored images, read back in the order of the shards."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"
    # A shard is dealt out in pieces of some MB, so a large one is read by many tasks.
    piece = F.col("offset").bitwiseAND(~((4 << 20) - 1))
    return rows.withColumn("piece", piece).repartition("shard", "piece").sortWithinPartitions("shard", "offset").mapInArrow(lambda it: _read(it, folder), schema)


def media_columns(docs: DataFrame) -> DataFrame:
    folder = work_dir(docs.sparkSession, "media")
    return read_shards(write_shards(docs, folder), folder)
