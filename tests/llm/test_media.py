import hashlib
import io
import tarfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arkloom.llm import media, queries
from arkloom.llm.store import open_store, work_dir


def payload_of(text):
    raw = (text or "").encode()
    return raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))


def check(rows, texts):
    assert len(rows) == len(texts)
    seen = {}
    for r, text in zip(rows, texts, strict=True):
        p = payload_of(text)
        assert (r["n_bytes"], r["payload_bytes"]) == (len((text or "").encode()), len(p))
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-32:])
        assert (r["width"], r["height"]) == (576, len(p) // 576)
        same = (r["media_bytes"], r["media_sha256"], r["feature"])
        assert seen.setdefault(p, same) == same


def test_query(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.QUERIES["op6_media_columns"](spark, data).collect()
    check(rows, [texts[r["doc_id"]] for r in rows])


def test_shards_are_tar_files_of_images(spark):
    texts = ["one", " ".join(str(i * i) for i in range(900)), "one", ""] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    folder = work_dir(spark, "media-test")
    rows = media.write_shards(docs, folder, shard=2500).collect()
    assert len({r["shard"] for r in rows}) > 1 and len({(r["shard"], r["offset"]) for r in rows}) < len(rows)
    store, path = open_store(folder)
    for shard in {r["shard"] for r in rows}:
        with store.open_input_file(f"{path}/{shard}") as f:
            tar = tarfile.open(fileobj=io.BytesIO(f.read()))
        members = {m.name: tar.extractfile(m).read() for m in tar.getmembers()}
        for r in (r for r in rows if r["shard"] == shard):
            image = members[f"{r['digest']}.png"]
            assert len(image) == r["length"] and media.from_png(image) == payload_of(texts[r["doc_id"]])


def test_damage_is_found():
    image = media.to_png(payload_of("text"))
    assert media.png_header(image[:33]) == (576, 1, 8)
    with pytest.raises(ValueError):
        media.from_png(image[:50] + bytes([image[50] ^ 1]) + image[51:])
    with pytest.raises(ValueError):
        media.png_header(b"GIF89a" + image[6:33])


def test_edges(spark, odd_docs, no_docs):
    rows = media.media_columns(odd_docs).orderBy("doc_id", "n_bytes").collect()
    want = odd_docs.orderBy("doc_id", F.octet_length(F.coalesce("text", F.lit("")))).collect()
    check(rows, [r["text"] for r in want])
    assert media.media_columns(no_docs).count() == 0


def test_features():
    assert media.features(np.array([0, 255], np.uint8)) == "127.500,127.500,1.0000,0.5000"
