import base64
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arkloom.llm import queries
from arkloom.llm import warc_archive as W
from arkloom.llm.store import open_store, work_dir


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(pages):
    first = {}
    for i, html in sorted(pages):
        first.setdefault(digest(html), i)
    return sorted((i, len((h or "").encode()), digest(h), "response" if first[digest(h)] == i else "revisit", None if first[digest(h)] == i else first[digest(h)]) for i, h in pages)


def test_query(spark, data):
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op8_warc_chain"](spark, data).collect())) == brute(pages)


MAGIC = W.record(99, "u", b"inner", digest("inner"), 5, None, False).decode()


@pytest.mark.parametrize("gzipped", [True, False])
@pytest.mark.parametrize("span", [1 << 23, 700])
def test_magic_inside_payloads(spark, gzipped, span):
    pages = [(i, (MAGIC * (1 + i % 3) + f"{i % 7}") if i % 2 else f"page {i % 5}\r\n\r\nWARC/1.0\r\n") for i in range(60)]
    df = spark.createDataFrame([(i, "http://x/\r\ny", h, 1) for i, h in pages], "page_id long, url string, html string, first_id int").repartition(2)
    folder = work_dir(spark, "warc-test")
    archives = W.write_archives(df, folder, gzipped=gzipped, archive=1500 if gzipped else 9000)
    assert archives.count() > 2
    assert sorted(map(tuple, W.read_archives(archives, folder, span).collect())) == brute(pages)


def test_stored_magic_in_gzip_members(spark):
    """A payload that holds whole gzip members, kept as it is by a stored block, yields candidates off the chain."""
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    inner = member.compress(MAGIC.encode()) + member.flush()
    outer = zlib.compressobj(0, zlib.DEFLATED, 31)
    raw = W.record(1, "u", inner, W.digest32(inner), len(inner), None, False)
    raw = outer.compress(raw) + outer.flush()
    folder = work_dir(spark, "warc-stored")
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/a.warc.gz", compression=None) as f:
        f.write(raw * 3)
    found = list(W.candidates(store, f"{path}/a.warc.gz", 0, 3 * len(raw), 3 * len(raw)))
    assert len(found) == 6
    rows = W.read_archives(spark.createDataFrame([("a.warc.gz", 3 * len(raw))], "file string, bytes long"), folder).collect()
    assert [r["page_id"] for r in rows] == [1, 1, 1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=40), st.sets(st.tuples(st.integers(0, 200), st.integers(1, 50)), max_size=20))
def test_pointer_jumping(lens, noise):
    true = [0]
    for n in lens:
        true.append(true[-1] + n)
    after = {a: a + n for a, n in noise} | dict(zip(true[:-1], true[1:], strict=True))
    at = sorted(after)
    mark = W.reachable(np.array(at), np.array([after[a] for a in at]))
    walk, here = set(), 0
    while here in after:
        walk.add(here)
        here = after[here]
    assert {a for a, m in zip(at, mark, strict=True) if m} == walk and set(true[:-1]) == walk & set(true[:-1])


@pytest.mark.parametrize("gzipped", [True, False])
def test_headers_of_any_length(spark, gzipped):
    pages = [(i, f"http://x/{'y' * (1 << 20) if i == 4 else i}", f"page {i}", "z", 1, True) for i in range(9)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, sha string, n int, revisit boolean").repartition(2)
    folder = work_dir(spark, "warc-long")
    archives = W.write_archives(df, folder, gzipped=gzipped)
    assert sorted(map(tuple, W.read_archives(archives, folder, 300_000).collect())) == brute([(i, h) for i, _, h, *_ in pages])


@pytest.mark.parametrize("gzipped", [True, False])
@pytest.mark.parametrize("lost", ["end", "start", "middle"])
def test_a_chain_that_breaks_off_is_an_error(spark, gzipped, lost):
    df = spark.createDataFrame([(i, "u", f"page {i}") for i in range(9)], "page_id long, url string, html string").coalesce(1)
    folder = work_dir(spark, "warc-cut")
    (file, size), = W.write_archives(df, folder, gzipped=gzipped).collect()
    store, path = open_store(folder)
    with store.open_input_file(f"{path}/{file}") as f:
        raw = f.read()
    at = {"end": size - 9, "start": 0, "middle": size // 2}[lost]
    raw = raw[:at] + (b"" if lost == "end" else b"\0" * 9 + raw[at + 9 :])
    with store.open_output_stream(f"{path}/{file}", compression=None) as f:
        f.write(raw)
    with pytest.raises(Exception, match="no record follows" if lost != "middle" else None):
        W.read_archives(spark.createDataFrame([(file, len(raw))], "file string, bytes long"), folder).collect()


def test_hot_payloads_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(W, "HOT", 5)
    pages = [(i, "same" if i % 2 else f"own {i % 12}") for i in range(40)]
    df = spark.createDataFrame([(i, "u", h) for i, h in pages], "page_id long, url string, html string").repartition(4)
    assert sorted(map(tuple, W.archive_pages(df).collect())) == brute(pages)


def test_edges(spark):
    pages = [(1, "u", ""), (2, None, None), (3, "u", "x"), (3, "u", "x"), (None, "u", "x"), (5, "ü\n", "é" * 200_000), (6, "u", "é" * 200_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    rows = sorted(((r["page_id"] is None, r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in W.archive_pages(df).collect()), key=lambda r: r[:3])
    assert rows == [
        (False, 1, "response", None), (False, 2, "revisit", 1), (False, 3, "response", None), (False, 3, "revisit", 3), (False, 5, "response", None), (False, 6, "revisit", 5), (True, 0, "revisit", 3)
    ]
    assert W.archive_pages(df.limit(0)).count() == 0


def test_repeated_rows_have_one_response(spark):
    df = spark.createDataFrame([(4, "u", "same")] * 40, "page_id long, url string, html string").repartition(8)
    rows = [r["record_type"] for r in W.archive_pages(df).collect()]
    assert sorted(rows) == ["response"] + ["revisit"] * 39
