import bz2
import gzip
import io
import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arkloom import cli, service
from arkloom.operators import registry
from arkloom.plans import corpus as C
from arkloom.sources import crawl, warc
from arkloom.sources import text as X


def raw(*records):
    f = io.BytesIO()
    for r in records:
        warc.write_record(f, *r)
    return f.getvalue()


RECORDS = [
    ("<urn:1>", "2020-01-01", "response", {"Content-Type": "text/html", "WARC-Name": "a.html"}, b"<html><body>The cat sat. Big cat</body></html>"),
    ("<urn:2>", "2020-01-02", "request", {}, b"GET / HTTP/1.0\r\nWARC/1.0\r\nContent-Length: 4\r\n\r\nabcd"),
    ("<urn:3>", "2020-01-03", "response", {"X": "y"}, b""),
]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.text("abc<>:", min_size=1), st.binary(max_size=60)), max_size=5))
def test_writer_then_reader(records):
    data = raw(*[(i, "d", "resource", {}, body) for i, body in records])
    got = list(warc.read_records(io.BytesIO(data)))
    assert [(r[0], r[5]) for r in got] == [(i.strip(), body) for i, body in records]
    assert [r[1] for r in warc.read_records(io.BytesIO(data), content=False)] == [len(b) for _, b in records]


def test_headers_and_line_ends():
    data = b"junk\nWARC/0.18\nWARC-Type: warcinfo\nX: 1\nx: 2: 3\nContent-Length: 2\n\nhi\n\nWARC/1.0\r\nContent-Length: 9\r\n\r\ncut"
    got = list(warc.read_records(io.BytesIO(data)))
    assert len(got) == 1 and got[0][3] == "warcinfo" and got[0][4] == {"x": "2: 3"} and got[0][5] == b"hi"
    with pytest.raises(warc.TruncatedRecord):
        list(warc.read_records(io.BytesIO(data), mode="FAILFAST"))


@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress, bz2.compress])
def test_source(spark, tmp_path, pack):
    (tmp_path / "a.warc").write_bytes(pack(raw(*RECORDS)))
    df = warc.read_warc(spark, str(tmp_path), rangeBytes="100")
    assert [r["warcRecordId"] for r in df.orderBy("warcRecordId").collect()] == ["<urn:1>", "<urn:2>", "<urn:3>"]
    assert df.where("warc_type = 'request'").first()["content"] == RECORDS[1][4]
    assert warc.read_warc(spark, str(tmp_path), includeContent="false").where("content IS NULL").count() == 3


def test_source_takes_in_filters_where_it_may(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(raw(*RECORDS))
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name, "false")
    try:
        spark.conf.set(name, "true")
        df = warc.read_warc(spark, str(tmp_path)).where("warc_type = 'request'")
        assert [r["warcRecordId"] for r in df.collect()] == ["<urn:2>"]
    finally:
        spark.conf.set(name, before)


def test_sink_round_trip(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(raw(*RECORDS))
    df = warc.read_warc(spark, str(tmp_path / "a.warc"))
    warc.write_warc(df, str(tmp_path / "out"), compression="gzip")
    back = warc.read_warc(spark, str(tmp_path / "out"))
    cols = ["warcRecordId", "warc_type", "content", F.to_json("optionalHeaderFlds").alias("h")]
    lower = df.select(*cols[:3], F.to_json("optionalHeaderFlds").alias("h"))
    assert sorted(map(tuple, back.select(*cols).collect())) == sorted(map(tuple, lower.collect()))
    with pytest.raises(Exception, match="exists"):
        warc.write_warc(df, str(tmp_path / "out"))


def test_operators(spark, tmp_path):
    path = str(tmp_path / "a.warc")
    (tmp_path / "a.warc").write_bytes(raw(*RECORDS))
    run = lambda name, **p: registry.run(spark, name, p)
    assert run("warcRecordCount", WARC_FILE=path).first()[0] == 3
    words = {r["word"]: r["count"] for r in run("warcWordCount", WARC_FILE=path).collect()}
    assert words["cat"] == 2 and "The" not in words
    sample, rest = run("warcSetAside", WARC_FILE=path, PERCENTAGE=50)
    assert sample.count() + rest.count() == 3
    assert run("warcFilter", WARC_FILE=path, WARC_FIELD="warc-TYPE", REGEX="resp.*").count() == 2
    assert run("warcFilter", WARC_FILE=path, WARC_FIELD="x", REGEX="y").count() == 3
    assert run("warcFilter", WARC_FILE=path, WARC_FIELD="x", REGEX="y", MISSING="drop").count() == 1
    assert run("warcStripHTML", WARC_FILE=path).where("warcRecordId = '<urn:1>'").first()["content"] == b"The cat sat. Big cat"
    assert run("warcGetTextOnly", infile=path).count() == 1
    run("warcNgrams", WARC_FILE=path, ARITY=1, NGRAM_DEST=str(tmp_path / "ngrams"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "ngrams")).collect()]
    assert "2,cat" in lines
    with pytest.raises(registry.NotImplementedOperator):
        run("nothing")
    with pytest.raises(registry.ParameterError):
        run("warcNgrams", WARC_FILE=path, COLOR="red")
    with pytest.raises(registry.ParameterError):
        run("warcNgrams")


def test_bytes_that_are_not_text(spark, tmp_path):
    """Latin-1 pages through all operators that look into content."""
    page = "<html><body>caf\u00e9 caf\u00e9 noir</body></html>".encode("latin1")
    path = str(tmp_path / "a.warc")
    (tmp_path / "a.warc").write_bytes(raw(("<urn:1>", "d", "response", {"Name": "a.html"}, page), ("<urn:2>", "d", "response", {}, b"\xff\xfe cat cat noir cat noir")))
    run = lambda name, **p: registry.run(spark, name, {"WARC_FILE": path} | p)
    words = {r["word"]: r["count"] for r in run("warcWordCount").collect()}
    assert words["caf\ufffd"] == 2 and words["cat"] == 3
    assert {r["words"]: r["count"] for r in run("warcNgrams").collect()}["cat,noir"] == 2
    assert run("warcStripHTML").where("warcRecordId = '<urn:1>'").first()["content"] == "caf\ufffd caf\ufffd noir".encode()
    assert run("warcStripHTML", ROBUST=True).count() == 2
    assert run("warcFilter", WARC_FIELD="content", REGEX=r"[\s\S]*noir[\s\S]*").count() == 2
    assert run("warcSetAside", PERCENTAGE=100)[0].count() == 2 and run("warcRecordCount").first()[0] == 2
    assert registry.run(spark, "warcGetTextOnly", {"infile": path}).first()[0].startswith("<html><body>caf\ufffd")
    assert run("warcNgrams", MAX_BYTES=10).count() == 0 and run("warcNgrams", MAX_BYTES=-1).count() == 1
    with pytest.raises(registry.ParameterError):
        run("warcSetAside", PERCENTAGE="many")
    with pytest.raises(registry.ParameterError):
        run("warcNgrams", WORD_LEN_MIN=0)


def test_columns_asked_for(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(raw(*RECORDS))
    df = warc.read_warc(spark, str(tmp_path), ["warc_type", "optionalHeaderFlds", "contentLength"])
    assert df.columns == ["warc_type", "optionalHeaderFlds", "contentLength"]
    assert sorted((r[0], len(r[1]), r[2]) for r in df.collect()) == sorted((k, len(h), len(b)) for _, _, k, h, b in RECORDS)


def test_file_operators(spark, tmp_path):
    (tmp_path / "grams").write_text("3,big,cat\n1,big,dog\n3,the,dog\n2,a,b\n\n")
    (tmp_path / "freqs").write_text("1,0.1\n3,0.2\n")
    (tmp_path / "last").write_text("big,cat,3\nthe,dog,4\nx,yy,2\n")
    run = lambda name, **p: registry.run(spark, name, p)
    assert [tuple(r) for r in run("ngramFrequencies", NGRAM_FILE=str(tmp_path / "grams")).collect()] == [(1, 1), (2, 1), (3, 2)]
    top = run("smoothNgrams", NGRAM_FILE=str(tmp_path / "grams"), FREQS_FILE=str(tmp_path / "freqs"), LIMIT=1)
    assert {tuple(r) for r in top.collect()} == {(0.2, "big,cat"), (0.2, "the,dog")}
    assert [tuple(r) for r in run("cullNgrams", NGRAM_FILE=str(tmp_path / "last")).collect()] == [("big,cat", 3)]
    assert [r[0] for r in run("concatColumns", RELATION_FILE=str(tmp_path / "last"), SLICE_SPEC="0:2", CONCAT_SEPARATOR="_").collect()] == ["big_cat", "the_dog", "x_yy"]
    (tmp_path / "ragged").write_text("a,b,c\nd\n")
    ragged = run("concatColumns", RELATION_FILE=str(tmp_path / "ragged"), SLICE_SPEC="1:", CONCAT_SEPARATOR="_").collect()
    assert sorted((r[0] for r in ragged), key=str) == [None, "b_c"]
    (tmp_path / "a").write_text("x\nx\ny\n")
    (tmp_path / "b").write_text("y\nz\n")
    assert run("jaccardSim", BAG1=str(tmp_path / "a"), BAG2=str(tmp_path / "b")).first()[0] == 1 / 3


def test_text_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "poem.txt").write_text("one\ntwo\n")
    rec = X.as_warc(X.read_text_tree(spark, str(tmp_path))).first()
    assert rec["contentLength"] == 8 and rec["warcRecordId"] == "file:///poem.txt" and rec["warc_type"] == "resource"
    (tmp_path / "q.csv").write_text('"a ""b""",2\n')
    assert tuple(X.read_csv(spark, str(tmp_path / "q.csv"), "t string, n int").first()) == ('a "b"', 2)


def test_crawl(spark):
    spec = crawl.CrawlSpec.parse("crawl-tx:10:b")
    assert (spec.pages, spec.start, spec.end) == (10, "b", None) and crawl.content_kind("gov-im") == "image"
    with pytest.raises(ValueError):
        crawl.CrawlSpec.parse("a:1:2:3:4")
    sites = crawl.parse_sites(["# x", "a 5", "b.com 4", "c 0", "d 6", "e 1"])
    plan = crawl.plan_splits(sites, 2)
    assert sum(p["pages"] for p in plan) == 16 and len(plan) == 2
    assert sum(p["pages"] for p in crawl.plan_splits(sites, 2, spec)) == 10
    data = crawl.encode_frame("u", "2020", 7, b"page", True) + crawl.encode_frame("v", "2021", 8, b"x", True)
    assert [(p["url"], p["position"], p["raw"]) for p in crawl.decode_frames(data, True)] == [("u", 7, b"page"), ("v", 8, b"x")]
    pages = spark.createDataFrame([("HTTP/1.0 200\r\nContent-Type: text/html\r\nX: 1\r\nx: 2\r\n\r\nbody",), ("no header",)], "raw string")
    got = crawl.records(pages).collect()
    assert len(got) == 1 and got[0]["content"] == "body" and got[0]["content_kind"] == "text" and got[0]["httpHeader"]["x"] == "2"


def test_index_operator(spark):
    pages = spark.createDataFrame([("http://a", "cat the hat")], "url string, content string")
    urls, index = registry.run(spark, "buildWebBaseIndex", {"CRAWL_SOURCE": pages, "include_summary": True})
    assert urls.count() == 1 and [(r["token"], r["pos"]) for r in index.collect()] == [("cat", 0), ("hat", 2), ("na", 3)]


def test_service(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(raw(*RECORDS))
    jobs = service.JobManager(spark)
    job = jobs.submit("warcRecordCount", {"WARC_FILE": str(tmp_path / "a.warc")}, service.Disposition.QUEUE)
    assert jobs.wait(job.name).status == "SUCCEEDED" and jobs.result(job.name)[0].first()[0] == 3
    assert jobs.queues["default"].get(timeout=5).name == job.name
    assert jobs.wait(jobs.submit("nothing", {}).name).status == "FAILED"
    assert jobs.progress("unknown").status == "UNKNOWN"
    server = service.serve(jobs)
    port = server.server_address[1]
    assert service.post(port, service.Request("testCall", {"a": 1})) == {"echo": {"a": 1}}
    started = service.post(port, service.Request("warcRecordCount", {"WARC_FILE": str(tmp_path / "a.warc")}))
    time.sleep(0.1)
    assert jobs.wait(started["name"]).status == "SUCCEEDED"
    server.shutdown()
    assert service.Request.from_json(json.dumps({"operator": "x", "params": {}})).operator == "x"
    with pytest.raises(registry.ParameterError):
        service.Request.from_json("[]")


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "a.warc").write_bytes(raw(*RECORDS))
    assert cli.main(["warcRecordCount", "--WARC_FILE", str(tmp_path / "a.warc")], spark) == 0
    assert cli.main(["warcNgrams", "--WARC_FILE", str(tmp_path / "a.warc"), "--ARITY", "x"], spark) == 2
    assert C.keep_if is not None and "ParameterError" in capsys.readouterr().err


def test_records_pass_in_small_batches(spark, tmp_path):
    """Workers hold a few records at a time, however many a file or a partition has."""
    (tmp_path / "a.warc").write_bytes(raw(*[(f"<urn:{i}>", "d", "response", {"N": str(i)}, b"x" * 20_000) for i in range(600)]))
    reader = warc.WarcReader({"path": str(tmp_path / "a.warc")})
    batches = list(reader.read(reader.partitions()[0]))
    assert max(b.nbytes for b in batches) < 2 * warc.BATCH_BYTES and max(b.num_rows for b in batches) <= warc.BATCH_ROWS
    assert sum(b.num_rows for b in batches) == 600 and batches[0].column(4)[1].as_py() == [("n", "1")]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with warc.small_batches(spark):
        assert int(spark.conf.get(name)) <= warc.BATCH_ROWS
    assert spark.conf.get(name) == before
    warc.write_warc(warc.read_warc(spark, str(tmp_path / "a.warc")).repartition(1), str(tmp_path / "out"))
    assert warc.read_warc(spark, str(tmp_path / "out")).where("length(content) = 20000").count() == 600
