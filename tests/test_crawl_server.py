"""The crawl source against a server on the loopback, and what it feeds."""

import socketserver
import struct
import threading
import time

import pytest

from arkloom import service
from arkloom.operators import registry
from arkloom.sources import crawl

PAGES = {f"site{i}.org": [(f"http://site{i}.org/{j}", f"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>page {j} of site{i} café".encode("latin1" if j == 0 else "utf-8")) for j in range(3 + i)] for i in range(4)}


@pytest.fixture(scope="module")
def server():
    asked = []

    class Stream(socketserver.StreamRequestHandler):
        def handle(self):
            for n, (url, raw) in enumerate(self.server.pages):
                self.wfile.write(crawl.encode_frame(url, "2020", n, raw, True))
            self.wfile.write(struct.pack(">iiiq", 0, 0, 0, 0))

    class Front(socketserver.StreamRequestHandler):
        def handle(self):
            line = self.rfile.readline().decode().strip()
            asked.append(line)
            _, _, start, end, *_ = line.split(",")
            if start == "broken":
                self.wfile.write(b"no\n")
                return
            names = sorted(PAGES)
            stream = socketserver.ThreadingTCPServer(("127.0.0.1", 0), Stream)
            stream.pages = [p for s in names[names.index(start) : names.index(end) + 1] for p in PAGES[s]]
            threading.Thread(target=stream.serve_forever, daemon=True).start()
            self.wfile.write(f"127.0.0.1 {stream.server_address[1]}\n".encode())

    front = socketserver.ThreadingTCPServer(("127.0.0.1", 0), Front)
    threading.Thread(target=front.serve_forever, daemon=True).start()
    yield f"127.0.0.1:{front.server_address[1]}", asked
    front.shutdown()


@pytest.fixture(scope="module")
def sites(tmp_path_factory):
    path = tmp_path_factory.mktemp("crawl") / "sites"
    path.write_text("# sites\n" + "".join(f"{s} {len(p)}\n" for s, p in sorted(PAGES.items())))
    return str(path)


def test_pages_of_all_sites(spark, server, sites):
    address, asked = server
    df = crawl.read_crawl(spark, "demo-tx", address, sites, 2, packed="true")
    assert df.rdd.getNumPartitions() == 2
    assert sorted((r["url"], bytes(r["raw"])) for r in df.collect()) == sorted(p for ps in PAGES.values() for p in ps)
    assert {a.split(",")[2] for a in asked} >= {"site0.org"} and all(a.startswith("new,0,") for a in asked)


def test_start_end_and_cap(spark, server, sites):
    read = lambda name, splits=1: sorted(r["url"] for r in crawl.read_crawl(spark, name, server[0], sites, splits, packed="true").collect())
    assert read("demo:-1:site1:site2.ORG") == sorted(u for s in ("site1.org", "site2.org") for u, _ in PAGES[s])
    assert len(read("demo:2")) == 2
    with pytest.raises(Exception, match="no site begins with"):
        read("demo::nowhere")


def test_a_server_that_refuses(server):
    with pytest.raises(ValueError, match="answered 'no'"):
        list(crawl.pull(server[0], "broken", "broken"))


def test_operators_by_a_crawls_name(spark, server, sites, tmp_path):
    params = {"CRAWL_SOURCE": "demo:-1:site0:site0.org", "CRAWL_SERVER": server[0], "CRAWL_SITES": sites}
    # The server's frames are packed; the operator reads plain ones unless told.
    pages = crawl.records(crawl.read_crawl(spark, "demo:-1:site0:site0.org", server[0], sites, packed="true").withColumn("raw", registry.T.as_text("raw")))
    words = {r["word"]: r["count"] for r in registry.run(spark, "webBaseWordCount", {"CRAWL_SOURCE": pages}).collect()}
    assert words["page"] == 3 and words["caf�"] == 1 and words["café"] == 2
    with pytest.raises(Exception, match="frame|page|PAGE|Data"):
        registry.run(spark, "webBaseWordCount", params | {"CRAWL_SERVER": "127.0.0.1:1"}).collect()
    pages.select("url", "content").write.parquet(str(tmp_path / "dump"))
    urls, index = registry.run(spark, "buildWebBaseIndex", {"CRAWL_SOURCE": str(tmp_path / "dump")})
    assert urls.count() == 3
    rows = [(r["token"], r["docID"]) for r in index.collect()]
    assert rows == sorted(rows)


def test_directory(spark):
    directory = spark.createDataFrame([("gov-2011-tx", "wb1", 4040), ("gov-2009-tx", "WB0", 4040)], "crawl string, machine string, port int")
    assert crawl.server_of(directory, "2011") == "wb1:4040"
    with pytest.raises(ValueError, match="not mounted"):
        crawl.server_of(directory, "2009")
    with pytest.raises(ValueError, match="no crawl"):
        crawl.server_of(directory, "1999")


def test_callback(spark):
    seen = []
    assert crawl.each_page(spark.range(5), lambda r: seen.append(r["id"])) == 5 and seen == list(range(5))


def test_jobs_queues_push_and_whole_results(spark, tmp_path):
    (tmp_path / "bag").write_text("".join(f"{i}\n" for i in range(12_000)))
    jobs = service.JobManager(spark)
    front = service.serve(jobs)
    port = front.server_address[1]
    told = []

    class Client(service.JobManager):
        def submit(self, operator, params, *more):
            told.append((operator, params["status"]))
            return service.JobState("x", operator)

    client = service.serve(Client(spark))
    ask = lambda op, params, **how: service.post(port, service.Request(op, params, how))
    bags = {"BAG1": str(tmp_path / "bag"), "BAG2": str(tmp_path / "bag")}
    job = ask("jaccardSim", bags, disposition="QUEUE_RESULTS", queue="mine")
    assert jobs.wait(job["name"]).status == "SUCCEEDED"
    assert [s["name"] for s in ask("getQueue", {"queue": "mine"})] == [job["name"]] and ask("getQueue", {"queue": "mine"}) == []
    job = ask("jaccardSim", bags, disposition="NOTIFY", notifyPort=client.server_address[1])
    jobs.wait(job["name"])
    for _ in range(100):
        if told:
            break
        time.sleep(0.1)
    assert told == [("jobDone", "SUCCEEDED")]
    job = jobs.submit("concatColumns", {"RELATION_FILE": str(tmp_path / "bag"), "SLICE_SPEC": "0:1"})
    assert jobs.wait(job.name).status == "SUCCEEDED" and jobs.result(job.name)[0].count() == 12_000
    job = jobs.submit("concatColumns", {"RELATION_FILE": str(tmp_path / "none"), "SLICE_SPEC": "0:1"})
    assert jobs.wait(job.name).status == "FAILED" and "StartError" in jobs.progress(job.name).message
    with pytest.raises(Exception, match="400|HTTP"):
        ask("jaccardSim", bags, disposition="SHRED")
    front.shutdown()
    client.shutdown()
