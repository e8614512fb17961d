"""Crawls: their specification, their splits, and pages from a framed stream or a table.

A crawl is named ``name[:pages[:start site[:end site]]]``.  Pages come from a
dump (rows of url, date, size, position, id, raw), a framed byte stream, or a server:

    spark.dataSource.register(CrawlDataSource)
    spark.read.format("webcrawl").option("server", "host:port").option("sites", path).load("name:100")

The sites with their numbers of pages are a text file.  Each planned run of sites is
one partition.  Its task asks the server for the run, is told where the stream is,
and reads frames from there; a number of pages in the name holds for each run.
"""

from __future__ import annotations

import io
import itertools
import socket
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from arkloom.session import settled

LIMITS = {"stamp": 24, "url": 100 << 10, "page": 100 << 20}
KINDS = {"au": "audio", "im": "image", "tx": "text", "un": "unknown"}


@dataclass(frozen=True)
class CrawlSpec:
    """What to read of a crawl; -1 pages are all."""

    name: str
    pages: int = -1
    start: str | None = None
    end: str | None = None

    @classmethod
    def parse(cls, text: str) -> CrawlSpec:
        parts = text.split(":")
        if len(parts) > 4 or not parts[0]:
            raise ValueError(f"a crawl is name[:pages[:start[:end]]], not {text!r}")
        parts += [""] * (4 - len(parts))
        return cls(parts[0], int(parts[1]) if parts[1] else -1, parts[2] or None, parts[3] or None)


def content_kind(name: str) -> str:
    """Kind of content by the suffix of a crawl's name; text without one."""
    return KINDS.get(name.rpartition("-")[2][:2] if "-" in name else "tx", "text")


def find_crawl(directory: DataFrame, name: str) -> DataFrame:
    """Lines of the directory whose crawl holds ``name``; crawls that are not mounted are left out."""
    return directory.where(F.col("crawl").contains(name) & (F.upper("machine") != "WB0"))


def server_of(directory: DataFrame, name: str) -> str:
    """``host:port`` of the first crawl that holds ``name``; an error if there is none, or none that is mounted."""
    found = directory.where(F.col("crawl").contains(name))
    row = find_crawl(found, name).orderBy("crawl").first()
    if row is None:
        raise ValueError(f"crawl {name} is not mounted" if found.first() else f"no crawl {name}")
    return f"{row['machine']}:{row['port']}"


def parse_sites(lines: list[str], most_bad: int = 100) -> list[tuple[str, int]]:
    """(site, pages) of lines ``site pages``, without comments and sites of no pages."""
    out, bad = [], 0
    for line in lines:
        parts = line.split()
        if not parts or parts[0].startswith("#"):
            continue
        if len(parts) < 2 or not parts[1].isdigit():
            bad += 1
            if bad > most_bad:
                raise ValueError("too many lines that are no sites")
            continue
        if int(parts[1]):
            out.append((parts[0], int(parts[1])))
    return out


def plan_splits(sites: list[tuple[str, int]], splits: int, spec: CrawlSpec | None = None, least: int = 3) -> list[dict]:
    """Runs of sites of about equal page counts: {start, end, pages}.

    Sites before the start site (found by prefix) and behind the end site are left
    out; a site of fewer than ``least`` pages begins no run of its own.
    """
    spec = spec or CrawlSpec("")
    if spec.start:
        at = next((i for i, (s, _) in enumerate(sites) if s.startswith(spec.start)), None)
        if at is None:
            raise ValueError(f"no site begins with {spec.start}")
        sites = sites[at:]
    kept, total = [], 0
    for site, pages in sites:
        if 0 <= spec.pages <= total:
            break
        pages = min(pages, spec.pages - total) if spec.pages >= 0 else pages
        kept.append((site, pages))
        total += pages
        if spec.end and site.lower() == spec.end.lower():
            break
    out: list[dict] = []
    done, share = 0, total / max(splits, 1)
    for site, pages in kept:
        if not out or (pages >= least and done >= share * len(out)):
            out.append({"start": site, "end": site, "pages": 0})
        out[-1]["end"] = site
        out[-1]["pages"] += pages
        done += pages
    return out


def split_plan(pages: DataFrame, target: int, url: str = "url") -> DataFrame:
    """(site, pages, before, split): sites in order with the split of about ``target`` pages they go to."""
    sites = pages.groupBy(F.lower(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1)).alias("site")).agg(F.count(F.lit(1)).alias("pages"))
    # Sums within ranges of sites, and over the ranges, which are as few as tasks.  Ranges are sampled, so they are fixed first.
    sites = settled(sites.repartitionByRange("site").withColumn("part", F.spark_partition_id()), "sites")
    upto = lambda w: F.coalesce(F.sum("pages").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sites.groupBy("part").agg(F.sum("pages").alias("pages")).select("part", upto(Window.orderBy("part")).alias("base"))
    sites = sites.join(parts, "part")
    sites = sites.select("site", "pages", (F.col("base") + upto(Window.partitionBy("part").orderBy("site"))).cast("long").alias("before"))
    return sites.withColumn("split", F.floor(F.col("before") / target).cast("long"))


def read_frames(f: io.BufferedIOBase, packed: bool = False) -> Iterator[dict]:
    """Pages of a framed stream: sizes of page, url and time stamp (4 bytes each), position (8), then these; a page of no bytes ends it."""

    def take(n: int) -> bytes:
        raw = f.read(n)
        if len(raw) < n:
            raise ValueError("stream ends within a page")
        return raw

    while head := f.read(20):
        if len(head) < 20:
            raise ValueError("stream ends within a page")
        page, url, stamp, position = struct.unpack(">iiiq", head)
        if page == 0:
            return
        if not (0 < page <= LIMITS["page"] and 0 <= url <= LIMITS["url"] and 0 <= stamp <= LIMITS["stamp"]):
            raise ValueError("frame exceeds its limits")
        out = {"url": take(url).decode("utf-8", "replace"), "date": take(stamp).decode("ascii", "replace"), "position": position}
        raw = take(page)
        yield out | {"raw": zlib.decompress(raw) if packed else raw}


def decode_frames(data: bytes, packed: bool = False) -> Iterator[dict]:
    """The same of bytes."""
    return read_frames(io.BytesIO(data), packed)


def encode_frame(url: str, date: str, position: int, raw: bytes, packed: bool = False) -> bytes:
    body, u, d = zlib.compress(raw) if packed else raw, url.encode(), date.encode()
    return struct.pack(">iiiq", len(body), len(u), len(d), position) + u + d + body


@dataclass
class SiteRun(InputPartition):
    start: str
    end: str


class CrawlReader(DataSourceReader):
    def __init__(self, options):
        self.spec = CrawlSpec.parse(options["path"])
        self.server = options["server"]
        self.packed = str(options.get("packed", "false")).lower() == "true"
        self.splits = int(options.get("splits", 1))
        with open(options["sites"].removeprefix("file://"), encoding="utf-8") as f:
            self.sites = parse_sites(f.read().splitlines())

    def partitions(self):
        return [SiteRun(s["start"], s["end"]) for s in plan_splits(self.sites, self.splits, self.spec)]

    def read(self, partition):
        for page in itertools.islice(pull(self.server, partition.start, partition.end, self.packed), self.spec.pages if self.spec.pages >= 0 else None):
            yield page["url"], page["date"], page["position"], page["raw"]


def pull(server: str, start: str, end: str, packed: bool = False, timeout: float = 60.0) -> Iterator[dict]:
    """Pages of a run of sites from a server: it is asked with one line, answers with an address, and the stream is there."""
    host, _, port = server.rpartition(":")
    with socket.create_connection((host, int(port)), timeout) as s:
        s.sendall(f"new,0,{start},{end},arkloom,arkloom\n".encode())
        with s.makefile("rb") as f:
            answer = f.readline().decode("ascii", "replace").split()
    if len(answer) != 2 or not answer[1].isdigit():
        raise ValueError(f"the server answered {' '.join(answer)!r}")
    with socket.create_connection((answer[0], int(answer[1])), timeout) as s, s.makefile("rb") as f:
        yield from read_frames(f, packed)


class CrawlDataSource(DataSource):
    @classmethod
    def name(cls):
        return "webcrawl"

    def schema(self):
        return "url string, date string, position long, raw binary"

    def reader(self, schema):
        return CrawlReader(self.options)


def read_crawl(spark, crawl: str, server: str, sites: str, splits: int = 1, **options) -> DataFrame:
    """(url, date, position, raw) of a crawl's pages."""
    spark.dataSource.register(CrawlDataSource)
    return spark.read.format("webcrawl").options(server=server, sites=sites, splits=str(splits), **options).load(crawl)


def each_page(pages: DataFrame, callback) -> int:
    """Hands the pages to a callback, one at a time as they come, and returns how many there were."""
    n = 0
    for row in pages.toLocalIterator():
        callback(row)
        n += 1
    return n


def records(pages: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds httpHeader (map, names in lower case), content and content_kind; pages without a header end are dropped."""
    parts = F.split(F.col(raw), "\r\n\r\n", 2)
    lines = F.filter(F.split(parts[0], "\r\n"), lambda x: x.contains(":"))
    pair = lambda x: F.struct(F.lower(F.trim(F.split(x, ":", 2)[0])), F.trim(F.split(x, ":", 2)[1]))
    first = F.filter(lines, lambda x: F.lower(x).startswith("content-type:"))
    kind: Column = F.lower(F.regexp_extract(F.coalesce(F.get(first, 0), F.lit("")), r"(?i)content-type:\s*([a-z]+)/", 1))
    # Of a repeated header the last counts.
    names = F.transform(lines, lambda x: F.lower(F.trim(F.split(x, ":", 2)[0])))
    last = F.filter(F.transform(lines, lambda x, i: F.when(F.array_position(F.reverse(names), F.get(names, i)) == F.size(names) - i, x)), lambda x: x.isNotNull())
    heads = F.map_from_entries(F.transform(last, pair))
    out = pages.where(F.size(parts) == 2).withColumn("httpHeader", heads).withColumn("content", parts[1])
    return out.withColumn("content_kind", F.when(kind.isin("text", "audio", "image"), kind).otherwise("unknown"))


def host(url: str) -> str:
    return (urlsplit(url).hostname or "").lower()
