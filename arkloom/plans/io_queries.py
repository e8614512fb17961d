"""Queries that write and read back through the sources and sinks, and run the named operators and the job service."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arkloom import service
from arkloom.functions import rows as R
from arkloom.functions import stats as S
from arkloom.functions import text as T
from arkloom.operators import registry
from arkloom.plans import corpus as C
from arkloom.plans.queries import _FOF, _SEP, _STOP, _TOKENS, _strip_sql, good_turing_sql, query, rounded, table
from arkloom.session import settled, work_folder
from arkloom.sources import crawl, warc
from arkloom.sources import text as X
from arkloom.streaming import counts as live


def local(spark: SparkSession, name: str) -> str:
    return work_folder(spark, name).removeprefix("file://")


def archive(spark: SparkSession, d: str, **options) -> str:
    """The pages as WARC files."""
    path = local(spark, "warc")
    name = F.concat(F.lit("page"), "page_id", F.when(F.col("page_id") % 2 == 0, F.lit(".html")).otherwise(F.lit(".bin")))
    rows = table(spark, d, "pages").select(
        F.concat(F.lit("<urn:page:"), "page_id", F.lit(">")).alias("warcRecordId"),
        F.lit("2020-01-01T00:00:00Z").alias("date"),
        F.when(F.col("page_id") % 3 == 0, F.lit("request")).otherwise(F.lit("response")).alias("warc_type"),
        F.create_map(F.lit("WARC-Target-URI"), "url", F.lit("WARC-Name"), name).alias("optionalHeaderFlds"),
        F.coalesce("html", F.lit("")).cast("binary").alias("content"),
    )
    warc.write_warc(rows, path, **options)
    return path


def page_id() -> F.Column:
    return F.regexp_extract("warcRecordId", "([0-9]+)", 1).cast("long").alias("page_id")


@query("SELECT page_id, CAST(strlen(html) AS INTEGER) AS length, CASE WHEN page_id % 3 = 0 THEN 'request' ELSE 'response' END AS kind, '2020-01-01T00:00:00Z' AS date, url, html FROM pages")
def warc_round_trip(spark, d):
    """Written with a gzip member a record and read back."""
    rows = warc.read_warc(spark, archive(spark, d, compression="gzip"))
    return rows.select(page_id(), F.col("contentLength").alias("length"), F.col("warc_type").alias("kind"), "date", F.col("optionalHeaderFlds")["warc-target-uri"].alias("url"), T.as_text("content").alias("html"))


@query("SELECT page_id, CAST(strlen(html) AS INTEGER) AS length FROM pages")
def warc_ranges(spark, d):
    """Plain files in ranges of records, and only the columns asked for."""
    return warc.read_warc(spark, archive(spark, d), ["warcRecordId", "contentLength"], rangeBytes="50000").select(page_id(), F.col("contentLength").alias("length"))


@query("SELECT page_id, CAST(strlen(html) AS INTEGER) AS length FROM pages WHERE page_id % 3 = 0")
def warc_by_type(spark, d):
    return warc.read_warc(spark, archive(spark, d)).where("warc_type = 'request'").select(page_id(), F.col("contentLength").alias("length"))


@query("""SELECT p_partkey, p_name || ' "' || p_brand || '", x' AS label FROM part""")
def csv_round_trip(spark, d):
    path = work_folder(spark, "csv")
    rows = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(' "'), "p_brand", F.lit('", x')).alias("label"))
    rows.write.option("quote", '"').option("escape", '"').csv(path)
    return X.read_csv(spark, path, "p_partkey long, label string")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def delimited_round_trip(spark, d):
    """Unquoted fields in gzip files."""
    path = work_folder(spark, "delimited")
    X.write_delimited(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, "|", "gzip")
    return X.read_delimited(spark, path, "|").select(*[F.get("fields", i).alias(c) for i, c in enumerate(("key", "name", "region"))])


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def delimited_schema(spark, d):
    path = work_folder(spark, "delimited")
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    X.write_delimited(n, path, ",")
    return X.read_delimited(spark, path, ",", ", ".join(f"{c} {k}" for c, k in n.dtypes))


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS numbers FROM lineitem GROUP BY l_returnflag")
def typed_store(spark, d):
    """A typed intermediate table, stored and read again."""
    kept = settled(table(spark, d, "lineitem").select("l_returnflag", "l_linenumber"), "typed")
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").cast("long").alias("numbers"))


def text_files(spark: SparkSession, d: str) -> DataFrame:
    path = work_folder(spark, "texts")
    table(spark, d, "nation").select(F.col("n_name").alias("value")).repartition(3).write.text(path)
    return X.read_text_tree(spark, path)


@query("SELECT n_name AS line FROM nation")
def text_tree(spark, d):
    return text_files(spark, d).select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")


@query("SELECT n_name AS line, true AS fits, 'resource' AS kind FROM nation")
def text_to_warc(spark, d):
    path = local(spark, "warc-of-texts")
    warc.write_warc(X.as_warc(text_files(spark, d)), path)
    rows = warc.read_warc(spark, path)
    fits = (F.col("contentLength") == F.octet_length("content")).alias("fits")
    return rows.select(F.explode(F.split(T.as_text("content"), "\n")).alias("line"), fits, F.col("warc_type").alias("kind")).where("line <> ''")


@query(r"SELECT regexp_replace('see ' || url || ' now', '\b(http://|https://)\S*\b', '', 'g') AS text FROM pages")
def link_stripped_text(spark, d):
    path = work_folder(spark, "stripped")
    table(spark, d, "pages").select(T.remove_links(F.concat(F.lit("see "), "url", F.lit(" now"))).alias("value")).write.text(path)
    return spark.read.text(path).select(F.col("value").alias("text"))


def run(spark: SparkSession, name: str, **params) -> DataFrame:
    return registry.run(spark, name, params)


@query("SELECT count(*) AS count FROM pages")
def named_warc_record_count(spark, d):
    return run(spark, "warcRecordCount", WARC_FILE=archive(spark, d))


_PAGE_WORDS = f"SELECT token AS word, count(*) AS count FROM (SELECT unnest(list_filter(string_split_regex(t, '{_SEP}'), lambda x: x <> '')) AS token FROM (SELECT {_strip_sql()} AS t FROM pages)) WHERE token NOT IN {_STOP} GROUP BY token"


@query(_PAGE_WORDS)
def named_warc_word_count(spark, d):
    return run(spark, "warcWordCount", WARC_FILE=archive(spark, d))


@query(_PAGE_WORDS)
def named_crawl_word_count(spark, d):
    return run(spark, "webBaseWordCount", CRAWL_SOURCE=table(spark, d, "pages").select("url", F.col("html").alias("content")))


_W = "SELECT page_id, list_filter(string_split_regex(html, '[^A-Za-z0-9_]+'), lambda x: x <> '') AS w FROM pages"
_PAGE_GRAMS = f"""SELECT count(*) AS count, words FROM (SELECT unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ',' || w[i + 1])) AS words FROM ({_W}))
WHERE regexp_full_match(words, '[a-zA-Z,]+') AND len(list_filter(string_split(words, ','), lambda x: length(x) < 2 OR length(x) > 20)) = 0 GROUP BY words HAVING count(*) > 1"""


@query(_PAGE_GRAMS)
def named_warc_ngrams(spark, d):
    return run(spark, "warcNgrams", WARC_FILE=archive(spark, d), ARITY=2)


@query(_PAGE_GRAMS)
def service_ngrams(spark, d):
    """The same as a job of the service."""
    jobs = service.JobManager(spark, start_timeout=120.0)
    job = jobs.warc_ngrams(archive(spark, d), 2)
    jobs.wait(job.name)
    return jobs.result(job.name)[0]


def grams_file(spark: SparkSession, d: str) -> str:
    path = work_folder(spark, "grams")
    run(spark, "warcNgrams", WARC_FILE=archive(spark, d), ARITY=2, NGRAM_DEST=path)
    return path


_PAGE_FOF = f"SELECT CAST(count AS INTEGER) AS freq, count(*) AS freq_of_freq FROM ({_PAGE_GRAMS}) GROUP BY count"


@query(_PAGE_FOF)
def named_ngram_frequencies(spark, d):
    return run(spark, "ngramFrequencies", NGRAM_FILE=grams_file(spark, d))


_ONE = f"SELECT freq, freq_of_freq FROM ({_PAGE_FOF}) UNION ALL SELECT 1, 1 WHERE NOT EXISTS (SELECT 1 FROM ({_PAGE_FOF}) WHERE freq = 1)"


def smoothed(spark: SparkSession, d: str) -> tuple[str, str]:
    """Files of n-grams and of probabilities, as three operators leave them to each other."""
    grams, freqs, probabilities = grams_file(spark, d), work_folder(spark, "freqs"), work_folder(spark, "probabilities")
    run(spark, "ngramFrequencies", NGRAM_FILE=grams, FREQS_DEST=freqs)
    run(spark, "goodTuring", FREQS_FILE=freqs, ENSURE_ONE=True, PROBABILITIES_DEST=probabilities)
    return grams, probabilities


@query(f"WITH {good_turing_sql(_ONE)} SELECT freq, round(probability, 9) AS probability FROM gt")
def named_good_turing(spark, d):
    """With a row for the frequency 1, which the n-grams that are kept never have."""
    return X.read_delimited(spark, smoothed(spark, d)[1], ",", "freq int, probability double").select("freq", rounded("probability").alias("probability"))


@query(f"""WITH {good_turing_sql(_ONE)}, c AS ({_PAGE_GRAMS})
SELECT round(probability, 9) AS probability, words FROM (SELECT *, row_number() OVER (PARTITION BY split_part(words, ',', 1) ORDER BY probability DESC, words) AS k FROM c JOIN gt ON count = freq) WHERE k <= 2""")
def named_smooth_ngrams(spark, d):
    grams, probabilities = smoothed(spark, d)
    return run(spark, "smoothNgrams", NGRAM_FILE=grams, FREQS_FILE=probabilities, LIMIT=2).select(rounded("probability").alias("probability"), "words")


@query(f"SELECT words, CAST(count AS INTEGER) AS count FROM ({_PAGE_GRAMS}) WHERE len(list_filter(string_split(words, ','), lambda x: x IN {_STOP})) = 0")
def named_cull_ngrams(spark, d):
    return run(spark, "cullNgrams", NGRAM_FILE=grams_file(spark, d), COUNT_POS=0)


@query("SELECT page_id FROM pages WHERE regexp_full_match(url, 'https?://[^/]*\\.org/.*')")
def named_warc_filter(spark, d):
    path = local(spark, "filtered")
    run(spark, "warcFilter", WARC_FILE=archive(spark, d), WARC_FIELD="warc-target-URI", REGEX=r"https?://[^/]*\.org/.*", MISSING="drop", FILTERED_DEST=path)
    return warc.read_warc(spark, path).select(page_id())


@query("SELECT page_id, html FROM pages WHERE regexp_matches(html, 'href')")
def named_warc_filter_content(spark, d):
    return run(spark, "warcFilter", WARC_FILE=archive(spark, d), WARC_FIELD="content", REGEX=r"[\s\S]*href[\s\S]*").select(page_id(), T.as_text("content").alias("html"))


_DRAWN = "CAST('0x' || substr(md5('0:<urn:page:' || page_id || '>'), 1, 8) AS BIGINT) < CAST(floor(0.3 * 4294967296) AS BIGINT)"


@query(f"SELECT page_id, CASE WHEN {_DRAWN} THEN 'sample' ELSE 'main' END AS part FROM pages")
def named_warc_set_aside(spark, d):
    sample, main = local(spark, "sample"), local(spark, "main")
    run(spark, "warcSetAside", WARC_FILE=archive(spark, d), PERCENTAGE=30, DEST_SAMPLE=sample, DEST_MAIN=main)
    read = lambda path, part: warc.read_warc(spark, path).select(page_id(), F.lit(part).alias("part"))
    return read(sample, "sample").unionByName(read(main, "main"))


@query(f"SELECT page_id, t AS text, CAST(length(t) AS INTEGER) AS text_len, CAST(strlen(t) AS INTEGER) AS length FROM (SELECT page_id, {_strip_sql()} AS t FROM pages)")
def named_warc_strip_html(spark, d):
    rows = run(spark, "warcStripHTML", WARC_FILE=archive(spark, d))
    return rows.select(page_id(), T.as_text("content").alias("text"), "text_len", F.col("contentLength").alias("length"))


@query("SELECT html AS content FROM (SELECT html, unnest([url, 'page' || page_id || CASE WHEN page_id % 2 = 0 THEN '.html' ELSE '.bin' END]) AS value FROM pages) WHERE regexp_matches(value, '\\.(txt|html)')")
def named_warc_text_only(spark, d):
    return run(spark, "warcGetTextOnly", infile=archive(spark, d))


@query("SELECT n_name || '-' || n_regionkey AS concat FROM nation")
def named_concat_columns(spark, d):
    path = work_folder(spark, "columns")
    X.write_delimited(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, ",")
    return run(spark, "concatColumns", RELATION_FILE=path, SLICE_SPEC="-2:", CONCAT_SEPARATOR="-")


@query("""WITH a AS (SELECT DISTINCT n_name AS e FROM nation WHERE n_regionkey < 3), b AS (SELECT DISTINCT n_name AS e FROM nation WHERE n_regionkey > 1)
SELECT (SELECT count(*) FROM a JOIN b USING (e)) / (SELECT CAST(count(*) AS DOUBLE) FROM (SELECT e FROM a UNION SELECT e FROM b)) AS jaccard""")
def named_jaccard(spark, d):
    paths = [work_folder(spark, "bag") for _ in range(2)]
    n = table(spark, d, "nation")
    for path, part in zip(paths, (n.where("n_regionkey < 3"), n.where("n_regionkey > 1")), strict=True):
        part.select("n_name").write.text(path)
    return run(spark, "jaccardSim", BAG1=paths[0], BAG2=paths[1])


@query(f"SELECT 'http://x/' || doc_id AS url, token, CAST(pos AS INTEGER) AS pos FROM ({_TOKENS}) WHERE token NOT IN {_STOP}")
def named_build_index(spark, d):
    pages = table(spark, d, "documents").select(F.concat(F.lit("http://x/"), "doc_id").alias("url"), F.col("text").alias("content"))
    urls, index = registry.run(spark, "buildWebBaseIndex", {"CRAWL_SOURCE": pages})
    return index.join(urls, "docID").select("url", "token", "pos")


_TOKEN_GRAMS = f"SELECT count(*) AS count, words FROM (SELECT token || ',' || lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS words FROM ({_TOKENS})) WHERE words IS NOT NULL GROUP BY words"


@query(f"WITH {good_turing_sql(f'SELECT count AS freq, count(*) AS freq_of_freq FROM ({_TOKEN_GRAMS}) GROUP BY count')} SELECT words, count, round(probability, 12) AS probability FROM ({_TOKEN_GRAMS}) JOIN gt ON count = freq")
def text_ngram_probabilities(spark, d):
    out = C.ngram_probabilities(table(spark, d, "documents"))
    return out.select("words", "count", rounded("probability", 12).alias("probability"))


@query(f"WITH {good_turing_sql(f'SELECT freq, freq_of_freq FROM ({_FOF}) WHERE freq > 1 UNION ALL SELECT 1, 1')} SELECT freq, round(probability, 9) AS probability FROM gt")
def good_turing_ensure_one(spark, d):
    from arkloom.plans.queries import ngram_freq_of_freq

    return S.good_turing(ngram_freq_of_freq(spark, d).where("freq > 1"), ensure_one=True).select("freq", rounded("probability").alias("probability"))


_URL_RUN = "[:/a-zA-Z0-9.*_+%?&=~-]+"


@query(f"""SELECT page_id, regexp_extract('x: ' || url, '(https|http|ftps|ftp|file|mailto|rtsp):{_URL_RUN}') AS first, regexp_extract(url, '^{_URL_RUN}') AS found FROM pages""")
def find_urls(spark, d):
    return table(spark, d, "pages").select("page_id", T.first_url(F.concat(F.lit("x: "), "url")).alias("first"), T.find_url("url").alias("found"))


@query("SELECT page_id, CASE WHEN page_id % 50 = 0 THEN CAST('-inf' AS DOUBLE) ELSE round(log10(page_id % 50), 9) END AS log FROM pages")
def log10_values(spark, d):
    return table(spark, d, "pages").select("page_id", rounded(T.log10(F.col("page_id") % 50)).alias("log"))


@query(r"""SELECT 'all_if' AS rule, page_id FROM pages WHERE regexp_full_match(url, '.*\.org/.*') UNION ALL SELECT 'all_if_not', page_id FROM pages WHERE NOT regexp_full_match(url, '.*\.org/.*')
UNION ALL SELECT 'contents_if', length(html) FROM pages WHERE regexp_full_match(url, '.*\.org/.*') UNION ALL SELECT 'contents_if_not', length(html) FROM pages WHERE NOT regexp_full_match(url, '.*\.org/.*')""")
def header_filters(spark, d):
    """The four filters by a header, with the rows or with their contents."""
    rows = table(spark, d, "pages").select("page_id", F.col("html").alias("content"), F.create_map(F.lit("Target"), "url").alias("optionalHeaderFlds"))
    out = [(f.__name__, f(rows, "target", r".*\.org/.*").select(value.cast("long").alias("page_id"))) for f, value in ((C.all_if, F.col("page_id")), (C.all_if_not, F.col("page_id")), (C.contents_if, F.length("content")), (C.contents_if_not, F.length("content")))]
    union = None
    for rule, part in out:
        part = part.select(F.lit(rule).alias("rule"), "page_id")
        union = part if union is None else union.unionByName(part)
    return union


@query("SELECT count(*) AS n, count(*) AS luids, count(*) AS uuids FROM pages")
def fresh_ids(spark, d):
    rows = table(spark, d, "pages").select(R.luid().alias("l"), R.random_uuid().alias("u"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l").alias("luids"), F.countDistinct("u").alias("uuids"))


@query("SELECT n_nationkey AS key, n_name AS name, 'nation' AS kind, 1 AS one FROM nation WHERE n_name IS NOT NULL")
def tuple_of_all(spark, d):
    """A row as one tuple, its fields, and constants."""
    n = R.peek(table(spark, d, "nation").select("n_nationkey", "n_name"), n=1)
    rows = n.where(F.col("n_name").isNotNull()).select(R.as_tuple(n).alias("t"))
    return rows.select(F.col("t.n_nationkey").alias("key"), F.col("t.n_name").alias("name"), F.lit("nation").alias("kind"), F.lit(1).alias("one"))


_CHAT = "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'A' ELSE 'B' END AS who, replace(replace(replace(trim(text), chr(10), ' '), chr(13), ' '), ':', ';') AS text FROM conversations WHERE turn IS NOT NULL"


@query(f"""WITH s AS ({_CHAT}), m AS (SELECT *, CASE WHEN who IS DISTINCT FROM lag(who) OVER w THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM m)
SELECT CAST(conv_id AS VARCHAR) AS call_id, CAST(island AS BIGINT) AS island, who AS role, trim(string_agg(trim(text), ' ' ORDER BY turn)) AS text,
  CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS topic FROM i GROUP BY conv_id, island, who""")
def transcripts(spark, d):
    """Conversations as transcript files of lines ``from to X: text``, their turns merged, and their topics."""
    chats = table(spark, d, "conversations").where("turn IS NOT NULL")
    said = F.replace(F.translate(F.trim("text"), "\n\r", "  "), F.lit(":"), F.lit(";"))
    line = F.concat(F.lit("0.10 1.20 "), F.when(F.col("role") == "user", "A").otherwise("B"), F.lit(": "), F.coalesce(said, F.lit("")))
    files = chats.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda t: t["line"]), "\n").alias("text"))
    files = files.select(F.concat(F.lit("calls/"), "conv_id", F.lit(".txt")).alias("path"), "text", "conv_id")
    topics = spark.createDataFrame([(0, "even"), (1, "odd")], "topic_id long, topic string")
    file_topic = files.select(F.col("conv_id").cast("string").alias("call_id"), F.pmod("conv_id", F.lit(2)).cast("long").alias("topic_id"))
    return C.transcripts(files.drop("conv_id"), file_topic, topics).select("call_id", "island", "role", "text", "topic")


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS topic FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def topic_lookup(spark, d):
    topics = spark.createDataFrame([(0, "bad"), (1, "good")], "topic_id long, topic string")
    marks = table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("topic_id"))
    return C.with_topic(table(spark, d, "documents").select("doc_id"), marks, topics, "doc_id").select("doc_id", "topic")


def _frames(batches, packed: bool):
    import pyarrow as pa

    for batch in batches:
        data = b"".join(crawl.encode_frame(u, "2020", i, ("HTTP/1.0 200 OK\r\nContent-Type: Text/HTML\r\n\r\n" + (h or "")).encode(), packed) for i, u, h in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield pa.RecordBatch.from_pydict({"stream": [data]})


def _pages(batches, packed: bool):
    import pyarrow as pa

    for batch in batches:
        for data in batch.column(0).to_pylist():
            rows = list(crawl.decode_frames(data, packed))
            kinds = {"url": pa.string(), "position": pa.int64(), "raw": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))


@query("SELECT page_id, url, html, 'text' AS kind, 'Text/HTML' AS type FROM pages")
def crawl_frames(spark, d):
    """Pages as a packed framed stream, decoded, with headers and content apart."""
    rows = table(spark, d, "pages").select("page_id", "url", "html").mapInArrow(lambda it: _frames(it, True), "stream binary")
    pages = crawl.records(rows.mapInArrow(lambda it: _pages(it, True), "url string, position long, raw binary").withColumn("raw", T.as_text("raw")))
    return pages.select(F.col("position").alias("page_id"), "url", F.col("content").alias("html"), F.col("content_kind").alias("kind"), F.col("httpHeader")["content-type"].alias("type"))


@query(f"SELECT token AS word, count(*) AS count FROM ({_TOKENS}) WHERE token NOT IN {_STOP} GROUP BY token")
def streaming_counts(spark, d):
    """An extension: the word counts of a growing folder, after all that is there."""
    docs, marks, out = (work_folder(spark, n) for n in ("stream", "marks", "counts"))
    rows = table(spark, d, "documents").select("doc_id", "text")
    # Three steps of the stream, each over as many files as keep all cores busy: every step gives out all words so far.
    files = -(-max(rows.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism) // 3)
    rows.repartition(3 * files).write.parquet(docs)
    words = live.running_counts(live.read_growing(spark, docs, "doc_id long, text string", files))
    last = live.into_folder(words, out, marks)
    return spark.read.schema(words.schema).parquet(last) if last else spark.createDataFrame([], words.schema)
