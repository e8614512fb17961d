"""The library's own queries over the driver's tables, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arkloom.functions import html as H
from arkloom.functions import rows as R
from arkloom.functions import stats as S
from arkloom.functions import text as T
from arkloom.operators.registry import MOST_BYTES
from arkloom.plans import corpus as C
from arkloom.sources import crawl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: F.Column | str, digits: int = 9) -> F.Column:
    return F.round(c, digits)


_SEP = r"[\s\x{00A0}!\"#$%&/''()*+,\-.:;<=>?@\[\]^_`{|}]"
_STOP = "(" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + ")"
_TOKENS = f"SELECT doc_id, pos - 1 AS pos, token FROM (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, list_filter(string_split_regex(text, '{_SEP}'), lambda x: x <> '') AS w FROM documents))"
_WORDS = "SELECT doc_id, list_filter(string_split_regex(text, '[^A-Za-z0-9_]+'), lambda x: x <> '') AS w FROM documents"


def _grams(n: int) -> str:
    return f"SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - {n} + 2, 1)), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ','))) AS words FROM ({_WORDS})"


def _counted(n: int, stop: bool) -> str:
    extra = f"AND len(list_filter(string_split(words, ','), lambda x: x IN {_STOP})) = 0" if stop else ""
    return f"""SELECT count(*) AS count, words FROM ({_grams(n)})
WHERE regexp_full_match(words, '[a-zA-Z,]+') AND len(list_filter(string_split(words, ','), lambda x: length(x) < 2 OR length(x) > 20)) = 0 {extra}
GROUP BY words HAVING count(*) > 1"""


@query(f"SELECT token AS word, count(*) AS count FROM ({_TOKENS}) WHERE token NOT IN {_STOP} GROUP BY token")
def token_count(spark, d):
    return C.count_tokens(table(spark, d, "documents"), T.tokenise("text"))


@query("SELECT word, count(*) AS count FROM (SELECT unnest(list_filter(string_split_regex(text, '[\\s\",()*]+'), lambda x: x <> '')) AS word FROM documents) GROUP BY word")
def token_count_builtin(spark, d):
    return C.count_tokens(table(spark, d, "documents"), T.builtin_tokenise("text"))


@query("""SELECT CAST(row_number() OVER (ORDER BY count DESC, word) AS INTEGER) AS rank, word, count FROM (
  SELECT word, count(*) AS count FROM (SELECT unnest(list_filter(string_split_regex(text, '[\\s\",()*]+'), lambda x: x <> '')) AS word FROM documents) GROUP BY word)
QUALIFY row_number() OVER (ORDER BY count DESC, word) <= 100""")
def top_words(spark, d):
    """A report of the hundred most frequent words."""
    best = C.count_tokens(table(spark, d, "documents"), T.builtin_tokenise("text")).orderBy(F.desc("count"), "word").limit(100)
    return best.select(F.row_number().over(Window.orderBy(F.desc("count"), "word")).alias("rank"), "word", "count")


@query(_counted(2, False))
def ngrams_2(spark, d):
    return C.count_ngrams(table(spark, d, "documents"), "text", 2)


@query(_counted(3, True))
def ngrams_3(spark, d):
    return C.count_ngrams(table(spark, d, "documents"), "text", 3, filter_stopwords=True)


@query(f"SELECT words, count(*) AS n FROM (SELECT DISTINCT doc_id, words FROM ({_grams(2)} UNION ALL SELECT doc_id, unnest(w) FROM ({_WORDS}))) GROUP BY words")
def ngrams_all_distinct(spark, d):
    """Documents of each distinct n-gram of one or two words."""
    rows = table(spark, d, "documents").select(F.explode(T.ngrams(T.plain_words("text"), 2, down_to=1, distinct=True)).alias("words"))
    return rows.groupBy("words").agg(F.count(F.lit(1)).alias("n"))


_FOF = f"SELECT CAST(count AS INTEGER) AS freq, count(*) AS freq_of_freq FROM (SELECT count(*) AS count FROM ({_grams(2)}) GROUP BY words) GROUP BY count"


def _all_bigrams(spark, d):
    grams = table(spark, d, "documents").select(F.explode(T.ngrams(T.plain_words("text"), 2)).alias("words"))
    return grams.groupBy("words").agg(F.count(F.lit(1)).alias("count")).select("count", "words")


@query(_FOF)
def ngram_freq_of_freq(spark, d):
    return C.frequency_of_frequency(_all_bigrams(spark, d))


def good_turing_sql(fof: str) -> str:
    """The tables of Simple Good-Turing, the last of them gt, from a query for (freq, freq_of_freq)."""
    return f"""
t0 AS (SELECT CAST(freq AS DOUBLE) AS r, CAST(freq_of_freq AS DOUBLE) AS n FROM ({fof})),
t1 AS (SELECT *, lag(r, 1, 0.0) OVER (ORDER BY r) AS i, lead(r) OVER (ORDER BY r) AS nr, lead(n) OVER (ORDER BY r) AS nn FROM t0),
t2 AS (SELECT *, 2 * n / (coalesce(nr, 2 * r - i) - i) AS z FROM t1),
fit AS (SELECT regr_slope(ln(z), ln(r)) AS b, regr_intercept(ln(z), ln(r)) AS a, sum(r * n) AS total, max(CASE WHEN r = 1 THEN n END) AS n1, count(*) AS k FROM t2),
t3 AS (SELECT r, n, nr, nn, (r + 1) * exp(a + b * ln(r + 1)) / exp(a + b * ln(r)) AS y, CASE WHEN nr = r + 1 THEN (r + 1) * nn / n END AS x, total, coalesce(n1 / total, 0) AS p0, k FROM t2, fit),
t4 AS (SELECT *, max(CASE WHEN x IS NULL OR abs(x - y) <= 1.96 * sqrt((r + 1) * (r + 1) * nn / (n * n) * (1 + nn / n)) THEN 1 ELSE 0 END) OVER (ORDER BY r) AS gone FROM t3),
t5 AS (SELECT *, CASE WHEN gone = 1 THEN y ELSE x END AS star FROM t4),
gt AS (SELECT CAST(r AS INTEGER) AS freq, (1 - p0) * star / sum(star * n) OVER () AS probability FROM t5 WHERE k >= 5 UNION ALL SELECT DISTINCT 0, p0 FROM t5 WHERE k >= 5)"""


_GT = good_turing_sql(_FOF)


@query(f"WITH {_GT} SELECT freq, round(probability, 9) AS probability FROM gt")
def good_turing(spark, d):
    return S.good_turing(ngram_freq_of_freq(spark, d)).select("freq", rounded("probability").alias("probability"))


@query(f"""WITH {_GT}, c AS ({_counted(2, False)})
SELECT round(probability, 9) AS probability, words FROM (SELECT *, row_number() OVER (PARTITION BY split_part(words, ',', 1) ORDER BY count DESC, words) AS k FROM c JOIN gt ON count = freq) WHERE k <= 3""")
def smooth_topk(spark, d):
    """The three likeliest followers of each word."""
    grams = _all_bigrams(spark, d)
    # Both sides come from one count of the corpus, whose shuffle is used twice.
    counts, gt = C.fit_ngrams(grams), S.good_turing(C.frequency_of_frequency(grams))
    return C.smooth_ngrams(counts, gt, 3, "count").select(rounded("probability").alias("probability"), "words")


@query(f"SELECT words, count FROM ({_counted(2, False)}) WHERE len(list_filter(string_split(words, ','), lambda x: x IN {_STOP} OR length(x) < 2)) = 0")
def cull_bigrams(spark, d):
    rows = C.count_ngrams(table(spark, d, "documents"), "text", 2)
    return rows.where(~T.has_stopword("words") & T.lengths_between(2, -1, "words")).select("words", "count")


_TF = f"SELECT doc_id, token, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY doc_id) AS tf FROM ({_TOKENS}) WHERE token NOT IN {_STOP} GROUP BY doc_id, token"


def _tf(spark, d):
    return S.row_term_frequencies(table(spark, d, "documents"), "doc_id", T.tokenise("text"))


@query(f"SELECT doc_id, token, n, round(tf, 9) AS tf FROM ({_TF})")
def term_frequency(spark, d):
    return _tf(spark, d).select("doc_id", "token", "n", rounded("tf").alias("tf"))


@query(f"""WITH tf AS ({_TF}), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token)
SELECT doc_id, token, n, round(tf, 9) AS tf, df, round(tf * log10((SELECT count(*) FROM documents) / (1.0 + df)), 9) AS tfidf FROM tf JOIN df USING (token)""")
def tfidf(spark, d):
    size = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n_docs"))
    out = S.tfidf_of(_tf(spark, d), size)
    return out.select("doc_id", "token", "n", rounded("tf").alias("tf"), "df", rounded("tfidf").alias("tfidf"))


@query(f"SELECT token, doc_id, CAST(pos AS INTEGER) AS pos FROM ({_TOKENS}) WHERE token NOT IN {_STOP}")
def postings(spark, d):
    return C.postings(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT page_id, url FROM pages")
def url_map(spark, d):
    return table(spark, d, "pages").select("page_id", "url")


@query(f"SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '{_SEP}'), lambda x: x <> '')) AS INTEGER) AS n_tokens FROM documents")
def doc_stats(spark, d):
    return C.doc_stats(table(spark, d, "documents"), "doc_id", "text")


_LANG = f"SELECT DISTINCT lang, token FROM ({_TOKENS}) JOIN documents USING (doc_id)"


@query(f"""WITH s AS ({_LANG}), a AS (SELECT token FROM s WHERE lang = 'en'), b AS (SELECT token FROM s WHERE lang = 'de')
SELECT (SELECT count(*) FROM a JOIN b USING (token)) / (SELECT CAST(count(*) AS DOUBLE) FROM (SELECT token FROM a UNION SELECT token FROM b)) AS jaccard""")
def jaccard_lang(spark, d):
    docs = table(spark, d, "documents")
    words = lambda lang: docs.where(F.col("lang") == lang).select(F.explode(T.tokenise("text", stop=False)).alias("token"))
    return S.jaccard(words("en"), words("de"))


_PART = "CAST('0x' || substr(md5('0:' || doc_id), 1, 8) AS BIGINT)"


@query(f"SELECT doc_id FROM documents WHERE {_PART} < CAST(floor(0.2 * 4294967296) AS BIGINT)")
def set_aside_sample(spark, d):
    return C.set_aside(table(spark, d, "documents").select("doc_id"), "doc_id", 20)[0]


@query(f"SELECT doc_id FROM documents WHERE {_PART} >= CAST(floor(0.2 * 4294967296) AS BIGINT)")
def set_aside_main(spark, d):
    return C.set_aside(table(spark, d, "documents").select("doc_id"), "doc_id", 20)[1]


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join(spark, d):
    """Documents without a label: the idiom of a co-group whose other side is empty."""
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT page_id, url FROM pages WHERE regexp_full_match(url, 'https?://[^/]*\\.org/.*')")
def filter_regex(spark, d):
    return C.keep_if(table(spark, d, "pages").select("page_id", "url"), "url", r"https?://[^/]*\.org/.*", "drop")


@query("SELECT doc_id, regexp_extract(text, '([A-Z][a-z]+ing)', 1) AS word FROM documents WHERE regexp_matches(text, '([A-Z][a-z]+ing)')")
def regex_extract(spark, d):
    return table(spark, d, "documents").where(F.col("text").rlike("([A-Z][a-z]+ing)")).select("doc_id", F.regexp_extract("text", "([A-Z][a-z]+ing)", 1).alias("word"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, '<a[\\s]+href[\\s]*=[\\s]*"[^>]*>(.*?)</a>', 1)) AS anchor FROM pages WHERE length(html) >= 15""")
def anchor_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(H.anchor_texts("html")).alias("anchor"))


def _strip_sql() -> str:
    t = "html"
    for tag in ("script", "style", "head", "title"):
        t = rf"regexp_replace({t}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', ' ', 'g')"
    t = rf"regexp_replace(regexp_replace({t}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    t = rf"trim(regexp_replace({t}, '[ \t\n\x0B\f\r]+', ' ', 'g'))"
    listed = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
    names, values = listed(H.ENTITIES), listed(H.ENTITIES.values())
    number, named = H.NUMERIC.replace(r"\A", "^"), H.NAMED.replace(r"\A", "^")
    code = f"coalesce(TRY_CAST(regexp_extract(p, '{number}', 1) AS INTEGER), TRY_CAST('0x' || regexp_extract(p, '{number}', 2) AS INTEGER))"
    one = f"""CASE WHEN coalesce({code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111, false) THEN chr({code}) || regexp_replace(p, '{number}', '')
      WHEN list_contains({names}, regexp_extract(p, '{named}', 1)) THEN {values}[list_position({names}, regexp_extract(p, '{named}', 1))] || regexp_replace(p, '{named}', '') ELSE '&' || p END"""
    return f"(SELECT s[1] || array_to_string(list_transform(s[2:], lambda p: {one}), '') FROM (SELECT string_split({t}, '&') AS s))"


@query(f"SELECT page_id, t AS text, CAST(length(t) AS INTEGER) AS text_len FROM (SELECT page_id, {_strip_sql()} AS t FROM pages)")
def strip_html(spark, d):
    return table(spark, d, "pages").select("page_id", H.strip_html("html").alias("s")).select("page_id", "s.text", "s.text_len")


@query()
def strip_html_robust(spark, d):
    return table(spark, d, "pages").select("page_id", H.strip_html_robust("html").alias("s")).select("page_id", "s.text", "s.text_len")


@query(r"SELECT page_id, regexp_replace('see ' || url || ' now', '\b(http://|https://)\S*\b', '', 'g') AS text FROM pages")
def remove_links(spark, d):
    return table(spark, d, "pages").select("page_id", T.remove_links(F.concat(F.lit("see "), "url", F.lit(" now"))).alias("text"))


@query("SELECT page_id, url AS token FROM (SELECT page_id, regexp_extract(url, '^[:/a-zA-Z0-9.*_+%?&=~-]+') AS url FROM pages)")
def url_tokens(spark, d):
    """URLs in running text come out of the tokeniser whole, up to their fragment."""
    rows = table(spark, d, "pages").select("page_id", F.posexplode(T.tokenise(F.concat(F.lit("see "), "url"))).alias("pos", "token"))
    return rows.where("pos = 1").select("page_id", "token")


@query("SELECT count(page_id) AS count FROM pages")
def record_count(spark, d):
    return table(spark, d, "pages").agg(F.count("page_id").alias("count"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M:%S') AS time FROM events")
def split_date_time(spark, d):
    rows = table(spark, d, "events").select("event_id", T.split_date_time(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("s"))
    return rows.select("event_id", "s.date", "s.time")


@query("SELECT n_nationkey, concat_ws('-', n_name, n_regionkey) AS joined FROM nation")
def concat_columns(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return n.select("n_nationkey", R.concat_columns(n, "1:3", "-").alias("joined"))


@query("""SELECT p_partkey, regexp_full_match(replace(p_name, ' ', ','), '[a-zA-Z,]+') AS letters, regexp_full_match(CAST(p_retailprice AS VARCHAR), '[-,.+0-9]*') AS numeric,
  regexp_full_match(p_brand, '[-.+0-9]*') AS number, len(list_filter(string_split(p_type, ' '), lambda x: length(x) > 8)) = 0 AS short, len(list_filter(string_split(p_type, ' '), lambda x: length(x) NOT BETWEEN 3 AND 9)) = 0 AS fitting FROM part""")
def csv_predicates(spark, d):
    csv = lambda c: F.replace(c, F.lit(" "), F.lit(","))
    return table(spark, d, "part").select(
        "p_partkey",
        T.only_letters(csv("p_name")).alias("letters"),
        T.fields_numeric(F.col("p_retailprice").cast("string")).alias("numeric"),
        T.is_number("p_brand").alias("number"),
        T.fields_at_most(csv("p_type"), 8).alias("short"),
        T.fields_between(csv("p_type"), 3, 9).alias("fitting"),
    )


_PUNCT = r"[!-/:-@\[-`{-~]"
_PLAIN = r"[^!-/:-@\[-`{-~]"


@query(f"SELECT DISTINCT word, CASE WHEN regexp_full_match(word, '{_PUNCT}*{_PLAIN}*{_PUNCT}*') THEN regexp_extract(word, '^{_PUNCT}*({_PLAIN}*){_PUNCT}*$', 1) ELSE word END AS chopped FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS word FROM documents)")
def chop(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")).distinct()
    return words.select("word", T.chop("word").alias("chopped"))


@query("""WITH m AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER w THEN 1 ELSE 0 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM m)
SELECT conv_id, CAST(island AS BIGINT) AS island, min(turn) AS first_turn, role, trim(string_agg(text, ' ' ORDER BY turn)) AS text FROM i GROUP BY conv_id, island, role""")
def merge_turns(spark, d):
    return C.merge_turns(table(spark, d, "conversations"))


@query(r"""WITH s AS (SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS site, count(*) AS pages FROM pages GROUP BY 1)
SELECT site, pages, before, CAST(floor(before / 20) AS BIGINT) AS split FROM (SELECT *, CAST(coalesce(sum(pages) OVER (ORDER BY site ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM s)""")
def split_plan(spark, d):
    return crawl.split_plan(table(spark, d, "pages"), 20)


@query("SELECT doc_id, source, quality, toxic FROM documents JOIN labels USING (doc_id)")
def lookup_join(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")


@query("SELECT n_nationkey, unnest([CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR)]) AS value FROM nation")
def columns_to_rows(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return n.select("n_nationkey", R.as_bag(n).alias("value"))


@query(f"SELECT doc_id, CAST(strlen(text) AS INTEGER) AS n_bytes FROM documents WHERE strlen(text) < {MOST_BYTES}")
def size_guard(spark, d):
    return table(spark, d, "documents").where(F.octet_length("text") < MOST_BYTES).select("doc_id", F.octet_length("text").alias("n_bytes"))


@query("SELECT length(token) AS len, count(*) AS n FROM (" + _TOKENS + ") GROUP BY 1")
def group_by_expression(spark, d):
    rows = table(spark, d, "documents").select(F.explode(T.tokenise("text", stop=False)).alias("token"))
    return rows.groupBy(F.length("token").cast("long").alias("len")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, split_part(text, ' ', 1) AS first, CAST(len(string_split(text, ' ')) - 1 AS INTEGER) AS n_rest FROM documents")
def first_and_rest(spark, d):
    parts = F.split("text", " ")
    return table(spark, d, "documents").select("doc_id", R.first(parts).alias("first"), F.size(R.rest(parts)).alias("n_rest"))
