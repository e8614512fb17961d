"""Named operators: parameters are validated, results are DataFrames.

    run(spark, "warcNgrams", {"WARC_FILE": "a.warc", "ARITY": 3})

With a destination parameter the result is written there as well; an existing
destination is an error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arkloom.functions import html as H
from arkloom.functions import rows as R
from arkloom.functions import stats as S
from arkloom.functions import text as T
from arkloom.plans import corpus as C
from arkloom.sources import crawl
from arkloom.sources import text as X
from arkloom.sources.warc import read_warc, write_warc

#: Operators that look into content leave out documents of so many bytes and more, unless MAX_BYTES says otherwise (-1: none).
MOST_BYTES = 700_000


class OperatorError(Exception):
    """Base of what goes wrong with a named operator."""


class NotImplementedOperator(OperatorError):
    """No operator has this name."""


class ParameterError(OperatorError):
    """A parameter is missing, unknown or of the wrong kind."""


class StartError(OperatorError):
    """The job failed before Spark ran anything."""


class CommunicationError(OperatorError):
    """Server and client could not talk."""


@dataclass(frozen=True)
class Operator:
    name: str
    run: Callable[..., DataFrame | tuple[DataFrame, ...]]
    required: dict[str, type]
    optional: dict[str, object] = field(default_factory=dict)
    dest: tuple[str, ...] = ()
    warc: bool = False
    #: The name of the result, as a client may ask for it.
    result: str = "result"


REGISTRY: dict[str, Operator] = {}


def operator(name: str, required: dict[str, type], optional: dict[str, object] | None = None, dest: tuple[str, ...] = (), warc: bool = False):
    def add(f):
        REGISTRY[name] = Operator(name, f, required, optional or {}, dest, warc, name + "Result")
        return f

    return add


def validated(op: Operator, params: dict) -> dict:
    unknown = set(params) - set(op.required) - set(op.optional) - set(op.dest)
    if unknown:
        raise ParameterError(f"{op.name} has no parameter {', '.join(sorted(unknown))}")
    out = {}
    for k, kind in op.required.items():
        if k not in params:
            raise ParameterError(f"{op.name} needs {k}")
        try:
            out[k] = params[k] if kind is object else kind(params[k])
        except (TypeError, ValueError) as error:
            raise ParameterError(f"{op.name}: {k}={params[k]!r}") from error
    for k, default in op.optional.items():
        value = params.get(k, default)
        try:
            out[k] = type(default)(value) if default is not None and value is not None else value
        except (TypeError, ValueError) as error:
            raise ParameterError(f"{op.name}: {k}={value!r}") from error
    return out


def run(spark: SparkSession, name: str, params: dict) -> DataFrame | tuple[DataFrame, ...]:
    """The operator's result; written to its destinations if they are given."""
    if name not in REGISTRY:
        raise NotImplementedOperator(name)
    op = REGISTRY[name]
    try:
        out = op.run(spark, **validated(op, params))
    except ValueError as error:
        raise ParameterError(f"{op.name}: {error}") from error
    dests = [params[d] for d in op.dest if params.get(d)]
    many = out if isinstance(out, tuple) else (out,)
    if dests:
        # Each destination is a job of its own, which reads the source.
        for df, dest in zip(many, dests, strict=False):
            if op.warc:
                write_warc(df, dest, **({"compression": "gzip"} if dest.endswith(".gz") else {}))
            else:
                spread = df.select(*[F.split(c, ",").alias(c) if c == "words" else c for c in df.columns])
                X.write_delimited(spread, dest, ",", "gzip" if dest.endswith(".gz") else None)
    return out


def _content() -> F.Column:
    return T.as_text("content")


def _small(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    rows = read_warc(spark, path).where("content IS NOT NULL")
    return rows.where(F.octet_length("content") < most) if most >= 0 else rows


@operator("warcRecordCount", {"WARC_FILE": str})
def warc_record_count(spark, WARC_FILE):  # noqa: N803
    return read_warc(spark, WARC_FILE, ["warcRecordId"]).agg(F.count("warcRecordId").alias("count"))


def word_count(rows: DataFrame, html: F.Column) -> DataFrame:
    return C.count_tokens(rows, T.tokenise(H.strip_html(html)["text"])).orderBy("word")


@operator("warcWordCount", {"WARC_FILE": str}, dest=("WORD_COUNT_DEST",))
def warc_word_count(spark, WARC_FILE):  # noqa: N803
    return word_count(read_warc(spark, WARC_FILE), _content())


def _crawl(spark: SparkSession, source: object, server: str, sites: str, splits: int) -> DataFrame:
    """Pages (url, content): a table of them, the path of one in Parquet, or a crawl by its name, with a server that has it."""
    if isinstance(source, DataFrame):
        return source
    if server:
        return crawl.records(crawl.read_crawl(spark, str(source), server, sites, splits).withColumn("raw", T.as_text("raw")))
    return spark.read.parquet(str(source))


_CRAWL = {"CRAWL_SERVER": "", "CRAWL_SITES": "", "CRAWL_SPLITS": 1}


@operator("webBaseWordCount", {"CRAWL_SOURCE": object}, _CRAWL, dest=("WORD_COUNT_DEST",))
def crawl_word_count(spark, CRAWL_SOURCE, CRAWL_SERVER, CRAWL_SITES, CRAWL_SPLITS):  # noqa: N803
    return word_count(_crawl(spark, CRAWL_SOURCE, CRAWL_SERVER, CRAWL_SITES, CRAWL_SPLITS), F.col("content"))


@operator("buildWebBaseIndex", {"CRAWL_SOURCE": object}, {"include_summary": False} | _CRAWL, dest=("URL_MAP_DEST", "INDEX_DEST"))
def build_index(spark, CRAWL_SOURCE, include_summary, CRAWL_SERVER, CRAWL_SITES, CRAWL_SPLITS):  # noqa: N803
    """(docID, url) and (token, docID, pos) of pages (url, content), by token and docID; ids are hashes of URLs, so both outputs agree."""
    docs = _crawl(spark, CRAWL_SOURCE, CRAWL_SERVER, CRAWL_SITES, CRAWL_SPLITS).select(F.sha1("url").alias("docID"), "url", "content")
    index = C.postings(docs, "docID", "content")
    if include_summary:
        stats = C.doc_stats(docs, "docID", "content")
        index = index.unionByName(stats.select(F.lit("na").alias("token"), "docID", F.col("n_tokens").alias("pos")))
    return docs.select("docID", "url"), index.orderBy("token", "docID")


@operator("warcNgrams", {"WARC_FILE": str}, {"ARITY": 2, "FILTER_STOPWORDS": 0, "WORD_LEN_MIN": 2, "WORD_LEN_MAX": 20, "MAX_BYTES": MOST_BYTES}, dest=("NGRAM_DEST",))
def warc_ngrams(spark, WARC_FILE, ARITY, FILTER_STOPWORDS, WORD_LEN_MIN, WORD_LEN_MAX, MAX_BYTES):  # noqa: N803
    rows = _small(spark, WARC_FILE, MAX_BYTES).select(_content().alias("text"))
    return C.count_ngrams(rows, "text", ARITY, bool(FILTER_STOPWORDS), WORD_LEN_MIN, WORD_LEN_MAX).orderBy("words")


def _counted(spark: SparkSession, path: str, count_pos: int = 0) -> DataFrame:
    """(count, words) of lines of n-grams and their count, which stands first or last."""
    f = X.read_delimited(spark, path, ",")
    n = F.size("fields")
    at = F.lit(count_pos) if count_pos >= 0 else n + count_pos
    words = F.array_join(F.filter("fields", lambda x, i: i != at), ",")
    return f.select(F.get("fields", at).try_cast("int").alias("count"), words.alias("words"))


@operator("ngramFrequencies", {"NGRAM_FILE": str}, dest=("FREQS_DEST",))
def ngram_frequencies(spark, NGRAM_FILE):  # noqa: N803
    return C.frequency_of_frequency(_counted(spark, NGRAM_FILE)).orderBy("freq")


@operator("goodTuring", {"FREQS_FILE": str}, {"ENSURE_ONE": False}, dest=("PROBABILITIES_DEST",))
def good_turing(spark, FREQS_FILE, ENSURE_ONE):  # noqa: N803
    """(freq, probability) of the frequencies that ngramFrequencies writes."""
    return S.good_turing(X.read_delimited(spark, FREQS_FILE, ",", "freq int, freq_of_freq long"), ensure_one=ENSURE_ONE).orderBy("freq")


@operator("textNgramProbabilities", {"TEXT_FILE": str}, {"ARITY": 2}, dest=("DEST",))
def text_ngram_probabilities(spark, TEXT_FILE, ARITY):  # noqa: N803
    """(words, count, probability) of a plain text's n-grams."""
    return C.ngram_probabilities(spark.read.text(TEXT_FILE, wholetext=True).select(F.col("value").alias("text")), "text", ARITY)


@operator("smoothNgrams", {"NGRAM_FILE": str, "FREQS_FILE": str}, {"LIMIT": -1}, dest=("DEST",))
def smooth_ngrams(spark, NGRAM_FILE, FREQS_FILE, LIMIT):  # noqa: N803
    probabilities = X.read_delimited(spark, FREQS_FILE, ",", "freq int, probability double")
    return C.smooth_ngrams(_counted(spark, NGRAM_FILE), probabilities, LIMIT)


@operator("cullNgrams", {"NGRAM_FILE": str}, {"MIN_LENGTH": 2, "MAX_LENGTH": -1, "COUNT_POS": -1}, dest=("CULLED_DEST",))
def cull_ngrams(spark, NGRAM_FILE, MIN_LENGTH, MAX_LENGTH, COUNT_POS):  # noqa: N803
    """(words, count) of n-grams all of whose words are long enough and no stopwords."""
    rows = _counted(spark, NGRAM_FILE, COUNT_POS)
    return rows.where(~T.has_stopword("words") & T.lengths_between(MIN_LENGTH, MAX_LENGTH, "words")).select("words", "count")


@operator("warcFilter", {"WARC_FILE": str, "WARC_FIELD": str, "REGEX": str}, {"MISSING": "keep", "MAX_BYTES": MOST_BYTES}, dest=("FILTERED_DEST",), warc=True)
def warc_filter(spark, WARC_FILE, WARC_FIELD, REGEX, MISSING, MAX_BYTES):  # noqa: N803
    return C.keep_if(_small(spark, WARC_FILE, MAX_BYTES), WARC_FIELD, REGEX, MISSING)


@operator("warcSetAside", {"WARC_FILE": str, "PERCENTAGE": float}, {"SEED": 0, "MAX_BYTES": MOST_BYTES}, dest=("DEST_SAMPLE", "DEST_MAIN"), warc=True)
def warc_set_aside(spark, WARC_FILE, PERCENTAGE, SEED, MAX_BYTES):  # noqa: N803
    return C.set_aside(_small(spark, WARC_FILE, MAX_BYTES), "warcRecordId", PERCENTAGE, SEED)


@operator("warcStripHTML", {"WARC_FILE": str}, {"ROBUST": False, "MAX_BYTES": MOST_BYTES}, dest=("STRIPPED_DEST",), warc=True)
def warc_strip_html(spark, WARC_FILE, ROBUST, MAX_BYTES):  # noqa: N803
    rows = _small(spark, WARC_FILE, MAX_BYTES)
    text = (H.strip_html_robust if ROBUST else H.strip_html)(_content())
    rows = rows.withColumn("__s", text)
    body = F.encode(F.col("__s.text"), "UTF-8")
    return rows.select("warcRecordId", F.octet_length(body).alias("contentLength"), "date", "warc_type", "optionalHeaderFlds", body.alias("content"), F.col("__s.text_len").alias("text_len"))


@operator("warcGetTextOnly", {"infile": str}, dest=("outfile",))
def warc_text_only(spark, infile):
    """Content of records, once for each header whose value names a .txt or .html file."""
    rows = read_warc(spark, infile).select("content", F.explode(F.map_values("optionalHeaderFlds")).alias("value"))
    return rows.where(F.col("value").rlike(r"\.(txt|html)")).select(_content().alias("content"))


@operator("concatColumns", {"RELATION_FILE": str, "SLICE_SPEC": str}, {"CONCAT_SEPARATOR": ""}, dest=("CONCAT_DEST",))
def concat_columns(spark, RELATION_FILE, SLICE_SPEC, CONCAT_SEPARATOR):  # noqa: N803
    """Lines may differ in length; where a line's slice is empty the result is null."""
    rows = X.read_delimited(spark, RELATION_FILE, ",")
    return rows.select(R.concat_fields(F.col("fields"), SLICE_SPEC, CONCAT_SEPARATOR).alias("concat"))


@operator("jaccardSim", {"BAG1": str, "BAG2": str}, dest=("DEST",))
def jaccard_sim(spark, BAG1, BAG2):  # noqa: N803
    read = lambda p: spark.read.text(p).where("value <> ''")
    return S.jaccard(read(BAG1), read(BAG2))
