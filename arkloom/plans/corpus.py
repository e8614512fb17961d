"""Plans of several steps over a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arkloom.functions import stats as S
from arkloom.functions import text as T


def count_tokens(rows: DataFrame, tokens: Column) -> DataFrame:
    """(word, count) over all rows' token arrays."""
    return rows.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def count_ngrams(rows: DataFrame, text: str, n: int = 2, filter_stopwords: bool = False, least: int = 2, most: int = 20, more_than: int = 1) -> DataFrame:
    """(count, words) of n-grams of letters whose words have fitting lengths, if they occur more than ``more_than`` times."""

    def fit(w: Column) -> Column:
        ok = T.only_letters(w) & T.lengths_between(least, most, w)
        return F.when(ok & T.is_content_word(w) if filter_stopwords else ok, w)

    # Unfit words become null, and runs that hold one are never built.
    grams = F.filter(T.ngrams(F.transform(T.plain_words(text), fit), n), lambda g: g.isNotNull())
    grams = rows.select(F.explode(grams).alias("words"))
    return grams.groupBy("words").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > more_than).select("count", "words")


def fit_ngrams(counts: DataFrame, least: int = 2, most: int = 20, more_than: int = 1) -> DataFrame:
    """Those of counted n-grams that ``count_ngrams`` keeps."""
    return counts.where(T.only_letters("words") & T.lengths_between(least, most, "words") & (F.col("count") > more_than))


def ngram_probabilities(rows: DataFrame, text: str = "text", n: int = 2) -> DataFrame:
    """(words, count, probability) of the n-grams of plain text by Good-Turing; stopwords and URLs are kept."""
    grams = rows.select(F.explode(T.ngrams(T.tokenise(text, stop=False), n)).alias("words"))
    counts = grams.groupBy("words").agg(F.count(F.lit(1)).alias("count"))
    probabilities = S.good_turing(frequency_of_frequency(counts))
    return counts.join(probabilities, F.col("count") == F.col("freq")).select("words", "count", "probability")


def frequency_of_frequency(counts: DataFrame, freq: str = "count") -> DataFrame:
    """(freq, freq_of_freq); rows without a number are left out."""
    rows = counts.select(F.col(freq).cast("string").try_cast("int").alias("freq")).where("freq IS NOT NULL")
    return rows.groupBy("freq").agg(F.count(F.lit(1)).alias("freq_of_freq"))


def smooth_ngrams(counts: DataFrame, probabilities: DataFrame, limit: int = -1, rank_col: str | None = None) -> DataFrame:
    """(probability, words) of the ``limit`` likeliest n-grams of each first word, ties by the words; -1: all.

    ``probabilities`` has one row a frequency; how it is joined is left to Spark.
    """
    rows = counts.join(probabilities, F.col("count") == F.col("freq"))
    if limit < 0:
        return rows.select("probability", "words")
    order = F.desc("probability") if rank_col is None else F.desc(rank_col)
    per = Window.partitionBy(F.substring_index("words", ",", 1)).orderBy(order, "words")
    return rows.withColumn("__rank", F.row_number().over(per)).where(F.col("__rank") <= limit).select("probability", "words")


def postings(docs: DataFrame, doc: str, text: str, stop: bool = True, url: bool = True, regex: str | None = None) -> DataFrame:
    """(token, doc, pos): positions count stopwords, so those that are kept tell the distance between words."""
    tokens = docs.select(F.col(doc), F.posexplode(T.tokenise(text, regex, stop=False, url=url)).alias("pos", "token"))
    tokens = tokens.where(T.is_content_word("token")) if stop else tokens
    return tokens.select("token", doc, "pos")


def doc_stats(docs: DataFrame, doc: str, text: str, url: bool = True) -> DataFrame:
    """(doc, n_tokens) with stopwords counted."""
    return docs.select(doc, F.size(T.tokenise(text, stop=False, url=url)).alias("n_tokens"))


def set_aside(rows: DataFrame, key: str, percent: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(sample, rest): a split by hash of the key; reruns agree and no row is in both or neither."""
    part = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")
    in_sample = part < int(percent / 100 * 2**32)
    return rows.where(in_sample), rows.where(~in_sample)


def merge_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, island, first_turn, role, text): consecutive turns of one speaker joined and trimmed.

    Gaps and islands by windows over thin keys; the one array is an island's texts.
    """
    w = Window.partitionBy(conv).orderBy(turn)
    rows = rows.select(conv, turn, role, text, (~F.lag(role).over(w).eqNullSafe(F.col(role))).cast("int").alias("new"))
    rows = rows.withColumn("island", F.sum("new").over(w))
    merged = rows.groupBy(conv, "island", role).agg(F.sort_array(F.collect_list(F.struct(turn, text))).alias("ts"))
    joined = F.trim(F.array_join(F.transform("ts", lambda t: t[text]), " "))
    return merged.select(conv, F.col("island").cast("long").alias("island"), F.get("ts", 0)[turn].alias("first_turn"), role, joined.alias("text"))


def transcript_turns(files: DataFrame, text: str = "text") -> DataFrame:
    """(path, turn, role, text) of transcript lines ``from to X: what is said``; lines without a colon are left out."""
    lines = files.select("path", F.posexplode(F.split(text, r"\r?\n")).alias("turn", "line")).where(F.col("line").contains(":") & ~F.col("line").startswith("#"))
    parts = F.split("line", ":")
    return lines.select("path", "turn", F.right(parts[0], F.lit(1)).alias("role"), F.trim(parts[1]).alias("text"))


def transcripts(files: DataFrame, file_topic: DataFrame, topics: DataFrame) -> DataFrame:
    """(call_id, topic_id, topic, island, first_turn, role, text) of transcript files (path, text).

    A file is named by its call; consecutive turns of one speaker are merged, and each
    row gets its call's topic from (call_id, topic_id) and (topic_id, topic).
    """
    turns = transcript_turns(files).withColumn("call_id", F.regexp_extract("path", r"([^/.]+)[^/]*$", 1))
    merged = merge_turns(turns.select("call_id", "turn", "role", "text"), "call_id")
    return with_topic(merged, file_topic, topics).select("call_id", "topic_id", "topic", "island", "first_turn", "role", "text")


def with_topic(rows: DataFrame, file_topic: DataFrame, topics: DataFrame, key: str = "call_id") -> DataFrame:
    """Joins a topic's description to each row by its file; rows without one are left out."""
    return rows.join(file_topic, key).join(topics, "topic_id")


def keep_if(df: DataFrame, field: str, regex: str, missing: str = "keep", heads: str = "optionalHeaderFlds") -> DataFrame:
    """Rows whose field (a column or a header, names in any case) matches as a whole.

    ``missing`` says what becomes of rows that lack the field: keep or drop.
    """
    columns = {c.lower(): c for c in df.columns}
    aliases = {"warc-record-id": "warcRecordId", "content-length": "contentLength", "warc-date": "date", "warc-type": "warc_type"}
    name = columns.get(field.lower()) or (aliases.get(field.lower()) if aliases.get(field.lower()) in df.columns else None)
    if name:
        value = F.col(name)
        value = T.as_text(value) if dict(df.dtypes)[name] == "binary" else value.cast("string")
    else:
        found = F.filter(F.map_entries(heads), lambda e: F.lower(e["key"]) == field.lower())
        value = F.get(found, 0)["value"]
    return df.where(F.coalesce(value.rlike(rf"\A(?:{regex})\z"), F.lit(missing == "keep")))


def all_if(df: DataFrame, field: str, regex: str) -> DataFrame:
    return keep_if(df, field, regex, "drop")


def all_if_not(df: DataFrame, field: str, regex: str) -> DataFrame:
    return keep_if(df, field, rf"(?!(?:{regex})\z)[\s\S]*", "keep")


def contents_if(df: DataFrame, field: str, regex: str) -> DataFrame:
    return all_if(df, field, regex).select("content")


def contents_if_not(df: DataFrame, field: str, regex: str) -> DataFrame:
    return all_if_not(df, field, regex).select("content")
