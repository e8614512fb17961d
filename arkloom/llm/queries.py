"""Queries of this subpackage: (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import quantised, top_k

    rows = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(rows.where("vec_id % 50 = 0"), rows)


query(op1_exact_topk)

ORACLE_SQL["op1_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


def op3_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


query(op3_budget_mix)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    return media_columns(table(spark, sf_dir, "documents"))


query(op6_media_columns)


def op8_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_archive import archive_pages

    return archive_pages(table(spark, sf_dir, "pages"))


query(op8_warc_chain)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats, read_chats, unescape

    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = read_chats(format_chats(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("mask", lambda m: unescape(F.substring("formatted", m["start"] + 1, m["end"] - m["start"]))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


query(op10_chat_format)

ORACLE_SQL["op10_chat_format"] = r"""
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), esc AS (
  SELECT *, length(regexp_replace(regexp_replace(replace(text, chr(27), chr(27) || 'e'), '([<\[])(/?s>|/?INST\]|/?ROLE\]|NEXT\])', '\1' || chr(27) || '.\2', 'g'), '$', '')) AS text_len,
    length(regexp_replace(replace(role, chr(27), chr(27) || 'e'), '([<\[])(/?s>|/?INST\]|/?ROLE\]|NEXT\])', '\1' || chr(27) || '.\2', 'g')) AS role_len,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM src
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_len + CASE WHEN before IS NOT DISTINCT FROM role THEN 6 ELSE 20 + role_len END) AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id
"""


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    return round_trip(spark, table(spark, sf_dir, "documents"))


query(op7_bpe_round_trip)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, remainder, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 4) == 2
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


query(op9_quality)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=2)


query(op5_near_duplicates)


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import remainder
    from .suffix_tree import score

    return score(table(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2)


query(op4_suffix_tree)


def op2_pii_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, pattern_table, told, with_spans

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = with_spans(docs, pattern_table(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))


query(op2_pii_contexts)

ORACLE_SQL["op8_warc_chain"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, strlen(t) AS n, sha1(t) AS x, row_number() OVER (PARTITION BY t ORDER BY page_id NULLS LAST) AS k, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, CAST(5 * g + 1 AS INTEGER), 5) AS BIGINT) >> s) & 31 AS INTEGER) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to FROM h
"""

_SPACES = r"[\x20\x09-\x0D]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LOW_WORDS = f"SELECT doc_id, list_filter(string_split_regex({_LOWER}, '{_SPACES}'), lambda x: x <> '') AS w FROM documents"

#: Pairs share one of their rarest shingles (as many as a similarity of 0.8 leaves out of a set, and one), and are held against whole sets.
ORACLE_SQL["op5_near_duplicates"] = f"""
WITH RECURSIVE s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END)) AS s FROM ({_LOW_WORDS})),
c AS (SELECT min(doc_id) AS cid, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
e AS (SELECT cid, n, unnest(s) AS t FROM c),
f AS (SELECT t, count(*) AS df FROM e GROUP BY t HAVING count(*) > 1),
r AS (SELECT cid, n, t, row_number() OVER (PARTITION BY cid ORDER BY df, t) AS k, count(*) OVER (PARTITION BY cid) AS m FROM e JOIN f USING (t)),
q AS (SELECT DISTINCT a.cid AS a, b.cid AS b FROM r a JOIN r b ON a.t = b.t AND a.cid < b.cid AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  WHERE a.k <= a.m - (4 * a.n + 4) // 5 + 1 AND b.k <= b.m - (4 * b.n + 4) // 5 + 1),
l AS (SELECT a, b FROM q JOIN c x ON x.cid = a JOIN c y ON y.cid = b WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (x.n + y.n - len(list_intersect(x.s, y.s)))),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
z AS (SELECT cid AS a, cid AS b FROM c UNION SELECT z.a, g.b FROM z JOIN g ON z.b = g.a),
k AS (SELECT a AS cid, min(b) AS comp FROM z GROUP BY a)
SELECT s.doc_id, CAST(coalesce(len(s.s), 0) AS BIGINT) AS n_shingles, coalesce(c.cid, s.doc_id) AS class_id, coalesce(comp, s.doc_id) AS component_id, s.doc_id = coalesce(comp, s.doc_id) AS kept
FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN k ON c.cid = k.cid
"""


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that SQL can say."""
    from .mixing import mix

    rows = mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


query(mix_targets)

ORACLE_SQL["mix_targets"] = f"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '{_SPACES}'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS n, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w FROM d GROUP BY source),
o AS (SELECT *, CAST(3.0 * n / w AS DOUBLE) AS ratio FROM s),
v AS (SELECT ratio, CAST((SELECT sum(n) FROM o) - coalesce((SELECT sum(3.0 * n) FROM o b WHERE b.ratio < a.ratio), 0) AS DOUBLE) / (SELECT sum(w) FROM o b WHERE b.ratio >= a.ratio) AS level FROM o a),
x AS (SELECT arg_min(level, ratio) AS level FROM v WHERE level <= ratio)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, round(CAST(least(3.0 * n, coalesce((SELECT level FROM x) * w, 3.0 * n)) AS DOUBLE), 6) AS target FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source
"""


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4 that SQL can say, with a split that it can say too."""
    from .suffix_tree import score

    rows = score(table(spark, sf_dir, "documents"), F.col("doc_id") % 7 != 2)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


query(lm_base)

ORACLE_SQL["lm_base"] = f"""
WITH t AS (SELECT doc_id, unnest(list_append(coalesce(w, []), ' ')) AS t FROM ({_LOW_WORDS})),
c AS (SELECT t, count(*) AS c FROM t WHERE doc_id % 7 <> 2 GROUP BY t),
a AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT doc_id, doc_id % 7 = 2 AS held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 4) AS base_score
FROM t LEFT JOIN c USING (t), a GROUP BY doc_id
"""


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2 that SQL can say."""
    from .pii import KINDS, with_base

    rows = with_base(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *map(count, KINDS))


query(pii_counts)

_OCTET = "0*(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
ORACLE_SQL["pii_counts"] = rf"""
SELECT doc_id, CAST(len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
  CAST(len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda m: regexp_full_match(m, '{_OCTET}(\.{_OCTET}){{3}}'))) AS BIGINT) AS n_ip,
  CAST(len(list_filter(list_transform(regexp_extract_all(t, '[0-9]([ -]?[0-9])+'), lambda m: regexp_replace(m, '[ -]', '', 'g')), lambda m: length(m) BETWEEN 14 AND 19
    AND list_sum(list_transform(range(1, length(m) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(m, CAST(length(m) - i + 1 AS INTEGER), 1) AS INTEGER)
      ELSE (2 * CAST(substr(m, CAST(length(m) - i + 1 AS INTEGER), 1) AS INTEGER)) // 10 + (2 * CAST(substr(m, CAST(length(m) - i + 1 AS INTEGER), 1) AS INTEGER)) % 10 END)) % 10 = 0)) AS BIGINT) AS n_card,
  CAST(len(list_filter(regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), lambda m: length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 10 AND 15)) AS BIGINT) AS n_phone
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
