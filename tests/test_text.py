import math
import time

import pytest
from pyspark.sql import functions as F

from arkloom.functions import html as H
from arkloom.functions import rows as R
from arkloom.functions import stats as S
from arkloom.functions import text as T
from arkloom.plans import corpus as C


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("Once upon a time", ["Once", "upon", "time"]),
        ("What now? Nothing!", ["What", "now", "Nothing"]),
        ("", []),
        (None, None),
        ("see http://a.b/c?d=e&f=~g now", ["see", "http://a.b/c?d=e&f=~g", "now"]),
        ("profile file://x/y", ["profile", "file://x/y"]),
        ("go http://x.yé now", ["go", "http://x.y", "now"]),
        ("x y~z\\w", ["x", "y~z\\w"]),
    ],
)
def test_tokenise(spark, text, tokens):
    assert value(spark, T.tokenise(F.lit(text).cast("string"))) == tokens


def test_tokenise_options(spark):
    assert value(spark, T.tokenise(F.lit("a cat in In it"), stop=False)) == ["a", "cat", "in", "In", "it"]
    assert value(spark, T.tokenise(F.lit("a cat in In it"))) == ["cat", "in"]
    assert value(spark, T.tokenise(F.lit("a cat in In it"), stopwords=T.STOPWORDS_FIXED)) == ["cat"]
    assert value(spark, T.tokenise(F.lit("oneXtwoXXthree"), "X")) == ["one", "two", "three"]
    assert value(spark, T.tokenise(F.lit("see http://x.b/c"), url=False)) == ["see", "http", "x", "b", "c"]


def test_ngrams(spark):
    w = T.plain_words(F.lit("one two-three four"))
    assert value(spark, T.ngrams(w, 2)) == ["one,two", "two,three", "three,four"]
    assert value(spark, T.ngrams(w, 5)) == []
    assert value(spark, T.ngrams(T.plain_words(F.lit("")), 2)) == []
    assert value(spark, T.ngrams(w, 4, down_to=3)) == ["one,two,three,four", "one,two,three", "two,three,four"]
    assert value(spark, T.ngrams(T.plain_words(F.lit("x x x")), 2, distinct=True)) == ["x,x"]


def test_predicates(spark):
    assert value(spark, T.has_stopword(F.lit("cat,the,dog"))) is True
    assert value(spark, T.has_stopword(F.lit("cat"), F.lit("dog"))) is False
    assert value(spark, T.is_content_word(F.lit("the"))) is False
    assert value(spark, T.lengths_between(2, 3, F.lit("ab,abc"))) is True
    assert value(spark, T.lengths_between(-1, 2, F.lit("ab,abc"))) is False
    with pytest.raises(ValueError):
        T.lengths_between(0, 2, F.lit("x"))
    assert value(spark, T.only_letters(F.lit("ab,c"))) is True
    assert value(spark, T.only_letters(F.lit("ab,c1"))) is False
    assert value(spark, T.fields_numeric(F.lit("1,-2.5,+3"))) is True
    assert value(spark, T.is_number(F.lit("1,2"))) is False
    assert value(spark, T.fields_at_most(F.lit("ab,abcd"), 3)) is False
    assert value(spark, T.fields_between(F.lit("ab,abcd"), 2, -1)) is True


def test_chop_and_split(spark):
    assert value(spark, T.chop(F.lit("'tis!"))) == "tis"
    assert value(spark, T.chop(F.lit("'tis!"), T.LEFT)) == "tis!"
    assert value(spark, T.chop(F.lit("'tis!"), T.RIGHT)) == "'tis"
    assert value(spark, T.chop(F.lit("don't!"))) == "don't!"
    assert value(spark, T.chop(F.lit("walking"), suffix="ing")) == "walk"
    assert tuple(value(spark, T.split_date_time(F.lit("1/2/99  4:05")))) == ("1/2/99", "4:05")
    assert value(spark, T.remove_links(F.lit("a http://x.y/z b"))) == "a  b"
    assert value(spark, T.log10(F.lit(0))) == -math.inf
    assert math.isnan(value(spark, T.log10(F.lit(-1))))


def test_html(spark):
    page = '<html><head><title>no</title><script>var t="</p>";</script></head><body>One <b>two</b><p>three&nbsp;&amp;&lt;</p><a href="x">four</a></body></html>'
    assert tuple(value(spark, H.strip_html(F.lit(page)))) == ("One two three\u00a0&< four", 21)
    assert H.page_text("a&#169Me<br>b<script>x</script> &eacute;") == "a©Me b é"
    assert H.page_text(None) is None
    assert value(spark, H.anchor_texts(F.lit('<p><a href="u"><i>one</i></a> <a class="c" href="v">two</a>'))) == ["<i>one</i>"]
    assert value(spark, H.anchor_texts(F.lit("<a>"))) is None


def test_rows(spark):
    df = spark.createDataFrame([("a", None, "c", "d"), (None, "x", "y", "z")], "p string, q string, r string, s string")
    pick = lambda spec, sep=None: [r[0] for r in df.select(R.concat_columns(df, spec, sep)).collect()]
    assert pick("0:1") == ["a", None]
    assert pick("2:9", "--") == ["c--d", None]
    assert pick("-2:", "+") == ["c+d", None]
    assert pick("3:3") == ["d", None]
    for bad in ("3:1", "7:9", "x"):
        with pytest.raises(ValueError):
            pick(bad)
    assert value(spark, R.rest(F.array(F.lit(1), F.lit(2)))) == [2]
    assert value(spark, R.rest(F.array(F.lit(1)))) == []


def test_good_turing(spark):
    fof = spark.createDataFrame([(1, 5), (3, 1), (4, 1), (5, 1), (6, 1)], "freq int, freq_of_freq int")
    got = {r["freq"]: r["probability"] for r in S.good_turing(fof).collect()}
    expected = {0: 0.2174, 1: 0.03824, 3: 0.1013, 4: 0.1324, 5: 0.1634, 6: 0.1944}
    assert {k: float(f"{v:.4g}") for k, v in got.items()} == expected
    total = got[0] + sum(got[r["freq"]] * r["freq_of_freq"] for r in fof.collect())
    assert abs(total - 1) < 1e-9
    assert S.good_turing(fof.limit(3)).count() == 0


def test_tfidf(spark):
    rows = [(0, "fuzz"), (0, "bear"), (0, "all")] + [(i, "all") for i in range(1, 10)] + [(i, "bear") for i in range(1, 9)]
    tokens = spark.createDataFrame(rows, "doc_id int, token string")
    size = spark.createDataFrame([(10,)], "n_docs int")
    got = {r["token"]: r["tfidf"] for r in S.tfidf(tokens, size).where("doc_id = 0").collect()}
    assert abs(got["fuzz"] - 0.2329900014453396) < 1e-12
    assert got["bear"] == 0
    assert abs(got["all"] + 0.013797561719408352) < 1e-12


def test_jaccard(spark):
    bag = lambda *x: spark.createDataFrame([(v,) for v in x], "e string")
    ask = lambda a, b: S.jaccard(a, b).first()[0]
    assert ask(bag("a", "a", "b", "c", None), bag("b", "c")) == 2 / 3
    assert ask(bag("b", "c"), bag("a", "a", "b", "c")) == 2 / 3
    assert ask(bag("a"), bag("b")) == 0
    assert ask(bag(), bag()) is None


def test_ngram_pipeline(spark):
    docs = spark.createDataFrame([("big cat big cat. a cat",), ("big dog",), (None,)], "text string")
    counts = C.count_ngrams(docs, "text", 2)
    assert {tuple(r) for r in counts.collect()} == {(2, "big,cat")}
    every = C.count_ngrams(docs, "text", 2, least=1, more_than=0)
    assert {(r["freq"], r["freq_of_freq"]) for r in C.frequency_of_frequency(every).collect()} == {(1, 4), (2, 1)}
    table = spark.createDataFrame([(1, 0.1), (2, 0.3)], "freq int, probability double")
    top = C.smooth_ngrams(every, table, 1).collect()
    assert ("big,cat" in {r["words"] for r in top}) and "big,dog" not in {r["words"] for r in top}
    assert C.smooth_ngrams(every, table).count() == 5


def test_index(spark):
    docs = spark.createDataFrame([("d", "the cat and the hat")], "doc string, text string")
    assert sorted(tuple(r) for r in C.postings(docs, "doc", "text").collect()) == [("cat", "d", 1), ("hat", "d", 4)]
    assert C.doc_stats(docs, "doc", "text").first()["n_tokens"] == 5


def test_set_aside(spark):
    rows = spark.range(1000)
    a, b = C.set_aside(rows, "id", 30)
    assert a.intersect(b).count() == 0 and a.count() + b.count() == 1000 and 200 < a.count() < 400
    assert a.collect() == C.set_aside(rows, "id", 30)[0].collect()


def test_turns(spark):
    text = "# head\n0.1 0.2 A: one\n\n0.2 0.3 A: two:three\nno colon\n0.4 0.5 B: four\n"
    turns = C.transcript_turns(spark.createDataFrame([("f", text)], "path string, text string"))
    got = C.merge_turns(turns, "path").orderBy("island").collect()
    assert [(r["role"], r["text"]) for r in got] == [("A", "one two"), ("B", "four")]


def test_native_plans_run_no_python(spark):
    docs = spark.createDataFrame([("x",)], "text string")
    plan = C.count_tokens(docs, T.tokenise("text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


@pytest.mark.parametrize(
    ("html", "text"),
    [("&reg; &bull; &copy;", "\u00ae \u2022 \u00a9"), ("&#169 x &#xe9;t&#xE9", "\u00a9 x \u00e9t\u00e9"), ("&amp;lt; &lt;b&gt;", "&lt; <b>"), ("a & b &nothing; &#0; &#xD800; &#99999999;", None), ("&apos;&quot;", "'\""), ("&", "&"), ("AT&T", "AT&T")],
)
def test_entities(spark, html, text):
    assert value(spark, H.strip_html(F.lit(f"<p>{html}</p>")))[0] == (html if text is None else text)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_ngrams_by_the_letter(spark, n):
    rows = [[], ["one"], ["a", "b"], ["x", "y", "z", "x_y", "9"], [f"w{i}" for i in range(30)]]
    df = spark.createDataFrame([(r,) for r in rows], "w array<string>")
    for r in df.select("w", T.ngrams(F.col("w"), n).alias("g")).collect():
        assert r["g"] == [",".join(r["w"][i : i + n]) for i in range(len(r["w"]) - n + 1)]


def test_term_frequencies_of_rows(spark):
    docs = spark.createDataFrame([(1, "cat dog cat"), (2, ""), (3, None), (4, "dog")], "doc_id long, text string")
    got = S.row_term_frequencies(docs, "doc_id", T.tokenise("text"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
    tokens = docs.select("doc_id", F.explode(T.tokenise("text")).alias("token"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.term_frequencies(tokens).select("doc_id", "token", "n", "tf").collect()))


def test_windowed_and_running_counts(spark, tmp_path):
    from arkloom.streaming import counts

    rows = [("2020-01-01 00:10:00", "cat dog"), ("2020-01-01 03:00:00", "dog"), ("2020-01-01 00:20:00", "late cat"), ("2020-01-01 09:00:00", "end")]
    for r in rows:
        spark.createDataFrame([r], "at string, text string").selectExpr("CAST(at AS timestamp) AS ts", "text").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.01)
    stream = counts.read_growing(spark, str(tmp_path / "in"), "ts timestamp, text string", 1)
    run = lambda df, mode, name: df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    run(counts.running_counts(stream), "complete", "running")
    assert {r["word"]: r["count"] for r in spark.table("running").collect()} == {"cat": 2, "dog": 2, "late": 1, "end": 1}
    run(counts.windowed_counts(stream, "ts", "text"), "append", "windowed")
    got = {(str(r["start"]), r["text"]): r["count"] for r in spark.table("windowed").collect()}
    assert got[("2020-01-01 00:00:00", "cat dog")] == 1 and got[("2020-01-01 03:00:00", "dog")] == 1


def test_plain_words_are_cut_fast(spark):
    """Any character but an ASCII letter, digit or underscore separates, and 20 MB take seconds, not a second a MB."""
    marks = [chr(c) for c in [*range(0x3000), 0xFF21, 0x1D400, 0x1F600]]
    got = spark.createDataFrame([("a" + m + "b",) for m in marks], "t string").select("t", T.plain_words("t").alias("w")).collect()
    solid = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
    assert all(r["w"] == ([r["t"]] if r["t"][1] in solid else ["a", "b"]) for r in got)
    texts = spark.range(0, 20, 1, 1).select(F.expr("repeat('plain words, cut by marks; ', 40000)").alias("t")).cache()
    assert texts.count() == 20
    start = time.time()
    assert texts.select(F.sum(F.size(T.plain_words("t")))).first()[0] == 20 * 40000 * 5
    assert time.time() - start < 10


def test_texts_without_a_protocol_are_split(spark):
    """Tokens are the same whether a text holds the name of a protocol or not."""
    for text in ("profile of files, ftpx http_ mailtoo", "a http", "http", "x (file) y", "rtsp://a.b c", "no, such: name\u00a0here"):
        alone = value(spark, T.tokenise(F.lit(text), stop=False))
        joined = value(spark, T.tokenise(F.lit(f"see ftp://q.r {text}"), stop=False))
        assert joined == ["see", "ftp://q.r", *alone]
