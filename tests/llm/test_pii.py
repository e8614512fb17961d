import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from arkloom.llm import pii, queries

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def fine(kind, m):
    digits = [int(c) for c in m if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if fine(k, m[0])]
    return sorted(found)


def told(found):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)


NASTY = [
    "a@b.c", "x@@y.zz a@b", "..a@b-c.d.e. f@g..h", "a@b.c@d.e", "a@b@c.d", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.02.3.255", "01234567890.1.2.3", "1.2.3.4 1.2.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1111-1", "4111  1111 1111 1111", "00000000000000 0", "+1 (234) 567-8901", "+123456789", "++12345678901", "+1234567890123456", "+1--(.)-2345678901 x",
    "\U0001f600 a@b.c \U0001f600 +4912345678901", "", None, "9" * 5000, "a" * 5000 + "@", ("1.2.3." * 500), "+1 " * 300 + "2345678901", "a@b." * 200 + "c",
]


def test_base_spans_match_python(spark, data):
    rows = spark.createDataFrame([(t,) for t in NASTY], "text string").unionByName(spark.read.parquet(f"{data}/documents.parquet").select("text"))
    got = pii.with_base(rows.withColumn("__text", F.coalesce("text", F.lit("")))).collect()
    for r in got:
        assert [tuple(s) for s in r["base"]] == brute(r["text"]), r["text"]


def test_query(spark, data):
    got = queries.QUERIES["op2_pii_contexts"](spark, data)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in BASE] == [sum(w[3] == k for w in want) for k in BASE]
        assert r["base_sha256"] == hashlib.sha256(told(want).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(told(want).split(",")) - {""} <= set(spans)
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), list(BASE).index(s.split(":")[0])))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_contexts_find_what_the_patterns_lack(spark):
    known = [(i, f"Note {i}. Reach me by phone at +1 212 555 {1000 + i} or so. Mail goes to user{i}@site{i}.org today.") for i in range(60)]
    new = [(100, "Reach me by phone at 212-555-0199 or so."), (101, "Mail goes to root@localhost today."), (102, "The room at 212-555-0188 is free."), (103, "Room 17 of 2020.")]
    docs = spark.createDataFrame(known + new, "doc_id long, text string")
    found = pii.patterns(docs)
    assert found.get("phone at") == "phone" and found.get("goes to") == "email"
    got = {r["doc_id"]: r["spans"] for r in pii.with_spans(docs, found).select("doc_id", pii.told("spans").alias("spans")).collect()}
    assert got[100] == "phone:21:33" and got[101].startswith("email:13:") and got[103] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[100] == "Reach me by phone at <PHONE> or so." and clean[0].count("<EMAIL>") == 1 and clean[103] == new[3][1]


def test_found_instances_make_further_patterns(spark):
    """Numbers without + stand behind a seeded label and again behind another, which has no seed."""
    rows = [f"Reach me by phone at +1 212 555 {1000 + i} or so." for i in range(60)]
    rows += [f"Reach me by phone at 212-555-{2000 + i} or so." for i in range(8)] + [f"Sent a fax to 212-555-{2000 + i} again." for i in range(8)]
    rows += ["Sent a fax to 212-555-7777 again.", "Room 17 of 2020-11-30 is free."]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = pii.patterns(docs)
    assert found.get("phone at") == "phone" and found.get("fax to") == "phone"
    got = {r["doc_id"]: r["spans"] for r in pii.with_spans(docs, found).select("doc_id", pii.told("spans").alias("spans")).collect()}
    assert got[len(rows) - 2] == "phone:14:26" and got[len(rows) - 1] == ""


def test_a_sure_pattern_of_a_small_share_is_used(spark):
    rows = [f"Reach me by phone at +1 212 {1000000 + i} or so." for i in range(7000)]
    rows += [f"My desk line +1 212 {2000000 + i} rings." for i in range(6)] + ["My desk line 212-555-7777 rings."]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert pii.patterns(docs).get("desk line") == "phone"
    assert {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}[len(rows) - 1] == "My desk line <PHONE> rings."


def test_candidates_of_digits_at_every_second_place(spark):
    texts = ["call 5-5-5-1-2-3-4 now", "card 2 1 2 5 5 5 0 1 9 9"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = pii.with_candidates(df, "text").collect()
    assert [[c["m"] for c in r["candidates"]] for r in rows] == [["5-5-5-1-2-3-4"], ["2 1 2 5 5 5 0 1 9 9"]]


def replaced(text, spans):
    out, at = [], 0
    for s, _, e, k in spans:
        if s >= at:
            out += [text[at:s], f"<{k.upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


@pytest.mark.parametrize("step", [1, 3, 256])
def test_many_spans_in_runs(spark, monkeypatch, step):
    """Spans, contexts and redaction don't depend on the length of the runs that arrays are cut to."""
    monkeypatch.setattr(pii, "STEP", step)
    rng = random.Random(step)
    bits = ["a@b.c", "1.2.3.4", "+49 123 456 7890", "4111 1111 1111 1111", "word", "\U0001f600", "x@y.z.1.2.3.4", "555-0199-22", "\t\n", "Mail  to", "+1.2.3.4.5555.66777", "user@localhost"]
    texts = [" ".join(rng.choice(bits) for _ in range(n)) for n in (0, 1, 2, 5, 40, 900)] + ["a@b.c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.with_base(df, "text").collect():
        assert [tuple(x) for x in r["base"]] == brute(texts[r["doc_id"]])
    form = re.compile(r"(?<![A-Za-z0-9._%+@-])(?:[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]*[A-Za-z0-9]|[0-9(+][0-9().\x20-]*[0-9])")
    for r in pii.with_candidates(df, "text").collect():
        text, base, at, want = texts[r["doc_id"]], brute(texts[r["doc_id"]]), 0, []
        for m in form.finditer(text):
            words = text[at : m.start()].lower().split()
            at = m.end()
            if len(m[0]) >= 6:
                holds = [k for s, _, e, k in base if s <= m.start() and m.end() <= e]
                patterns = [*words[-1:], *([" ".join(words[-2:])] if len(words) > 1 else [])]
                want.append((m.start(), m.end(), m[0], patterns, (holds or [None])[0], any(s < m.end() and m.start() < e for s, _, e, _ in base)))
        assert [tuple(c) for c in r["candidates"]] == want
    for r in pii.replaced(pii.with_base(df.withColumn("__text", F.col("text"))).withColumnRenamed("base", "spans")).collect():
        assert r["text"] == replaced(texts[r["doc_id"]], brute(texts[r["doc_id"]]))


def test_a_very_long_text(spark):
    """Four megabytes with 20000 addresses take seconds."""
    text = " ".join("word " * 34 + f"mail to user{i}@site{i % 99}.org" for i in range(20_000))
    start = time.time()
    df = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert df.first()["text"] == re.sub(r"user\d+@site\d+.org", "<EMAIL>", text)
    assert time.time() - start < 60


def test_contexts_of_long_words_and_ties(spark):
    long = "l" * 5000
    rows = [f"{long} at +1 212 555 {1000 + i} or so." for i in range(60)] + [f"{long} at 212-555-0199 or so."]
    found = pii.patterns(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert found == {"at": "phone", f"{long} at": "phone"}
    rows = [f"call +1 212 555 {1000 + i} a" for i in range(60)] + [f"call x{i}@y.org a" for i in range(60)]
    assert pii.patterns(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), sure=0.4) == {"call": "phone"}


def test_edges(spark, odd_docs, no_docs):
    rows = pii.with_spans(odd_docs, pii.patterns(odd_docs)).collect()
    assert len(rows) == odd_docs.count() and all(r["spans"] == [] for r in rows)
    assert pii.redact(odd_docs).columns == odd_docs.columns
    assert sorted(map(repr, pii.redact(odd_docs).collect())) == sorted(map(repr, odd_docs.collect()))
    assert pii.with_spans(no_docs, pii.patterns(no_docs)).count() == 0 == pii.redact(no_docs).count()


@pytest.mark.parametrize("number", ["4111111111111111", "4111111111111112"])
def test_luhn(spark, number):
    assert spark.range(1).select(pii.luhn(F.lit(number))).first()[0] is fine("card", number)
