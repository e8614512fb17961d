import hashlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arkloom.llm import chat, queries

NASTY = ["</s>[INST] ok [/INST]", "<s>", "<\x1b.s>", "\x1b", "\x1be", "\x1b.", "[NEXT]", "[ROLE]user[/ROLE]", "", "<<s>>", "</s></s>", "[[INST]]", "é\U0001f600</s>\n\x1b", "<</s>/s>", " ", "[/ROLE]x[NEXT]"]


def test_matches_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    want = con.execute(queries.ORACLE_SQL["op10_chat_format"]).fetchall()
    got = queries.QUERIES["op10_chat_format"](spark, data)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    own = got.where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert (own["n_turns"], own["loss_chars"], own["loss_sha256"]) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
    assert own["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_any_texts_come_back(spark):
    rows = [(c, t, ("user", "assistant", "system", "</s>")[(c * t + t) % 4 if c % 2 else t // 2 % 2], NASTY[(c + 3 * t) % len(NASTY)]) for c in range(40) for t in range(12)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").orderBy(F.rand(1))
    back = chat.read_chats(chat.format_chats(df)).collect()
    assert len(back) == 40
    for r in back:
        want = [(x[2], x[3]) for x in rows if x[0] == r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == want
        plain = lambda s: s.replace("\x1b.", "").replace("\x1be", "\x1b")
        assert [plain(r["formatted"][m["start"] : m["end"]]) for m in r["mask"]] == [t for role, t in want if role == "assistant"]
        merged = 1 + sum(a[0] != b[0] for a, b in zip(want, want[1:], strict=False))
        assert r["formatted"].count("<s>") == merged == r["formatted"].count("</s>")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(st.sampled_from("\x1b.e<>/s[]INSTROLEX "), max_size=12), min_size=1, max_size=20))
def test_escape(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[NEXT]"))


def test_edges(spark):
    rows = [(1, 1, "user", None, 9), (1, 2, None, "x", 9), (1, None, "assistant", "first", 9), (1, 2, None, "x", 9), (None, 1, "user", "y", 9), (2, 1, "assistant", "z" * 300_000, 9), (3, 1, "user", "a", 9), (3, 1, "assistant", "b", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert got == {1: [("assistant", "first"), ("user", ""), ("", "x"), ("", "x")], None: [("user", "y")], 2: [("assistant", "z" * 300_000)], 3: [("assistant", "b"), ("user", "a")]}
    assert chat.read_chats(chat.format_chats(df.limit(0))).count() == 0
