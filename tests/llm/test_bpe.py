import functools
import hashlib
import random
import time

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from arkloom.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
NASTY = [
    "", None, " ", "  ", "   ", "a  b", " a ", "a\n", "a\n\n", "\n\n\na", "a \n b", "\t\ta", "don't we'll I'M 'x", "x y", "　　x  ", "1234 5 67", "héllo wörld ß", "日本語 テキスト", "\U0001f600\U0001f600 ok",
    "<|endoftext|>", "a<|endoftext|>b <|endoftext|> <|endoftext|>", "<|endoftext|", "é ‍", "a" * 3000, "!" * 50 + " ?" * 20, "foo_bar-baz (qux)", "\x00\x01 \x7f", "\r\n\r\n x\r", "   ", "ﬁ ½ ²",
]


@functools.cache
def _merges():
    return bpe.Merges.load(PATH)


@pytest.fixture(scope="module")
def lib():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def coder(spark, data):
    return bpe.Encoder(bpe.build(spark.read.parquet(f"{data}/documents.parquet"), PATH))


def test_query(spark, data, lib):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.QUERIES["op7_bpe_round_trip"](spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nasty_texts(spark, lib):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(NASTY)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in bpe.round_trip(spark, docs).collect()}
    uri = bpe.build(docs, PATH)
    for r in bpe.encode(docs, uri).collect():
        want = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want, r["text"]
        assert rows[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(lib.decode(want, skip_special_tokens=False).encode()).hexdigest(), r["text"]


def test_long_words(lib):
    """A megabyte without a cut takes seconds, and merges as the library does."""
    rng = random.Random(1)
    merges = bpe.Merges.load(PATH)
    assert merges.ordered
    for text in ("".join(rng.choice("abcdefgh") for _ in range(1 << 20)), "".join(chr(rng.randrange(0x4E00, 0x5000)) for _ in range(200_000)), "ab" * 5000, "".join(rng.choice(["the", "ing", "str", "nation"]) for _ in range(3000))):
        start = time.time()
        assert merges.ids([text])[0].tolist() == lib.encode(text, add_special_tokens=False).ids
        assert time.time() - start < 30


@settings(max_examples=100, deadline=None)
@given(text=st.text(st.sampled_from("abtheins"), min_size=2, max_size=80), ordered=st.booleans())
def test_long_words_merge_as_short_ones(lib, text, ordered):
    merges = _merges()
    merges.ordered = ordered
    assert merges.merge_long(merges.single[list(text.encode())]).tolist() == merges.merge([text.encode()])[0].tolist() == lib.encode(text, add_special_tokens=False).ids


def test_decode(spark, odd_docs):
    uri = bpe.build(odd_docs, PATH)
    out = bpe.encode(odd_docs, uri, check=True)
    assert all(r["decoded"] for r in out.select("decoded").collect())
    back = {r["text"] for r in bpe.decode(out.drop("text"), uri).select("text").collect()}
    assert back == {r["text"] or "" for r in odd_docs.select("text").collect()}


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from("ab 'stre\n\t é1.,!日\U0001f600<|endoftext|>"), max_size=60))
def test_any_text(coder, lib, text):
    assert coder.encode([text])[0].tolist() == lib.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6).map(lambda b: bytes(c % 3 + 97 for c in b)), max_size=30), st.lists(st.binary(max_size=6).map(lambda b: bytes(c % 3 + 97 for c in b))))
def test_automaton(words, others):
    words = sorted(words)
    fst = bpe.compile_lexicon(words)
    assert bpe.find_words(fst, words).tolist() == list(range(len(words)))
    assert bpe.find_words(fst, others).tolist() == [words.index(o) if o in words else -1 for o in others]


def test_edges(spark, odd_docs, no_docs, lib):
    uri = bpe.build(odd_docs, PATH)
    out = bpe.encode(odd_docs, uri)
    assert out.columns == [*[c for c in odd_docs.columns if c != "ids"], "ids"]
    assert all(r["ids"] == lib.encode(r["text"] or "", add_special_tokens=False).ids for r in out.collect())
    assert bpe.encode(no_docs, bpe.build(no_docs, PATH)).count() == 0
    assert bpe.round_trip(spark, no_docs).count() == 0
