import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arkloom.llm import queries, suffix_tree as P
from arkloom.llm.store import mapped

WORD = re.compile(r"[^\x20\x09-\x0D]+")
lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(text):
    return WORD.findall((text or "").translate(lower)) + [None]


def base(docs, held):
    counts = Counter(t for i, text in docs if not held(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    return n, {i: (len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in docs}


def test_query(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    n, want = base(docs, held)
    rows = queries.QUERIES["op4_suffix_tree"](spark, data).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (*want[r["doc_id"]][:2], n, held(r["doc_id"]))
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][2], rel=1e-9)


def test_unseen_texts_are_told_from_noise_and_better_than_by_single_words(spark):
    rows = queries.QUERIES["op4_suffix_tree"](spark, "/root/testdata/sf0.1").where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert sum(r["score"] > r["base_score"] for r in rows) > 0.75 * len(rows)


def test_states_and_scores_by_the_letter(spark):
    """Counts, retention, smoothing and longest suffixes against dictionaries."""
    texts = ["abra cadabra", "abra abra", "brac", "", "a b a b a b a b"] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = {k: np.array(v) for k, v in mapped(P.fit(docs, F.lit(True))).items()}
    streams = ["".join(w + " " for w in t.split()) + "\xff" for t in texts]
    counts: dict[str, Counter] = {}
    for s in streams:
        padded = "\xff" + s
        for i in range(1, len(padded)):
            for d in range(P.DEPTH + 1):
                if i - d >= 0:
                    counts.setdefault(padded[i - d : i], Counter())[padded[i]] += 1
    total = len("".join(texts).encode())
    alphabet = sorted(counts[""])
    usable = lambda c: len(c) < 2 or sum(counts[c].values()) >= P.SHARE * total

    def gain(c):
        here, up = counts[c], counts[c[1:]]
        n, m = sum(here.values()), sum(up.values())
        return sum(k * math.log((k / n) / (up[x] / m)) for x, k in here.items())

    kept = {c for c in counts if c and usable(c) and gain(c) >= P.GAIN}

    def prob(c, x):
        if not c:
            n = sum(counts[""].values())
            return (counts[""].get(x, 0) + 1) / (n + 256)
        up = prob(c[1:], x)
        return (counts[c].get(x, 0) + P.TOWARDS * up) / (sum(counts[c].values()) + P.TOWARDS) if c in kept else up

    for s in ("abra cad\xff", "b a zz q \xff", "\xff", "cab \xff"):
        raw = np.frombuffer(s.encode("latin1"), np.uint8)
        got = P.score_stream(model, raw)
        past = "\xff"
        for x, g in zip(s, got, strict=True):
            c = next(past[len(past) - d :] for d in range(min(P.DEPTH, len(past)), -1, -1) if past[len(past) - d :] in kept or d == 0)
            assert 10**g == pytest.approx(prob(c, x), rel=1e-4), (past, x)
            past += x
    width = int(model["width"][0])
    sums = (10 ** model["logp"].reshape(-1, width).astype(float))[:, :-1].sum(axis=1)
    assert (sums <= 1.0001).all() and len(alphabet) == width - 1


def test_streams():
    data = np.frombuffer(b"AB\x0bc  d", np.uint8)
    out, off = P.stream(data, np.array([0, 4, 4, 7]))
    assert out.tobytes() == b"ab c \xff" + b"\xff" + b"d \xff" and off.tolist() == [0, 6, 7, 10]


def test_edges(spark, odd_docs, no_docs):
    rows = P.score(odd_docs, F.lit(True)).collect()
    n, want = base([(i, r["text"]) for i, r in enumerate(odd_docs.collect())], lambda i: False)
    for r, w in zip(sorted((r["n_tokens"], r["n_known"], r["base_score"]) for r in rows), sorted(want.values()), strict=True):
        assert r[:2] == w[:2] and r[2] == pytest.approx(w[2], rel=1e-9)
    assert {r["train_tokens"] for r in rows} == {n} and all(math.isfinite(r["score"]) for r in rows)
    none = P.score(odd_docs, F.lit(False)).collect()
    assert len(none) == len(rows) and all(r["base_score"] == 0 and math.isfinite(r["score"]) for r in none)
    assert P.score(no_docs, F.lit(True)).collect() == []
