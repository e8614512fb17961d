import re
from collections import Counter

import pytest

import corpus_pipeline as P
from arkloom.llm import pii, quality
from arkloom.llm.near_dup import near_duplicates

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for i, (_, stage) in enumerate(P.STAGES):
        out.append(P.cut(stage(spark, out[-1], SF), f"test-{i}", keep=True))
    return out


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(steps):
    assert [name for name, _ in P.STAGES] == ["quality classifier", "MinHash near-dedup", "PII", "mixing sources to target weights", "BPE encoding and decoding"]
    docs, good, unique, clean, mixed, coded = steps
    for s in steps[:-1]:
        assert s.columns == docs.columns
    assert set(docs.columns) < set(coded.columns)
    assert set(ids(good)) < set(ids(docs)) and set(ids(unique)) < set(ids(good))
    assert ids(clean) == ids(unique) and set(ids(mixed)) <= set(ids(clean)) and ids(coded) == ids(mixed)


def test_quality_rejects_bad_and_keeps_clean(spark, steps):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(ids(steps[1]))
    share = lambda q: sum(i in kept for i in labels if labels[i] == q) / sum(v == q for v in labels.values())
    assert share(1) > 0.85 and share(0) < 0.25


def test_no_near_duplicate_is_left(steps):
    assert near_duplicates(steps[2]).where("NOT kept").count() == 0
    groups = {r["component_id"] for r in near_duplicates(steps[1]).collect()}
    assert groups == set(ids(steps[2]))


def test_no_personal_data_is_left(spark, steps):
    left = pii.with_spans(steps[3], {}).where("size(base) > 0")
    assert left.count() == 0
    before = {r["doc_id"]: r["text"] for r in steps[2].collect()}
    for r in steps[3].collect():
        if r["text"] != before[r["doc_id"]]:
            assert re.search("<(EMAIL|IP|CARD|PHONE)>", r["text"]) and r["n_chars"] == len(r["text"])


def test_mix_is_near_its_targets(steps):
    words = lambda df: {r["source"]: r["n"] for r in df.selectExpr("source", "regexp_count(text, '[^ \\t-\\r]+') AS n").groupBy("source").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    have, got = words(steps[3]), words(steps[4])
    order = sorted(have)
    total, weight = sum(have.values()), {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    share = {s: total * weight[s] / sum(weight.values()) for s in order}
    if all(share[s] <= 3 * have[s] for s in order):
        assert all(abs(got[s] - share[s]) <= 0.02 * share[s] for s in order)
    assert sum(got.values()) <= 1.02 * total
    assert max(ids(steps[4]).values()) <= 3


def test_ids_decode_to_the_texts(steps):
    from tokenizers import Tokenizer

    from arkloom.llm import bpe

    lib = Tokenizer.from_file(bpe.default_path())
    for r in steps[5].limit(200).collect():
        assert r["n_tokens"] == len(r["ids"]) and lib.decode(r["ids"], skip_special_tokens=False) == r["text"]


@pytest.mark.parametrize("make", ["odd_docs", "no_docs"])
def test_edges(spark, request, make):
    docs = request.getfixturevalue(make)
    for i, (_, stage) in enumerate(P.STAGES):
        out = P.cut(stage(spark, docs, SF), f"edge-{i}", keep=True)
        if i == 0 and make == "odd_docs":
            assert out.columns == docs.columns
            continue  # each of the other stages gets all the odd rows
        out.collect()


def test_quality_of_no_documents(spark, no_docs):
    assert quality.score(no_docs, quality.fit(no_docs, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality"))).count() == 0
