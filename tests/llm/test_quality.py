import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arkloom.llm import quality, queries


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    up = y == 1
    return (rank[up].sum() - up.sum() * (up.sum() + 1) / 2) / (up.sum() * (~up).sum())


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_quality"](spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").count()
    assert len(got) == docs
    held = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert all(got[i]["held_out"] for i in held) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    score, y = np.array([got[i]["score"] for i in held]), np.array(list(held.values()))
    assert auc(score, y) > 0.9
    assert np.mean([(got[i]["score"] >= 0.5) == held[i] for i in held]) > 0.8


def test_held_out_labels_and_other_columns_have_no_say(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "quality").where(quality.remainder("doc_id", 4) != 2)
    ask = lambda d, ls: {r["doc_id"]: r["score"] for r in quality.score(d, quality.fit(d, ls)).collect()}
    one = ask(docs, labels)
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string")).repartition(7)
    assert one == ask(other, labels)
    twice = quality.score(docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10**9)), quality.fit(docs, labels)).collect()
    assert all(r["score"] == one[r["doc_id"] % 10**9] for r in twice)


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 30, 6)).astype(np.uint32) for _ in range(60)]
    y = np.where(np.array([int(r[0]) < 5 for r in rows]), 1.0, -1.0)
    ratio = rng.normal(size=30)
    w, b = quality.descend(rows, y, ratio, passes=500)
    x = np.zeros((60, 31))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt((ratio[r] ** 2).sum())
        x[i, 30] = 1
    cost = np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum()))
    value = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    best = np.append(w, b)
    here = value(best)
    assert all(here <= value(best + rng.normal(size=31) * s) + 1e-2 for s in (1e-3, 1e-2, 0.1) for _ in range(50))


@pytest.mark.parametrize("marks", [[], [(1, 1)], [(1, 0), (3, 1), (3, 0), (5, None), (7, 2), (5, 1)]])
def test_edges(spark, odd_docs, no_docs, marks):
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    rows = quality.score(odd_docs, quality.fit(odd_docs, labels))
    assert set(rows.columns) == {*odd_docs.columns, "score", "predicted"}
    rows = rows.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    if not marks:
        assert {r["score"] for r in rows} == {0.5}
    assert len({r["score"] for r in rows if not r["text"]}) == 1
    assert quality.score(no_docs, quality.fit(no_docs, labels)).count() == 0
