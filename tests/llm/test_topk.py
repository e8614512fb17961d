import duckdb
import numpy as np
import pyarrow as pa
import pytest

from arkloom.llm import queries, topk
from arkloom.llm.store import cut, path_of, work_dir


def brute(rows, pick, k):
    out = []
    ids = [i for i, _ in rows]
    w = np.array([v for _, v in rows])
    for i, v in rows:
        if pick(i):
            s = (w * v).sum(axis=1)
            best = sorted((-int(s[j]), ids[j]) for j in range(len(ids)) if ids[j] != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_matches_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    want = con.execute(queries.ORACLE_SQL["op1_exact_topk"]).fetchall()
    got = queries.QUERIES["op1_exact_topk"](spark, data)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("block", [5, 4096])
def test_blocks_ties_and_sparse_rows(spark, block):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-2, 3, 6) * (rng.random(6) < 0.4)).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, w array<long>").repartition(5)
    got = topk.top_k(df.where("vec_id % 10 = 0"), df, 4, block)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0, 4)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (50, [0.25, -0.001]), (None, [1.0, 1.0]), (7, [1e9, 0.0]), (8, [1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")
    q = topk.quantised(df)
    assert {r["vec_id"]: r["w"] for r in q.collect()} == {0: [256, 128], 50: [64, -1], 7: [256_000_000_000, 0], 8: [256]}
    got = sorted(map(tuple, topk.top_k(q.where("vec_id % 50 = 0"), q).collect()))
    assert got == [(0, 1, 7, 256 * 256_000_000_000), (0, 2, 8, 65536), (0, 3, 50, 256 * 64 - 128), (50, 1, 7, 64 * 256_000_000_000), (50, 2, 8, 64 * 256), (50, 3, 0, 256 * 64 - 128)]


def test_pieces_that_pass_the_held_bytes(spark, monkeypatch):
    monkeypatch.setattr(topk, "HOLD", 100)  # workers import the module anew; _search is called here
    rng = np.random.default_rng(4)
    w = rng.integers(-9, 10, (90, 4))
    batches = [pa.RecordBatch.from_pydict({"vec_id": pa.array(range(i, i + 30)), "w": pa.array(w[i : i + 30].tolist(), pa.list_(pa.int64()))}) for i in (0, 30, 60)]
    df = spark.createDataFrame([(i, w[i].tolist()) for i in range(0, 90, 10)], "vec_id long, w array<long>")
    folder = work_dir(spark, "blocks")
    index = path_of(cut(df.repartition(2).mapInArrow(lambda it: topk._pack(it, folder, 4), "uri string"), "index"))
    hits = [tuple(r.values()) for b in topk._search(iter(batches), index, 2) for r in b.to_pylist()]
    assert len(hits) == 3 * 9 * 2
    want = {(q, i, s) for q, _, i, s in brute([(i, w[i].tolist()) for i in range(90)], lambda i: i % 10 == 0, 2)}
    assert want <= set(hits)


def test_one_id_with_unlike_vectors_and_repeated_rows(spark):
    rows = [(0, [1, 0]), (0, [1, 0]), (0, [0, 2]), (1, [3, 1]), (1, [3, 1]), (2, [0, 4])]
    df = spark.createDataFrame(rows, "vec_id long, w array<long>")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df.where("vec_id = 0"), df, 4).collect())
    assert got == [(1, 2, 8), (2, 1, 3), (3, 1, 3), (4, 1, 2)]


def test_scores_beyond_64_bits(spark):
    big = 1 << 62
    rows = [(0, [big, big]), (1, [big, -big]), (2, [big, big - 1]), (3, [-big, -big]), (4, [3, -big]), (5, [-3, 5])]
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(spark.createDataFrame(rows[:1], "vec_id long, w array<long>"), spark.createDataFrame(rows, "vec_id long, w array<long>")).orderBy("rank").collect()]
    top = (1 << 63) - 1
    assert got == [(2, top), (5, top), (1, 0), (3, -top), (4, -top)]


def test_empty(spark):
    q = topk.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(q, q).collect() == []
