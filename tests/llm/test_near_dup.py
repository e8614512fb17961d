import random
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from arkloom.llm import near_dup, queries
from arkloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    w = WORD.findall((text or "").translate(lower))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(docs, k):
    sets = {i: shingles(t, k) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    for i, s in sets.items():
        for j in {j for x in s for j in holders[x] if j < i}:
            inter = len(s & sets[j])
            if 100 * inter >= 80 * (len(s) + len(sets[j]) - inter):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize("k", [2, 5])
def test_matches_brute_force(spark, data, k):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(near_dup.near_duplicates(docs, k)) == brute(rows, k)
    if k == 2:
        assert got(queries.QUERIES["op5_near_duplicates"](spark, data)) == brute(rows, 2)


def test_groups_chains_and_the_threshold(spark):
    rng = random.Random(2)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    core = words(100)
    for i in range(600):  # near copies of one text: a region above REGION in every order
        t = list(core)
        for j in rng.sample(range(100), rng.choice((0, 1, 2, 4))):
            t[j] = f"x{rng.randrange(50)}"
        rows.append((1000 + i, " ".join(t)))
    rows += [(3000 + i, " ".join(core)) for i in range(300)]
    chain = words(60)
    for i in range(30):  # neighbours link, the ends do not
        chain = chain[3:] + words(3)
        rows.append((5000 + i, " ".join(chain)))
    for i in range(200):  # pairs about the threshold: 45 of 45 + 2 * x shingles
        t = words(46)
        x = rng.choice((5, 6))
        rows += [(7000 + 2 * i, " ".join(t)), (7001 + 2 * i, " ".join(t + words(x)[: x]) if i % 2 else " ".join(t[:-x] + words(x)))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(near_dup.near_duplicates(df, 2)) == brute(rows, 2)


def test_edges(spark, odd_docs, no_docs):
    rows = near_dup.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    at = {r["doc_id"]: r for r in rows}
    assert at[7]["component_id"] == 1 and not at[7]["kept"] and at[1]["kept"]
    assert at[8]["component_id"] == 5
    assert [at[i]["component_id"] for i in (2, 3, 4)] == [2, 3, 4] and all(at[i]["kept"] and at[i]["n_shingles"] == 0 for i in (2, 3, 4))
    kept = near_dup.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, i) for i in (1, 2, 3, 4, 5, 9)] + [(True, None)]
    assert near_dup.near_duplicates(no_docs).count() == 0 == near_dup.deduplicate(no_docs).count()


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150), (300, 300)] + [(1000, 1000 + i) for i in range(1, 200)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(51)) and out[200] == out[150] == 100 and all(out[1000 + i] == 1000 for i in range(200))


def test_a_largest_component_that_grows_stays_in_view(tmp_path):
    """Row 2 joins the largest component and then links to row 3; row 4 links to row 1 of the largest alone."""
    sets = [range(10), range(100, 110), range(11), range(12), range(100, 111)]
    raw = [np.array(s, np.uint64).tobytes() for s in sets]
    (tmp_path / "f").write_bytes(b"".join(raw))
    size = [len(x) for x in raw]
    n = len(sets)
    rows = pa.RecordBatch.from_pydict(
        {
            "tree": pa.array([0] * n, pa.int32()), "key": pa.array([bytes(16)] * n), "cid": pa.array(range(n), pa.int64()), "sketch": pa.array([bytes(64)] * n),
            "comp": pa.array([10, 10, 20, 30, 40], pa.int64()), "file": ["f"] * n, "at": pa.array([sum(size[:i]) for i in range(n)], pa.int64()), "size": pa.array(size, pa.int64()),
        }
    )
    out = [tuple(r.values()) for b in near_dup._rest(iter([rows]), 80, f"file://{tmp_path}") for r in b.to_pylist()]
    assert sorted(out) == [(0, 2), (1, 4), (2, 3)]


def test_a_region_of_more_than_a_chunk_is_compared_as_a_whole(spark):
    """11500 texts of four common words, which make one region; planted pairs share no other and lie far apart in it."""
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]

    def sketched(texts):
        raw = [t.encode() for t in texts]
        return list(near_dup.shingles(*near_dup.words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))), 1))

    pool = fresh(300000)
    v = np.concatenate(sketched(pool))
    least = lambda sets, k: ((sets * near_dup._odd[k] + near_dup._plus[k]) >> np.uint64(32)).astype(np.uint32)
    core = [int(least(v, k).argmin()) for k in range(near_dup.LEAST)]
    texts = [" ".join([pool[i] for i in core] + fresh(16)) for _ in range(11500)]
    top = np.sort(near_dup.signature(sketched(texts))[:, near_dup.LEAST])
    gen, planted = np.random.default_rng(5), []
    for _ in range(6):
        a = np.concatenate((np.tile(core, (300000, 1)), gen.integers(0, len(pool), (300000, 16))), axis=1)
        b = np.concatenate((a[:, :-2], gen.integers(0, len(pool), (300000, 2))), axis=1)
        next_a, next_b = (least(v[x], near_dup.LEAST).min(axis=1).astype(np.uint16) for x in (a, b))
        far = (next_a > top[10700]) & (next_b < top[9500])
        a, b = a[far], b[far]
        same = near_dup.signature(list(v[a])) == near_dup.signature(list(v[b]))
        others = same.reshape(len(a), near_dup.TREES, near_dup.LEAST)[:, 1:].all(axis=2).any(axis=1)
        good = np.flatnonzero(~others & (same.mean(axis=1) > 0.62))
        planted += [(" ".join(pool[i] for i in x), " ".join(pool[i] for i in y)) for x, y in zip(a[good].tolist(), b[good].tolist(), strict=True)]
    assert len(planted) > 3
    rows = list(enumerate(texts)) + [(20000 + 2 * i + j, x) for i, p in enumerate(planted) for j, x in enumerate(p)]
    out = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 1).collect()}
    assert [out[20001 + 2 * i] for i in range(len(planted))] == [20000 + 2 * i for i in range(len(planted))]
    assert sum(out[i] != i for i in out) == len(planted)


def test_texts_of_one_template_in_oversized_regions(spark, monkeypatch):
    """Texts of one template that don't link but for planted pairs; a region of more than 60 classes goes to blocks of 40."""
    monkeypatch.setattr(near_dup, "CHUNK", 60)
    monkeypatch.setattr(near_dup, "BLOCK", 40, raising=False)
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    core = fresh(61)
    rows = [(i, " ".join(core + fresh(16))) for i in range(300)]
    for i in range(100):
        own = fresh(16)
        rows += [(1000 + 2 * i, " ".join(core + own)), (1001 + 2 * i, " ".join(core + own[:8] + fresh(8)))]
    assert similarity(rows[0][1], rows[1][1]) < 0.8 <= similarity(rows[-2][1], rows[-1][1])
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    keep = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert got(near_dup.near_duplicates(df, 2)) == brute(rows, 2)
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)


@pytest.mark.parametrize("n", [600, 5000])
def test_texts_of_one_template_just_below_the_threshold(spark, n):
    """Each is like every other, none links but for planted pairs; work stays bounded and no pair is lost."""
    rng = random.Random(7)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    core = fresh(120)
    rows = [(i, " ".join(core + fresh(rng.randrange(17, 22)))) for i in range(n)]
    for i in range(100):
        own = fresh(18)
        rows += [(10**6 + 2 * i, " ".join(core + own)), (10**6 + 2 * i + 1, " ".join(core + own[:4] + fresh(14)))]
    assert 0.7 < similarity(rows[0][1], rows[1][1]) < 0.8 <= similarity(rows[-2][1], rows[-1][1]) < 0.85
    rng.shuffle(rows)
    start = time.time()
    out = got(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 2))
    assert {i: c for i, (_, c, _) in out.items()} == {i: i - (i >= 10**6 and i % 2) for i, _ in rows}
    assert time.time() - start < 120


def test_parity_bitmaps_rule_out_no_link():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, rng.integers(1, 400), np.uint64) * np.uint64(2)) for _ in range(60)]
    sets += [np.unique(np.concatenate((rng.permutation(s)[: max(1, int(len(s) * 0.92))], rng.integers(0, 2**63, 1 + len(s) // 20, np.uint64)))) for s in sets]
    size = np.array([len(s) for s in sets])
    parity = near_dup.Parity(size, lambda i: sets[i])
    for x in range(len(sets)):
        other = np.delete(np.arange(len(sets)), x)
        links = {y for y in other.tolist() if near_dup.similar(sets[x], sets[y], 80)}
        assert links <= set(parity.may(x, other, size, 80).tolist())
        assert links == {y for y, ok in zip(other.tolist(), near_dup.linked(sets[x], [sets[y] for y in other], 80), strict=True) if ok}


def test_unlike_texts_under_one_doc_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    df = spark.createDataFrame([(1, a), (1, b), (1, b), (2, b), (3, c), (0, c)], "doc_id long, text string").repartition(3)
    assert sorted((r["doc_id"], r["text"]) for r in near_dup.deduplicate(df).collect()) == [(0, c), (1, a), (1, b)]
    rows = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(df).collect())
    assert rows == [(0, 0, True), (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 0, False)]


def test_no_text_is_shuffled(spark, data):
    """What the stages of deduplication and mixing return reads the table again, without an exchange below it."""
    from arkloom.llm import mixing

    docs = spark.read.parquet(f"{data}/documents.parquet")
    for df in (near_dup.deduplicate(docs), mixing.mixed(docs)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def similarity(a, b):
    a, b = shingles(a, 2), shingles(b, 2)
    return len(a & b) / len(a | b)
