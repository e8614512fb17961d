"""Exact top-k inner products by term-at-a-time accumulation.

Vectors are sparse rows of integer weights.  The queries are packed into blocks of
bounded rows and bytes, each a file of the shared folder that tasks map to memory;
none passes the driver.  Each task holds a bounded piece of the candidates that it
read and goes through the blocks, so candidates are scanned once.  There, term after
term, the postings of a term (the candidates of a piece that have a weight for it)
are scaled by each query's weight and scattered into dense score arrays; a partition
selection leaves k candidates a query and piece, and a window merges those of all.

Defined results: vectors that are null or hold a null, NaN or infinity take no
part, nor does a null id; a vector shorter than another counts as zero in what it
lacks; rows with the query's own id are not its candidates; repeated query rows
count once, and query rows of one id with unlike vectors are ranked together, as
candidate rows of one id are ranked each; fewer candidates than k are all returned;
an empty table gives an empty result; other columns are ignored.  Weights are 64-bit
integers.  Where products may pass 64 bits they are summed as integers of any size,
and scores beyond stand at the ends of the range.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, lean, mapped, open_store, path_of, save, work_dir

BLOCK = 4096
BLOCK_BYTES = 16 << 20
PIECE = 1024
#: Bytes of candidates that a task holds while it goes through the blocks.
HOLD = 64 << 20
#: Below every score.
NONE = -(1 << 63)
MOST = (1 << 63) - 1


def quantised(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, w): floor(scale * x) of each component, of rows that take part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    w = F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)).cast("long"))
    return rows.where(F.col(ident).isNotNull() & F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(ident).cast("long").alias("vec_id"), w.alias("w"))


def _dense(ws: pa.Array, width: int | None = None) -> np.ndarray:
    if isinstance(ws, pa.ChunkedArray):
        ws = ws.combine_chunks()
    lens = np.diff(ws.offsets.to_numpy())
    width = max(int(lens.max(initial=0)), 1) if width is None else width
    out = np.zeros((len(ws), width), np.int64)
    if len(ws):
        values = ws.flatten().to_numpy(zero_copy_only=False)
        row, col = np.repeat(np.arange(len(ws)), lens), np.arange(len(values)) - np.repeat(np.cumsum(lens) - lens, lens)
        fits = col < width
        out[row[fits], col[fits]] = values[fits]
    return out


@lean
def _pack(batches: Iterator[pa.RecordBatch], folder: str, block: int) -> Iterator[pa.RecordBatch]:
    """Writes queries to files of at most ``block`` rows and BLOCK_BYTES, or one row; rows name the files."""
    for batch in batches:
        lens = np.diff(batch.column(1).offsets.to_numpy())
        rows = max(1, min(block, BLOCK_BYTES // (8 * max(int(lens.max(initial=0)), 1))))
        for lo in range(0, batch.num_rows, rows):
            part = batch.slice(lo, rows)
            w = _dense(part.column(1))
            uri = save({"qid": part.column(0).to_numpy(), "qw": w.ravel(), "width": np.array([w.shape[1]])}, f"{folder}/{uuid.uuid4().hex}")
            yield pa.RecordBatch.from_pydict({"uri": [uri]})


def _accumulated(qw: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Scores of queries (rows) and candidates (columns), term after term."""
    wide = np.abs(qw.astype(np.float64)).sum(axis=1).max(initial=0) * np.abs(w.astype(np.float64)).max(initial=0) >= 2.0**62
    if wide:
        qw, w = qw.astype(object), w.astype(object)
    scores = np.zeros((len(qw), len(w)), object if wide else np.int64)
    for t in np.flatnonzero((qw != 0).any(axis=0)).tolist():
        post, rows = np.flatnonzero(w[:, t]), np.flatnonzero(qw[:, t])
        if len(rows) == len(qw) and len(post) == len(w):
            scores += np.multiply.outer(qw[:, t], w[:, t])
        elif len(post) and len(rows):
            scores[np.ix_(rows, post)] += np.multiply.outer(qw[rows, t], w[post, t])
    return np.clip(scores, -MOST, MOST).astype(np.int64) if wide else scores


def _best(qid: np.ndarray, qw: np.ndarray, held: list[pa.RecordBatch], k: int) -> pa.RecordBatch:
    """Each query's k best of some candidates."""
    best_s = np.full((len(qid), k), NONE)
    best_i = np.full((len(qid), k), np.iinfo(np.int64).max)
    for batch in held:
        for lo in range(0, batch.num_rows, PIECE):
            part = batch.slice(lo, PIECE)
            ids = part.column(0).to_numpy()
            scores = _accumulated(qw, _dense(part.column(1), qw.shape[1]))
            take = np.ones(scores.shape, bool)
            for j in np.flatnonzero(np.isin(ids, qid)):
                take[qid == ids[j], j] = False
            for q in range(len(qid)):
                s, ok = scores[q], take[q]
                if len(s) > 4 * k:
                    # Everything that reaches the k-th best score, ties included.
                    s0 = np.where(ok, s, NONE)
                    floor = max(np.partition(s0, len(s0) - k)[len(s0) - k], best_s[q, k - 1])
                    pick = np.flatnonzero(ok & (s >= floor))
                else:
                    pick = np.flatnonzero(ok)
                if len(pick):
                    s1, i1 = np.append(best_s[q], s[pick]), np.append(best_i[q], ids[pick])
                    order = np.lexsort((i1, ~s1))[:k]
                    best_s[q], best_i[q] = s1[order], i1[order]
    q, r = np.nonzero(best_s != NONE)
    return pa.RecordBatch.from_pydict({"query_id": qid[q], "vec_id": best_i[q, r], "score": best_s[q, r]})


@lean
def _search(batches: Iterator[pa.RecordBatch], index: str, k: int) -> Iterator[pa.RecordBatch]:
    """Each query's k best of each piece of this task's candidates; ``index`` is a table of the blocks' files."""
    import pyarrow.dataset as ds

    store, path = open_store(index)
    uris = sorted(ds.dataset(path, filesystem=store, format="parquet").to_table(columns=["uri"]).column("uri").to_pylist())

    def told() -> Iterator[pa.RecordBatch]:
        for uri in uris:
            block = mapped(uri)
            yield _best(block["qid"], block["qw"].reshape(-1, int(block["width"][0])), held, k)

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > HOLD:
            yield from told()
            held, size = [], 0
    if held:
        yield from told()


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of all candidates, ties to the smaller id."""
    packed = cut(queries.distinct(), "queries")
    n = packed.count()
    if not n:
        return candidates.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    folder = work_dir(packed.sparkSession, "blocks")
    written = packed.select("vec_id", "w").repartition(-(-n // block)).mapInArrow(lambda it: _pack(it, folder, block), "uri string")
    index = path_of(cut(written, "index"))
    found = candidates.select("vec_id", "w").mapInArrow(lambda it: _search(it, index, k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
