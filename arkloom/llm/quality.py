"""Quality classifier: a linear support vector machine on naive Bayes features.

A text's features are indicators of its hashed n-grams: three bytes running, one
word, two words, and how much of it repeats itself.  Each indicator is scaled by
the log-count ratio of its feature in the two classes, rows are brought to length
one, and the hinge loss is minimized by dual coordinate descent.  A sigmoid fitted
on a part of the sample that the machine has not seen turns margins into scores.

The fit takes a sample of at most SAMPLE labelled documents (those of smallest
hash; all, if there are fewer), so it needs the same memory at any size.  Scoring
is one pass over whole texts without a shuffle; the weights are DIMENSIONS floats.

Defined results: null and empty texts have no features and get the score of the
bare offset; with labels of one class, or none, all scores are that class's share
(0.5 for none); a label that is null or neither 0 nor 1 is left out, of several
labels of a document the smallest counts; of unlike texts under one doc_id one is
taken for the fit, by its features; repeated rows are scored alike; an empty table gives an empty result; ``score`` and ``predicted`` replace columns of
these names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import lean, modest
from .words import flat, mix, slices, words

DIMENSIONS = 1 << 18
SAMPLE = 8000
THRESHOLD = 0.7
PASSES = 12
PRICE = 1.0


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Each text's distinct feature numbers."""
    top = np.uint64(DIMENSIONS - 1)
    w, at = words(data, offsets)
    one = (mix(w ^ np.uint64(0x11)) & top).astype(np.uint32)
    two = (mix(w[:-1] * np.uint64(3) + w[1:]) & top).astype(np.uint32) if len(w) > 1 else one[:0]
    same = w[:-1] == w[1:] if len(w) > 1 else np.zeros(0, bool)
    b = data.astype(np.uint64)
    tri = (mix((b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:] | np.uint64(1 << 40)) & top).astype(np.uint32) if len(b) > 2 else one[:0]
    for i in range(len(offsets) - 1):
        a, z, s, e = int(at[i]), int(at[i + 1]), int(offsets[i]), int(offsets[i + 1])
        parts = [one[a:z], two[a : max(a, z - 1)], tri[s : max(s, e - 2)]]
        if z - a > 1:
            twins, fresh = same[a : z - 1].mean(), len(np.unique(w[a:z])) / (z - a)
            told = np.array([int(min(twins * 20, 9)), 16 + int(fresh * 10), 32 + min((z - a).bit_length(), 15)], np.uint64)
            parts.append((mix(told + np.uint64(1 << 50)) & top).astype(np.uint32))
        yield np.unique(np.concatenate(parts))


@dataclass
class Model:
    """margin = weights[features].sum() / length of the scaled row + offset; score = sigmoid(slope * margin + shift)."""

    ratio: np.ndarray
    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def margin(self, f: np.ndarray) -> float:
        r = self.ratio[f].astype(np.float64)
        return float((r * self.weights[f]).sum() / max(np.sqrt((r * r).sum()), 1e-9)) + self.offset

    def score(self, f: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(f) + self.shift, -500, 500))))


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, passes: int = PASSES, price: float = PRICE, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and offset of the hinge loss by dual coordinate descent."""
    rng = np.random.default_rng(seed)
    w, offset, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    values = []
    for f in rows:
        r = ratio[f].astype(np.float64)
        values.append(r / max(np.sqrt((r * r).sum()), 1e-9))
    # Both classes weigh alike, whatever their shares.
    costs = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1))) * price
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            f, x = rows[i], values[i]
            gradient = y[i] * (w[f] @ x + offset) - 1
            new = min(max(alpha[i] - gradient / (x @ x + 1), 0.0), costs[i])
            if step := (new - alpha[i]) * y[i]:
                alpha[i] = new
                w[f] += step * x
                offset += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, offset


def sigmoid_fit(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(1 | margin) by Newton's method on smoothed targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, float(np.log((up + 1) / (down + 1)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        g = np.array([((p - t) * margins).sum(), (p - t).sum()])
        s = p * (1 - p)
        h = np.array([[(s * margins * margins).sum() + 1e-6, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        size = min(1.0, 5.0 / max(np.abs(d).max(), 1e-12))
        a, b = a - size * d[0], b - size * d[1]
        if np.abs(d).max() < 1e-7:
            break
    return float(max(a, 0.0)), float(b)


def train(rows: list[np.ndarray], quality: np.ndarray) -> Model:
    y = np.where(quality > 0, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        share = 0.5 if not len(y) else float((y > 0).mean())
        logit = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        return Model(np.zeros(DIMENSIONS, np.float32), np.zeros(DIMENSIONS, np.float32), 0.0, 0.0, logit)
    held = np.arange(len(rows)) % 5 == 4
    fit = np.flatnonzero(~held)
    counts = {s: np.bincount(np.concatenate([rows[i] for i in fit if y[i] == s] or [np.zeros(0, np.uint32)]), minlength=DIMENSIONS) + 1.0 for s in (1.0, -1.0)}
    ratio = np.log((counts[1.0] / counts[1.0].sum()) / (counts[-1.0] / counts[-1.0].sum())).astype(np.float32)
    w, offset = descend([rows[i] for i in fit], y[fit], ratio)
    model = Model(ratio, w.astype(np.float32), offset, 1.0, 0.0)
    check = np.flatnonzero(held) if len(set(y[held].tolist())) == 2 else fit
    model.slope, model.shift = sigmoid_fit(np.array([model.margin(rows[i]) for i in check]), y[check])
    return model


@lean
def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch.column(2))
        for a, b in slices(offsets, 1 << 20):
            own = offsets[a : b + 1] - offsets[a]
            f = [x.astype(np.uint32).tobytes() for x in features(data[offsets[a] : offsets[b]], own)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(f, pa.binary())], ["doc_id", "quality", "f"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` of the documents that ``labels`` (doc_id, quality) marks."""
    modest(docs.sparkSession)
    marks = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # The sample's bound is the broadcast's: a row of 12 bytes for each of its documents.
    rows = texts.join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "text")
    rows = rows.mapInArrow(_featured, "doc_id long, quality int, f binary")
    # Of unlike texts under one doc_id one is taken, the same in every run.
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("f", "quality")).alias("x")).select("doc_id", "x.*")
    got = sorted(((r["doc_id"], r["quality"], np.frombuffer(bytes(r["f"]), np.uint32)) for r in rows.toLocalIterator()), key=lambda r: (hash_order(r[0]), r[0]))
    return train([f for _, _, f in got], np.array([q for _, q, _ in got]))


def hash_order(n: int) -> int:
    return int(mix(np.array([n], np.int64).view(np.uint64))[0])


@lean
def _scored(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch.column(batch.schema.get_field_index("text")))
        for a, b in slices(offsets, 1 << 20):
            own = offsets[a : b + 1] - offsets[a]
            s = [model.score(f) for f in features(data[offsets[a] : offsets[b]], own)]
            part = batch.slice(a, b - a)
            marks = [pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())]
            yield pa.RecordBatch.from_arrays([*part.columns, *marks], names=[*batch.schema.names, "score", "predicted"])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    modest(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda it: _scored(it, sent.value, threshold), schema)


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that reach ``threshold``, with all their columns."""
    aside = {c: f"__own_{c}" for c in ("score", "predicted") if c in docs.columns}
    rows = score(docs.withColumnsRenamed(aside), model, threshold).where("predicted = 1")
    return rows.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def remainder(ident: str, of: int) -> Column:
    return F.coalesce(F.crc32(F.coalesce(F.col(ident).cast("string"), F.lit("")).cast("binary")) % of, F.lit(0))
