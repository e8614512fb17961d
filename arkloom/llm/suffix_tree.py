"""Language-model scoring by a probabilistic suffix tree over bytes.

The model reads a text as its words in lower case, each followed by a blank, and
an end symbol.  Contexts are the last bytes, up to DEPTH of them.  One pass over
the training texts counts every (context, next symbol) of full depth; they are dealt
by hash and summed.  The sums, a row for each distinct one, are dealt by their latest
two bytes: sorted with the latest byte first, the counts of all shorter contexts are
sums of runs.  A context of at least SHARE of all symbols is retained if its next-symbol
distribution diverges from that of its longest proper suffix by a log-likelihood
gain of GAIN; distributions are smoothed towards the suffix's.  The tree becomes
an automaton whose state is the longest suffix retained, so texts are scored in
many lanes at once, a table look-up a symbol.

Beside it stands the base score, an add-one unigram model of words.  A word's
probability in the model is in parts, set by UNIGRAM, what the tree gives to its
bytes and its unigram probability, which also is a smoothing of rare contexts; the
unigram's share for unknown words goes to the tree.  Words that
make up more than a set share of the training words are few whatever the input
and are looked up in a table; the others are dealt by hash, counted where they
meet, and their logarithms sent back to the block of texts that they came from.
So no word, however common, gathers in one task, and nothing but bounded tables
(contexts and words above a share) reaches the driver.

Defined results: null and empty texts are the end symbol alone; a null doc_id
counts as the text "" in the split; without training texts every symbol has the
same probability; repeated rows are scored each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut, lean, mapped, modest, save, work_dir
from .words import LOWER, SPACE, flat, slices, words

DEPTH = 5
SHARE = 1e-6
GAIN = 6.0
TOWARDS = 4.0
END = 255
#: A word of at least this share of the training bytes is looked up in a table; at most half as many as one by this fit.
COMMON = 1 / 400_000
#: Tasks of a step by tasks of the input, so that what one reads stays in proportion.
SPREAD = 2
#: Buckets by tasks, which evens out what tasks get; but for very many tasks, where rows would be small.
BUCKETS, MANY = 8, 4096
LANE = 1024
HELD = 1 << 20
#: The unigram's part in a word's probability, chosen on a part of the training rows that was left out for it.
UNIGRAM = 0.1
BLOCK_ROWS = 1 << 15


def stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, offsets): each text's words in lower case, a blank after each, and END."""
    n, docs = len(data), len(offsets) - 1
    solid = ~SPACE[data]
    stop = solid.copy()
    if n:
        stop[:-1] &= ~solid[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        stop[edges - 1] |= solid[edges - 1]
    before = np.concatenate(([0], np.cumsum(solid)))
    ended = np.concatenate(([0], np.cumsum(stop)))
    doc = np.repeat(np.arange(docs), np.diff(offsets))
    at = np.flatnonzero(solid)
    out = np.full(int(before[-1] + ended[-1] + docs), 0x20, np.uint8)
    out[before[at] + ended[at] + doc[at]] = LOWER[data[at]]
    close = before[offsets[1:]] + ended[offsets[1:]] + np.arange(docs)
    out[close] = END
    return out, np.concatenate(([0], close + 1))


def grams(symbols: np.ndarray) -> np.ndarray:
    """Sorted keys: the latest byte in front, DEPTH bytes of context, then the next symbol."""
    n = len(symbols)
    key = np.zeros(n, np.uint64)
    over = np.zeros(n, bool)
    for j in range(1, DEPTH + 1):
        c = np.full(n, END, np.uint8)
        c[j:] = symbols[: max(n - j, 0)]
        c[over] = END  # nothing before a text's start
        over |= c == END
        key = (key << np.uint64(8)) | c
    key = (key << np.uint64(8)) | symbols
    key.sort()
    return key


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their counts; without ``counts`` the keys are sorted and count one each."""
    if counts is not None:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    if counts is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


class Sums:
    """Counts of keys, summed again whenever MOST entries have come together."""

    MOST = 1 << 20

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.n += len(keys)
        if self.n > self.MOST and len(self.parts) > 1:
            self.parts = [self.total()]
            self.n = len(self.parts[0][0])
            self.MOST = max(Sums.MOST, 2 * self.n)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self.parts) == 1:
            return self.parts[0]
        return summed(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))


def dealt(bucket: np.ndarray, n: int, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, its part of each column, packed) for buckets that have any."""
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(n + 1))
    columns = tuple(c[order] for c in columns)
    for b in np.flatnonzero(np.diff(edge)).tolist():
        yield b, b"".join(c[edge[b] : edge[b + 1]].tobytes() for c in columns)


def undo(raw: bytes, *kinds: str) -> list[np.ndarray]:
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _rows(kind: str, pairs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(pairs), pa.string()), pa.array([b for b, _ in pairs], pa.int64()), pa.array([p for _, p in pairs], pa.binary())], ["kind", "bucket", "packed"]
    )


@lean
def _gather(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts of words ("w") and of full-depth contexts with next symbols ("g"), dealt to buckets."""
    w, g, docs = Sums(), Sums(), 0

    def told(kind: str, sums: Sums) -> pa.RecordBatch:
        k, c = sums.total()
        b = (k if kind == "w" else k * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(buckets)
        return _rows(kind, list(dealt(b.astype(np.int64), buckets, k, c.astype(np.uint32))))

    for batch in batches:
        data, offsets = flat(batch.column(0))
        docs += batch.num_rows
        for a, b in slices(offsets, 1 << 20):
            own, part = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
            h, _ = words(part, own)
            h.sort()
            w.add(*summed(h))
            g.add(*summed(grams(stream(part, own)[0])))
        for kind, sums in (("w", w), ("g", g)):
            if sums.n > 3 * HELD:
                yield told(kind, sums)
                sums.__init__()
    yield told("w", w)
    yield told("g", g)
    yield _rows("d", [(0, np.array([docs], np.int64).tobytes())])


def contexts(keys: np.ndarray, counts: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, key of context and next symbol, count) of contexts of ``least`` and all of depth 0 and 1."""
    for depth in range(DEPTH + 1):
        short = ((keys >> np.uint64(8 * (DEPTH - depth) + 8)) << np.uint64(8)) | (keys & np.uint64(255))
        k, c = summed(short, counts)
        if depth > 1:
            s, n = summed(k >> np.uint64(8), c)
            good = n >= least
            keep = good[np.searchsorted(s, k >> np.uint64(8))]
            k, c = k[keep], c[keep]
        yield depth, k, c


@lean
def _reduce(batches: Iterator[pa.RecordBatch], buckets: int, common: float) -> Iterator[pa.RecordBatch]:
    """Sums each bucket's counts; keeps totals and common words, and deals contexts by their latest two bytes ("h")."""

    def told(kind: str, k: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        if kind == "w":
            top = c >= common
            yield _rows("n", [(0, np.array([c.sum(), len(c)], np.int64).tobytes())])
            yield _rows("c", [(0, k[top].tobytes() + c[top].astype(np.int64).tobytes())])
        else:
            # So shorter contexts from there up are whole in a bucket.
            b = ((k >> np.uint64(8 * DEPTH - 8)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(buckets)
            yield _rows("h", list(dealt(b.astype(np.int64), buckets, k, c.astype(np.uint64))))

    yield from _by_bucket(batches, ("w", "g"), ("u8", "u4"), told)


@lean
def _shorten(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Contexts of all depths that may be retained ("t"), from each bucket's sums; the other rows pass."""

    def told(kind: str, k: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        for depth, x, n in contexts(k, c, least):
            yield _rows("t", [(depth, x.tobytes() + n.astype(np.int64).tobytes())])

    yield from _by_bucket(batches, ("h",), ("u8", "u8"), told)


def _by_bucket(batches: Iterator[pa.RecordBatch], kinds: tuple[str, ...], types: tuple[str, str], told) -> Iterator[pa.RecordBatch]:
    """``told`` of each bucket's summed counts; rows of other kinds pass."""
    at, sums = None, Sums()
    for batch in batches:
        for kind, bucket, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if kind not in kinds:
                yield _rows(kind, [(bucket, raw.as_py())])
                continue
            if at != (kind, bucket):
                if at is not None:
                    yield from told(at[0], *sums.total())
                at, sums = (kind, bucket), Sums()
            k, c = undo(raw.as_buffer().to_pybytes(), *types)
            sums.add(k, c.astype(np.int64))
    if at is not None:
        yield from told(at[0], *sums.total())


def grow(tables: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """The tree as an automaton: next state and log10 probability for each state and symbol class.

    ``tables`` has for each depth the sorted keys (context, next symbol) and their counts.
    """
    k0, c0 = tables.get(0, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    seen = (k0 & np.uint64(255)).astype(np.int64)
    classes = np.full(256, len(seen), np.uint8)
    classes[seen] = np.arange(len(seen))
    node: dict[tuple[int, int], np.ndarray] = {(0, 0): c0.astype(np.float32)}
    for depth in range(1, DEPTH + 1):
        k, c = tables.get(depth, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        ctx = (k >> np.uint64(8)).astype(np.int64)
        # A context that goes on behind a text's start says no more than the one that ends there.
        inner = np.zeros(len(ctx), bool)
        for i in range(1, depth):
            inner |= (ctx >> 8 * i) & 255 == END
        ctx, k, c = ctx[~inner], k[~inner], c[~inner]
        edge = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1])) if len(ctx) else np.zeros(0, np.int64)
        counts = np.zeros((len(edge), len(seen)), np.float32)
        counts[np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(ctx)))), classes[(k & np.uint64(255)).astype(np.int64)]] = c
        node |= {(depth, s): n for s, n in zip(ctx[edge].tolist(), counts, strict=True)}
    root = node[0, 0]
    suffix = lambda d, s: (d - 1, s >> 8)  # noqa: E731  drops the oldest byte, which stands last
    retained = set()
    for (d, s), counts in node.items():
        if d:
            above = node.get(suffix(d, s))
            if above is None:
                continue
            has = counts > 0
            n = counts[has].astype(np.float64)
            if (n * np.log((n / n.sum()) / (above[has] / above.sum(dtype=np.float64)))).sum() >= GAIN:
                retained.add((d, s))
    known = {(0, 0)}
    todo = list(retained)
    while todo:
        d, s = todo.pop()
        if (d, s) in known or d == 0:
            continue
        known.add((d, s))
        todo.append(suffix(d, s))
        # The automaton's state must be known from the state before: without the latest byte.
        todo.append((d - 1, s & ((1 << 8 * (d - 1)) - 1)))
    order = sorted(known)
    number = {x: i for i, x in enumerate(order)}
    width = len(seen) + 1
    prob = np.empty((len(order), width))
    full = root.sum(dtype=np.float64)
    prob[0, :-1] = (root + 1) / (full + 256)
    prob[0, -1] = 1 / (full + 256)
    to = np.zeros((len(order), width), np.int32)
    for i, (d, s) in enumerate(order):
        if d:
            up = prob[number[suffix(d, s)]]
            if (d, s) in retained:
                counts = node[d, s]
                prob[i] = (np.append(counts, 0.0) + TOWARDS * up) / (counts.sum(dtype=np.float64) + TOWARDS)
            else:
                prob[i] = up
    # Reading x in state s leads to the longest known suffix of (s, x): the state that ends in x and
    # goes on as s, if it is known, else where the suffix of s leads.
    ahead: dict[int, list[tuple[int, int]]] = {}
    for i, (d, s) in enumerate(order):
        if d:
            at = number[d - 1, s & ((1 << 8 * (d - 1)) - 1)]
            ahead.setdefault(at, []).append((classes[s >> 8 * (d - 1)], i))
    for i, (d, s) in enumerate(order):
        if d:
            to[i] = to[number[suffix(d, s)]]
        for x, j in ahead.get(i, ()):
            to[i, x] = j
    return {"classes": classes, "to": to.ravel(), "logp": np.log10(prob).astype(np.float32).ravel(), "width": np.array([width])}


def score_stream(model: dict[str, np.ndarray], symbols: np.ndarray) -> np.ndarray:
    """log10 probability of each symbol of a stream."""
    n, width = len(symbols), int(model["width"][0])
    lanes = -(-n // LANE)
    # DEPTH symbols before a lane bring it to its state, since no context is longer; before the first stands an end.
    padded = np.full(lanes * LANE + DEPTH, END, np.uint8)
    padded[DEPTH : DEPTH + n] = symbols
    x = model["classes"][padded].astype(np.int64)
    state = np.zeros(lanes, np.int64)
    base = np.arange(lanes) * LANE
    out = np.empty((LANE, lanes), np.float32)
    to, logp = model["to"], model["logp"]
    for t in range(LANE + DEPTH):
        at = state * width + x[base + t]
        if t >= DEPTH:
            out[t - DEPTH] = logp[at]
        state = to[at].astype(np.int64)
    return out.T.ravel()[:n].astype(np.float64)


def score_tokens(model: dict[str, np.ndarray], symbols: np.ndarray) -> np.ndarray:
    """log10 probability of each word with its blank, and of each end."""
    if not len(symbols):
        return np.zeros(0)
    closes = (symbols[:-1] == 0x20) | (symbols[:-1] == END)
    return np.add.reduceat(score_stream(model, symbols), np.append(0, np.flatnonzero(closes) + 1))


def blend(tree: np.ndarray, count: np.ndarray, total: float, part: float = UNIGRAM) -> np.ndarray:
    """log10 probability of words by tree and counts; ``total`` is the unigram's denominator, ``part`` its weight."""
    rest = np.log10(1 - part + part / total) + tree
    known = np.log10(part * (count + 1.0) / total)
    both = np.maximum(rest, known) + np.log10(1 + 10.0 ** -np.abs(rest - known))
    return np.where(count > 0, both, rest)


@lean
def _assess(batches: Iterator[pa.RecordBatch], uri: str, buckets: int) -> Iterator[pa.RecordBatch]:
    """Scores texts; sends uncommon words to their buckets ("p") and what is known of the rows to their block ("r")."""
    model = mapped(uri)
    common, log_c = model["common"], np.log10(model["common_count"] + 1.0)
    weight = float(model["unigram"][0])
    docs, total = int(model["docs"][0]), float(model["tokens"][0] + model["types"][0] + 1)
    log_end, known_end = np.log10(docs + 1.0), int(docs > 0)
    pid, block = TaskContext.get().partitionId(), 0
    rows: list[tuple] = []
    posts: list[tuple[np.ndarray, ...]] = []
    n = held = 0

    def told() -> Iterator[pa.RecordBatch]:
        ident = (pid << 16) | block
        yield _rows("r", [(ident, b"".join(np.concatenate(c).tobytes() for c in zip(*rows, strict=True)))])
        h, r, tree = (np.concatenate(c) for c in zip(*posts, strict=True))
        key = (np.uint64(ident) << np.uint64(20)) | r.astype(np.uint64)
        yield _rows("p", list(dealt((h % np.uint64(buckets)).astype(np.int64), buckets, h, key, tree)))

    for batch in batches:
        data, offsets = flat(batch.column(2))
        for a, b in slices(offsets, 1 << 20):
            own, part = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
            h, at = words(part, own)
            ids, trains = batch.column(0)[a:b], batch.column(1)[a:b].to_numpy(zero_copy_only=False).astype(np.uint8)
            row = np.repeat(np.arange(b - a), np.diff(at))
            if len(common):
                i = np.minimum(np.searchsorted(common, h), len(common) - 1)
                hit = common[i] == h
            else:
                i, hit = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
            base = np.bincount(row[hit], log_c[i[hit]], b - a) + log_end
            known = np.bincount(row[hit], minlength=b - a) + known_end
            docs_at = at[1:] + np.arange(b - a)  # the end of each text among the tokens
            tree = score_tokens(model, stream(part, own)[0])
            s = blend(tree[docs_at], np.full(b - a, docs), total, weight)
            tree = np.delete(tree, docs_at)
            s += np.bincount(row[hit], blend(tree[hit], model["common_count"][i[hit]], total, weight), b - a)
            nulls = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            rows.append((ids.fill_null(0).to_numpy(), np.diff(at) + 1, base, known, s, trains, nulls))
            # A word's row says in its lowest bit whether it is of a training text.
            posts.append((h[~hit], ((n + row[~hit]) << 1) | trains[row[~hit]], tree[~hit].astype(np.float32)))
            n += b - a
            held += int((~hit).sum())
            if n >= BLOCK_ROWS or held > HELD // 2:
                yield from told()
                rows, posts, n, held, block = [], [], 0, 0, block + 1
    if rows:
        yield from told()


@lean
def _return(batches: Iterator[pa.RecordBatch], uri: str) -> Iterator[pa.RecordBatch]:
    """Counts the words of each bucket and sends logarithms back to the blocks ("s"); passes "r" on."""
    model = mapped(uri)
    whole, part = float(model["tokens"][0] + model["types"][0] + 1), float(model["unigram"][0])
    at, parts, back = None, [], []

    def told() -> None:
        h, key, tree = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        h, key, tree = h[order], key[order], tree[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        count = np.add.reduceat((key & np.uint64(1)).astype(np.int64), first)
        per = np.repeat(count, np.diff(np.append(first, len(h))))
        order = np.argsort(key, kind="stable")
        key, per, tree = key[order] >> np.uint64(1), per[order], tree[order].astype(np.float64)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        base, known = np.add.reduceat(np.log10(per + 1.0), first), np.add.reduceat((per > 0).astype(np.int64), first)
        back.append((key[first], base, known, np.add.reduceat(blend(tree, per, whole, part), first)))

    def sent() -> pa.RecordBatch:
        """What the buckets so far have for each row, added up."""
        key, base, known, model_p = (np.concatenate(c) for c in zip(*back, strict=True))
        order = np.argsort(key, kind="stable")
        key, base, known, model_p = key[order], base[order], known[order], model_p[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        base, known, model_p = (np.add.reduceat(c, first) for c in (base, known, model_p))
        key = key[first]
        block, row = key >> np.uint64(19), (key & np.uint64((1 << 19) - 1)).astype(np.uint32)
        edge = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        pairs = []
        for a, b in zip(edge, np.append(edge[1:], len(key)), strict=True):
            pairs.append((int(block[a]), b"".join(c[a:b].tobytes() for c in (row, base, known.astype(np.uint32), model_p))))
        return _rows("s", pairs)

    for batch in batches:
        for kind, bucket, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if kind == "r":
                yield _rows("r", [(bucket, raw.as_py())])
                continue
            if bucket != at:
                if at is not None:
                    told()
                    if sum(len(b[0]) for b in back) > 2 * HELD:
                        yield sent()
                        back = []
                at, parts = bucket, []
            parts.append(undo(raw.as_buffer().to_pybytes(), "u8", "u8", "f4"))
    if at is not None:
        told()
        yield sent()


@lean
def _finish(batches: Iterator[pa.RecordBatch], uri: str) -> Iterator[pa.RecordBatch]:
    """Adds up each block's rows; "r" sorts before "s"."""
    model = mapped(uri)
    tokens = int(model["tokens"][0])
    unit = float(np.log10(tokens + float(model["types"][0]) + 1.0))
    at, rows = None, None

    def told() -> pa.RecordBatch:
        ids, n, base, known, s, train, null = rows
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=null.astype(bool)), pa.array(train == 0), pa.array(n), pa.array(known), pa.array(np.full(len(n), tokens)), pa.array(base - n * unit), pa.array(s)],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    for batch in batches:
        for kind, block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = raw.as_buffer().to_pybytes()
            if kind == "r":
                if at is not None:
                    yield told()
                at, rows = block, [c.copy() for c in undo(raw, "i8", "i8", "f8", "i8", "f8", "u1", "u1")]
            else:
                if block != at:
                    raise ValueError("words came back without their texts")
                row, base, known, s = undo(raw, "u4", "f8", "u4", "f8")
                rows[2][row] += base
                rows[3][row] += known.astype(np.int64)
                rows[4][row] += s
    if at is not None:
        yield told()


def _sizes(rows: DataFrame) -> tuple[int, int]:
    """(tasks, buckets) of a step."""
    tasks = max(8, SPREAD * rows.rdd.getNumPartitions())
    return tasks, tasks * max(1, min(BUCKETS, MANY // tasks))


def _bucketed(df: DataFrame, tasks: int) -> DataFrame:
    return df.repartition(tasks, "kind", "bucket").sortWithinPartitions("kind", "bucket")


PACKED = "kind string, bucket long, packed binary"


def fit(docs: DataFrame, train: Column, share: float = SHARE, unigram: float = UNIGRAM) -> str:
    """Learns from rows of ``docs`` (doc_id, text) for which ``train`` holds; returns the model file's URI."""
    texts = docs.where(train).select("text")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks, buckets = _sizes(texts)
    modest(docs.sparkSession)
    gathered = _bucketed(texts.mapInArrow(lambda it: _gather(it, buckets), PACKED), tasks)
    summed_up = _bucketed(gathered.mapInArrow(lambda it: _reduce(it, buckets, max(2.0, COMMON * total)), PACKED), tasks)
    reduced = cut(summed_up.mapInArrow(lambda it: _shorten(it, share * total), PACKED), "lm")
    words_n, types, n_docs = 0, 0, 0
    common, tables = [], {}
    # Bounded: contexts and words that have a set share of the input, and a row of totals a bucket.
    for row in reduced.toLocalIterator():
        raw = bytes(row["packed"])
        if row["kind"] == "n":
            n, v = undo(raw, "i8")[0]
            words_n, types = words_n + int(n), types + int(v)
        elif row["kind"] == "d":
            n_docs += int(undo(raw, "i8")[0][0])
        elif row["kind"] == "c":
            common.append(undo(raw, "u8", "i8"))
        else:
            tables.setdefault(row["bucket"], []).append(undo(raw, "u8", "i8"))
    k, c = (np.concatenate(x) for x in zip(*common, strict=True)) if common else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    order = np.argsort(k)
    tree = grow({d: summed(*(np.concatenate(x) for x in zip(*parts, strict=True))) for d, parts in tables.items()})
    facts = {"common": k[order], "common_count": c[order], "docs": np.array([n_docs]), "tokens": np.array([words_n + n_docs]), "types": np.array([types + (n_docs > 0)]), "unigram": np.array([float(unigram)])}
    return save(tree | facts, work_dir(docs.sparkSession, "lm") + "/model")


def score(docs: DataFrame, train: Column, share: float = SHARE, unigram: float = UNIGRAM) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    uri = fit(docs, train, share, unigram)
    rows = docs.select("doc_id", train.alias("train"), "text")
    tasks, buckets = _sizes(rows)
    sent = _bucketed(rows.mapInArrow(lambda it: _assess(it, uri, buckets), PACKED), tasks)
    home = sent.mapInArrow(lambda it: _return(it, uri), PACKED).repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return home.mapInArrow(lambda it: _finish(it, uri), schema)
