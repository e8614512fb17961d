"""Near-duplicate documents by an LSH forest, confirmed on full shingle sets.

1. One pass over the texts makes each document's shingle set, a digest of it and
   POSITIONS MinHash values.  Documents of equal sets are one class from here on,
   under a number of its own; where a member's row lies is kept with it.
2. TREES sorted orders of the classes: an order's key is the signature from its own
   position on, so documents with a long common prefix are neighbours in it.  The
   orders are range-partitioned.  A region is a run of equal prefixes of LEAST values.
   One of up to CHUNK classes lies in one task; only larger ones, which are counted
   and listed first, are spread over tasks.
3. In a region of up to REGION
   classes all pairs are compared by signature; in a larger one the depth adapts:
   pairs with prefixes twice as long, in runs of up to REGION, and each class's
   NEAR next neighbours.  Each class keeps the best partner before it.
4. These pairs are confirmed on full sets and give components.  Then the orders are
   read again with the components: whatever pair of different components shares a
   region is compared by signature, then by parity bitmaps of the full sets, whose
   distance is never above that of the sets, and if it still may link, on the sets.
   Only pairs within one component are never confirmed, as they
   change nothing, and only links that join components are handed on.  A region of
   more than CHUNK classes is dealt to blocks in files of the shared folder, those of
   its largest component apart; each block of the others meets each block.

Full sets lie in files of the shared folder, and tasks read those they need by
offset; neither texts, sets nor pairs are joined.  Thus large groups of copies cost
rows in proportion to their members, and what step 3 skips in a large region step 4
takes up.  A pair at the threshold of 0.8 shares a region of some order with
probability 1 - (1 - 0.8**4)**16 = 0.9998.  Where very many classes of a region are
alike but don't link, step 4 costs some 20 ns for each of their pairs.

Defined results: texts without words and null texts have no shingles and are
linked with nothing; null doc_ids take no part and stay; repeated rows are alike,
and rows of one doc_id with unlike texts are documents of their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .places import FILE, ROW, Marks, placed, taken, write_marks
from .store import bounded, cut, drop, lean, open_store, work_dir
from .words import flat, mix, shingles, slices, words

POSITIONS = 64
TREES = 16
LEAST = 4
REGION = 64
NEAR = 3
#: Share of equal signature values from which a pair may link; at a similarity of 0.8 this is four deviations down.
HOPE = 0.6
CHUNK = 8192
BLOCK = 4096

_odd = mix(np.arange(1, POSITIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_plus = mix(np.arange(1, POSITIONS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """POSITIONS MinHash values of 16 bits for each set; the sets must not be empty."""
    lens = np.array([len(s) for s in sets])
    out = np.empty((len(sets), POSITIONS), np.uint16)
    if len(sets):
        flat_set, start = np.concatenate(sets), np.cumsum(lens) - lens
        for k in range(POSITIONS):
            h = ((flat_set * _odd[k] + _plus[k]) >> np.uint64(32)).astype(np.uint32)
            out[:, k] = np.minimum.reduceat(h, start).astype(np.uint16)
    return out


@lean
def _sketch(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch.column(1))
        for a, b in slices(offsets, 1 << 20):
            own = offsets[a : b + 1] - offsets[a]
            sets = list(shingles(*words(data[offsets[a] : offsets[b]], own), k))
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = signature([sets[i] for i in full])
            digest: list[bytes | None] = [None] * len(sets)
            sigs: list[bytes | None] = [None] * len(sets)
            for j, i in enumerate(full):
                digest[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                sigs[i] = sig[j].astype(">u2").tobytes()
            own = [batch.column(i)[a:b] for i in (0, 2, 3)]
            facts = [pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays([*own, *facts], ["doc_id", FILE, ROW, "n", "digest", "sig"])


@lean
def _sets(batches: Iterator[pa.RecordBatch], k: int, folder: str, wanted: str) -> Iterator[pa.RecordBatch]:
    """Writes the sets of wanted texts to a file of this task; rows say where."""
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    marks = Marks(wanted, -1)
    name, out, at = uuid.uuid4().hex[:16], None, 0
    for batch in batches:
        cid = marks.values(batch.column(1), batch.column(2))
        keep = np.flatnonzero(cid >= 0)
        if not len(keep):
            continue
        data, offsets = flat(batch.column(0).take(pa.array(keep)))
        for a, b in slices(offsets, 1 << 20):
            own = offsets[a : b + 1] - offsets[a]
            packed = [s.astype("<u8").tobytes() for s in shingles(*words(data[offsets[a] : offsets[b]], own), k)]
            if out is None:
                out = store.open_output_stream(f"{path}/{name}", compression=None)
            out.write(b"".join(packed))
            size = np.array([len(x) for x in packed], np.int64)
            where = at + np.cumsum(size) - size
            at += int(size.sum())
            yield pa.RecordBatch.from_arrays([pa.array(cid[keep[a:b]]), pa.array([name] * len(size)), pa.array(where), pa.array(size)], ["cid", "file", "at", "size"])
    if out is not None:
        out.close()


class Sets:
    """Sets read by offset; those last used stay in memory, up to a bound."""

    MOST = 64 << 20

    def __init__(self, folder: str):
        self.store, self.path = open_store(folder)
        self.files: dict[str, object] = {}
        self.sets: dict[tuple[str, int], np.ndarray] = {}
        self.bytes = 0

    def get(self, file: str, at: int, size: int) -> np.ndarray:
        got = self.sets.get((file, at))
        if got is None:
            if len(self.files) > 64:
                self.files.clear()
            if file not in self.files:
                self.files[file] = self.store.open_input_file(f"{self.path}/{file}")
            got = np.frombuffer(self.files[file].read_at(size, at), "<u8")
            if self.bytes > self.MOST:
                self.sets.clear()
                self.bytes = 0
            self.sets[file, at] = got
            self.bytes += got.nbytes
        return got


def fits(a: int | np.ndarray, b: int | np.ndarray, shared: int | np.ndarray, percent: int) -> bool | np.ndarray:
    """Whether sets of ``a`` and ``b`` elements link if they share so many."""
    return 100 * shared >= percent * (a + b - shared)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether sorted distinct arrays have 100 * intersection >= percent * union."""
    return bool(fits(len(a), len(b), min(len(a), len(b)), percent)) and bool(linked(a, [b], percent)[0])


def linked(x: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of some sets, none empty, link with x."""
    size = np.array([len(s) for s in others])
    every = np.concatenate(others)
    hit = x[np.minimum(np.searchsorted(x, every), len(x) - 1)] == every
    return fits(len(x), size, np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size), percent)


class Parity:
    """Bitmaps of sets: a bit says whether an odd number of elements falls on it.

    Two bitmaps differ in no more bits than their sets in elements, so what the
    bitmaps rule out does not link.
    """

    def __init__(self, sizes: np.ndarray, get):
        self.get = get
        self.log = max(9, min(15, int(2 * sizes.max(initial=1) - 1).bit_length()))
        self.rows = np.zeros((len(sizes), 1 << (self.log - 6)), np.uint64)
        self.have = np.zeros(len(sizes), bool)

    def of(self, i: np.ndarray) -> np.ndarray:
        for j in i[~self.have[i]].tolist():
            odd = np.bincount((self.get(j) >> np.uint64(64 - self.log)).astype(np.int64), minlength=1 << self.log) & 1
            self.rows[j] = np.packbits(odd.astype(np.uint8)).view(np.uint64)
            self.have[j] = True
        return self.rows[i]

    def may(self, x: int, other: np.ndarray, count: np.ndarray, percent: int) -> np.ndarray:
        """Those of ``other`` that may link with x; ``count`` has the sets' numbers of elements."""
        if not len(other):
            return other
        apart = np.bitwise_count(self.of(other) ^ self.of(np.array([x]))).sum(axis=1, dtype=np.int64)
        return other[fits(count[x], count[other], (count[x] + count[other] - apart) // 2, percent)]


@lean
def _confirm(batches: Iterator[pa.RecordBatch], percent: int, folder: str) -> Iterator[pa.RecordBatch]:
    sets = Sets(folder)
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("file_a", "at_a", "size_a", "file_b", "at_b", "size_b")]
        keep = [similar(sets.get(*r[:3]), sets.get(*r[3:]), percent) for r in zip(*cols, strict=True)]
        where = pa.array(np.flatnonzero(keep))
        yield pa.RecordBatch.from_arrays([batch.column("a").take(where), batch.column("b").take(where)], ["a", "b"])


class Region:
    """Runs of equal key prefixes among sorted rows of one task."""

    def __init__(self, rows: pa.RecordBatch | pa.Table):
        col = lambda c: rows.column(c).combine_chunks() if isinstance(rows, pa.Table) else rows.column(c)
        n = rows.num_rows
        self.tree = col("tree").to_numpy()
        raw = np.frombuffer(col("key").cast(pa.binary(4 * LEAST)).buffers()[1], np.uint8)
        at = col("key").offset * 0
        self.key = raw[at : at + n * 4 * LEAST].view(">u8").reshape(n, 2)
        self.cid = col("cid").to_numpy()
        sketch = col("sketch").cast(pa.binary(POSITIONS))
        self.sketch = np.frombuffer(sketch.buffers()[1], np.uint8)[: n * POSITIONS].reshape(n, POSITIONS)
        change = np.ones(n, bool)
        change[1:] = (self.tree[1:] != self.tree[:-1]) | (self.key[1:, 0] != self.key[:-1, 0])
        deeper = change.copy()
        deeper[1:] |= self.key[1:, 1] != self.key[:-1, 1]
        self.end, self.size = self._runs(change)
        self.sub_end, self.sub_size = self._runs(deeper)

    @staticmethod
    def _runs(change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.flatnonzero(change)
        stop = np.append(start[1:], len(change))
        which = np.cumsum(change) - 1
        return stop[which], (stop - start)[which]

    def close(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self.sketch[i] == self.sketch[j]).mean(axis=1) if len(i) else np.zeros(0)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in pieces that end with a region; only an oversized one is cut, after CHUNK rows."""
    have: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        have.append(batch)
        n += batch.num_rows
        if n < CHUNK:
            continue
        rows = pa.Table.from_batches(have).combine_chunks()
        key, tree = rows.column("key"), rows.column("tree")
        last = n - 1
        stop = n
        while stop > 0 and n - stop < CHUNK and tree[stop - 1] == tree[last] and key[stop - 1].as_buffer()[: 2 * LEAST].equals(key[last].as_buffer()[: 2 * LEAST]):
            stop -= 1
        if n - stop >= CHUNK or stop == 0:
            stop = n
        yield rows.slice(0, stop)
        have, n = rows.slice(stop).to_batches(), n - stop
    if n:
        yield pa.Table.from_batches(have).combine_chunks()


def _tight(rows: pa.Table) -> pa.Table:
    return rows.take(pa.array(np.arange(rows.num_rows)))


@lean
def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, close): the best partner with a smaller id of each class; (a, null, 0) for a class that has any."""
    for rows in _chunks(batches):
        r = Region(_tight(rows))
        n = len(r.cid)
        i = np.flatnonzero(r.size > 1)
        best, partner = np.zeros(n), np.full(n, -1)
        seen = (r.size > REGION) | rows.column("big").to_numpy()
        step = 1
        while len(i):
            i = i[i + step < r.end[i]]
            i = i[(r.size[i] <= REGION) | (step <= NEAR) | ((i + step < r.sub_end[i]) & (r.sub_size[i] <= REGION))]
            c = r.close(i, i + step)
            ok = c >= HOPE
            x, y, c = i[ok], i[ok] + step, c[ok]
            seen[x] = True
            seen[y] = True
            swap = r.cid[x] < r.cid[y]
            for src, dst in ((np.where(swap, y, x), np.where(swap, x, y)),):
                # Within a step a class may stand on both sides; later writes must not lose to earlier ones.
                order = np.argsort(c, kind="stable")
                src, dst, cc = src[order], dst[order], c[order]
                better = cc > best[src]
                best[src[better]] = cc[better]
                partner[src[better]] = dst[better]
            step += 1
        got = np.flatnonzero(partner >= 0)
        alone = np.flatnonzero(seen & (partner < 0))
        a = np.concatenate((r.cid[got], r.cid[alone]))
        b = pa.array(np.concatenate((r.cid[partner[got]], r.cid[alone])), mask=np.arange(len(a)) >= len(got))
        yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate((best[got], np.zeros(len(alone)))))], ["a", "b", "close"])


def _equal(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Number of equal sketch bytes of each row and one."""
    same = (rows == one).view(np.uint64)
    total = same[:, 0].copy()
    for i in range(1, POSITIONS // 8):
        total += same[:, i]
    return ((total * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64)


def _joins(x: int, other: np.ndarray, group: np.ndarray, most: int, size: np.ndarray, sketch: np.ndarray, parity: Parity, percent: int) -> Iterator[int]:
    """Rows of ``other`` by which row x joins components it wasn't of; ``group`` follows."""
    other = other[group[other] != group[x]]
    other = other[100 * np.minimum(size[x], size[other]) >= percent * np.maximum(size[x], size[other])]
    close = _equal(sketch[other], sketch[x])
    other = other[np.argsort(-close, kind="stable")][: int((close >= HOPE * POSITIONS).sum())]
    other = parity.may(x, other, size // 8, percent)
    most_at_once = 1
    while len(other):
        part, other = other[:most_at_once], other[most_at_once:]
        for y in part[linked(parity.get(x), [parity.get(y) for y in part.tolist()], percent)].tolist():
            if group[x] != group[y]:
                yield y
                # What x's component had meets no more than what y's did: they are one now.  The
                # largest keeps its number, by which later rows find its members.
                gone, stay = (group[y], group[x]) if group[x] == most else (group[x], group[y])
                group[group == gone] = stay
        other = other[group[other] != group[x]]
        most_at_once = min(8 * most_at_once, max(1, (4 << 20) // max(int(size[x]), 1)))


def _links(cid: np.ndarray, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    at = np.array(pairs, np.int64).reshape(-1, 2)
    a, b = cid[at[:, 0]], cid[at[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


@lean
def _rest(batches: Iterator[pa.RecordBatch], percent: int, folder: str) -> Iterator[pa.RecordBatch]:
    """(a, b): confirmed links between classes of a region whose components nothing in this task had joined."""
    sets = Sets(folder)
    for rows in _chunks(batches):
        r = Region(_tight(rows))
        comp, size = rows.column("comp").to_numpy(), rows.column("size").to_numpy()
        file, at = rows.column("file").to_pylist(), rows.column("at").to_pylist()
        out = []
        for s in np.flatnonzero(np.append(True, r.end[1:] != r.end[:-1])).tolist():
            e = int(r.end[s])
            ids, group, counts = np.unique(comp[s:e], return_inverse=True, return_counts=True)
            if len(ids) < 2:
                continue
            most = int(counts.argmax())
            parity = Parity(size[s:e] // 8, lambda i: sets.get(file[s + i], at[s + i], int(size[s + i])))  # noqa: B023
            # Everything outside the largest component meets everything of the region.
            for x in np.flatnonzero(group != most).tolist():
                other = np.flatnonzero((group == most) | (np.arange(e - s) > x))
                out += [(s + x, s + y) for y in _joins(x, other, group, most, size[s:e], r.sketch[s:e], parity, percent)]
        yield _links(r.cid, out)


@lean
def _blocks(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Writes each run of equal (tree, prefix, block) to a file of this task; rows say where."""
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    name, out, at = uuid.uuid4().hex[:16], None, 0
    have: list[pa.RecordBatch] = []

    def told(run: pa.Table) -> pa.RecordBatch:
        nonlocal out, at
        if out is None:
            out = store.open_output_stream(f"{path}/{name}", compression=None)
        sink = pa.BufferOutputStream()
        body = run.select(["cid", "comp", "sketch", "file", "at", "size"])
        with pa.ipc.new_stream(sink, body.schema) as writer:
            writer.write_table(body)
        raw = sink.getvalue()
        out.write(raw)
        at += raw.size
        ids = [run.column(c).slice(0, 1).combine_chunks() for c in ("tree", "prefix", "block")]
        return pa.RecordBatch.from_arrays([*ids, pa.array([name]), pa.array([at - raw.size], pa.int64()), pa.array([raw.size], pa.int64())], ["tree", "prefix", "block", "file", "at", "size"])

    for batch in batches:
        if not batch.num_rows:
            continue
        have.append(batch)
        rows = pa.Table.from_batches(have)
        ids = list(zip(*(rows.column(c).to_pylist() for c in ("tree", "prefix", "block")), strict=True))
        edge = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1])]
        for s, e in zip(edge, edge[1:], strict=False):
            yield told(rows.slice(s, e - s))
        have = rows.slice(edge[-1]).to_batches()
    if have:
        yield told(pa.Table.from_batches(have))
    if out is not None:
        out.close()


@lean
def _meet(batches: Iterator[pa.RecordBatch], percent: int, blocks: str, folder: str) -> Iterator[pa.RecordBatch]:
    """(a, b): confirmed links between the classes of two blocks, or of one."""
    sets = Sets(folder)
    store, path = open_store(blocks)

    def read(file: str, at: int, size: int) -> pa.Table:
        with store.open_input_file(f"{path}/{file}") as f:
            return pa.ipc.open_stream(f.read_at(size, at)).read_all()

    for batch in batches:
        for r in batch.to_pylist():
            first = read(r["file_i"], r["at_i"], r["size_i"])
            n = first.num_rows
            alone = r["i"] == r["j"]
            rows = (first if alone else pa.concat_tables([first, read(r["file_j"], r["at_j"], r["size_j"])])).combine_chunks()
            cid, size = rows.column("cid").to_numpy(), rows.column("size").to_numpy()
            file, at = rows.column("file").to_pylist(), rows.column("at").to_pylist()
            sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, POSITIONS)
            ids, group = np.unique(rows.column("comp").to_numpy(), return_inverse=True)
            most = int(np.searchsorted(ids, r["most"])) if r["most"] in ids else -1
            parity = Parity(size // 8, lambda i: sets.get(file[i], at[i], int(size[i])))  # noqa: B023
            out = []
            for x in range(n):
                other = np.arange(x + 1 if alone else n, len(cid))
                out += [(x, y) for y in _joins(x, other, group, most, size, sketch, parity, percent)]
            yield _links(cid, out)


def in_trees(classes: DataFrame, *keep: str) -> DataFrame:
    """TREES rows of (tree, prefix, key, cid, sketch) a class; regions are of equal tree and prefix."""
    twice = F.concat("sig", "sig")
    sketch = F.expr(f"unhex(array_join(transform(sequence(1, {POSITIONS}), i -> substring(hex(sig), 4 * i - 1, 2)), ''))")
    rows = classes.select("cid", "sig", sketch.alias("sketch"), *keep)
    rows = rows.select("cid", "sketch", *keep, twice.alias("twice"), F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    key = lambda n: F.substring("twice", F.col("tree") * (2 * LEAST) + 1, F.lit(n))
    return rows.select("tree", key(2 * LEAST).alias("prefix"), key(4 * LEAST).alias("key"), "cid", "sketch", *keep)


def oversized(classes: DataFrame) -> DataFrame:
    """(tree, prefix) of the regions of more than CHUNK classes, at most TREES / CHUNK a class."""
    return in_trees(classes).groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK).select("tree", "prefix")


def orders(classes: DataFrame, big: DataFrame) -> DataFrame:
    """The rows of ``in_trees`` in sorted order; only regions of ``big`` are spread over partitions."""
    rows = in_trees(classes).join(bounded(big.withColumn("big", F.lit(True))), ["tree", "prefix"], "left")
    rows = rows.withColumn("big", F.coalesce("big", F.lit(False)))
    spread = [F.when(F.col("big"), F.col(c)) for c in ("key", "cid")]
    return rows.repartitionByRange("tree", "prefix", *spread).sortWithinPartitions("tree", "key", "cid")


def across(classes: DataFrame, big: DataFrame, percent: int, folder: str) -> DataFrame:
    """Links (a, b) between components of the regions of ``big``, each compared as a whole by pairs of blocks."""
    spark = classes.sparkSession
    rows = in_trees(classes, "comp", "file", "at", "size").join(bounded(big), ["tree", "prefix"])
    held = rows.groupBy("tree", "prefix", "comp").agg(F.count(F.lit(1)).alias("n"))
    most = F.max_by("comp", F.struct("n", "comp"))
    split = held.groupBy("tree", "prefix").agg(most.alias("most"), F.max("n").alias("inner"), F.sum("n").alias("n")).where("n > inner")
    up = lambda n: F.ceil(n / BLOCK).cast("long")
    split = cut(split.select("tree", "prefix", "most", up(F.col("n") - F.col("inner")).alias("n_outer"), up(F.col("inner")).alias("n_inner")), "split")
    pairs = split.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_outer") - 1)).alias("i"))
    pairs = pairs.select("tree", "prefix", "most", "i", F.explode(F.sequence("i", F.col("n_outer") + F.col("n_inner") - 1)).alias("j"))
    dealt = F.when(F.col("comp") == F.col("most"), F.col("n_outer") + F.pmod(F.xxhash64("cid"), "n_inner")).otherwise(F.pmod(F.xxhash64("cid"), "n_outer"))
    rows = rows.join(bounded(split), ["tree", "prefix"]).withColumn("block", dealt).select("tree", "prefix", "block", "cid", "comp", "sketch", "file", "at", "size")
    blocks = work_dir(spark, "blocks")
    rows = rows.repartition("tree", "prefix", "block").sortWithinPartitions("tree", "prefix", "block")
    index = cut(rows.mapInArrow(lambda it: _blocks(it, blocks), "tree int, prefix binary, block long, file string, at long, size long"), "blocks")
    where = lambda x: index.select("tree", "prefix", F.col("block").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("file", "at", "size")])
    pairs = cut(pairs.join(where("i"), ["tree", "prefix", "i"]).join(where("j"), ["tree", "prefix", "j"]), "pairs")
    # Rows are few and each is much work: as many tasks as there are, within bounds, which Spark then doesn't unite.
    tasks = max(1, min(pairs.count(), 8 * spark.sparkContext.defaultParallelism + 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return pairs.repartition(tasks, "tree", "prefix", "i", "j").mapInArrow(lambda it: _meet(it, percent, blocks, folder), "a long, b long")


def confirmed(pairs: DataFrame, index: DataFrame, percent: int, folder: str) -> DataFrame:
    """Those of the pairs (a, b) that link, by their full sets."""
    where = lambda x: index.select(F.col("cid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("file", "at", "size")])
    both = pairs.join(where("a"), "a").join(where("b"), "b")
    return both.mapInArrow(lambda it: _confirm(it, percent, folder), "a long, b long")


def _linked(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Each row of ``placed`` documents: (doc_id, n, FILE, ROW, first, head).

    ``first`` and ``head`` are the (doc_id, FILE, ROW) that stand for the row's class
    and for its component; null where the row takes no part.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), FILE, ROW)
    thin = cut(texts.mapInArrow(lambda it: _sketch(it, k), f"doc_id long, {FILE} long, {ROW} long, n long, digest binary, sig binary"), "sketches")
    some = thin.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = some.groupBy("digest").agg(F.min(F.struct("doc_id", FILE, ROW)).alias("first"), F.first("sig").alias("sig"))
    # Numbers are given as the table is written, so they are the same whenever it is read.
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    big = cut(oversized(classes), "oversized")
    found = cut(orders(classes, big).mapInArrow(_partners, "a long, b long, close double"), "partners")
    paired = found.select(F.col("a").alias("cid")).unionByName(found.where("b IS NOT NULL").select(F.col("b").alias("cid"))).distinct()
    # Only classes that may have a partner need their sets.
    wanted = write_marks(classes.join(paired, "cid").select(f"first.{FILE}", f"first.{ROW}", F.col("cid").alias("value")))
    folder = work_dir(docs.sparkSession, "sets")
    index = cut(texts.select("text", FILE, ROW).mapInArrow(lambda it: _sets(it, k, folder, wanted), "cid long, file string, at long, size long"), "index")
    first = found.where("b IS NOT NULL").groupBy("a").agg(F.max_by("b", F.struct("close", "b")).alias("b"))
    links = cut(confirmed(first, index, percent, folder), "links")
    drop(found)
    known = components(links)
    joined = classes.select("cid", "sig").join(index, "cid").join(known.withColumnRenamed("node", "cid"), "cid", "left")
    joined = cut(joined.select("cid", "sig", "file", "at", "size", F.coalesce("component", "cid").alias("comp")), "joined")
    drop(known, index)
    whole = in_trees(joined, "comp", "file", "at", "size").join(bounded(big), ["tree", "prefix"], "left_anti")
    whole = whole.repartitionByRange("tree", "prefix").sortWithinPartitions("tree", "key", "cid")
    links = links.unionByName(cut(whole.mapInArrow(lambda it: _rest(it, percent, folder), "a long, b long"), "rest"))
    if not big.isEmpty():
        links = links.unionByName(cut(across(joined, big, percent, folder), "across"))
    drop(joined)
    known = components(links).withColumnRenamed("node", "cid")
    members = known.join(classes.select("cid", "first"), "cid")
    known = known.join(members.groupBy("component").agg(F.min("first").alias("head")), "component").select("cid", "head")
    named = classes.select("digest", "cid", "first").join(known, "cid", "left").select("digest", "first", F.coalesce("head", "first").alias("head"))
    out = some.select("doc_id", "n", FILE, ROW, "digest").join(named, "digest").drop("digest")
    # Rows that take no part have no digest to be joined by, and don't meet in one task.
    rest = thin.where("digest IS NULL OR doc_id IS NULL").select("doc_id", "n", FILE, ROW)
    return out.unionByName(rest, allowMissingColumns=True)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept) of each document."""
    rows = _linked(placed(docs.select("doc_id", "text")), k, percent)
    of = lambda c: F.coalesce(F.col(c)["doc_id"], F.col("doc_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), of("first").alias("class_id"), of("head").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, of its smallest doc_id; rows that take no part stay."""
    rows = placed(docs)
    found = _linked(rows, k, percent)
    head = F.col("head")
    gone = found.where(head.isNotNull() & ((head[FILE] != F.col(FILE)) | (head[ROW] != F.col(ROW))))
    return taken(rows, write_marks(gone.select(FILE, ROW, F.lit(0).alias("value"))))
