"""Byte-level BPE by a minimal acyclic transducer over frequent words.

Encoding takes two passes.  The first counts all words of all documents; those that
occur once in every 1 / SHARE bytes (so their number is bounded) are merged once, on
the driver (1.25 million words take some 2 GB there at the most, while they are
compiled; the corpora measured have under a tenth of that), and compiled to a minimal acyclic automaton in which words share prefixes and suffixes.  Its arcs add up to
a word's number, and the number leads to the word's ids.  Automaton, merge table
and token bytes are one file in the shared folder, which tasks map to memory.  In
the second pass the words of a slice of texts are looked up in the automaton all
at once; those it lacks are merged exactly, again all at once; a word of more than LONG
symbols is merged by itself, with a queue of ranks, so that a round costs what it
merges and not the word's length.

A word here is a blank with what follows it up to the next blank (the first word
of a text has none).  The pre-tokenizer's pattern never joins over such a cut,
except where three blanks or other white-space characters meet or two end a text;
such texts are cut by the pattern itself.

Defined results: a null text is empty and has no ids; text that spells a special
token becomes that token; texts and words of any length, repeated rows and null
doc_ids need no care; an empty table gives an empty result; extra columns are kept by
``encode`` unless they are named ``ids`` (or ``decoded``, if that is asked for),
which are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import cut, lean, mapped, save, work_dir

#: Words of the lexicon occur at least so often a byte; with their blanks they have two bytes, so at most 1 / (2 * SHARE) qualify.
SHARE = 4e-7
#: A word of more bytes is left to exact merging.
LONGEST = 64
SLICE = 2 << 20
KNOWN = 300_000
#: Bytes of words that a task keeps at most beside the texts at hand.
KEPT = 32 << 20
#: Symbols from which a word is merged by itself.
LONG = 1024
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_pieces = regex.compile(PATTERN)
_joined = re.compile(r"\s\s(?:\s|\Z)")


def byte_of() -> dict[str, int]:
    """Byte for each character in which the vocabulary spells bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Pair ranks and token bytes as arrays."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.pair, self.rank, self.made, self.single = (arrays[k] for k in ("pair", "rank", "made", "single"))
        self.offset, self.bytes = arrays["token_offset"], arrays["token_bytes"]
        self.by_rank = np.argsort(self.rank)
        # Where no merge makes a token that an earlier merge takes, all places of one rank can be merged in a round.
        made = np.full(max(int(self.made.max(initial=0)), int(self.pair.max(initial=0) >> 32), int((self.pair & 0xFFFFFFFF).max(initial=0))) + 1, -1)
        np.maximum.at(made, self.made, self.rank)
        self.ordered = bool((np.maximum(made[self.pair >> 32], made[self.pair & 0xFFFFFFFF]) < self.rank).all())

    @classmethod
    def load(cls, path: str) -> Merges:
        spec = json.loads(Path(path).read_text())
        vocab, chars = spec["model"]["vocab"], byte_of()
        rows = []
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            rows.append(((vocab[a] << 32) | vocab[b], rank, vocab[a + b]))
        rows.sort()
        pair, rank, made = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        single = np.full(256, -1, np.int64)
        tokens = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for word, i in vocab.items():
            tokens[i] = bytes(chars[c] for c in word)
            if len(word) == 1:
                single[chars[word]] = i
        special = [(t["content"], t["id"]) for t in spec["added_tokens"]]
        for content, i in special:
            tokens[i] = content.encode()
        arrays = {"pair": pair, "rank": rank, "made": made, "single": single}
        arrays |= {"special": np.frombuffer(json.dumps(special).encode(), np.uint8)}
        for name, table in (("token", tokens), ("decimal", [b"%d," % i for i in range(len(tokens))])):
            arrays[f"{name}_offset"] = np.cumsum([0, *map(len, table)])
            arrays[f"{name}_bytes"] = np.frombuffer(b"".join(table), np.uint8)
        return cls(arrays)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word by exact merging: lowest rank first, leftmost first, all words in step."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        lens = np.array([len(w) for w in words], np.int64)
        for i in np.flatnonzero(lens > LONG).tolist():
            out[i] = self.merge_long(self.single[np.frombuffer(words[i], np.uint8)])
        live = np.flatnonzero((lens > 0) & (lens <= LONG))
        if not len(live):
            return out
        sym = self.single[np.frombuffer(b"".join([words[i] for i in live.tolist()]), np.uint8)]
        size = lens[live]
        worst = np.int64(1 << 40)
        word = np.repeat(np.arange(len(live)), size)
        at, rank = np.zeros(len(sym), np.int64), np.full(len(sym), worst)
        new = np.arange(len(sym))  # where the pair that begins is not yet looked up
        while len(live):
            if len(new) and new[-1] == len(sym) - 1:
                rank[-1] = worst
                new = new[:-1]
            key = (sym[new] << 32) | sym[new + 1]
            i = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            at[new] = i
            rank[new] = np.where((self.pair[i] == key) & (word[new] == word[new + 1]), self.rank[i], worst)
            start = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, start)
            done = least == worst
            for i in np.flatnonzero(done).tolist():
                out[live[i]] = sym[start[i] : start[i] + size[i]]
            where = np.flatnonzero((rank == least[word]) & (rank < worst))
            if not len(where):
                break
            # In a run of overlapping pairs every other one is merged, from the left.
            first = np.append(True, np.diff(where) > 1)
            run = where[np.flatnonzero(first)][np.cumsum(first) - 1]
            where = where[(where - run) % 2 == 0]
            if not self.ordered:
                where = where[np.append(True, word[where[1:]] != word[where[:-1]])]
            sym[where] = self.made[at[where]]
            keep = ~done[word]
            keep[where + 1] = False
            # Pairs that begin at a merged symbol or end with one are new.
            new = np.zeros(len(sym) + 1, bool)
            new[where] = True
            new[where - 1] |= where > 0
            before = np.maximum.accumulate(np.where(keep, np.arange(len(sym)), -1))
            left = before[where - 1]
            new[left[(where > 0) & (left >= 0)]] = True
            gone = np.bincount(word[where], minlength=len(live))
            live, size = live[~done], (size - gone)[~done]
            sym, at, rank, new = sym[keep], at[keep], rank[keep], np.flatnonzero(new[:-1][keep])
            word = np.repeat(np.arange(len(live)), size)
        return out

    def merge_long(self, sym: np.ndarray) -> np.ndarray:
        """The same for the symbols of one word."""
        n = len(sym)
        sym, after, before, live = sym.copy(), np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def push(at: np.ndarray) -> None:
            at = at[after[at] < n]
            key = (sym[at] << 32) | sym[after[at]]
            i = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            hit = self.pair[i] == key
            at, rank = at[hit], self.rank[i[hit]]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            first = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(at) else at
            for s, e in zip(first, np.append(first[1:], len(at)), strict=False):
                r = int(rank[s])
                if r not in places:
                    places[r] = []
                    heapq.heappush(ranks, r)
                places[r].append(at[s:e])

        push(np.arange(n - 1))
        while ranks:
            r = heapq.heappop(ranks)
            pair = self.by_rank[r]
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[live[at]]
            at = at[after[at] < n]
            at = at[((sym[at] << 32) | sym[after[at]]) == self.pair[pair]]
            if not len(at):
                continue
            i = np.arange(len(at))
            first = np.append(True, at[1:] != after[at[:-1]])
            at = at[(i - np.maximum.accumulate(np.where(first, i, 0))) % 2 == 0]
            if not self.ordered:
                push(at[1:])
                at = at[:1]
            gone = after[at]
            sym[at] = self.made[pair]
            live[gone] = False
            on = after[gone]
            after[at] = on
            before[on[on < n]] = at[on < n]
            left = before[at]
            push(np.union1d(left[left >= 0], at))
        return sym[live]

    def ids(self, units: list[str]) -> list[np.ndarray]:
        """Ids of units of text; each is cut by the pre-tokenizer's pattern first."""
        pieces, counts = [], []
        for u in units:
            # A word of ASCII letters, with a blank before it or not, is one piece.
            if u.isascii() and (u[1:] if u[:1] == " " else u).isalpha():
                pieces.append(u.encode())
                counts.append(1)
            else:
                own = _pieces.findall(u)
                pieces += [p.encode() for p in own]
                counts.append(len(own))
        flat = self.merge(pieces)
        out, i = [], 0
        for n in counts:
            out.append(flat[i] if n == 1 else np.concatenate(flat[i : i + n]) if n else np.zeros(0, np.int64))
            i += n
        return out

    def spell(self, ids: np.ndarray, name: str = "token") -> bytes:
        """The bytes (or, by name "decimal", the numbers with commas) of ids."""
        offset = self.arrays[f"{name}_offset"]
        lens = offset[ids + 1] - offset[ids]
        at = np.repeat(offset[ids] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
        return self.arrays[f"{name}_bytes"][at].tobytes()


def compile_lexicon(words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of sorted distinct words, by incremental minimization.

    ``arc`` is the sorted array of state * 256 + byte, ``to`` and ``add`` are
    what follows: the next state, and by how much the word's number grows.
    """
    register: dict[tuple, int] = {}
    states: list[tuple] = []
    path: list[list] = [[False, []]]  # final, arcs (byte, state); the last arc's state is still open

    def close(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    last = b""
    for w in words:
        same = 0
        while same < min(len(w), len(last)) and w[same] == last[same]:
            same += 1
        while len(path) > same + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], close(node)))
        for _ in w[same:]:
            path.append([False, []])
        path[-1][0] = True
        last = w
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((last[len(path) - 1], close(node)))
    root = close(path[0])
    count = [0] * len(states)
    arcs = []
    for s, (final, out) in enumerate(states):  # a state's targets come before it
        n = int(final)
        for byte, to in out:
            arcs.append((s * 256 + byte, to, n))
            n += count[to]
        count[s] = n
    arcs.sort()
    arc, to, add = (np.array(x, np.int64) for x in zip(*arcs, strict=True)) if arcs else (np.zeros(0, np.int64),) * 3
    return {"arc": arc, "to": to, "add": add, "final": np.array([f for f, _ in states]), "root": np.array([root])}


def find_words(fst: dict[str, np.ndarray], words: list[bytes]) -> np.ndarray:
    """Each word's number in the automaton, or -1; all words step on together."""
    n = len(words)
    number = np.full(n, -1, np.int64)
    if not n or not len(fst["arc"]):
        return number
    lens = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    start = np.cumsum(lens) - lens
    live, state, total = np.flatnonzero(lens <= LONGEST), None, None
    state = np.full(len(live), int(fst["root"][0]))
    total = np.zeros(len(live), np.int64)
    step = 0
    while len(live):
        ended = lens[live] == step
        good = ended & fst["final"][state]
        number[live[good]] = total[good]
        live, state, total = live[~ended], state[~ended], total[~ended]
        if not len(live):
            break
        key = state * 256 + data[start[live] + step]
        at = np.minimum(np.searchsorted(fst["arc"], key), len(fst["arc"]) - 1)
        ok = fst["arc"][at] == key
        live, state, total = live[ok], fst["to"][at[ok]], total[ok] + fst["add"][at[ok]]
        step += 1
    return number


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of slices of some MB."""
    from .words import flat, slices

    _, offsets = flat(column)
    for a, b in slices(offsets, SLICE):
        yield a, [t or "" for t in column[a:b].to_pylist()]


@lean
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of this task's words, more than once if they are many; (null, bytes) for its texts."""
    seen: Counter = Counter()
    total = held = 0

    def told():
        w = [k for k in seen if k and len(k) < LONGEST]
        return pa.RecordBatch.from_pydict({"word": pa.array(w, pa.string()), "n": pa.array([seen[k] for k in w], pa.int64())})

    for batch in batches:
        total += batch.column(0).nbytes
        for _, texts in _texts(batch.column(0)):
            for t in texts:
                words = t.split(" ")
                seen.update(words[1:])
                held += len(t)
            if len(seen) > KNOWN or held > KEPT:
                yield told()
                seen.clear()
                held = 0
    yield told()
    yield pa.RecordBatch.from_pydict({"word": pa.array([None], pa.string()), "n": pa.array([total], pa.int64())})


def build(docs: DataFrame, path: str, share: float = SHARE) -> str:
    """Counts the words of ``docs``, compiles the frequent ones; returns the file's URI."""
    text = docs.select(F.col("text").cast("string").alias("text"))
    counts = text.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut(counts.where("n > 1 OR word IS NULL"), "words")
    total = counts.where("word IS NULL").agg(F.sum("n")).first()[0] or 0
    top = counts.where((F.col("n") >= share * total) & (F.octet_length("word") < LONGEST))
    units = sorted({(" " + r["word"]) for r in top.select("word").toLocalIterator() if not r["word"][:1].isspace()}, key=str.encode)
    merges = Merges.load(path)
    ids = merges.ids(units)
    arrays = merges.arrays | compile_lexicon([u.encode() for u in units])
    arrays["word_offset"] = np.cumsum([0, *map(len, ids)])
    arrays["word_ids"] = np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int32)
    return save(arrays, work_dir(docs.sparkSession, "bpe") + "/lexicon")


class Encoder:
    """Encodes texts with the file of ``build``."""

    def __init__(self, uri: str):
        self.data = mapped(uri)
        self.merges = Merges(self.data)
        self.special = dict(json.loads(self.data["special"].tobytes()))
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.long = 0

    def learn(self, units: list[str]) -> None:
        raw = [u.encode() for u in units]
        number = find_words(self.data, raw)
        offset, ids = self.data["word_offset"], self.data["word_ids"]
        for i in np.flatnonzero(number >= 0).tolist():
            self.known[units[i]] = ids[offset[number[i]] : offset[number[i] + 1]].tobytes()
        new = [units[i] for i in np.flatnonzero(number < 0).tolist()]
        for u, x in zip(new, self.merges.ids(new), strict=True):
            self.known[u] = x.astype(np.int32).tobytes()
            self.long += len(u) if len(u) > LONGEST else 0

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        if _joined.search(text):
            return _pieces.findall(text)
        first, *rest = text.split(" ")
        return [first, *(" " + w for w in rest)] if first else [" " + w for w in rest]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = []
        for t in texts:
            if self.split is not None and any(s in t for s in self.special):
                parts = [[p] if p in self.special else self.units(p) for p in self.split.split(t)]
                cut.append([u for p in parts for u in p])
            else:
                cut.append(self.units(t))
        new = set().union(*cut) - self.known.keys()
        if len(self.known) + len(new) > KNOWN or self.long > KEPT:
            self.known.clear()
            self.long = 0
            new = set().union(*cut)
        for s, i in self.special.items():
            if s in new:
                new.discard(s)
                self.known[s] = np.array([i], np.int32).tobytes()
        self.learn(list(new)) if new else None
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, c)), np.int32) for c in cut]


@lean
def _encode(batches: Iterator[pa.RecordBatch], uri: str, check: bool) -> Iterator[pa.RecordBatch]:
    coder = Encoder(uri)
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for a, texts in _texts(batch.column(at)):
            ids = coder.encode(texts)
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            part = batch.slice(a, len(texts))
            more = {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))}
            if check:
                more["decoded"] = pa.array([coder.merges.spell(i.astype(np.int64)) == t.encode() for i, t in zip(ids, texts, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*part.columns, *more.values()], names=[*batch.schema.names, *more])


def encode(docs: DataFrame, uri: str, check: bool = False) -> DataFrame:
    """``docs`` with the column ``ids``, an array of int; to ``check`` adds ``decoded``, whether they decode to the text."""
    docs = docs.drop("ids", *["decoded"] * check)
    more = [T.StructField("ids", T.ArrayType(T.IntegerType())), *[T.StructField("decoded", T.BooleanType())] * check]
    return docs.mapInArrow(lambda it: _encode(it, uri, check), T.StructType([*docs.schema.fields, *more]))


@lean
def _decode(batches: Iterator[pa.RecordBatch], uri: str) -> Iterator[pa.RecordBatch]:
    merges = Merges(mapped(uri))
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("ids"))
        offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
        texts = [merges.spell(flat[a:b].astype(np.int64)).decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        rest = [i for i, c in enumerate(batch.schema.names) if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(texts, pa.string())], names=[*(batch.schema.names[i] for i in rest), "text"])


def decode(rows: DataFrame, uri: str) -> DataFrame:
    """``rows`` with ``text``, what their ``ids`` decode to; null ids are none."""
    rows = rows.drop("text").withColumn("ids", F.coalesce("ids", F.expr("CAST(array() AS array<int>)")))
    schema = T.StructType([*rows.schema.fields, T.StructField("text", T.StringType())])
    return rows.mapInArrow(lambda it: _decode(it, uri), schema)


@lean
def _digests(batches: Iterator[pa.RecordBatch], uri: str) -> Iterator[pa.RecordBatch]:
    merges = Merges(mapped(uri))
    for batch in batches:
        ids = batch.column(1)
        offsets = ids.offsets.to_numpy()
        flat = ids.values.to_numpy()
        rows = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = flat[a:b].astype(np.int64)
            text = merges.spell(own).decode("utf-8", "replace")
            rows.append((b - a, hashlib.sha256(merges.spell(own, "decimal")[:-1]).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        if rows:
            n, i, d = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(i), pa.array(d)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(encoded: DataFrame, uri: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of rows of (doc_id, ids)."""
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids")
    return rows.mapInArrow(lambda it: _digests(it, uri), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def round_trip(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes every text, decodes the ids, returns the digests of both."""
    uri = build(docs, path or default_path())
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return digests(encode(rows, uri), uri)
