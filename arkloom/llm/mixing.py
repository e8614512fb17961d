"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length within each source.  A source's target is
taken as whole passes over the source plus a remaining budget, and a bounded
knapsack over the length counts says how many documents of each length fill it.
Which ones is settled by a seeded hash, so reruns agree.  First every length gives
an even share of its documents, which keeps a source's mix of lengths; of what
rounding leaves, the part above WINDOW is filled by large lengths first, and the
knapsack fits the last WINDOW words.  Its memory is bounded by WINDOW, whatever the
number of documents, of lengths, or the longest text.

Only rows of (doc_id, source, size) move: neither texts nor lists of documents
leave the tasks that read them.  A length that very many documents of a source
share is dealt over HASHES buckets, and only the bucket in which the count falls
is ranked.

Targets are computed in one task, from one row a source.

Defined results: a null text has size 0 and is never taken; null sources form a
source of their own, last in order; a null doc_id and repeated rows are rows like
others (many rows without doc_id are dealt over the buckets like others), and of
rows alike in all three columns any may be taken; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .places import FILE, ROW, placed, taken, write_marks
from .store import cut

WORD = r"[^\x20\x09-\x0D]+"
HASHES = 4096
#: So many words of a budget at least are fitted by dynamic programming.
WINDOW = 1 << 17


def knapsack(sizes: list[int], counts: list[int], budget: int, window: int = WINDOW) -> list[int]:
    """How many of each size (at most ``counts``) come nearest to ``budget``.

    Bounded knapsack over sums, as a bit set: a bit of the integer says that a sum can
    be made, and ``first`` by which step it was made first, which leads back to the
    counts.  Sums above twice the budget are worse than none, so they are left out.
    """
    taken = [0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    for i in order:
        if budget > window and sizes[i] > 0:
            k = min(counts[i], (budget - window // 2) // sizes[i])
            taken[i] += k
            budget -= k * sizes[i]
    left = [(sizes[i], counts[i] - taken[i], i) for i in order if 0 < sizes[i] <= 2 * budget and counts[i] > taken[i]]
    if budget <= 0 or not left:
        return taken
    if sum(s * n for s, n, _ in left) <= budget:
        for _, n, i in left:
            taken[i] += n
        return taken
    top = 2 * budget
    full = (1 << (top + 1)) - 1
    reach, steps, first = 1, [], np.full(top + 1, -1, np.int32)
    for s, n, i in left:
        n, part = min(n, top // s), 1
        while n > 0:
            part = min(part, n)
            new = (reach << (s * part)) & full & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(top // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits)] = len(steps)
                steps.append((s * part, part, i))
                reach |= new
            n -= part
            part *= 2
        if reach >> budget & 1:
            break
    below = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = reach >> budget
    above = budget + (above & -above).bit_length() - 1 if above else None
    goal = below if above is None or budget - below <= above - budget else above
    # A sum that a step made first comes from one that an earlier step made.
    while goal:
        weight, part, i = steps[first[goal]]
        goal -= weight
        taken[i] += part
    return taken


def fit_source(lengths: pd.DataFrame) -> pd.DataFrame:
    """Passes and further documents for each length of one source."""
    lengths = lengths.sort_values("size", ascending=False)
    size, n = lengths["size"].tolist(), lengths["n"].tolist()
    total, target = sum(s * k for s, k in zip(size, n, strict=True)), float(lengths["target"].iloc[0])
    passes, extra = 0, [0] * len(size)
    if total > 0:
        passes = min(int(target // total), 3)
        budget = round(target - passes * total) if passes < 3 else 0
        # An even share of every length keeps the source's mix of lengths; the knapsack fits what rounding leaves.
        extra = [k * budget // total for k in n]
        rest = knapsack(size, [k - e for k, e in zip(n, extra, strict=True)], budget - sum(s * e for s, e in zip(size, extra, strict=True)))
        extra = [e + r for e, r in zip(extra, rest, strict=True)]
    return pd.DataFrame({"skey": lengths["skey"], "size": lengths["size"], "passes": passes, "extra": np.array(extra, np.int64)})


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """Adds each source's target to rows of (skey, source, source_size).

    A source whose share is above ``most`` times its size gets that much, and the
    excess is shared again by weight.  The level at which it settles follows from
    one pass in order of cap over weight.  There is one row a source here.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    s = sources.select("*", w.alias("w")).select("*", (F.col("source_size") * float(most)).alias("cap"))
    s = s.withColumn("ratio", F.col("cap") / F.col("w"))
    all_rows = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    s = s.select(
        "*",
        (
            (F.sum("source_size").over(all_rows).cast("double") - zero(F.sum("cap").over(before)))
            / (F.sum("w").over(all_rows) - zero(F.sum("w").over(before)))
        ).alias("level"),
    )
    settled = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(all_rows)["level"]
    s = s.withColumn("settled", settled)
    capped = F.col("settled").isNull() | (F.col("level") > F.col("ratio"))
    return s.select("skey", "source_size", F.when(capped, F.col("cap")).otherwise(F.col("settled") * F.col("w")).alias("target"))


def mix(docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, keep: list[Column] | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    thin = docs.select("doc_id", "source", size.alias("size"), *(keep or []))
    thin = thin.select("*", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("skey"), F.xxhash64(F.lit(seed), "doc_id", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())).alias("h"))
    thin = cut(thin.withColumn("hb", F.pmod("h", F.lit(HASHES)).cast("int")), "mix")
    buckets = thin.groupBy("skey", "source", "size", "hb").agg(F.count(F.lit(1)).alias("n"))
    lengths = buckets.groupBy("skey", "source", "size").agg(F.sum("n").alias("n"))
    sources = lengths.groupBy("skey", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goal = cut(targets(sources, weights, most), "targets")
    fitted = (
        lengths.drop("source").join(goal, "skey").groupBy("skey").applyInPandas(lambda p: fit_source(p), "skey string, size long, passes long, extra long")
    )
    fitted = cut(fitted.join(goal, "skey"), "fitted")
    upto = Window.partitionBy("skey", "size").orderBy("hb").rowsBetween(Window.unboundedPreceding, -1)
    deal = buckets.select("skey", "size", "hb", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    deal = deal.join(fitted, ["skey", "size"]).select("skey", "size", "hb", (F.col("extra") - F.col("before")).alias("k"), "passes", "source_size", "target")
    rows = thin.join(deal, ["skey", "size", "hb"])
    order = F.row_number().over(Window.partitionBy("skey", "size", "hb").orderBy("h", "doc_id"))
    rows = rows.withColumn("copies", F.col("passes") + (order <= F.col("k")).cast("long"))
    extra = [c for c in thin.columns if c not in ("doc_id", "source", "size", "skey", "h", "hb")]
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", *extra)


def mixed(docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it.

    Copies are decided on thin rows, which find their texts again by place.
    """
    rows = placed(docs)
    plan = mix(rows, seed, weights, most, keep=[F.col(FILE), F.col(ROW)])
    return taken(rows, write_marks(plan.where("copies <> 1").select(FILE, ROW, F.col("copies").alias("value"))))
