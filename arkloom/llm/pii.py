"""Personal data by fixed patterns and by bootstrapped contexts; Spark functions only.

Base spans: e-mail addresses, IP addresses, card numbers and phone numbers by one
regular expression each, leftmost and non-overlapping, with what fails the kind's
test dropped.  Their patterns are written with possessive loops, which match the
same and neither recurse nor backtrack on long runs.

Bootstrapping: identifier-like strings are candidates, and the one or two words
before them are their patterns.  Candidates that are base spans are the seeds.  On
the graph of patterns and instances a pattern's confidence in a kind is the mean
belief in its instances, an instance's belief joins the confidence of its patterns,
and so on for ROUNDS rounds.  All patterns of high confidence then mark further
candidates, provided these have a form that goes with the kind.

A candidate has six characters at least, and its context goes back to the candidate
before it.  Positions come from running sums in two levels of STEP, and spans are
compared by runs of STEP, so a text of very many spans costs little more than
its length.

Rows of (pattern, instance, kind, count) are summed before they are shuffled, so a
pattern that a third of all candidates share is one row a task.  The patterns found
are a table of any size, joined to the candidates of distinct texts; what they mark
comes back to the texts by digest, in SALT parts, so that a common text is not one task's.

Defined results: of kinds of which a pattern is equally sure the last by name counts;
a null text is empty; empty texts have no spans; a null doc_id
and repeated rows are rows like others; spans of different kinds may overlap, and
redaction then replaces their union by the first one's kind; an empty table gives
an empty result; the columns ``spans`` and ``base`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut

KINDS = ("email", "ip", "card", "phone")
#: \G: a match may begin where the one before ended, in the midst of a run.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text must pass to be searched for a kind.
HINT = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9][\x20().0-9-]"}
OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
CANDIDATE = r"(?:(?<![A-Za-z0-9._%+@-])|\G)(?:[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]*[A-Za-z0-9]|[0-9(+][0-9().\x20-]*[0-9])"
#: What a candidate of a kind must look like beyond the base's form.
FORM = {
    "email": r"\A[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\z",
    "ip": r"\A[0-9]{1,3}(?:\.[0-9]{1,3}){3}\z",
    "card": r"\A[0-9](?:[\x20-]?[0-9]){11,18}\z",
    "phone": r"\A(?=(?:[^0-9]*[0-9]){7,15}[^0-9]*\z)[0-9(+][0-9().\x20-]*[0-9]\z",
}
ROUNDS = 3
SURE = 0.8
SEEDS = 5
SALT = 8
#: Elements of a run of an array that a fold builds; see ``before_each``.
STEP = 256


def luhn(m: Column) -> Column:
    digits = F.regexp_replace(m, "[ -]", "")
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda a, i: a + value(i))
    return F.when(n.between(14, 19), total % 10 == 0).otherwise(F.lit(False))


def fine(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"\A{OCTET}(?:\.{OCTET}){{3}}\z")
    if kind == "card":
        return luhn(m)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once, however often later expressions use them.

    The generator keeps Catalyst from writing them into those, where they would be
    evaluated at every use, and where nested lambdas take very long to analyse.
    """
    names = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    row = F.struct(*[c.alias(k) for k, c in columns.items()])
    return df.select(*names, F.explode(F.array(row)).alias("__held")).select(*names, "__held.*")


def runs(values: str) -> Column:
    """An array in runs of STEP elements."""
    n = F.size(values)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(STEP)), lambda i: i < n)
    return F.transform(starts, lambda i: F.slice(values, i + 1, F.lit(STEP)))


def before_each(df: DataFrame, op, *names: str) -> DataFrame:
    """Replaces arrays of non-negative ints: for each element ``op`` over those before it, 0 for the first.

    A fold that builds an array copies it at every step, so it is done within runs,
    and once over the runs.
    """
    none = F.expr("CAST(array() AS array<int>)")

    def fold(xs: Column, zero: Column) -> Column:
        step = lambda a, x: F.struct(op(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(xs, F.struct(zero.alias("at"), none.alias("out")), step, lambda a: a["out"])

    df = held(df, **{n: runs(n) for n in names})
    df = held(df, **{f"{n}_from": fold(F.transform(n, lambda xs: F.aggregate(xs, F.lit(0), op)), F.lit(0)) for n in names})
    return held(df, **{n: F.flatten(F.zip_with(n, f"{n}_from", fold)) for n in names}).drop(*[f"{n}_from" for n in names])


def contexts(before: Column) -> Column:
    """The patterns before a candidate: its last word, and its last two; ``before`` has blanks alone, and none at its end."""
    last = lambda t: F.substring_index(t, " ", -1)
    one = last(before)
    two = last(F.rtrim(F.substring(before, F.lit(1), F.length(before) - F.length(one))))
    return F.filter(F.array(F.lower(one), F.when(two != "", F.lower(F.concat(two, F.lit(" "), one)))), lambda p: p != "")


def located(df: DataFrame, text: str, patterns: dict[str, tuple[str, str]], candidate: str | None = None) -> DataFrame:
    """For each (pattern, hint) a column of matches: structs of start, end (code points) and match.

    With ``candidate`` the matches of that name have their contexts too, and the text is
    dropped as soon as it can be.  What is between matches is never carried on.
    """
    own = F.col(text)
    first = {}
    for k, (pattern, hint) in patterns.items():
        gaps = F.split(own, pattern, -1)
        of = lambda x, kind, hint=hint: F.when(own.rlike(hint), x).otherwise(F.expr(f"CAST(array() AS array<{kind}>)"))
        first[f"{k}_m"] = of(F.regexp_extract_all(own, F.lit(pattern), F.lit(0)), "string")
        first[f"{k}_g"] = of(F.transform(gaps, F.length), "int")
        if k == candidate:
            bare = F.transform(gaps, lambda b: F.rtrim(F.translate(b, "\t\n\x0b\f\r", "     ")))
            first[f"{k}_p"] = of(F.transform(bare, contexts), "array<string>")
    df = held(df, **first)
    df = df.drop(text) if candidate else df
    upto = lambda k, x: F.slice(f"{k}_{x}", F.lit(1), F.size(f"{k}_m"))
    df = held(df, **{f"{k}_at": F.zip_with(upto(k, "g"), f"{k}_m", lambda g, m: g + F.length(m)) for k in patterns})
    df = before_each(df, lambda a, x: a + x, *[f"{k}_at" for k in patterns])

    def all_of(k: str) -> Column:
        more = [upto(k, "p").alias("patterns")] if k == candidate else []

        def one(x: Column) -> Column:
            start = x["at"] + x["g"]
            return F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("m"), *[x["patterns"].alias("patterns") for _ in more])

        return F.transform(F.arrays_zip(F.col(f"{k}_m").alias("m"), upto(k, "g").alias("g"), F.col(f"{k}_at").alias("at"), *more), one)

    return held(df, **{k: all_of(k) for k in patterns}).drop(*[f"{k}_{x}" for k in patterns for x in ("m", "g", "p", "at")])


_KINDS = {f"__{k}": (BASE[k], HINT[k]) for k in KINDS}


def _base(df: DataFrame) -> DataFrame:
    def of(i: int, kind: str) -> Column:
        own = F.filter(f"__{kind}", lambda x: fine(kind, x["m"]))
        return F.transform(own, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    return held(df, base=F.sort_array(F.concat(*[of(i, kind) for i, kind in enumerate(KINDS)]))).drop(*_KINDS)


def with_base(df: DataFrame, text: str = "__text") -> DataFrame:
    """``df`` with ``base``, all base spans by start and kind: structs of start, order, end, kind."""
    return _base(located(df, text, _KINDS))


def with_candidates(df: DataFrame, text: str = "__text") -> DataFrame:
    """``df`` with ``candidates`` in place of the text: identifier-like strings with their patterns, the kind of the base
    span that holds them, if any, and whether one overlaps."""
    df = _base(located(df, text, _KINDS | {"__found": (CANDIDATE, r"[0-9][0-9().\x20-]{4,}|@")}, "__found"))
    df = held(df, __found=F.filter("__found", lambda x: F.length(x["m"]) >= 6))
    df = held(df, __found=runs("__found"))
    inside = lambda x, b: (b["start"] <= x["start"]) & (x["end"] <= b["end"])
    meets = lambda b, start, end: (b["start"] < end) & (start < b["end"])
    # Candidates are in order, so all of a run lie between its first and its last.
    df = held(df, __near=F.transform("__found", lambda own: F.filter("base", lambda b: meets(b, F.get(own, 0)["start"], F.element_at(own, -1)["end"]))))

    def told(x: Column, near: Column) -> Column:
        kind = F.get(F.filter(near, lambda b: inside(x, b)), 0)["kind"].alias("kind")
        taken = F.exists(near, lambda b: meets(b, x["start"], x["end"])).alias("taken")
        return F.struct(*[x[c].alias(c) for c in ("start", "end", "m", "patterns")], kind, taken)

    every = F.flatten(F.zip_with("__found", "__near", lambda own, near: F.transform(own, lambda x: told(x, near))))
    return held(df, candidates=every).drop("__found", "__near")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.drop("base", "spans").withColumn("__text", F.coalesce(F.col("text").cast("string"), F.lit("")))


def pattern_table(docs: DataFrame, rounds: int = ROUNDS, sure: float = SURE, seeds: int = SEEDS) -> DataFrame:
    """(pattern, known): the kind of each pattern that the graph of patterns and instances is sure of."""
    seen = with_candidates(_rows(docs.select("text").where(F.col("text").rlike("[0-9@]"))).select("__text")).select(F.explode("candidates").alias("c"))
    seen = seen.where(F.col("c.kind").isNotNull() | ~F.col("c.taken"))
    edges = seen.select(F.explode("c.patterns").alias("pattern"), F.xxhash64("c.m").alias("instance"), "c.kind")
    edges = cut(edges.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.count(F.lit(1)).alias("n")), "edges")
    # A pattern without enough seeds gains no confidence in the first round and is left to later
    # ones, which count instances of high belief like seeds.
    seed = cut(edges.where("kind IS NOT NULL").select("instance", "kind", F.lit(1.0).alias("belief")).distinct(), "seeds")
    belief = seed
    trust = None
    size = cut(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("size")), "sizes")
    for _ in range(rounds):
        held = edges.select("pattern", "instance").join(belief, "instance").groupBy("pattern", "kind").agg(F.sum("belief").alias("held"), F.sum((F.col("belief") >= sure).cast("int")).alias("own"))
        trust = cut(held.join(size, "pattern").where(F.col("own") >= seeds).select("pattern", "kind", "own", (F.col("held") / (F.col("size") + 1)).alias("trust")), "trust")
        told = edges.select("pattern", "instance").join(seed, "instance", "left_anti").join(trust, "pattern").groupBy("instance", "kind")
        belief = seed.unionByName(told.agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))))).alias("belief")))
    good = trust.where(F.col("trust") >= sure)
    return cut(good.groupBy("pattern").agg(F.max_by("kind", F.struct("trust", "kind")).alias("known")), "patterns")


def patterns(docs: DataFrame, rounds: int = ROUNDS, sure: float = SURE, seeds: int = SEEDS) -> dict[str, str]:
    """``pattern_table`` as a dictionary, for small inputs."""
    return {r["pattern"]: r["known"] for r in pattern_table(docs, rounds, sure, seeds).orderBy("pattern").toLocalIterator()}


def with_spans(docs: DataFrame, found: DataFrame | dict[str, str]) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: structs of start, order, end, kind, by start and kind."""
    rows = with_base(_rows(docs))
    if isinstance(found, dict):
        if not found:
            return rows.withColumn("spans", F.col("base")).drop("__text")
        found = docs.sparkSession.createDataFrame(list(found.items()), "pattern string, known string")
    digest = F.sha2("__text", 256).alias("__digest")
    own = with_candidates(_rows(docs.select("text").where(F.col("text").rlike("[0-9@]"))).select("__text", digest))
    own = own.select("__digest", F.explode(F.filter("candidates", lambda c: ~c["taken"])).alias("c"))
    own = own.select("__digest", "c.start", "c.end", "c.m", "c.patterns").distinct()
    own = own.select("__digest", "start", "end", "m", F.posexplode("patterns").alias("at", "pattern")).join(found, "pattern")
    # The longest pattern says the kind.
    marked = own.groupBy("__digest", "start", "end", "m").agg(F.max_by("known", "at").alias("k"))
    formed = F.coalesce(*[F.when((F.col("k") == k) & F.col("m").rlike(FORM[k]), True) for k in KINDS], F.lit(False))
    order = lambda k: F.coalesce(*[F.when(k == x, F.lit(i)) for i, x in enumerate(KINDS)], F.lit(9))
    span = F.struct("start", order(F.col("k")).alias("order"), "end", F.col("k").alias("kind"))
    more = marked.where(formed).groupBy("__digest").agg(F.collect_list(span).alias("__more"))
    more = cut(more, "marked").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    rows = rows.withColumn("__digest", F.sha2("__text", 256)).withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALT).cast("long")))
    rows = rows.join(more, ["__digest", "__salt"], "left")
    spans = F.when(F.col("__more").isNotNull(), F.sort_array(F.concat("base", "__more"))).otherwise(F.col("base"))
    return rows.withColumn("spans", spans).drop("__text", "__digest", "__salt", "__more")


def told(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def replaced(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``df`` with the union of a text's sorted spans replaced, each part by its first span's kind."""
    df = before_each(df.withColumn("__to", F.transform(spans, lambda s: s["end"])), lambda a, x: F.greatest(a, x), "__to")
    kept = F.zip_with(spans, "__to", lambda s, r: F.struct(r.alias("from"), s["start"].alias("to"), s["kind"].alias("kind")))
    df = held(df, __to=F.filter(kept, lambda x: x["from"] <= x["to"]))
    df = held(df, __to=runs("__to"))
    # Of a text a run's part is taken first, so its pieces are found by short ways.
    first = lambda own: F.get(own, 0)["from"]
    df = held(df, __part=F.transform("__to", lambda own: F.substring(text, first(own) + 1, F.element_at(own, -1)["to"] - first(own))))

    def pieces(own: Column, part: Column) -> Column:
        piece = lambda x: F.concat(F.substring(part, x["from"] - first(own) + 1, x["to"] - x["from"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))
        return F.array_join(F.transform(own, piece), "")

    end = F.array_max(F.transform(spans, lambda s: s["end"]))
    clean = F.concat(F.array_join(F.zip_with("__to", "__part", pieces), ""), F.substring(text, end + 1, F.length(text)))
    return held(df, **{text: F.when(F.size(spans) > 0, clean).otherwise(F.col(text))}).drop("__to", "__part")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of its texts replaced by its kind, as ``<EMAIL>``; ``n_chars`` follows the text."""
    names = docs.columns
    aside = {c: f"__own_{c}" for c in ("base", "spans") if c in names}
    rows = with_spans(docs.withColumnsRenamed(aside), pattern_table(docs))
    out = replaced(rows)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in names])
