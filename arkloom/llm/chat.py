"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted, neighbours of one
role are merged to a block, and blocks are concatenated:

    <s>[ROLE]role[/ROLE]text[NEXT]text</s><s>[ROLE]...

Control strings inside roles and texts are escaped: ESC becomes ESC e, and
ESC . goes after the first character of ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``,
``[ROLE]``, ``[/ROLE]`` and ``[NEXT]``, so none of them occurs but as markup, and
dropping ESC . and turning ESC e back to ESC restores any text.

The loss mask is an array of (start, end) in code points of the formatted text:
one span for each assistant text, markup left out.

Defined results: a null role or text is empty; turns are ordered by turn (null
first), then role, then text, so ties and repeated rows have one order; null
conv_ids form one conversation; an empty table gives an empty result; other
columns are ignored.  The one row of a conversation holds all its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESC = "\u001b"
CONTROL = r"([<\[])(?=/?s>|/?INST\]|/?ROLE\]|NEXT\])"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit(ESC), F.lit(ESC + "e")), CONTROL, "$1" + ESC + ".")


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(ESC + "."), F.lit("")), F.lit(ESC + "e"), F.lit(ESC))


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask) of each conversation."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.select("conv_id", F.struct("turn", text("role").alias("role"), text("text").alias("text")).alias("t"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    chats = chats.withColumn("n", F.size("ts"))
    chats = chats.withColumn(
        "starts", F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: (i == 1) | (F.get("ts", i - 1)["role"] != F.get("ts", i - 2)["role"]))
    )

    def block(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.col("n") + 1)
        return F.struct(
            F.get("ts", start - 1)["role"].alias("role"),
            F.transform(F.slice("ts", start, end - start), lambda t: escape(t["text"])).alias("texts"),
        )

    chats = chats.select("conv_id", F.transform("starts", block).alias("blocks"))
    head = lambda b: F.concat(F.lit("<s>[ROLE]"), escape(b["role"]), F.lit("[/ROLE]"))
    whole = F.array_join(F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], "[NEXT]"), F.lit("</s>"))), "")
    # Lengths in order: markup before a text, the text, ...; running sums of them are the mask's ends.
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.transform(
                b["texts"],
                lambda t, i: F.struct(
                    (F.when(i == 0, F.length(head(b))).otherwise(F.lit(6)) + 0).alias("gap"),
                    F.length(t).alias("len"),
                    F.when(i == F.size(b["texts"]) - 1, F.lit(4)).otherwise(F.lit(0)).alias("tail"),
                    (b["role"] == "assistant").alias("loss"),
                ),
            ),
        )
    )
    out = chats.select("conv_id", whole.alias("formatted"), pieces.alias("pieces"))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("spans"))
    # The fold carries a string, which grows in place of an array that each step would copy whole.
    spans = F.aggregate(
        "pieces",
        zero,
        lambda a, p: F.struct(
            (a["at"] + p["gap"] + p["len"] + p["tail"]).alias("at"),
            F.when(p["loss"], F.concat(a["spans"], (a["at"] + p["gap"]).cast("string"), F.lit(":"), (a["at"] + p["gap"] + p["len"]).cast("string"), F.lit(",")))
            .otherwise(a["spans"])
            .alias("spans"),
        ),
        lambda a: F.rtrim(a["spans"], F.lit(",")),
    )
    mask = F.transform(
        F.filter(F.split(spans, ","), lambda x: x != ""),
        lambda x: F.struct(F.split(x, ":")[0].cast("int").alias("start"), F.split(x, ":")[1].cast("int").alias("end")),
    )
    return out.select("conv_id", "formatted", mask.alias("mask"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """Adds ``turns``, the (role, text) read back from the formatted text."""
    blocks = F.filter(F.split("formatted", "</s>"), lambda b: b != "")
    bare = F.transform(blocks, lambda b: F.split(F.substring(b, F.lit(10), F.length(b)), r"\[/ROLE\]", 2))
    turns = F.flatten(
        F.transform(
            bare,
            lambda b: F.transform(F.split(b[1], r"\[NEXT\]"), lambda t: F.struct(unescape(b[0]).alias("role"), unescape(t).alias("text"))),
        )
    )
    return formatted.withColumn("turns", turns)
