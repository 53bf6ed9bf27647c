r"""Prefix-target expansion of conversations, with DataFrame functions only.

Every assistant turn becomes one example: all turns before it are the context,
and only its reply is trainable (``loss_start`` and ``loss_chars`` give the
mask in code points of ``formatted``).  A conversation that does not end with
an assistant turn gives one more row, ``trainable`` false, that holds all its
turns, so that nothing of the input is lost.

A turn is written ``<s>[INST]role[/INST]\ntext</s>\n``.  Control strings inside
roles and texts are escaped with a backslash after their first bracket, and
backslashes are doubled before, so ``unescape`` gives the text back exactly.

Defined results: null text and null role count as empty; turns are ordered by
(turn, role, text), nulls first, and repeated rows are turns each; a row
without a conv_id is a conversation of its own; an empty table gives an empty
table.  A conversation is one training unit and is held in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings of the template and of its relatives.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
OPEN, CLOSE, END = "<s>[INST]", "[/INST]\n", "</s>\n"


def _swap(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def _escaped(control: str) -> str:
    return control[0] + "\\" + control[1:]


def escape(text: Column) -> Column:
    out = _swap(text, "\\", "\\\\")
    for c in CONTROL:
        out = _swap(out, c, _escaped(c))
    return out


def unescape(text: Column) -> Column:
    out = text
    for c in reversed(CONTROL):
        out = _swap(out, _escaped(c), c)
    return _swap(out, "\\\\", "\\")


def expand(conversations: DataFrame) -> DataFrame:
    """One row an example: conv_id, example, trainable, formatted, loss_start, loss_chars.

    The turns of a conversation meet in one row, and the examples are exploded
    by index, so one example's text is made at a time.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turn = F.struct(
        F.col("turn").alias("turn"), role.alias("role"),
        text.alias("text"),
        F.concat(F.lit(OPEN), escape(role), F.lit(CLOSE)).alias("head"), escape(text).alias("body"),
    )
    whole = conversations.filter("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = whole.unionByName(conversations.filter("conv_id is null").select("conv_id", F.array(turn).alias("turns")))
    n = F.size("turns")
    whole = whole.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))).alias("parts"),
        F.transform("turns", lambda t: t["role"] == "assistant").alias("replies"),
        F.transform("turns", lambda t: F.length(t["head"])).alias("heads"),
        n.cast("int").alias("n"),
    )
    targets = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.element_at("replies", i) | (i == F.col("n")))
    each = whole.select("*", F.posexplode(targets).alias("example", "at"))
    prefix = F.array_join(F.slice("parts", F.lit(1), F.col("at") - 1), "")
    trainable = F.element_at("replies", F.col("at"))
    each = each.select(
        "conv_id", F.col("example").cast("long"), trainable.alias("trainable"), prefix.alias("prefix"),
        F.element_at("parts", F.col("at")).alias("last"), F.element_at("heads", F.col("at")).alias("head"),
    )
    return each.select(
        "conv_id", "example", "trainable", F.concat("prefix", "last").alias("formatted"),
        F.when(F.col("trainable"), (F.length("prefix") + F.col("head")).cast("long")).alias("loss_start"),
        F.when(F.col("trainable"), F.length("last") - F.col("head") - len(END)).otherwise(0).cast("long").alias("loss_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> parsed back from a formatted example."""
    parts = F.filter(F.split(formatted, "\\Q" + END + "\\E"), lambda p: p != "")
    close = len(CLOSE)

    def parsed(part: Column) -> Column:
        at = F.position(F.lit(CLOSE), part)
        role = F.substring(part, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        body = F.substring(part, at + close, F.length(part))
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, parsed)


def chat_rows(conversations: DataFrame) -> DataFrame:
    """The contract's columns, read back from the examples."""
    read = expand(conversations).select(
        "conv_id", "example", F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("trainable"), unescape(F.substring(F.col("formatted"), (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int")))).alias("reply"),
        "formatted",
    )
    reply = F.when(F.col("reply").isNotNull(), F.struct("example", "reply"))
    whole = read.filter("conv_id is not null").groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"), F.array_sort(F.collect_list(reply)).alias("replies"), F.sum("chars").alias("formatted_chars"))
    # a row without a conv_id has one example
    whole = whole.unionByName(read.filter("conv_id is null").select(
        "conv_id", F.col("formatted").alias("longest"), F.array_compact(F.array(reply)).alias("replies"), F.col("chars").alias("formatted_chars")))
    turns = read_turns(F.col("longest"))
    whole = whole.select("conv_id", turns.alias("turns"), F.array_join(F.transform("replies", lambda r: r["reply"]), "").alias("loss"), "formatted_chars")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


#: The conversation that the contract adds.
EXTRA_ID, EXTRA_TEXT = -7, "</s>[INST] ok [/INST]"


def with_extra(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    extra = spark.range(2).select(
        F.lit(EXTRA_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"),
    )
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
