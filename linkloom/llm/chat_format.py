"""Conversations as marked texts with loss masks, by Spark expressions only.

The template: a block ``### role: text</turn>`` and a line feed for each turn. Neighbouring turns of one role share a
block, their texts parted by ``<next/>``, so that nothing is lost. Every control string that stands in a
role or a text is broken by a backslash behind its first character, and every backslash is doubled;
so control strings stand only where the template put them, and reading takes the escapes away again.

Turns are collected by conversation and stretch of ``STRETCH`` turn numbers, sorted as structs, and
merged by an array aggregation; the stretches' texts are then put together with the offsets that windows over
stretches give. Conversations of one stretch, nearly all, are shuffled once; texts of longer ones twice.
Stretches with more than ``MOST`` rows (turn numbers that repeat) are parted by ranks, so no group that
is collected grows with the input but the conversation's own text.

Null texts and roles are empty; null ids make one conversation, null turns come first; repeated turn numbers are in
order of role and escaped text, repeated rows are all kept. Other columns are ignored; nothing gives nothing.
"""

from __future__ import annotations

from functools import reduce
from re import escape as quoted

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.llm.store import Tables
from linkloom.operators.ranks import ranked

#: The template's control strings, none a part of another: a block's begin, the end of its role, what parts merged turns, its end.
OPEN, ROLE_END, NEXT, END = "### ", ": ", "<next/>", "</turn>\n"
CONTROLS = (OPEN, ROLE_END, NEXT, END.strip())
#: Turn numbers of a stretch, and rows of one that are collected together.
STRETCH, MOST = 128, 4096


def escaped(text: Column) -> Column:
    """A text without control strings."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + "\\" + c[1:])), CONTROLS, doubled)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(ROLE_END))


def _stretches(rows: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Rows with _at (stretch) and _sub (its part, if it has too many rows), and the ids of conversations of more than one."""
    key = ["conv_id", "_at"]
    sizes = tables.write(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")), "stretches")
    rows = rows.withColumn("_sub", F.lit(0).cast("long"))
    many = sizes.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_of"), F.max("_n").alias("_n")).where((F.col("_of") > 1) | (F.col("_n") > MOST))
    large = sizes.where(F.col("_n") > MOST).select(*(F.col(c).alias(f"_{c}") for c in key))
    if not large.isEmpty():
        same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key))
        parted = ranked(rows.join(large, same, "left_semi"), ["turn", "role", "text"], "_rank", key)
        parted = parted.withColumn("_sub", F.floor((F.col("_rank") - 1) / MOST)).drop("_rank")
        rows = rows.join(large, same, "left_anti").unionByName(parted)
    return rows, tables.write(many.select(F.col("conv_id").alias("_conv")), "long-conversations")


def _fragments(rows: DataFrame, loss_roles: list[str]) -> DataFrame:
    """(conv_id, _at, _sub, f): the text of each stretch from its first turn's text to its last turn's, with its roles at both ends and the spans of the loss."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    start = F.struct(F.lit("").alias("first"), F.lit("").alias("last"), F.array().cast("array<string>").alias("pieces"), F.lit(0).cast("long").alias("bytes"), F.array().cast("array<struct<start:bigint,bytes:bigint>>").alias("loss"))

    def add(acc: Column, x: Column) -> Column:
        own = F.octet_length(x["text"]).cast("long")
        new = F.size(acc["pieces"]) == 0
        lead = F.when(new, "").when(acc["last"] == x["role"], NEXT).otherwise(F.concat(F.lit(END), _head(x["role"])))
        begin = acc["bytes"] + F.octet_length(lead)
        span = F.array(F.struct(begin.alias("start"), own.alias("bytes")))
        return F.struct(
            F.when(new, x["role"]).otherwise(acc["first"]).alias("first"), x["role"].alias("last"), F.concat(acc["pieces"], F.array(F.concat(lead, x["text"]))).alias("pieces"), (begin + own).alias("bytes"),
            F.when(x["role"].isin(loss_roles), F.concat(acc["loss"], span)).otherwise(acc["loss"]).alias("loss"),
        )

    def done(acc: Column) -> Column:
        return F.struct(acc["first"].alias("first"), acc["last"].alias("last"), F.array_join(acc["pieces"], "").alias("body"), acc["bytes"].alias("bytes"), acc["loss"].alias("loss"))

    return rows.groupBy("conv_id", "_at", "_sub").agg(F.aggregate(turns, start, add, done).alias("f"))


def _shifted(spans: Column, by: Column) -> Column:
    return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), s["bytes"].alias("bytes")))


def format_chats(conversations: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss): each conversation's text, and the spans (start, bytes; in UTF-8) of it that count for the loss, in order."""
    tables = Tables(conversations.sparkSession)
    clean = lambda c: escaped(F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = conversations.select("conv_id", "turn", clean("role").alias("role"), clean("text").alias("text"), F.floor(F.col("turn") / STRETCH).alias("_at"))
    rows, many = _stretches(rows, tables)
    counted = [_plain_escaped(r) for r in loss_roles]
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    one = _fragments(rows.join(many, same, "left_anti"), counted).select("conv_id", _head(F.col("f.first")).alias("_head"), "f")
    short = one.select("conv_id", F.concat("_head", "f.body", F.lit(END)).alias("formatted"), _shifted(F.col("f.loss"), F.octet_length("_head").cast("long")).alias("loss"))
    if many.isEmpty():
        return short
    order = Window.partitionBy("conv_id").orderBy("_at", "_sub")
    parts = _fragments(rows.join(many, same, "left_semi"), counted).withColumn("_before", F.lag("f.last").over(order))
    lead = F.when(F.lag(F.lit(True)).over(order).isNull(), _head(F.col("f.first"))).when(F.col("_before") == F.col("f.first"), NEXT).otherwise(F.concat(F.lit(END), _head(F.col("f.first"))))
    parts = parts.withColumn("_lead", lead).withColumn("_bytes", F.octet_length("_lead") + F.col("f.bytes"))
    begin = F.coalesce(F.sum("_bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.octet_length("_lead")
    parts = parts.select("conv_id", F.struct("_at", "_sub", F.concat("_lead", "f.body").alias("text"), _shifted(F.col("f.loss"), begin).alias("loss")).alias("p"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    joined = whole.select("conv_id", F.concat(F.array_join("p.text", ""), F.lit(END)).alias("formatted"), F.flatten("p.loss").alias("loss"))
    return short.unionByName(joined)


def _plain_escaped(role: str) -> str:
    """``escaped`` of a role that is known beforehand."""
    return reduce(lambda t, c: t.replace(c, c[0] + "\\" + c[1:]), CONTROLS, role.replace("\\", "\\\\"))


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) read from a formatted text."""
    blocks = F.split(formatted, quoted(END), -1)

    def of_block(block: Column) -> Column:
        role = F.substring_index(block, ROLE_END, 1)
        texts = F.split(F.substring(block, F.char_length(role) + len(ROLE_END) + 1, F.char_length(block)), quoted(NEXT), -1)
        return F.transform(texts, lambda t: F.struct(unescaped(F.substring(role, len(OPEN) + 1, F.char_length(role))).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), of_block))


def loss_text(formatted: Column, loss: Column) -> Column:
    """The text under the mask, unescaped, nothing between."""
    data = formatted.cast("binary")
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(data, (s["start"] + 1).cast("int"), s["bytes"].cast("int")).cast("string"))), "")


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from formatted texts and masks alone."""
    read = chats.select("conv_id", turns_of(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("said"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(line, 256).alias("turns_sha256"), F.char_length("said").cast("long").alias("loss_chars"), F.sha2("said", 256).alias("loss_sha256"), "formatted_chars")
