"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted, adjacent turns of
one role are merged into a block by array functions, and blocks are joined to
one string. Each turn stays marked inside its block, and control strings inside
texts are escaped reversibly, so that the turns can be read back exactly.

Template::

    <s>[SYS]text[/SYS][INST]text[TURN]text[/INST][OUT]text</s>[ROLE]tool[BODY]text[/ROLE]

``[TURN]`` parts the turns of a merged block. A control string in a text gets one
more backslash after its first character; taking one away restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import pick

#: Rest of a control string after its first character, ``<`` or ``[``.
_REST = r"(/?s>|/?(?:SYS|INST|ROLE)\]|(?:OUT|BODY|TURN)\])"
ESCAPE = (r"([<\[])(\\*)" + _REST, r"$1\\$2$3")
UNESCAPE = (r"([<\[])\\(\\*)" + _REST, r"$1$2$3")

#: Role, opening and closing mark of the roles that have marks of their own.
MARKS = (("system", "[SYS]", "[/SYS]"), ("user", "[INST]", "[/INST]"), ("assistant", "[OUT]", "</s>"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPE[0]), F.lit(ESCAPE[1]))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(UNESCAPE[0]), F.lit(UNESCAPE[1]))


def _opening(role: Column) -> Column:
    out = F.concat(F.lit("[ROLE]"), escape(role), F.lit("[BODY]"))
    for name, mark, _ in MARKS:
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def _closing(role: Column) -> Column:
    out = F.lit("[/ROLE]")
    for name, _, mark in MARKS:
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def format_chats(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    ``loss_spans`` are (start, length) in code points of ``formatted``, one for
    each turn of ``loss_role`` in order: the escaped text without any mark.

    Turns are sorted by (turn, role, text), so ties have one order. Null role or
    text: empty. Rows that repeat are turns of their own. Null conv_id: one
    conversation. Null turn: sorts first. Empty table: no rows. Other columns are not read.
    """
    rows = pick(df, conv_id=conv_id, turn=turn, role=role, text=text)
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    # merge: the turns at which a block begins cut the array into slices of one role
    size = F.size("turns")
    starts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(F.col("turns"), i)["role"] != F.get(F.col("turns"), i - 1)["role"]))
    chats = chats.withColumn("starts", starts)
    blocks = F.transform(
        F.col("starts"),
        lambda s, j: F.struct(
            F.get(F.col("turns"), s)["role"].alias("role"),
            F.transform(F.slice("turns", s + 1, F.coalesce(F.get(F.col("starts"), j + 1), size) - s), lambda t: escape(t["text"])).alias("parts"),
        ),
    )
    chats = chats.select("conv_id", blocks.alias("blocks"))
    # strings between the marks; every second one, from the second, is the text of a turn
    pieces = F.flatten(
        F.transform(
            F.col("blocks"),
            lambda b: F.flatten(
                F.array(
                    F.flatten(F.transform(b["parts"], lambda p, k: F.array(F.struct(F.when(k == 0, _opening(b["role"])).otherwise(F.lit("[TURN]")).alias("s"), F.lit(False).alias("loss")), F.struct(p.alias("s"), (b["role"] == loss_role).alias("loss"))))),
                    F.array(F.struct(_closing(b["role"]).alias("s"), F.lit(False).alias("loss"))),
                )
            ),
        )
    )
    chats = chats.select("conv_id", F.concat(F.array(F.struct(F.lit("<s>").alias("s"), F.lit(False).alias("loss"))), pieces).alias("pieces"))
    span = "struct<start:bigint,length:bigint>"
    walked = F.aggregate(
        F.col("pieces"),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{span}>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["s"])).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), F.length(p["s"]).cast("long").alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return chats.select("conv_id", F.concat_ws("", F.col("pieces.s")).alias("formatted"), walked["spans"].alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    marks = "|".join("\\" + m for _, m, _ in MARKS) + r"|\[ROLE\]"
    blocks = F.split(F.substr(formatted, F.lit(4)), f"(?={marks})")

    def turns(block: Column) -> Column:
        other = block.startswith("[ROLE]")
        role, body = unescape(F.split_part(F.substr(block, F.lit(7)), F.lit("[BODY]"), F.lit(1))), F.regexp_replace(block, r"(?s)^\[ROLE\].*?\[BODY\]|\[/ROLE\]$", "")
        for name, opening, closing in MARKS:
            role = F.when(block.startswith(opening), F.lit(name)).otherwise(role)
            body = F.when(block.startswith(opening), F.substr(block, F.lit(len(opening) + 1), F.length(block) - len(opening) - len(closing))).otherwise(body)
        role = F.when(other, role).otherwise(role)
        return F.transform(F.split(body, r"\[TURN\]"), lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def chat_digests(chats: DataFrame) -> DataFrame:
    """What :func:`format_chats` returns, read back and digested; one row per conversation."""
    chats = chats.withColumn("turns", read_back(F.col("formatted")))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))))
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
