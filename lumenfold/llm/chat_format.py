"""Operator 6, chat formatting: Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role share a block, inside
which a separator marks each turn. Control strings inside texts are escaped so that parse() gives back every
turn: a backslash goes before the bar of "<|", and one more where backslashes stand there already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns whose spans are gathered at once.
STEP = 256
START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Roles end at a newline: percent signs, newlines and angle brackets become percent codes."""
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant"
) -> DataFrame:
    """One row a conversation: its id, formatted (string) and loss_spans, the (start, chars) of each text of the role trained.

    Starts count code points from 0. Turns go by number, then role, then text, so ties and repeated rows have a
    fixed order and all stay; a null turn comes first. Null texts and roles are empty. Rows of a null
    conversation form one. Other columns are left out; an empty table gives no rows. A conversation is one
    output row and so must fit in memory; nothing else is gathered by key.
    """
    rows = df.select(
        F.col(conv).alias("conv"),
        F.struct(
            F.col(turn).alias("turn"),
            escape_role(F.coalesce(F.col(role), F.lit(""))).alias("role"),
            escape(F.coalesce(F.col(text), F.lit(""))).alias("text"),
        ).alias("t"),
    )
    turns = rows.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    at = lambda i: F.get(F.col("turns"), i)  # noqa: E731  null outside the array
    pieces = turns.select(
        "conv",
        F.transform(
            "turns",
            lambda t, i: F.struct(
                F.when((i == 0) | (at(i - 1)["role"] != t["role"]), F.concat(F.lit(START), t["role"], F.lit("\n"))).otherwise(SEPARATOR).alias("before"),
                t["text"].alias("text"),
                F.when((i == F.size("turns") - 1) | (at(i + 1)["role"] != t["role"]), F.lit(END)).otherwise("").alias("after"),
                (t["role"] == F.lit(trained)).alias("loss"),
            ),
        ).alias("pieces"),
    )
    size = F.char_length
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,chars:int>>)").alias("spans"))
    # appending copies an array: spans grow in runs of STEP turns, and only the runs are appended to each other
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("pieces"), F.lit(1)), F.lit(STEP)),
        lambda i: F.aggregate(
            F.slice("pieces", i, F.lit(STEP)),
            start,
            lambda acc, p: F.struct(
                (acc["at"] + size(p["before"]) + size(p["text"]) + size(p["after"])).alias("at"),
                F.when(
                    p["loss"],
                    F.concat(acc["spans"], F.array(F.struct((acc["at"] + size(p["before"])).alias("start"), size(p["text"]).alias("chars")))),
                )
                .otherwise(acc["spans"])
                .alias("spans"),
            ),
        ),
    )
    spans = F.aggregate(
        runs,
        start,
        lambda acc, run: F.struct(
            (acc["at"] + run["at"]).alias("at"),
            F.concat(acc["spans"], F.transform(run["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["chars"].alias("chars")))).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return pieces.select(
        F.col("conv").alias(conv),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns (array of struct of role and text) that a formatted conversation holds."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b.startswith(START))

    def turns(block: Column) -> Column:
        inside = F.substring(block, len(START) + 1, 2147483647)
        role = F.substring_index(inside, "\n", 1)
        body = F.substr(inside, F.char_length(role) + 2)
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda t: F.struct(unescape_role(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["chars"]))), "")
