"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

Every assistant turn becomes an example: all preceding turns as context and only that reply under the loss mask. If
turns follow the last reply (or there is none) one more example without a mask holds the whole conversation, so that
the output can be read back completely. The template marks turns with control strings; `&` and `<|` in texts and roles
(and line ends in roles) are replaced by references, so no text can contain a control string, and reading reverses it.

Defined results: null roles and texts are empty; turns are ordered by (turn, role, text) with null turns first, repeated
rows stay repeated turns; rows without conv_id are one conversation; other columns are ignored.
A conversation is one row of the output, as its digests and prefixes need it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def _replaced(c: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape(c: Column) -> Column:
    return _replaced(c, ("&", "&amp;"), ("<|", "&lt;|"))


def unescape(c: Column) -> Column:
    return _replaced(c, ("&lt;|", "<|"), ("&#10;", "\n"), ("&amp;", "&"))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per example: the conversation, example (from 0), text, loss_start and loss_end (code points of the reply in
    text; equal where nothing is trainable), whole (it holds the whole conversation)."""
    rows = turns.select(F.col(conv).alias("c"), F.col(turn).alias("n"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    grouped = rows.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("n", "r", "t"))).alias("turns"))

    def formatted(x):
        head = F.concat(F.lit(START), _replaced(escape(x["r"]), ("\n", "&#10;")), F.lit("\n"))
        body = escape(x["t"])
        return F.struct((x["r"] == "assistant").alias("target"), F.length(head).alias("head"), F.length(body).alias("body"), F.concat(head, body, F.lit(END)).alias("text"))

    shaped = grouped.select("c", F.transform("turns", formatted).alias("f"))
    size = F.size("f")
    ends = F.filter(F.sequence(F.lit(1), size), lambda i: F.element_at("f", i)["target"] | (i == size))
    each = shaped.select("c", "f", F.posexplode(ends).alias("example", "upto"))
    last = F.element_at("f", F.col("upto"))
    context = F.array_join(F.transform(F.slice("f", 1, F.col("upto") - 1), lambda x: x["text"]), "")
    each = each.select("c", "example", last.alias("last"), context.alias("context"), (F.col("upto") == size).alias("whole"))
    begin = (F.length("context") + F.col("last.head")).cast("long")
    return each.select(
        F.col("c").alias(conv), "example", F.concat("context", "last.text").alias("text"),
        begin.alias("loss_start"), (begin + F.when(F.col("last.target"), F.col("last.body")).otherwise(0)).alias("loss_end"), "whole",
    )


def read_back(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, from formatted examples alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    marked = F.split(F.col("text"), F.lit(r"<\|im_end\|>\n"))
    bodies = F.transform(F.slice(marked, 1, F.size(marked) - 1), lambda s: F.substr(s, F.lit(len(START) + 1)))
    turns = F.transform(bodies, lambda s: F.concat(unescape(F.substring_index(s, "\n", 1)), F.lit("\n"), unescape(F.substr(s, F.instr(s, "\n") + 1)), F.lit("\n")))
    reply = unescape(F.substr(F.col("text"), (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))
    parts = examples.select(
        conv, "example", F.length("text").cast("long").alias("chars"),
        F.when(F.col("whole"), (F.size(marked) - 1).cast("long")).alias("n_turns"),
        F.when(F.col("whole"), F.sha2(F.array_join(turns, ""), 256)).alias("turns_sha256"), reply.alias("reply"),
    )
    grouped = parts.groupBy(conv).agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("example", "reply"))).alias("replies"))
    loss = F.array_join(F.transform("replies", lambda x: x["reply"]), "")
    return grouped.select(conv, "n_turns", "turns_sha256", F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
