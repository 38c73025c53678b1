"""Conversations as training text: one row of turns becomes one row of text with a loss mask.

The template marks the turns of a conversation so::

    ### user
    first text<turn>second text of the same role</turn>
    ### assistant
    answer</turn>

``#`` and ``<`` inside roles and texts are written ``&num;`` and ``&lt;``, and ``&`` is ``&amp;``, so
control strings never occur inside a text and the turns can be read back as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HEAD, JOIN, END = "### ", "<turn>", "</turn>\n"


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit("#"), F.lit("&num;"))


def unescaped(text: Column) -> Column:
    out = F.replace(text, F.lit("&num;"), F.lit("#"))
    out = F.replace(out, F.lit("&lt;"), F.lit("<"))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def head_of(role: Column) -> Column:
    """A role on one line."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("&nl;"))


def formatted(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", trained_role: str = "assistant",
) -> DataFrame:
    """``(conv_id, segments, formatted)`` per conversation.

    ``segments`` are ``(text, loss)`` pieces whose texts make up ``formatted``; the loss mask is on
    for the texts of ``trained_role`` and nothing else. Turns are sorted by number, nulls first,
    ties by role and text; repeated rows are turns of their own. Adjacent turns of one role share
    a block. Null texts and roles are empty; rows with a null conversation make one conversation;
    a conversation is one row and has to fit a task. No rows give no rows.
    """
    rows = turns.select(
        turns[conv_col].alias("conv_id"), turns[turn_col].alias("turn"),
        F.coalesce(turns[role_col].cast("string"), F.lit("")).alias("role"),
        F.coalesce(turns[text_col].cast("string"), F.lit("")).alias("text"),
    )
    # escaped before the turns meet, so a long conversation does its share in many tasks
    rows = rows.select(
        "conv_id", "turn", "role", "text", head_of(F.col("role")).alias("head"), escaped(F.col("text")).alias("body")
    )
    each = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "head", "body"))).alias("turns"))
    off = F.lit(False)

    def pieces(turn: Column, i: Column) -> Column:
        starts = (i == 0) | (F.get("turns", i - 1)["role"] != turn["role"])
        ends = (i == F.size("turns") - 1) | (F.get("turns", i + 1)["role"] != turn["role"])
        lead = F.when(starts, F.concat(F.lit(HEAD), turn["head"], F.lit("\n"))).otherwise(JOIN)
        return F.array(
            F.struct(lead.alias("text"), off.alias("loss")),
            F.struct(turn["body"].alias("text"), (turn["role"] == trained_role).alias("loss")),
            F.struct(F.when(ends, END).otherwise("").alias("text"), off.alias("loss")),
        )

    made = each.select("conv_id", F.flatten(F.transform("turns", pieces)).alias("segments"))
    made = made.select("conv_id", F.filter("segments", lambda s: s["text"] != "").alias("segments"))
    return made.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def turns_of(text: Column) -> Column:
    """The turns ``(role, text)`` of a formatted text, read back from its control strings."""
    blocks = F.filter(F.split(text, END), lambda b: b != "")

    def turns(block: Column) -> Column:
        at = F.instr(block, "\n")
        role = F.substr(block, F.lit(len(HEAD) + 1), at - len(HEAD) - 1)
        role = unescaped(F.replace(role, F.lit("&nl;"), F.lit("\n")))
        texts = F.split(F.substr(block, at + 1), JOIN)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def trained_text(segments: str) -> Column:
    """All text under the loss mask, as it was written."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
