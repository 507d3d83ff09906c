"""Chat formatting: every dialogue is rendered once from the view of each participant.

In a participant's view their own turns are the assistant's and carry the loss, other
participants are named users, and system turns stay system turns (a system is no
participant). Turns are numbered by a distributed row number, so a conversation may be
spread over many tasks; a view is cut into parts of ``turns_per_part`` turns, which bounds
what is rendered at once. A turn is rendered as ``<|name|>``, line feed, text, ``<|end|>``,
line feed; the mask lists the code point spans of the assistant's text with its end mark.

Defined results: turns sort by number (missing first), then role and text, so ties and rows
that repeat keep a fixed order; a missing text is empty; a missing or empty role is a user
named ``unknown`` and no participant; a conversation without an id is one conversation; a
conversation without participants has no view; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.relational import sequence_number
from panelspark.session import materialize

END = "<|end|>\n"


def heading(role: Column, view: Column, system_roles: Sequence[str]) -> Column:
    name = (F.when(role == view, F.lit("assistant"))
            .when(role.isin(list(system_roles)), F.lit("system"))
            .otherwise(F.concat(F.lit("user name="), role)))
    return F.concat(F.lit("<|"), name, F.lit("|>\n"))


def perspectives(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", system_roles: Sequence[str] = ("system",),
                 turns_per_part: int = 256) -> DataFrame:
    """(conversation, speaker, part, n_turns, n_own, text, mask) for every participant.

    ``mask`` is an array of (start, stop): the code points of ``text`` that the loss covers.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.when(F.length(F.col(role_col)) > 0, F.col(role_col)).otherwise("unknown").alias("role"),
        (F.length(F.col(role_col)) > 0).alias("named"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = sequence_number(rows, ["turn", "role", "text"], "at", group=["conv"])
    rows = materialize(rows.withColumn("part", F.floor((F.col("at") - 1) / turns_per_part).cast("long")), "turns")
    # with its conversation's number missing, a row still belongs to one conversation
    known = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))
    views = (rows.where(F.coalesce("named", F.lit(False)) & ~F.col("role").isin(list(system_roles)))
             .select(known.alias("key"), F.col("role").alias("speaker")).distinct())
    parts = rows.groupBy(known.alias("key"), "part").agg(
        F.first("conv").alias("conv"),
        F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("turns"))
    seen = parts.join(views, "key")
    return render(seen, system_roles).select(
        F.col("conv").alias(conv_col), "speaker", "part", F.size("turns").cast("long").alias("n_turns"),
        F.size("mask").cast("long").alias("n_own"), "text", "mask")


def render(seen: DataFrame, system_roles: Sequence[str]) -> DataFrame:
    """Add ``text`` and ``mask`` to rows of (speaker, turns)."""
    view = F.col("speaker")
    shown = F.transform("turns", lambda t: F.struct(
        heading(t["role"], view, system_roles).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"),
        (t["role"] == view).alias("own")))
    seen = seen.withColumn("shown", shown)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def walk(state: Column, t: Column) -> Column:
        body = state["at"] + F.char_length(t["head"])
        stop = body + F.char_length(t["body"])
        span = F.struct(body.alias("start"), (stop - 1).alias("stop"))
        return F.struct(stop.alias("at"), F.when(t["own"], F.concat(state["spans"], F.array(span)))
                        .otherwise(state["spans"]).cast("array<struct<start:int,stop:int>>").alias("spans"))

    return (seen.withColumn("text", F.array_join(F.transform("shown", lambda t: F.concat(t["head"], t["body"])), ""))
            .withColumn("mask", F.aggregate("shown", start, walk)["spans"]))
