"""Rebuild conversations from event logs and render them with a reversible template.

Events of a message, in order of ``seq``: ``message`` (starts it over with a text),
``delta`` (appends), ``edit`` (replaces the text), ``regenerate`` (drops what was
written; later deltas write anew).  Events are folded per message first, so that a
long conversation is many small folds, and the folded messages are then put together.

The template wraps a turn of the assistant in ``<s>`` and ``</s>``, any other in
``[INST]`` and ``[/INST]``; the role stands on the first line.  Inside roles and texts
``~``, ``<`` and ``[`` are written ``~0``, ``~1`` and ``~2`` (a line end in a role
``~3``), so no control string can stand in a text and reading back is exact.

Rows: a NULL text or role is empty, a NULL kind is a message; repeated events are folded
like any others, ties of ``seq`` in order of kind, role and text.  A conversation is
one value of the result and has to fit into a task; a NULL conv_id is one of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probatio.llm.common import let

ASSISTANT = "assistant"
END = "(?:</s>|\\[/INST\\])\n"


def escape(text: Column) -> Column:
    for raw, coded in (("~", "~0"), ("<", "~1"), ("[", "~2")):
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for raw, coded in (("\n", "~3"), ("[", "~2"), ("<", "~1"), ("~", "~0")):
        text = F.replace(text, F.lit(coded), F.lit(raw))
    return text


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of events (conv_id, message, seq,
    kind, role, text); ``message`` orders the messages of a conversation."""
    ordered = F.sort_array(F.collect_list(F.struct(
        "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "role",
        F.coalesce("text", F.lit("")).alias("text"))))

    def state(log: Column) -> Column:
        fresh = F.array_max(F.transform(log, lambda e, i: F.when(
            e["kind"] != "delta", i + 1).otherwise(1)))
        tail = F.slice(log, fresh, F.size(log))
        named = F.filter(log, lambda e: e["role"].isNotNull())
        return F.struct(
            F.coalesce(F.get(named, F.size(named) - 1)["role"], F.lit("")).alias("role"),
            F.array_join(F.transform(tail, lambda e: F.when(
                e["kind"] == "regenerate", F.lit("")).otherwise(e["text"])), "").alias("text"))

    return (events.groupBy("conv_id", "message").agg(ordered.alias("log"))
            .select("conv_id", "message", let(F.col("log"), state).alias("s"))
            .select("conv_id", "message", "s.*"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    ``loss_spans`` are [start, stop) byte offsets into the UTF-8 of ``formatted`` that
    cover the texts of the assistant, without marks.
    """
    spoken = F.col("role") == ASSISTANT
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("~3"))
    head = F.concat(F.when(spoken, F.lit("<s>")).otherwise(F.lit("[INST]")), role, F.lit("\n"))
    tail = F.when(spoken, F.lit("</s>\n")).otherwise(F.lit("[/INST]\n"))
    turns = messages.select("conv_id", "message", spoken.alias("spoken"), head.alias("head"),
                            escape(F.col("text")).alias("body"), tail.alias("tail"))
    size = sum((F.octet_length(c) for c in ("head", "body", "tail")), F.lit(0).cast("long"))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(
        Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.octet_length("head")
    turns = turns.withColumn("start", begin)
    whole = (turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "message", "spoken", "start", F.octet_length("body").alias("length"),
        F.concat("head", "body", "tail").alias("turn")))).alias("turns")))
    return whole.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["spoken"]), lambda t: F.struct(
            t["start"].alias("start"), (t["start"] + t["length"]).alias("stop")))
        .alias("loss_spans"))


def format_conversations(events: DataFrame) -> DataFrame:
    return render(fold(events))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a rendered conversation."""
    turns = F.filter(F.split(formatted, END), lambda t: t != "")

    def turn(piece: Column) -> Column:
        line = F.locate("\n", piece)
        mark = F.when(F.startswith(piece, F.lit("<s>")), 3).otherwise(6)
        return F.struct(
            unescape(F.substring(piece, mark + 1, line - mark - 1)).alias("role"),
            unescape(F.substring(piece, line + 1, F.length(piece))).alias("text"))

    return F.transform(turns, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask."""
    return let(formatted.cast("binary"), lambda data: F.array_join(F.transform(
        spans, lambda s: unescape(F.decode(F.substring(
            data, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")),
            "UTF-8"))), ""))
