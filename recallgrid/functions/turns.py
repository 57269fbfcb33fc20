"""Turns of a conversation as text: built from messages, and compacted from what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.functions.text import cut_bytes

# Speaker labels, marks of a client's own summaries, and the note for a turn with nothing left.
LABELS = ("USER: ", "ASSISTANT: ", "TOOL: ", "SYSTEM: ", "FUNCTION: ")
SUMMARY = ("CONTEXT COMPACTION", "Conversation Summary")
NOTHING = "[turn compacted: it held only tool output or a context summary]"


def is_summary(text: Column) -> Column:
    head = F.substring(text, 1, 200)
    return F.contains(head, F.lit(SUMMARY[0])) | F.contains(head, F.lit(SUMMARY[1]))


def build_turns(messages: DataFrame, per_message: int, total: int) -> DataFrame:
    """conv_id, turns, n of messages (conv_id, turn, role, text): users' and assistants' messages in order, without summaries."""
    m = messages.filter(F.col("role").isin("user", "assistant") & ~is_summary(F.col("text")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.upper("role"), F.lit(": "), F.substring("text", 1, per_message)).alias("t")))), lambda x: x["t"])
    return m.groupBy("conv_id").agg(F.substring(F.array_join(lines, "\n\n"), 1, total).alias("turns"), F.count("*").alias("n"))


def compacted(text: Column, per_message: int, total: int) -> Column:
    """A stored turn, split where a speaker's label follows a blank line: users' and assistants' messages and an unlabelled start stay."""
    labels = "|".join(LABELS)
    parts = F.split(text, f"(?:(?<=\\n\\n)|(?<=\\n\\r\\n))(?={labels})", -1)

    def kept(x: Column) -> Column:
        role = F.regexp_extract(x, f"^({labels})", 1)
        body = F.trim(F.regexp_replace(F.substring(x, F.length(role) + 1, F.length(x)), "^\\s+|\\s+$", ""))
        mine = role.isin(LABELS[0], LABELS[1], "") & (body != "") & ~is_summary(body)
        return F.when(mine, F.concat(role, cut_bytes(body, per_message)))

    some = F.filter(F.transform(parts, kept), lambda x: x.isNotNull())
    plain = F.size(F.filter(parts, lambda x: x.rlike(f"^({labels})"))) == 0
    return F.when(plain, cut_bytes(text, total)).when(F.size(some) == 0, NOTHING).otherwise(cut_bytes(F.array_join(some, "\n\n"), total))
