"""Conversations: lists, bounded memory, follow-up rewriting, exchanges with revisions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X

MAX_TURNS, MAX_CHARS, SUMMARY_CHARS, SNIPPET_CHARS = 6, 6000, 2000, 200


def conversation_list(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with their number of messages (0 kept), latest first. Messages are counted before the join."""
    counts = messages.groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("message_count"))
    return conversations.join(counts, "id", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0))).orderBy(F.col("updated_at").desc(), "id")


def last_substantive(messages: DataFrame, words: int = 4) -> DataFrame:
    """``topic``: before each turn, the last user turn of more than ``words`` words."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    count = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    return messages.withColumn("topic", F.last(F.when((F.col("role") == "user") & (count > words), F.col("text")), ignorenulls=True).over(w))


def rewritten(question: Column, topic: Column) -> Column:
    """A follow-up with the topic it follows; anything else as it is."""
    q = F.trim(question)
    return F.when((q != "") & X.is_followup(q) & topic.isNotNull(), F.concat(topic, F.lit(" ("), q, F.lit(")"))).otherwise(q)


def folded(summary: str, role: str, content: str) -> str:
    """The summary with a trace of a dropped turn, its tail if too long."""
    return f"{summary}\n- {role}: {content[:SNIPPET_CHARS]}".strip()[-SUMMARY_CHARS:]


def remember(turns: list[tuple[str, str]], summary: str, role: str, content: str, max_turns: int = MAX_TURNS, max_chars: int = MAX_CHARS) -> tuple[list[tuple[str, str]], str]:
    """State after a turn: at most ``max_turns`` turns and ``max_chars`` characters; what is dropped leaves a trace."""
    turns = [*turns, (role, content)]
    while len(turns) > max_turns or (len(turns) > 1 and sum(len(c) for _, c in turns) > max_chars):
        summary, turns = folded(summary, *turns[0]), turns[1:]
    if len(turns[0][1]) > max_chars:
        summary = folded(summary, *turns[0])
        turns[0] = (turns[0][0], turns[0][1][-max_chars:])
    return turns, summary


def session_memory(messages: DataFrame, max_turns: int = MAX_TURNS, max_chars: int = MAX_CHARS) -> DataFrame:
    """conv_id, kept turns, their characters, and the summary after the last turn.

    Memory is a fold over a conversation's turns. Content outside the last turns matters only by its first
    characters and its length, so long old turns are cut before they travel.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        turns, summary = [], ""
        for role, text in pdf.sort_values("turn")[["role", "text"]].itertuples(index=False):
            turns, summary = remember(turns, summary, role or "", text or "", max_turns, max_chars)
        return pd.DataFrame({"conv_id": [pdf["conv_id"].iloc[0]], "n_turns": [len(turns)], "n_chars": [sum(len(c) for _, c in turns)], "summary": [summary], "turns": [[{"role": r, "content": c} for r, c in turns]]})

    return messages.select("conv_id", "turn", "role", "text").groupBy("conv_id").applyInPandas(fold, "conv_id long, n_turns long, n_chars long, summary string, turns array<struct<role:string,content:string>>")


def context_info(memory: DataFrame) -> DataFrame:
    return memory.select("conv_id", F.size("turns").alias("messages"), F.aggregate("turns", F.lit(0), lambda n, t: n + F.length(t["content"])).alias("chars"))


def exchanges_applied(conversations: DataFrame, exchanges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, conflicts) after a batch of exchanges, one for a conversation.

    An exchange holds for the revision it saw; another revision is a conflict. The first exchange sets the title.
    """
    e = exchanges.select("id", F.col("revision").alias("_seen"), F.col("question").alias("_q"), F.col("at").alias("_at"))
    joined = conversations.join(e, "id", "left")
    fits = F.col("_seen").isNotNull() & (F.col("_seen") == F.col("revision"))
    conflicts = joined.where(F.col("_seen").isNotNull() & ~fits).select("id", F.col("_seen").alias("seen"), "revision")
    titled = F.when(fits & (F.coalesce("title", F.lit("")) == ""), F.substring("_q", 1, 80)).otherwise(F.col("title"))
    done = joined.withColumns({"title": titled, "updated_at": F.when(fits, F.col("_at")).otherwise(F.col("updated_at")), "revision": F.col("revision") + fits.cast("int")})
    return done.select(*conversations.columns), conflicts


def without(conversations: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete conversations and, with them, their messages."""
    return conversations.join(gone, "id", "left_anti"), messages.join(gone.withColumnRenamed("id", "session_id"), "session_id", "left_anti")


def opened(conversations: DataFrame, wanted: DataFrame) -> DataFrame:
    """Insert conversations that do not exist yet."""
    return conversations.unionByName(wanted.join(conversations.select("id"), "id", "left_anti"), allowMissingColumns=True)
