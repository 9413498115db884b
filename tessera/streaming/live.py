"""Streaming extensions: ingest without repeats, telemetry windows, session memory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators import sessions, telemetry


def new_content(chunks: DataFrame, at: str = "ingested_at", late: str = "1 day") -> DataFrame:
    """Chunks whose content hash has not been seen; hashes are forgotten after ``late``, which bounds the state."""
    return chunks.withWatermark(at, late).dropDuplicatesWithinWatermark(["content_hash"])


def status_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and mean run time by status in event-time windows; later events than ``late`` are dropped."""
    timed = telemetry.from_events(events).withColumn("started_at", F.col("started_at").cast("timestamp"))  # watermarks need a time zone
    requests = timed.withWatermark("started_at", late)
    grouped = requests.groupBy(F.window("started_at", width).alias("w"), "status").agg(F.count(F.lit(1)).alias("n"), F.avg("runtime_ms").alias("avg_runtime_ms"))
    return grouped.select(F.col("w.start").alias("window_start"), "status", "n", "avg_runtime_ms")


def live_memory(messages: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """The bounded memory of each conversation after every batch. With ``idle_ms``, idle sessions are forgotten; such a query never falls idle itself."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        turns, summary = state.get if state.exists else ([], "")
        turns = [tuple(t) for t in turns]
        for role, text in pd.concat(list(batches)).sort_values("turn")[["role", "text"]].itertuples(index=False):
            turns, summary = sessions.remember(turns, summary, role or "", text or "")
        state.update(([list(t) for t in turns], summary))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"conv_id": [key[0]], "n_turns": [len(turns)], "n_chars": [sum(len(c) for _, c in turns)], "summary": [summary]})

    out = "conv_id long, n_turns long, n_chars long, summary string"
    return messages.groupBy("conv_id").applyInPandasWithState(step, out, "turns array<array<string>>, summary string", "update", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
