"""Request history: status, summary, pages and latest state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ["success", "fallback", "error", "running"]


def request_status(http_status: Column, fallback: Column) -> Column:
    return F.when(http_status >= 400, "error").when(F.coalesce(fallback, F.lit(False)), "fallback").otherwise("success")


def from_events(events: DataFrame) -> DataFrame:
    """The events table read as a request log: errors fail, searches without result fall back, the value is the run time."""
    k = F.get_json_object("props", "$.k").cast("int")
    status = request_status(F.when(F.col("event_type") == "error", 500).otherwise(200), (F.col("event_type") == "search") & (k % 2 == 0))
    return events.select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("ts").alias("started_at"), "event_type", status.alias("status"), F.col("value").alias("runtime_ms"), F.when(k % 3 != 0, F.col("value") / 2).alias("ttft_ms"))


def matching(requests: DataFrame, **wanted) -> DataFrame:
    return requests.where(reduce(lambda c, kv: c & (F.col(kv[0]) == F.lit(kv[1])), [kv for kv in wanted.items() if kv[1] is not None], F.lit(True)))


def summary(requests: DataFrame, *by: str) -> DataFrame:
    """Totals over the whole filtered history; averages skip nulls."""
    counts = [F.coalesce(F.sum(F.when(F.col("status") == s, 1).otherwise(0)), F.lit(0)).alias(s) for s in STATUSES]
    return requests.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *counts, F.avg("runtime_ms").alias("avg_runtime_ms"), F.avg("ttft_ms").alias("avg_ttft_ms"), F.count("ttft_ms").alias("ttft_count"))


def page(requests: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return requests.orderBy(F.col("started_at").desc(), F.col("id").desc()).offset(offset).limit(limit)


def latest_state(log: DataFrame) -> DataFrame:
    """The last entry of each request of a begin/finish log, by a pre-aggregated maximum."""
    return log.groupBy("id").agg(F.max(F.struct("at", *[c for c in log.columns if c not in ("id", "at")])).alias("s")).select("id", "s.*")


def chart_rows(requests: DataFrame) -> DataFrame:
    """id, measure, value: the two durations in seconds, melted, at local time of UTC+7."""
    local = F.from_utc_timestamp("started_at", "+07:00").alias("local_time")
    wide = requests.select("id", local, (F.col("runtime_ms") / 1000).alias("runtime_s"), (F.col("ttft_ms") / 1000).alias("ttft_s"))
    return wide.unpivot(["id", "local_time"], ["runtime_s", "ttft_s"], "measure", "value")


def peaks(samples: DataFrame) -> DataFrame:
    return samples.agg(F.max("memory_mb").alias("peak_memory_mb"), F.max("utilisation").alias("peak_utilisation"))
