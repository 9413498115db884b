import datetime as dt

import pytest

from tessera.operators import sessions, telemetry
from tessera.streaming import live

T0 = dt.datetime(2024, 1, 1)


def run(frame, name, mode):
    """All available input, then stop."""
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    return frame.sparkSession.table(name)


def test_repeated_content_is_dropped_across_batches(spark, tmp_path):
    rows = [("a", "h1", T0), ("b", "h2", T0), ("c", "h1", T0 + dt.timedelta(hours=1))]
    schema = "chunk_id string, content_hash string, ingested_at timestamp"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).write.parquet(str(tmp_path / f"in{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path))
    assert sorted(r["content_hash"] for r in run(live.new_content(stream), "fresh_chunks", "append").collect()) == ["h1", "h2"]


def test_status_windows_agree_with_the_batch_query(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001/")
    got = run(live.status_windows(stream), "status_counts", "complete").groupBy("status").sum("n").collect()
    want = telemetry.from_events(events).groupBy("status").count().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.filterwarnings("ignore")
def test_memory_agrees_with_the_batch_fold(spark, tmp_path):
    rows = [(1, t, "user" if t % 2 else "assistant", f"message {t}") for t in range(10)] + [(2, 0, "user", "x" * 7000)]
    schema = "conv_id long, turn long, role string, text string"
    frame = spark.createDataFrame(rows, schema)
    frame.where("turn < 5").coalesce(1).write.parquet(str(tmp_path / "a"))
    frame.where("turn >= 5").coalesce(1).write.parquet(str(tmp_path / "b"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path))
    live_rows = {r["conv_id"]: (r["n_turns"], r["n_chars"], r["summary"]) for r in run(live.live_memory(stream), "memories", "update").collect()}
    batch = {r["conv_id"]: (r["n_turns"], r["n_chars"], r["summary"]) for r in sessions.session_memory(frame).collect()}
    assert live_rows == batch
