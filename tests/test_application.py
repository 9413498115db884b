import pytest
from pyspark.sql import functions as F

from tessera import __main__ as app
from tessera import settings as S
from tessera.operators import caching


def test_settings_precedence(tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"top_k": 7, "dense_top": 20, "relevance_threshold": 0.3}')
    got = S.load(str(path), {"TESSERA_TOP_K": "8", "TESSERA_ALLOW_EGRESS": "yes", "OTHER": "1"}, relevance_threshold=0.6, dense_top=None)
    assert (got.top_k, got.dense_top, got.relevance_threshold, got.allow_egress) == (8, 20, 0.6, True)
    for bad in ({"TESSERA_TOP_K": "0"}, {"TESSERA_NOPE": "1"}, {"TESSERA_TARGET_TOKENS": "900"}, {"TESSERA_RELEVANCE_THRESHOLD": "2"}):
        with pytest.raises(ValueError):
            S.load(None, bad)
    with pytest.raises(PermissionError):
        S.require_egress(S.Settings(), "somewhere")


def test_cache_computes_each_missing_key_once(spark):
    wanted = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "id int, fingerprint string")
    cache = spark.createDataFrame([("a", 10)], "fingerprint string, value int")
    got, fresh = caching.filled(wanted, cache, lambda misses: misses.select("fingerprint", F.lit(99).alias("value")))
    assert {r["id"]: r["value"] for r in got.collect()} == {1: 10, 2: 99, 3: 99, 4: 99} and fresh.count() == 2


def test_caption_states(spark):
    images = spark.createDataFrame([("i1", "k1", False), ("i2", "k2", False), ("i3", "k3", True), ("i4", "k4", False)], "element_id string, cache_key string, excluded boolean")
    cache = spark.createDataFrame([("k1", "good", None)], "cache_key string, caption string, error string")
    describe = lambda m: m.select("cache_key", F.when(F.col("cache_key") == "k2", "n/a").alias("caption"), F.when(F.col("cache_key") == "k4", "timeout").alias("error"))
    review = F.array_compact(F.array(F.when(F.col("caption") == "n/a", "placeholder")))
    got, fresh = caching.captioned(images, cache, describe, review)
    assert {r["element_id"]: r["status"] for r in got.collect()} == {"i1": "completed", "i2": "needs_review", "i3": "excluded", "i4": "error"}
    assert [r["cache_key"] for r in fresh.collect()] == ["k2"] and caching.status_histogram(got).count() == 4


def test_ingest_and_ask(spark, tmp_path):
    root = f"file://{tmp_path}"
    docs = spark.createDataFrame([(i, f"Heading {i}\nThe {w} costs {i} coins per year.") for i, w in enumerate(["castle", "bridge", "harbour", "garden"])], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "The harbour costs 2 coins per year."), (2, "zzz qqq")], "question_id int, question string")
    with pytest.raises(LookupError):
        app.ask(spark, root, asked, S.Settings())
    app.ingest(spark, docs, root, "g1", S.Settings())
    got = {r["question_id"]: r for r in app.ask(spark, root, asked, S.Settings(relevance_threshold=0.4)).collect()}
    assert "harbour" in got[1]["answer"] and "[2.txt]" in got[1]["answer"]
    assert got[2]["fallback"] and got[2]["reason"] == "below relevance threshold"
    assert app.ask(spark, root, asked, S.Settings()).where("reason = 'relevance threshold not configured'").count() == 2
