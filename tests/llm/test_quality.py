import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in quality.op9_quality(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    right = [got[r["doc_id"]]["predicted"] == r["quality"] for r in labels]
    assert len(labels) > 80 and np.mean(right) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_labels_of_held_out_rows_change_nothing(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, labels).rules == quality.fit(docs, other).rules


def test_column_and_numpy_scores_agree(spark, make_docs):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    counted, stats = quality.with_statistics(docs, F.col("text"))
    rows = counted.select(*[c.alias(k) for k, c in stats.items()], model.column(stats).alias("out")).toPandas()
    assert model.rules
    assert rows["out"].to_numpy() == pytest.approx(model.score({k: rows[k].to_numpy() for k in stats}))


def test_rules_find_a_conjunction():
    rng = np.random.default_rng(1)
    x = {"a": rng.random(2000), "b": rng.random(2000), "noise": rng.random(2000)}
    y = ((x["a"] > 0.5) & (x["b"] <= 0.4)).astype(float)
    model = quality.fit_rules(x, y)
    assert (((model.score(x) >= 0.5) == y).mean()) > 0.97


def test_statistics(spark, make_docs):
    docs = make_docs([(1, "Aa Bb!! 12\nAa Bb!! 12"), (2, "go go go stop"), (3, None)])
    counted, stats = quality.with_statistics(docs, quality.whole_text())
    got = {r["doc_id"]: r for r in counted.select("doc_id", *[c.alias(k) for k, c in stats.items()]).collect()}
    assert got[1]["distinct_lines"] == 0.5 and got[1]["distinct_words"] == 0.5 and got[1]["upper"] == 0.5
    assert got[2]["repeated"] == pytest.approx(8 / 13)
    assert got[3]["word_length"] == 0 and got[3]["log_words"] == 0


def test_odd_documents_and_missing_labels(odd_docs, make_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(odd_docs, none)
    assert model.rules == [] and model.intercept == 0.0
    assert quality.scored(odd_docs, model).count() == 13
    one = spark.createDataFrame([(i, 1) for i in range(40)] + [(None, 0), (5, None)], "doc_id long, quality int")
    assert quality.fit(odd_docs, one).intercept > 0
    assert quality.good_documents(make_docs([]), none).collect() == []
