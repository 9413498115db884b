import corpus_pipeline
import pytest

import __spark_entry__ as entry
from tests.llm.test_neardup import brute
from tests.llm.test_packing import check
from tests.llm.test_private import listed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What every stage returns, each written and read again."""
    home = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(str(home / name))
        out.append(spark.read.parquet(str(home / name)))
    return out


def test_stages_keep_the_columns_of_documents(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "private_data", "mixing", "packing"]
    for docs in stages[1:-1]:
        assert docs.columns == stages[0].columns


def test_quality_keeps_good_documents(stages, spark):
    kept = {r["doc_id"] for r in stages[1].collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = [(d in kept) == (q == 1) for d, q in labels.items()]
    assert sum(right) / len(right) > 0.93


def test_one_document_of_each_group_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    assert {r["doc_id"] for r in stages[2].collect()} == {i for i, (_, c) in brute(rows, 5).items() if i == c}


def test_no_personal_data_is_left(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    after = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    assert before.keys() == after.keys()
    for i, text in after.items():
        assert listed(text) == "" and (listed(before[i]) or text == before[i] or "[TERM]" in text)


def test_mixing_repeats_documents_within_the_cap(stages):
    words = lambda docs: {r["source"]: 0 for r in docs.select("source").collect()}
    size, taken = words(stages[3]), words(stages[3])
    for r in stages[3].collect():
        size[r["source"]] += len(r["text"].split())
    for r in stages[4].collect():
        taken[r["source"]] += len(r["text"].split())
    assert max(r["count"] for r in stages[4].groupBy("doc_id").count().collect()) <= 2
    assert sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.05)


def test_packing_covers_every_token(stages):
    check(stages[5].collect(), stages[4])


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 100


def test_empty_and_odd_tables(spark, odd_docs, make_docs):
    for docs in (make_docs([]), odd_docs):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            out.collect()


def test_queries_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)}
