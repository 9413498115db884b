"""python -m tessera: list and run queries, build and publish an index, ask it a question."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import settings as S
from tessera.functions import vectors as V
from tessera.operators import answer, dense, elements, hybrid, index, lexical
from tessera.operators.chunking import Budget, chunk, type_aware
from tessera.plans import catalog
from tessera.session import build_session


def ingest(spark: SparkSession, documents: DataFrame, root: str, generation: str, settings: S.Settings) -> str:
    """Documents (doc_id, text) to a published generation; an index that fails verification is not published."""
    rows = elements.with_sections(elements.element_ids(elements.from_text(documents)))
    budget = Budget(settings.target_tokens, settings.preferred_max_tokens, settings.hard_max_tokens, settings.overlap_tokens)
    chunks = chunk(elements.retrieval_elements(rows), type_aware, budget=budget).withColumn("file_name", F.concat("doc_id", F.lit(".txt")))
    home = index.build(chunks, root, generation)
    index.publish(spark, root, generation, index.verify(spark, home, spark.read.parquet(f"{home}/payload").count()))
    return home


def ask(spark: SparkSession, root: str, questions: DataFrame, settings: S.Settings, embed: Callable = V.dense_hash, scorer: Column | None = None, **wanted) -> DataFrame:
    """Answers to (question_id, question) from the published generation.

    ``embed`` (table, key, text column) gives key and embedding, as the index was built with; ``scorer`` reranks by a
    column over question and content; ``wanted`` filters the payload (doc_id, type, ...) before any ranking.
    """
    home = index.current(spark, root)
    if home is None:
        raise LookupError("no generation has been published")
    made = index.load(spark, home)
    words = lexical.scores_from_index(questions, made.postings, made.lengths)
    kept, outcomes = hybrid.retrieve(
        questions, embed(questions, "question_id", "question"), made.payload, made.vectors, words, settings.relevance_threshold, settings.top_k,
        settings.dense_top, settings.sparse_top, settings.candidate_top, dense.payload_filter(local=False, **wanted) if wanted else None, scorer,
    )
    return answer.answers(questions, kept, outcomes)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessera")
    parser.add_argument("--master", default="local[*]")
    parser.add_argument("--settings")
    parser.add_argument("--threshold", type=float)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("query")
    run.add_argument("folder")
    build = commands.add_parser("ingest")
    build.add_argument("documents")
    build.add_argument("root")
    build.add_argument("generation")
    question = commands.add_parser("ask")
    question.add_argument("root")
    question.add_argument("question")
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(catalog.queries())))
        return
    settings = S.load(args.settings, relevance_threshold=args.threshold)
    spark = build_session(args.master)
    if args.command == "run":
        catalog.queries()[args.query](spark, args.folder).show(truncate=80)
    elif args.command == "ingest":
        print(ingest(spark, spark.read.parquet(args.documents), args.root, args.generation, settings))
    else:
        asked = spark.createDataFrame([(1, args.question)], "question_id int, question string")
        for row in ask(spark, args.root, asked, settings).collect():
            print(row["answer"] if not row["fallback"] else f"{row['answer']} ({row['reason']})")


if __name__ == "__main__":
    main()
