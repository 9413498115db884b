"""Grading retrieval and choosing the relevance threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def supports() -> F.Column:
    """A chunk carries the expected text, type and document - each only where one is expected."""
    free = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    text = free("expect_contains") | F.col("content").contains(F.col("expect_contains"))
    kind = free("expect_type") | (F.col("type") == F.col("expect_type"))
    return text & kind & (F.col("source_doc").isNull() | (F.col("doc_id") == F.col("source_doc")))


def calibration(questions: DataFrame, chunks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: threshold between the worst supported and the best unsupported question, or an error.

    ``questions``: question_id, expect_fallback, expect_contains, expect_type, source_doc.
    """
    joined = questions.join(chunks, "question_id", "left").where("not expect_fallback")
    positive = joined.groupBy("question_id").agg(F.max(F.when(supports(), F.col("dense"))).alias("best"))
    p = positive.agg(F.min("best").alias("lowest_supported_score"), F.count(F.lit(1)).alias("supported_questions"), F.count_if(F.col("best").isNull()).alias("unseen"))
    n = questions.where("expect_fallback").join(outcomes, "question_id", "left").agg(F.max(F.coalesce("best_score", F.lit(0.0))).alias("highest_unsupported_score"), F.count(F.lit(1)).alias("unsupported_questions"))
    both = p.join(F.broadcast(n))  # one row each
    wrong = (
        F.when((F.col("supported_questions") == 0) | (F.col("unsupported_questions") == 0), "calibration requires supported and unsupported questions")
        .when(F.col("unseen") > 0, "no expected source evidence retrieved").when(F.isnan("lowest_supported_score") | F.isnan("highest_unsupported_score"), "calibration scores must be finite")
        .when(F.col("highest_unsupported_score") >= F.col("lowest_supported_score"), "no threshold separates the labeled questions")
    )
    threshold = F.when(wrong.isNull(), (F.greatest(F.lit(0.0), F.col("highest_unsupported_score")) + F.col("lowest_supported_score")) / 2)
    return both.select(threshold.alias("threshold"), wrong.alias("error"), "highest_unsupported_score", "lowest_supported_score", "supported_questions", "unsupported_questions")


def grades(questions: DataFrame, chunks: DataFrame, outcomes: DataFrame, top_k: int = 5) -> DataFrame:
    """question_id, fallback, has_text, has_type, passed."""
    seen = questions.join(chunks.where(F.col("rank") <= top_k), "question_id", "left")
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    found = seen.groupBy("question_id").agg(any_of(F.col("content").contains(F.col("expect_contains"))).alias("has_text"), any_of(F.col("type") == F.col("expect_type")).alias("has_type"), any_of(supports() & F.col("content").isNotNull()).alias("supported"))
    joined = questions.join(outcomes, "question_id").join(found, "question_id")
    passed = F.when(F.col("expect_fallback"), F.col("fallback")).otherwise(~F.col("fallback") & F.col("supported"))
    return joined.select("question_id", "fallback", "has_text", "has_type", passed.alias("passed"))


def totals(graded: DataFrame) -> DataFrame:
    return graded.agg(F.count(F.lit(1)).alias("questions"), F.count_if("passed").alias("passed"))
