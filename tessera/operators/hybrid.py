"""Rank fusion, the relevance gate and batched retrieval. Everything is keyed by question, so any number of questions is one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import dense
from tessera.operators.lexical import top

RRF_K = 60
DENSE_TOP, SPARSE_TOP, CANDIDATES, TOP_K = 10, 10, 10, 5
FALLBACK = "Tôi không tìm thấy thông tin phù hợp trong tài liệu."


def fuse(lists: list[DataFrame], question_id: str = "question_id", key: str = "chunk_id", k: int = RRF_K, carry: tuple[str, ...] = ()) -> DataFrame:
    """question_id, key, fused = sum of 1 / (k + rank); ``place`` orders ties by list, then rank; and the columns to ``carry`` from their lists.

    Lists are joined full outer. (A union of ranked lists would claim their partitioning, which fails in Spark 4.1
    when adaptive execution coalesces one list only.)
    """
    joined = None
    for i, ranked in enumerate(lists):
        rows = ranked.select(question_id, key, F.col("rank").alias(f"_r{i}"), *[c for c in carry if c in ranked.columns])
        joined = rows if joined is None else joined.join(rows, [question_id, key], "full")
    ranks = [F.col(f"_r{i}") for i in range(len(lists))]
    fused = sum((F.coalesce(1.0 / (k + r), F.lit(0.0)) for r in ranks), F.lit(0.0))
    place = F.coalesce(*[F.when(r.isNotNull(), F.struct(F.lit(i).alias("list"), r.alias("rank"))) for i, r in enumerate(ranks)])
    return joined.select(question_id, key, fused.alias("fused"), place.alias("place"), *carry)


def resolve_threshold(override: float | None, configured: float | None) -> float | None:
    """The larger of both; none at all leaves retrieval closed."""
    for value in (override, configured):
        if value is not None and not -1 <= value <= 1:
            raise ValueError("a cosine threshold lies between -1 and 1")
    if override is None:
        return configured
    return max(override, configured or 0.0)


def is_sound(dense: Column, fused: Column, content: Column) -> Column:
    """Evidence with finite scores and a text."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return finite(dense) & finite(fused) & (F.trim(F.coalesce(content, F.lit(""))) != "")


def gate(questions: DataFrame, candidates: DataFrame, threshold: float | None, top_k: int = TOP_K, pool: int = CANDIDATES, rerank: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, outcomes) of candidates with question_id, chunk_id, fused, place, dense, content.

    Order: cut to the pool, drop unsound evidence, note the best cosine, close if no threshold is set, keep
    cosines above 0 and the threshold, rerank, cut to top_k. outcomes: question_id, fallback, reason, best_score.
    """
    by_fused = Window.partitionBy("question_id").orderBy(F.col("fused").desc(), "place")
    pooled = candidates.withColumn("pool_rank", F.row_number().over(by_fused)).where(F.col("pool_rank") <= max(top_k, pool))
    sound = is_sound(F.col("dense"), F.col("fused"), F.col("content"))
    passes = F.lit(False) if threshold is None else sound & (F.col("dense") > 0) & (F.col("dense") >= threshold)
    judged = pooled.withColumn("sound", sound).withColumn("passes", passes)
    counts = judged.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("sound"), F.col("dense"))).alias("best"), F.count_if("passes").alias("passing"))
    asked = questions.select("question_id", F.trim(F.coalesce("question", F.lit(""))).alias("q")).join(counts, "question_id", "left")
    reason = (
        F.when(F.col("q") == "", "empty query").when(F.coalesce("n", F.lit(0)) == 0, "no matching chunks")
        .when(F.lit(threshold is None), "relevance threshold not configured").when(F.col("passing") == 0, "below relevance threshold").otherwise("")
    )
    outcomes = asked.select("question_id", (reason != "").alias("fallback"), reason.alias("reason"), F.coalesce("best", F.lit(0.0)).alias("best_score"))
    order = [F.col(rerank).desc(), F.col("pool_rank")] if rerank else [F.col("pool_rank")]
    kept = judged.where("passes").withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).where(F.col("rank") <= top_k)
    # A row that passes is evidence enough that its question did not fall back, unless there was no question.
    kept = kept.join(questions.where(F.trim(F.coalesce("question", F.lit(""))) != "").select("question_id"), "question_id", "left_semi")
    return kept.drop("sound", "passes"), outcomes


def retrieve(
    questions: DataFrame, asked: DataFrame, chunks: DataFrame, store: DataFrame, lexical_scores: DataFrame, threshold: float | None, top_k: int = TOP_K,
    dense_top: int = DENSE_TOP, sparse_top: int = SPARSE_TOP, pool: int = CANDIDATES, wanted: Column | None = None, scorer: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Hybrid retrieval: the best by cosine and by BM25 are fused, given a cosine each, and gated.

    ``asked``: question_id, embedding. ``chunks``: chunk_id, content and payload columns. ``store``: chunk_id,
    embedding. ``lexical_scores``: question_id, chunk_id, bm25. ``wanted`` is a condition on the payload that holds
    for both lists before either is cut. ``scorer`` reranks what passes the gate. A candidate without a payload stays
    until the gate drops it as unsound. Only the candidates of the lexical list have their cosine computed beside the scan.
    """
    if wanted is not None:
        allowed = chunks.where(wanted).select("chunk_id")
        store, lexical_scores = store.join(allowed, "chunk_id", "left_semi"), lexical_scores.join(allowed, "chunk_id", "left_semi")
    fused = fuse([dense.dense_top(asked, store, dense_top), top(lexical_scores, "bm25", sparse_top, key="chunk_id")], carry=("dense",))
    vectors = store.select("chunk_id", F.col("embedding").alias("_v"))
    with_vectors = fused.join(vectors, "chunk_id", "left").join(asked.select("question_id", F.col("embedding").alias("_q")), "question_id", "left")
    cosine = F.when(F.col("dense").isNull(), F.round(V.cosine(F.col("_v"), F.col("_q")), 9)).otherwise(F.col("dense"))
    candidates = with_vectors.withColumn("dense", cosine).drop("_v", "_q").join(chunks, "chunk_id", "left")
    if scorer is None:
        return gate(questions, candidates, threshold, top_k, pool)
    return gate(questions, reranked(candidates.join(questions.select("question_id", "question"), "question_id"), scorer).drop("question"), threshold, top_k, pool, "rerank")


def reranked(candidates: DataFrame, scorer: Column) -> DataFrame:
    """Adds ``rerank``; a score that is not finite fails the query, as a broken model should."""
    bad = scorer.isNull() | F.isnan(scorer) | (F.abs(scorer) == F.lit(float("inf")))
    return candidates.withColumn("rerank", F.when(bad, F.raise_error(F.lit("reranker scores must be finite"))).otherwise(scorer))


def citations(kept: DataFrame) -> DataFrame:
    """question_id, citations: distinct, in the order of rank."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", X.citation(F.col("file_name"), F.col("page")).alias("c"))))
    return kept.groupBy("question_id").agg(F.array_distinct(F.transform(ordered, lambda s: s["c"])).alias("citations"))
