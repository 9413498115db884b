"""BM25 over an inverted index of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X

K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """term, key, tf. Partial aggregation runs before the shuffle."""
    words = docs.select(key, F.explode(X.tokens(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    return words.groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))


def document_lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.size(X.tokens(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("length"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: n_docs (empty ones included) and avgdl (0 for an empty corpus)."""
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("length") / F.count(F.lit(1)), F.lit(0.0)).alias("avgdl"))


def term_stats(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.0), F.ln((n_docs - df + 0.5) / (df + 0.5) + 1))


def contribution(tf: Column, length: Column, avgdl: Column) -> Column:
    mean = F.when(avgdl == 0, 1.0).otherwise(avgdl)
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def scores_from_index(questions: DataFrame, index: DataFrame, lengths: DataFrame, question_id: str = "question_id", question: str = "question", key: str = "chunk_id") -> DataFrame:
    """question_id, key, bm25 from written postings (term, key, tf) and lengths (key, length); only the asked terms' postings are joined."""
    terms = questions.select(question_id, F.explode(F.array_distinct(X.tokens(F.col(question)))).alias("term"))
    hits = index.join(terms.select("term").distinct(), "term", "left_semi")
    frequency = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = terms.join(frequency, "term").join(hits, "term").join(lengths, key).join(F.broadcast(corpus_stats(lengths)))  # one row of statistics
    part = idf(F.col("n_docs"), F.col("df")) * contribution(F.col("tf"), F.col("length"), F.col("avgdl"))
    return weighed.groupBy(question_id, key).agg(F.sum(part).alias("bm25"))


def containing(questions: DataFrame, index: DataFrame, texts: DataFrame, question_id: str = "question_id", question: str = "question", key: str = "chunk_id", content: str = "content") -> DataFrame:
    """question_id of the questions whose whole text occurs in some text.

    A word inside the question, with others on both sides, must be a word of such a text; the rarest one's postings
    name the texts to look at. Questions of fewer than three words have none and are compared with all texts.
    """
    words = X.tokens(F.col(question))
    inner = questions.select(question_id, question, F.explode(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))).alias("term"))
    hits = index.join(inner.select("term").distinct(), "term", "left_semi")
    frequency = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rarest = inner.join(frequency, "term", "left").groupBy(question_id, question).agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    places = rarest.join(hits, "term").select(question_id, question, key)
    found = places.join(texts.select(key, content), key).where(F.col(content).contains(F.col(question))).select(question_id)
    short = questions.where(F.size(words) < 3).select(question_id, question)
    return found.unionByName(short.join(texts.select(content), F.col(content).contains(F.col(question))).select(question_id)).distinct()


def scores(questions: DataFrame, docs: DataFrame, question_id: str = "question_id", question: str = "question", key: str = "doc_id", text: str = "text") -> DataFrame:
    """question_id, key, bm25 of every document with at least one of the question's terms.

    The questions' terms are joined to the word stream before anything is grouped, so only the postings of asked
    terms are built; with few questions that join is a broadcast.
    """
    terms = questions.select(question_id, F.explode(F.array_distinct(X.tokens(F.col(question)))).alias("term"))
    asked = terms.select("term").distinct()
    words = docs.select(key, F.explode(X.tokens(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    index = words.join(asked, "term", "left_semi").groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))
    lengths = document_lengths(docs, key, text)
    frequency = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = corpus_stats(lengths)
    weighed = terms.join(frequency, "term").join(index, "term").join(lengths, key).join(F.broadcast(stats))  # one row of statistics
    part = idf(F.col("n_docs"), F.col("df")) * contribution(F.col("tf"), F.col("length"), F.col("avgdl"))
    return weighed.groupBy(question_id, key).agg(F.sum(part).alias("bm25"))


def top(scored: DataFrame, score: str, n: int, by: str = "question_id", key: str = "doc_id") -> DataFrame:
    """The best ``n`` rows of each group with their rank; ties to the smaller key. Ranks are cut before the shuffle by AQE's window-group limit."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
