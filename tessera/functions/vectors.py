"""Vector arithmetic and the hash embedder as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean norm; 1 for a zero vector."""
    n = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(n == 0, 1.0).otherwise(n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def hash_index(token: Column, dim: int = 1024) -> Column:
    """SHA-256 of the token modulo a power of two up to 4096: its last three hexadecimal digits decide."""
    digest = F.sha2(token, 256)
    digit = lambda place: F.instr(F.lit("0123456789abcdef"), F.substring(digest, place, 1)) - 1
    return ((digit(62) * 256 + digit(63) * 16 + digit(64)) % dim).cast("int").alias("idx")


def sparse_hash(docs: DataFrame, key: str, text: str, dim: int = 1024) -> DataFrame:
    """key, idx, weight: counts of the hashed tokens of each text (lower case, cut at white space)."""
    words = docs.select(key, F.explode(F.split(F.lower(F.col(text)), r"\s+")).alias("token")).where("token != ''")
    return words.select(key, hash_index(F.col("token"), dim)).groupBy(key, "idx").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def dense_hash(docs: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """key, embedding: the sparse counts as a vector of unit length; texts without tokens give zeros."""
    sparse = sparse_hash(docs, key, text, dim).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("idx", "weight"))).alias("m"))
    values = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    joined = docs.select(key).join(sparse, key, "left").withColumn("v", values)
    return joined.withColumn("n", norm(F.col("v"))).select(key, F.transform("v", lambda x: x / F.col("n")).alias("embedding"))


def is_valid_hybrid(dense: Column, indices: Column, weights: Column, dim: int) -> Column:
    """Right width, all finite, distinct non-negative indices, positive weights, one weight an index."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return (
        (F.size(dense) == dim) & F.forall(dense, finite) & (F.size(indices) == F.size(weights))
        & (F.size(F.array_distinct(indices)) == F.size(indices)) & F.forall(indices, lambda i: i >= 0) & F.forall(weights, lambda w: finite(w) & (w > 0))
    )
