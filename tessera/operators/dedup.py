"""Content identity and the three kinds of upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def point_id(chunk_id: Column) -> Column:
    """MD5 of the chunk id, grouped 8-4-4-4-12."""
    return F.regexp_replace(F.md5(chunk_id), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def chunk_id(document: Column, kind: Column, ordinal: Column, source_ids: Column, text: Column) -> Column:
    """document-kind-hash over a compact JSON array of what identifies the chunk."""
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
    value = F.concat(F.lit("["), F.concat_ws(",", quote(document), quote(kind), ordinal.cast("string"), F.concat(F.lit("["), F.array_join(F.transform(source_ids, quote), ","), F.lit("]")), quote(F.sha2(text, 256))), F.lit("]"))
    return F.concat(document, F.lit("-"), kind, F.lit("-"), F.substring(F.sha2(value, 256), 1, 20))


def first_wins(rows: DataFrame, hash_column: str = "content_hash", order: str = "seq") -> DataFrame:
    """The first row of each content hash; rows with a blank hash all stay.

    The minimum per hash is pre-aggregated, so a hash that a third of the rows share is no single task's load.
    """
    hashed = F.coalesce(F.col(hash_column), F.lit("")) != ""
    firsts = rows.where(hashed).groupBy(hash_column).agg(F.min(order).alias("_first")).select("_first")
    kept = rows.where(hashed).join(firsts, F.col(order) == F.col("_first"), "left_semi")
    return kept.unionByName(rows.where(~hashed))


def fresh(incoming: DataFrame, store: DataFrame, hash_column: str = "content_hash") -> DataFrame:
    """Incoming rows whose hash the store does not have."""
    return incoming.join(store.select(hash_column).distinct(), hash_column, "left_anti")


def last_wins(rows: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """The last row of each key, by a pre-aggregated maximum."""
    lasts = rows.groupBy(key).agg(F.max(order).alias("_last")).select("_last")
    return rows.join(lasts, F.col(order) == F.col("_last"), "left_semi")


def upsert_local(store: DataFrame, incoming: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Skip a hash seen before (in the store or earlier in the batch); a known id overwrites in place. Both have ``seq``."""
    marked = store.withColumn("_new", F.lit(False)).unionByName(incoming.withColumn("_new", F.lit(True)))
    blank = F.coalesce(F.col("content_hash"), F.lit("")) == ""
    # Blank hashes never match. The first of each other hash is pre-aggregated, as in first_wins, and so is the last of each key.
    firsts = marked.where(~blank).groupBy("content_hash").agg(F.min(F.struct("_new", "seq")).alias("_f")).where("_f._new").select(F.col("_f.seq").alias("seq"))
    fresh_rows = marked.where(F.col("_new") & ~blank).join(firsts, "seq", "left_semi")
    kept = marked.where(~F.col("_new") | blank).unionByName(fresh_rows)
    lasts = kept.groupBy(key).agg(F.max(F.struct("_new", "seq")).alias("_l")).select("_l._new", "_l.seq")
    return kept.join(lasts, ["_new", "seq"], "left_semi").drop("_new")


def upsert_dense(store: DataFrame, incoming: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Skip hashes present before the call (not within the batch); known ids overwrite."""
    return _overwrite(store, fresh(incoming, store), key)


def upsert_hybrid(store: DataFrame, incoming: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Overwrite by point id; hashes play no part."""
    return _overwrite(store, incoming, key)


def _overwrite(store: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    newest = last_wins(incoming, key)
    return store.join(newest.select(key), key, "left_anti").unionByName(newest)


def first_by_text(rows: DataFrame, text: str, order: str) -> DataFrame:
    """Distinct trimmed texts, the first of each."""
    return rows.groupBy(F.trim(F.col(text)).alias("_t")).agg(F.min_by(F.struct("*"), order).alias("_r")).select("_r.*")


def collisions(files: DataFrame, path: str = "path") -> DataFrame:
    """Number of files that share a stem, ignoring case."""
    stem = F.lower(F.regexp_replace(F.regexp_extract(F.col(path), r"([^/\\]+)$", 1), r"\.[^.]*$", ""))
    stems = files.withColumn("stem", stem)
    counts = stems.groupBy(F.col("stem").alias("_s")).agg(F.count(F.lit(1)).alias("n_same_stem"))
    return stems.join(counts, F.col("stem").eqNullSafe(F.col("_s")), "left").drop("_s")
