"""Content-addressed caches as tables: model calls run for misses only, and what they return is appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(revision: str, config: str, text: Column) -> Column:
    """Identity of a model's output for a text."""
    return F.sha2(F.concat(F.lit(f"{revision}\n{config}\n"), text), 256)


def filled(wanted: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """(wanted with the cached or computed columns, the rows to append to the cache).

    Equal inputs are computed once. ``compute`` takes one row a missing key and returns the cache's columns.
    """
    misses = wanted.join(cache.select(key), key, "left_anti").dropDuplicates([key])
    fresh = compute(misses).select(*cache.columns)
    return wanted.join(cache.unionByName(fresh), key), fresh


def captioned(images: DataFrame, cache: DataFrame, describe: Callable[[DataFrame], DataFrame], review: Column) -> tuple[DataFrame, DataFrame]:
    """Images with their captions and a status, and new cache rows.

    ``describe`` returns the cache's columns for misses, with ``error`` where it failed. A failure is ``error`` and is
    not cached; review reasons make ``needs_review``; images marked excluded are not described.
    """
    todo = images.where(~F.coalesce("excluded", F.lit(False)))
    done, fresh = filled(todo, cache, describe, "cache_key")
    judged = done.withColumn("review_reasons", review)
    status = F.when(F.col("error").isNotNull(), "error").when(F.size("review_reasons") > 0, "needs_review").otherwise("completed")
    skipped = images.where(F.coalesce("excluded", F.lit(False))).withColumn("status", F.lit("excluded"))
    return judged.withColumn("status", status).unionByName(skipped, allowMissingColumns=True), fresh.where("error is null")


def status_histogram(captions: DataFrame) -> DataFrame:
    return captions.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def previews(rows: DataFrame, most: int = 800) -> DataFrame:
    """Retrieved rows for an interface: the content cut to ``most`` characters."""
    return rows.withColumn("preview", F.substring("content", 1, most)).drop("content")


def parents(elements: DataFrame) -> DataFrame:
    """Elements whose parser-side parent reference is replaced by that element's id."""
    refs = elements.select("document_id", F.col("ref").alias("parent_ref"), F.col("element_id").alias("parent_id"))
    return elements.drop("parent_id").join(refs, ["document_id", "parent_ref"], "left")
