"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target in words. A document's expected number of copies is its source's target over its
source's size; the whole part is taken outright and the fraction is rounded dependently: documents are
paired, words of expectation move at random from one to the other until one fraction becomes whole, and
the other goes on to the next pair. The move keeps both the pair's expected words and each document's own
expectation. Documents are dealt by hash into bounded groups of one source; every group leaves at most one
fractional document, and those residuals are combined by the same rule in a reduction tree.

Random draws hash the two doc_ids and a seed, so reruns agree. Null texts have size 0; a null source is a
source of its own, ordered last. Documents of size 0 take nothing. Very long texts are counted whole; a long document
moves in units of its own expectation like any other. Documents of equal size tie by doc_id. Extra columns are ignored. Rows that
repeat a doc_id are rounded one by one. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, documents, whole_text

SHARE, CAP, WEIGHTS = 1.5, 2.0, (5, 2, 1)
#: Documents paired in one task, and residuals combined in one task.
GROUP, FAN_IN = 2_000, 64
#: A fraction this near to a whole number is whole.
EPSILON = 1e-9

_ROWS = "doc_id long, source string, size long, copies long, fraction double, part long"


def word_count() -> F.Column:
    text = F.regexp_replace(whole_text(), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sized: DataFrame, share: float = SHARE, cap: float = CAP, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """source, source_size, n_docs, target: weighted shares, none over ``cap`` times its source.

    With sources ordered by cap over weight, a source is capped just if the share left when its
    predecessors are capped exceeds its cap; so two running sums settle it without iterating. The
    windows are over one row a source.
    """
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    stats = stats.withColumn("weight", weight).withColumn("most", cap * F.col("source_size")).withColumn("total", share * F.sum("source_size").over(everything))
    before = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    capped_before = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    stats = stats.withColumn("capped", (F.col("total") - capped_before) * F.col("weight") >= F.col("most") * weight_left)
    spare = F.max("total").over(everything) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("most"))).over(everything), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    target = F.when(F.col("capped"), F.col("most")).otherwise(spare * F.col("weight") / open_weight)
    return stats.select("source", "source_size", "n_docs", target.alias("target"))


def _draw(a: int, b: int, seed: int) -> float:
    """A number in [0, 1) from two ids (splitmix64 finaliser)."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + seed * 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def round_group(rows: pd.DataFrame, *, seed: int = 0) -> pd.DataFrame:
    """Rounds all fractions of a group but one at most; large documents come first, so that a small one is left."""
    rows = rows.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
    ids = [0 if pd.isna(x) else int(x) for x in rows["doc_id"]]
    sizes, parts = rows["size"].tolist(), rows["fraction"].tolist()
    held = -1
    for i, p in enumerate(parts):
        if sizes[i] == 0:
            parts[i] = 0.0
            continue
        if not EPSILON < p < 1 - EPSILON:
            parts[i] = float(round(p))
            continue
        if held < 0:
            held = i
            continue
        w, v, q = sizes[held], sizes[i], parts[held]
        up, down = min(w * (1 - q), v * p), min(w * q, v * (1 - p))  # words that may move to, and from, the held one
        move = up if _draw(ids[held], ids[i], seed) * (up + down) < down else -down
        parts[held], parts[i] = q + move / w, p - move / v
        fractional = [k for k in (held, i) if EPSILON < parts[k] < 1 - EPSILON]
        for k in {held, i} - set(fractional):
            parts[k] = float(round(parts[k]))
        held = fractional[0] if fractional else -1
    rows["copies"] += [int(p) if p == 1.0 else 0 for p in parts]
    rows["fraction"] = [p if 0 < p < 1 else 0.0 for p in parts]
    return rows


def mix(docs: DataFrame, share: float = SHARE, cap: float = CAP, weights: Sequence[float] = WEIGHTS, seed: int = 20) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies; one row for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.keep(docs.select("doc_id", "source", word_count().alias("size")), "sized")
    targets = scratch.keep(source_targets(sized, share, cap, weights), "targets")
    t = targets.withColumnRenamed("source", "of_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    groups = F.ceil(F.col("n_docs") / GROUP)
    rows = sized.join(t, F.col("source").eqNullSafe(F.col("of_source"))).select(
        "doc_id", "source", "size", F.floor(ratio).cast("long").alias("copies"), (ratio - F.floor(ratio)).alias("fraction"),
        F.pmod(F.xxhash64("doc_id", F.lit(seed)), groups).cast("long").alias("part"),
    )
    parts = targets.agg(F.max(F.ceil(F.col("n_docs") / GROUP))).first()[0] or 0
    level, settled = 0, []
    while True:
        rounded = scratch.keep(rows.groupBy("source", "part").applyInPandas(partial(round_group, seed=seed + level), _ROWS), f"level{level}")
        settled.append(rounded.where("fraction = 0"))
        if parts <= 1:
            break
        rows = rounded.where("fraction > 0").withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long"))
        parts, level = -(-parts // FAN_IN), level + 1
    # One document a source is left fractional: it takes the nearer whole number.
    settled.append(rounded.where("fraction > 0").withColumn("copies", F.col("copies") + F.when(F.col("fraction") >= 0.5, 1).otherwise(0)))
    done = settled[0]
    for more in settled[1:]:
        done = done.unionByName(more)
    return done.join(t, F.col("source").eqNullSafe(F.col("of_source"))).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as its document is taken.

    Rows that repeat a doc_id all follow the largest number of copies decided for it.
    """
    copies = mix(docs, **options).groupBy("doc_id").agg(F.max("copies").alias("_tessera_copies")).where("_tessera_copies > 0").withColumnRenamed("doc_id", "_tessera_taken")
    joined = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("_tessera_taken")))
    return joined.withColumn("_tessera_copy", F.explode(F.sequence(F.lit(1), F.col("_tessera_copies").cast("int")))).select(*docs.columns)


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7_mix_sources draws to: each document's size, its source's size and target. No draw is in it, so SQL can tell it."""
    sized = documents(spark, sf_dir).select("doc_id", "source", word_count().alias("size"))
    t = source_targets(sized).withColumnRenamed("source", "of_source")
    return sized.join(t, F.col("source").eqNullSafe(F.col("of_source"))).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


#: Sources in the order in which they reach their caps; a source is capped if what is left then exceeds its cap.
MIXING_TARGETS_SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) size FROM documents),
stats AS (SELECT source, CAST(sum(size) AS BIGINT) source_size FROM sized GROUP BY source),
weighed AS (SELECT *, 2.0 * source_size most, [5.0, 2.0, 1.0][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)] weight FROM stats),
ordered AS (
  SELECT *, 1.5 * sum(source_size) OVER () total,
         coalesce(sum(most) OVER w, 0) gone, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) weight_left
  FROM weighed WINDOW w AS (ORDER BY most / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (SELECT *, (total - gone) * weight >= most * weight_left AS capped FROM ordered),
spare AS (SELECT max(total) - coalesce(sum(most) FILTER (capped), 0) left_over, sum(weight) FILTER (NOT capped) open_weight FROM judged)
SELECT doc_id, size, source_size, round(CAST(CASE WHEN capped THEN most ELSE left_over * weight / open_weight END AS DOUBLE), 6) target
FROM sized JOIN judged ON sized.source IS NOT DISTINCT FROM judged.source, spare
"""


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("copies")
