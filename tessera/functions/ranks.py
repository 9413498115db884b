"""Row numbers within groups that may be any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Integers that share a bucket.
SPAN = 65_536


def numbered(rows: DataFrame, by: list[str], order: str, number: str = "_i", total: str = "_n") -> DataFrame:
    """Rows with their number (from 1) in their group by an integer column, and the group's size.

    Rows are numbered within buckets of neighbouring integers, so that no task sorts a whole group, and buckets are
    numbered from their counts: one row for each bucket that is not empty. Null keys are a group; a null order comes first.
    """
    bucket = F.floor(F.col(order) / SPAN)
    local = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(order))
    placed = rows.withColumn("_bucket", bucket).withColumn("_local", local)
    groups = Window.partitionBy(*by)
    before = F.sum("_size").over(groups.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy(*by, bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_size"))
    counts = counts.withColumns({"_before": F.coalesce(before, F.lit(0)), "_total": F.sum("_size").over(groups)})
    keys = [*by, "_bucket"]
    counts = counts.select(*[F.col(c).alias(f"_key{k}") for k, c in enumerate(keys)], "_before", "_total")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_key{k}")) for k, c in enumerate(keys)])
    joined = placed.join(counts, same).withColumns({number: F.col("_before") + F.col("_local"), total: F.col("_total")})
    return joined.drop("_bucket", "_local", "_before", "_total", *[f"_key{k}" for k in range(len(keys))])
