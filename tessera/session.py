"""Session construction shared by the bench, the tests and scripts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session with the settings the queries assume: UTC, AQE and Arrow transfer.

    On a cluster, ``master`` is left to spark-submit; the shuffle width is only a
    starting point there because AQE coalesces or splits it from measured sizes.
    """
    builder = SparkSession.builder.appName("tessera")
    if master or "SPARK_MASTER" in os.environ:
        builder = builder.master(master or os.environ["SPARK_MASTER"])
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder; works on any filesystem Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
