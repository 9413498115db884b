"""What the operators share: column normalisation and tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space; ``bytes.split()`` cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"

_own_root: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a temporary folder
    serves a local master only; on a cluster that would lose files, so it is refused.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own_root:
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_root[context.applicationId] = f"file://{folder}"
    return _own_root[context.applicationId]


class Scratch:
    """Tables written to the shared folder, so that lineage is cut and a lost executor loses nothing.

    What an operator returns reads some of them until it is consumed; the others go at once by keep_only().
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.home = spark, f"{shared_root(spark)}/tessera-{label}-{uuid.uuid4().hex[:12]}"
        self.names: set[str] = set()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.home}/{name}"
        self.names.add(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table that no later read needs."""
        self.names.discard(name)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep_only(self, *names: str) -> None:
        """Remove all tables but these."""
        for name in sorted(self.names - set(names)):
            self.drop(name)

    def close(self) -> None:
        """Remove the whole folder, once nothing reads from it any more."""
        self.keep_only()
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.home)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
