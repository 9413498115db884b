"""Index generations: tables in a folder of their own, verified before a pointer makes them current."""

from __future__ import annotations

import json
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import dense, hybrid, lexical


def _filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file through Spark's filesystem: written beside its place, then renamed over it in one step."""
    target, fs = _filesystem(spark, path)
    jvm = spark._jvm
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.new")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    option = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    overwrite = jvm.java.lang.reflect.Array.newInstance(option, 1)
    overwrite[0] = jvm.java.lang.Enum.valueOf(option, "OVERWRITE")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(beside, target, overwrite)


def read_text(spark: SparkSession, path: str) -> str | None:
    target, fs = _filesystem(spark, path)
    return spark.read.text(path, wholetext=True).first()[0] if fs.exists(target) else None


def build(chunks: DataFrame, root: str, generation: str, dim: int = 64) -> str:
    """Writes payload, vectors, postings and lengths of a generation; payload files are sorted for pruning by type and document.

    The payload is written first and the rest is made from it, so chunks that cost much are made once. Where they come in
    fewer partitions than there are cores they are dealt over all of them.
    """
    home, cores = f"{root.rstrip('/')}/{generation}", chunks.sparkSession.sparkContext.defaultParallelism
    spread = chunks if chunks.rdd.getNumPartitions() >= cores else chunks.repartition(cores)
    spread.sortWithinPartitions("type", "doc_id").write.mode("overwrite").parquet(f"{home}/payload")
    chunks = chunks.sparkSession.read.parquet(f"{home}/payload")
    embedded = V.dense_hash(chunks, "chunk_id", "content", dim)
    embedded.write.mode("overwrite").parquet(f"{home}/vectors")
    lexical.postings(chunks, "chunk_id", "content").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{home}/postings")
    lexical.document_lengths(chunks, "chunk_id", "content").write.mode("overwrite").parquet(f"{home}/lengths")
    return home


@dataclass(frozen=True)
class Generation:
    """The tables of a published generation."""

    payload: DataFrame
    vectors: DataFrame
    postings: DataFrame
    lengths: DataFrame


def load(spark: SparkSession, home: str) -> Generation:
    return Generation(*(spark.read.parquet(f"{home}/{name}") for name in ("payload", "vectors", "postings", "lengths")))


def fingerprint(spark: SparkSession, path: str) -> str:
    """Changes with the names, sizes and times of the files at a path."""
    p, fs = _filesystem(spark, path)
    files, found = fs.listFiles(p, True), [path]
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}")
    return f"g{zlib.crc32(chr(10).join(sorted(found)).encode()):08x}"


def published(spark: SparkSession, root: str, generation: str, chunks: DataFrame) -> Generation:
    """The generation, if it is current; else it is built from the chunks, verified and published first."""
    home = f"{root.rstrip('/')}/{generation}"
    if current(spark, root) != home:
        publish(spark, root, generation, verify(spark, build(chunks, root, generation), chunks.count()))
    return load(spark, home)


def verify(spark: SparkSession, home: str, expected: int, dim: int = 64) -> DataFrame:
    """One row: counts and errors. Counts must agree, and every vector must have the right width and be finite."""
    payload, vectors = spark.read.parquet(f"{home}/payload"), spark.read.parquet(f"{home}/vectors")
    postings = spark.read.parquet(f"{home}/postings")
    sound = V.is_valid_hybrid(F.col("embedding"), F.array().cast("array<int>"), F.array().cast("array<double>"), dim)
    n = payload.agg(F.count(F.lit(1)).alias("payload_count"), F.count_distinct("chunk_id").alias("ids"))
    v = vectors.agg(F.count(F.lit(1)).alias("vector_count"), F.count_if(~sound).alias("bad_vectors"))
    p = postings.agg(F.count(F.lit(1)).alias("posting_count"))
    row = n.join(F.broadcast(v)).join(F.broadcast(p))  # one row each
    errors = F.array_compact(F.array(
        F.when(F.col("payload_count") != expected, "payload count differs"), F.when(F.col("ids") != F.col("payload_count"), "chunk ids repeat"),
        F.when(F.col("vector_count") != F.col("payload_count"), "vector count differs"), F.when(F.col("bad_vectors") > 0, "invalid vectors"),
        F.when((F.col("posting_count") == 0) & (F.col("payload_count") > 0), "lexical index is empty"),
    ))
    return row.withColumn("errors", errors).withColumn("ok", F.size("errors") == 0)


def smoke(spark: SparkSession, home: str, question: str, dim: int = 64, n: int = 3) -> DataFrame:
    """One row: what a question finds in a generation by vectors, by words and by both, at most ``n`` each, and errors where nothing is found."""
    g = load(spark, home)
    asked = spark.createDataFrame([(0, question)], "question_id int, question string")
    near = dense.dense_top(V.dense_hash(asked, "question_id", "question", dim), g.vectors, n)
    words = hybrid.top(lexical.scores_from_index(asked, g.postings, g.lengths), "bm25", n, key="chunk_id")
    both = hybrid.fuse([near, words])
    count = lambda found, name: found.agg(F.least(F.count(F.lit(1)), F.lit(n)).alias(name))
    row = count(near, "dense_results").join(F.broadcast(count(words, "sparse_results"))).join(F.broadcast(count(both, "hybrid_results")))  # one row each
    errors = F.array_compact(F.array(*[F.when(F.col(f"{k}_results") == 0, f"{k}_smoke_empty") for k in ("dense", "sparse", "hybrid")]))
    return row.withColumn("errors", errors).withColumn("ok", F.size("errors") == 0)


def manifest(spark: SparkSession, path: str, run_id: str, started_at: str, seen: DataFrame, new: DataFrame, inserted: int, published: bool, **settings) -> dict:
    """Counts, status and settings of one ingest run, written as JSON; returned as a dict."""
    n_seen, n_new = seen.count(), new.count()
    row = {"run_id": run_id, "started_at": started_at, **settings, "chunks_seen": n_seen, "chunks_new": n_new, "chunks_inserted": inserted, "chunks_skipped_dup": n_seen - n_new, "published": published}
    row["status"] = "published" if published else "indexed" if inserted else "prepared"
    write_text(spark, path, json.dumps(row, ensure_ascii=False, indent=2))
    return row


def publish(spark: SparkSession, root: str, generation: str, verified: DataFrame) -> None:
    """Makes a verified generation current; an unverified one is refused and nothing changes."""
    row = verified.first()
    if not row["ok"]:
        raise ValueError(f"generation {generation} failed verification: {list(row['errors'])}")
    write_text(spark, f"{root.rstrip('/')}/CURRENT.json", json.dumps({"generation": generation, "count": row["payload_count"]}))


def current(spark: SparkSession, root: str) -> str | None:
    text = read_text(spark, f"{root.rstrip('/')}/CURRENT.json")
    return f"{root.rstrip('/')}/{json.loads(text)['generation']}" if text else None
