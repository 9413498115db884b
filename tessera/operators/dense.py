"""Dense and sparse vector search over tables."""

from __future__ import annotations

from functools import reduce
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators.lexical import top

#: Queries that one batch of vectors is multiplied with at once.
QUERY_LIMIT = 4096


def payload_filter(local: bool = True, **wanted) -> Column:
    """Conditions that hold before any ranking. ``local``: only doc_id and type count and falsy values set none; else every key with a value does."""
    chosen = {k: v for k, v in wanted.items() if (v and k in ("doc_id", "type") if local else v is not None)}
    return reduce(lambda c, kv: c & (F.col(kv[0]) == F.lit(kv[1])), chosen.items(), F.lit(True))


def cosine_scores(questions: DataFrame, store: DataFrame, question_id: str = "question_id", key: str = "chunk_id", n: int | None = None) -> DataFrame:
    """question_id, key, dense for every pair, or for the ``n`` best of each batch of the store by cosine to nine digits, then key.

    Questions are the small side and are sent to the store's tasks, in blocks of QUERY_LIMIT. For each the store is
    scanned once, in Arrow batches; a batch is multiplied with the block as one matrix. The driver holds all
    questions' vectors, a task those of one block. With ``n`` no more than that many rows a question leave a batch.
    """
    rows = questions.select(question_id, "embedding").toLocalIterator()
    blocks = [_block_scores(block, questions, store, question_id, key, n) for block in batched(rows, QUERY_LIMIT)]
    return reduce(DataFrame.unionAll, blocks or [_block_scores((), questions, store, question_id, key, n)])


def _block_scores(rows: tuple, questions: DataFrame, store: DataFrame, question_id: str, key: str, n: int | None) -> DataFrame:
    ids = [r[0] for r in rows]
    asked = np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), -1 if rows else 0)
    asked_norm = np.linalg.norm(asked, axis=1)
    asked_norm[asked_norm == 0] = 1.0
    types = dict(questions.dtypes)[question_id], dict(store.dtypes)[key]

    def score(batches):
        for batch in batches:
            if not len(batch) or not ids:
                continue
            x = np.array(batch["embedding"].tolist(), dtype=np.float64)
            norms = np.linalg.norm(x, axis=1)
            norms[norms == 0] = 1.0
            s, keys = (asked @ x.T) / asked_norm[:, None] / norms[None, :], batch[key].to_numpy()
            if n is None or n >= len(batch):
                yield pd.DataFrame({question_id: np.repeat(ids, len(batch)), key: np.tile(keys, len(ids)), "dense": s.ravel()})
                continue
            by_key = np.argsort(keys, kind="stable")
            best = by_key[np.argsort(-np.round(s[:, by_key], 9), axis=1, kind="stable")[:, :n]]
            yield pd.DataFrame({question_id: np.repeat(ids, n), key: keys[best].ravel(), "dense": np.take_along_axis(s, best, axis=1).ravel()})

    return store.select(key, "embedding").mapInPandas(score, f"{question_id} {types[0]}, {key} {types[1]}, dense double")


def dense_top(questions: DataFrame, store: DataFrame, n: int, question_id: str = "question_id", key: str = "chunk_id") -> DataFrame:
    """The ``n`` best of every question by cosine to nine digits, ties to the smaller key: the best of each batch, ranked once more."""
    scored = cosine_scores(questions, store, question_id, key, n).withColumn("dense", F.round("dense", 9))
    return top(scored, "dense", n, question_id, key)


def one_query_top(store: DataFrame, query: Column, n: int, key: str = "vec_id") -> DataFrame:
    """Best ``n`` for one vector, in built-in functions: a narrow scan and a top-n."""
    scored = store.select(key, V.cosine(F.col("embedding"), query).alias("dense"))
    return scored.orderBy(F.col("dense").desc(), key).limit(n)


def sparse_scores(question_terms: DataFrame, document_terms: DataFrame, question_id: str = "question_id", key: str = "chunk_id") -> DataFrame:
    """question_id, key, sparse: inner products of (idx, weight) rows, joined on the index."""
    q = question_terms.select(question_id, "idx", F.col("weight").alias("q_weight"))
    return document_terms.join(q, "idx").groupBy(question_id, key).agg(F.sum(F.col("weight") * F.col("q_weight")).alias("sparse"))
