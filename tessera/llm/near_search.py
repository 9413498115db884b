"""Approximate nearest neighbours by collision counting.

Each block of candidates keeps, built once, one sorted array of values for every random projection. A query's
windows are centred on its own projections; their half-width grows step by step ("virtual rehashing": a wider
window is the union of finer buckets, so nothing is rehashed). A candidate at distance d lies in a window of
half-width h with probability 2 Phi(h / d) - 1. Windows grow until they are ``REACH`` times the kth best distance
found; a neighbour at just that distance then collides in a share p = 2 Phi(REACH) - 1 of the projections,
and a candidate that collides in p less ``MARGIN`` standard deviations is verified: its exact distance is
computed. The kth distance starts from the query's kth over a bounded sample of candidates, which no
final one exceeds, so that no block opens wider windows than that. There is no cap on candidates. If
windows cover everything, everything has been verified.

Vectors that are null, zero, or hold null or non-finite components take no part. Vectors of different widths have
no distance; each is searched among those of its own width. Rows that repeat a vec_id count once (the
smallest vector). Ties go to the smaller vec_id. With fewer than k candidates, all are returned; an empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from functools import partial
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import vectors as V
from tessera.llm.common import Scratch

PROJECTIONS, REACH, MARGIN, GROWTH = 128, 1.28, 1.5, 1.25
_SEED = 4242


def needed(projections: int = PROJECTIONS) -> int:
    """Collisions from which a candidate is verified."""
    p = 2 * NormalDist().cdf(REACH) - 1
    return int(np.ceil(projections * (p - MARGIN * (p * (1 - p) / projections) ** 0.5)))


def lines(width: int) -> np.ndarray:
    return np.random.default_rng(_SEED).standard_normal((width, PROJECTIONS))


def index(ids: np.ndarray, x: np.ndarray) -> tuple:
    """ids, vectors, and for every projection the order of the rows and their sorted values."""
    values = x @ lines(x.shape[1])
    order = np.argsort(values, axis=0, kind="stable")
    ordered = np.take_along_axis(values, order, axis=0).T
    return ids, x, np.ascontiguousarray(order.T.astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32)), np.ascontiguousarray(ordered)


def near_in_block(block: tuple, queries: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray, k: int, counts: list | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, distances) of the best found in a block of index(). ``bounds``: what no kth distance exceeds. ``counts`` gets the number verified."""
    ids, x, order, ordered = block
    n, asked, threshold, out = len(ids), queries @ lines(x.shape[1]), needed(), []
    place = lambda at, side: np.fromiter((row.searchsorted(a, side) for row, a in zip(ordered, at)), np.int64, PROJECTIONS)
    for vector, own, centre, limit in zip(queries, query_ids, asked, bounds):
        waiting = ids != own
        total = int(waiting.sum())
        k_here = min(k, total)
        if not k_here:
            continue
        hits, distance = np.zeros(n, np.int32), np.full(n, np.inf)
        low = high = place(centre, "left")
        half = REACH * limit / GROWTH**2 if np.isfinite(limit) else float(np.median(np.abs(ordered - centre[:, None]))) / 2
        half = half or 1e-12
        while True:
            new_low, new_high = np.minimum(low, place(centre - half, "left")), np.maximum(high, place(centre + half, "right"))
            fresh = [order[p, new_low[p] : low[p]] for p in range(PROJECTIONS)] + [order[p, high[p] : new_high[p]] for p in range(PROJECTIONS)]
            hits += np.bincount(np.concatenate(fresh), minlength=n).astype(np.int32)
            low, high = new_low, new_high
            found = np.flatnonzero(waiting & (hits >= threshold))
            distance[found] = np.sqrt(((x[found] - vector) ** 2).sum(axis=1))
            waiting[found] = False
            verified = total - int(waiting.sum())
            kth = min(limit, float(np.partition(distance, k_here - 1)[k_here - 1]) if verified >= k_here else np.inf)
            if verified == total or REACH * kth <= half:
                break
            half = min(half * GROWTH, REACH * kth)
        if counts is not None:
            counts.append(verified)
        best = np.lexsort((ids, distance))[:k_here]
        best = best[np.isfinite(distance[best])]
        out.append((int(own), ids[best], distance[best]))
    return out


def _index_queries(ids: np.ndarray, x: np.ndarray, bounds: np.ndarray) -> tuple:
    return ids, x, bounds


def _within(block: tuple, group: tuple, *, k: int) -> dict:
    found = near_in_block(block, group[1], group[0], group[2], k)
    together = lambda j, kind: np.concatenate([f[j] for f in found] or [np.zeros(0, kind)])
    return {"query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64), "vec_id": together(1, np.int64), "score": together(2, np.float64)}


def _sample_kth(ids: np.ndarray, x: np.ndarray, *, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """The kth smallest distance of each query over the sample, a little enlarged: no final one is greater."""
    if len(sample_ids) <= k:
        return np.full(len(ids), np.inf)
    out = np.empty(len(ids))
    for i, vector in enumerate(x):
        away = np.sqrt(((sample - vector) ** 2).sum(axis=1))
        out[i] = np.partition(np.where(sample_ids == ids[i], np.inf, away), k - 1)[k - 1]
    return out * (1 + 1e-9)


def nearest(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) for the rows whose vec_id is divisible by ``every``."""
    scratch = Scratch(vectors.sparkSession, "near")
    clean = scratch.keep(V.clean_vectors(vectors, drop_zero=True), "clean")

    def one_width(some: DataFrame, name: str) -> DataFrame:
        ids, sample = V.bounded_sample(some)
        bound = partial(_sample_kth, sample_ids=ids, sample=sample, k=k)
        # One cell: any block may hold a neighbour, and collision counting decides inside it.
        return V.search(some, sample[:1], every, k, scratch, name, index, _index_queries, bound, partial(_within, k=k), "double", ascending=True)

    return V.by_width(clean, one_width)


def op10_near_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=100, k=10)
