"""Exact top-k search by inner product: dual cover trees.

Candidates and queries are indexed alike. At the top level a set of pivots, whose cells and covering radii all
tasks know, prunes pairs of a cell and a query group before any vector is sent. Below it every block of
candidates and every query group has a cover tree, built once: a node at level i has a data point as its
centre and covers its rows within 2**i; its children's centres, the node's own among them (nesting), lie more
than 2**(i-1) apart (separation) and cover its rows within that distance (covering). Levels without a new
centre are left out, and each node also keeps the true covering radius. A pair of nodes is pruned when the
largest inner product that their balls allow,

    <q, c> + r_q |c| + r_c |q| + r_q r_c    (q, c the centres, r the covering radii),

is under the worst kth score of the query node. A query's kth score starts from its kth over a bounded sample
of candidates. A node of few rows, or whose next level would give nearly every row a centre of its own (as far
apart as random vectors of many dimensions are), keeps its rows as a leaf, to be compared by a matrix product.

Vectors that are null or hold null or non-finite components take no part. Vectors of different widths have no
inner product; each is searched among those of its own width. Rows that repeat a vec_id count once (the
smallest vector). Scores are exact: in doubles while they stay under 2**53, in 64-bit integers under 2**62, in
Python's integers above. A score among the best that fits no long raises an error. Ties go to the smaller
vec_id. With fewer than k candidates, all are returned; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import vectors as V
from tessera.llm.common import Scratch

#: Rows of a leaf; a level is worth building if its centres have so many rows on average.
LEAF, MEAN = 128, 16
_SLACK = 1e-9
#: Rows compared at once.
_SLICE = 2048
_LEAST, _MOST = -(2**63) + 1, 2**63 - 1
#: Stands for no score, and for scores below all longs.
_NONE, _BELOW = -(2**63), _LEAST


class CoverTree:
    """Nodes as lists: centre (a row of ``x``), covering radius, level, children, and the rows that the node covers."""

    def __init__(self, x: np.ndarray):
        self.x, self.centres, self.radii, self.levels, self.children, self.rows = x, [], [], [], [], []
        if len(x):
            self._grow(np.arange(len(x)), 0)
        self.norms = [float(np.linalg.norm(x[c])) for c in self.centres]

    def _grow(self, rows: np.ndarray, centre: int) -> int:
        far = np.sqrt(((self.x[rows] - self.x[centre]) ** 2).sum(axis=1))
        radius, node = float(far.max()), len(self.centres)
        level = int(np.ceil(np.log2(radius))) if radius > 0 else None
        for of, value in ((self.centres, centre), (self.radii, radius * (1 + _SLACK)), (self.levels, level), (self.children, []), (self.rows, rows)):
            of.append(value)
        if len(rows) > LEAF and radius > 0:
            split = self._net(rows, centre, far, 2.0 ** (level - 1))
            if split is not None:
                heads, nearest = split
                self.children[node] = [self._grow(rows[nearest == h], int(head)) for h, head in enumerate(heads)]
        return node

    def _net(self, rows: np.ndarray, centre: int, far: np.ndarray, apart: float) -> tuple[list[int], np.ndarray] | None:
        """Centres more than ``apart`` from each other that leave no row farther than that, and each row's nearest one."""
        heads, nearest, gap = [centre], np.zeros(len(rows), np.int64), far.copy()
        while True:
            worst = int(gap.argmax())
            if gap[worst] <= apart:
                return heads, nearest
            if len(heads) * MEAN > len(rows):
                return None
            heads.append(int(rows[worst]))
            new = np.sqrt(((self.x[rows] - self.x[rows[worst]]) ** 2).sum(axis=1))
            closer = new < gap
            nearest[closer], gap = len(heads) - 1, np.minimum(gap, new)


def products(queries: np.ndarray, candidates: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as 64-bit integers; _NONE where ``same``. No partial sum exceeds the product of the norms."""
    norm = lambda x: float(np.sqrt((x**2).sum(axis=1)).max(initial=0.0))
    a, b = norm(queries), norm(candidates)
    if a * b < 2.0**52:
        out = (queries @ candidates.T).astype(np.int64)
    elif max(a, b, a * b) < 2.0**62:
        out = queries.astype(np.int64) @ candidates.astype(np.int64).T
    else:
        whole = lambda x: [[int(c) for c in row] for row in x]
        others = whole(candidates)
        exact = [[_BELOW if own else max(sum(p * q for p, q in zip(one, other)), _BELOW) for other, own in zip(others, row)] for one, row in zip(whole(queries), same)]
        if any(s > _MOST for row in exact for s in row):
            raise OverflowError("an inner product fits no long")
        out = np.array(exact, dtype=np.int64).reshape(same.shape)
    out[same] = _NONE
    return out


def dual_search(candidates: CoverTree, ids: np.ndarray, queries: CoverTree, query_ids: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scores (_NONE: none) and ids of the best ``k`` of every query; ``ids`` ascending. ``least``: what each kth score is known to reach."""
    best = np.full((len(query_ids), k), _NONE)
    best_ids = np.full((len(query_ids), k), np.iinfo(np.int64).max)
    floor = np.full(len(query_ids), -np.inf) if least is None else least

    def bound(q: int, c: int) -> float:
        one, other = queries.x[queries.centres[q]], candidates.x[candidates.centres[c]]
        most = float(one @ other) + queries.radii[q] * candidates.norms[c] + candidates.radii[c] * queries.norms[q] + queries.radii[q] * candidates.radii[c]
        return most + _SLACK * (abs(most) + queries.norms[q] * candidates.norms[c] + 1)

    def visit(q: int, c: int, most: float) -> None:
        rows = queries.rows[q]
        kth = best[rows, -1]
        kth = np.where(kth > _BELOW, kth - _SLACK * np.abs(kth.astype(np.float64)), -np.inf)
        if most < np.maximum(kth, floor[rows]).min():
            return
        below_q, below_c = queries.children[q], candidates.children[c]
        if not below_q and not below_c:
            for at in range(0, len(candidates.rows[c]), _SLICE):
                compare(rows, candidates.rows[c][at : at + _SLICE])
        elif below_q and (not below_c or queries.radii[q] > candidates.radii[c]):
            for child in below_q:
                visit(child, c, bound(child, c))
        else:
            for most_here, child in sorted(((bound(q, n), n) for n in below_c), reverse=True):
                visit(q, child, most_here)

    def compare(q_rows: np.ndarray, c_rows: np.ndarray) -> None:
        c_rows = np.sort(c_rows)
        score = products(queries.x[q_rows], candidates.x[c_rows], query_ids[q_rows][:, None] == ids[c_rows][None, :])
        better = score.max(axis=1) >= best[q_rows, -1]
        q_rows, score = q_rows[better], score[better]
        if not len(q_rows):
            return
        # ~x turns the order of 64-bit integers round; a stable sort keeps candidates of equal score in the order of their ids.
        top = np.argsort(~score, axis=1, kind="stable")[:, :k]
        all_scores = np.concatenate([best[q_rows], np.take_along_axis(score, top, axis=1)], axis=1)
        all_ids = np.concatenate([best_ids[q_rows], ids[c_rows][top]], axis=1)
        order = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]
        best[q_rows], best_ids[q_rows] = np.take_along_axis(all_scores, order, axis=1), np.take_along_axis(all_ids, order, axis=1)

    if len(ids) and len(query_ids):
        visit(0, 0, bound(0, 0))
    return best, best_ids


def _index(ids: np.ndarray, x: np.ndarray) -> tuple:
    return ids, CoverTree(x)


def _index_queries(ids: np.ndarray, x: np.ndarray, least: np.ndarray) -> tuple:
    return ids, CoverTree(x), least


def _within(block: tuple, group: tuple, *, k: int) -> dict:
    best, found = dual_search(block[1], block[0], group[1], group[0], k, group[2])
    q, j = np.nonzero(best > _NONE)
    return {"query_id": group[0][q], "vec_id": found[q, j], "score": best[q, j]}


def _sample_kth(ids: np.ndarray, x: np.ndarray, *, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """The kth best score of each query over the sample: no final kth score is lower."""
    if len(sample_ids) <= k:
        return np.full(len(ids), -np.inf)
    score = x @ sample.T
    score[ids[:, None] == sample_ids[None, :]] = -np.inf
    size = np.sqrt((x**2).sum(axis=1)) * np.sqrt((sample**2).sum(axis=1)).max()
    return np.partition(score, -k, axis=1)[:, -k] - _SLACK * (size + 1)


def top_inner_products(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by ``every``, over floor(256 * component)."""
    scratch = Scratch(vectors.sparkSession, "exact")
    clean = scratch.keep(V.clean_vectors(vectors, scaled=True), "clean")

    def one_width(some: DataFrame, name: str) -> DataFrame:
        ids, sample = V.bounded_sample(some)
        pivots = sample[V.farthest_first(sample, V.PIVOTS)] if len(sample) else sample
        bound = partial(_sample_kth, sample_ids=ids, sample=sample, k=k)

        def worthwhile(cells: DataFrame, asked: DataFrame) -> DataFrame:
            groups = asked.groupBy("q_cell", "q_group").agg(F.max("far").alias("r_q"), F.min("bound").alias("kth"))
            radii = cells.groupBy("cell").agg(F.max("far").alias("r_c"))  # one row a pivot
            norms = np.linalg.norm(pivots, axis=1)
            centres = [(i, j, float(pivots[i] @ pivots[j]), float(norms[i]), float(norms[j])) for i in range(len(pivots)) for j in range(len(pivots))]
            table = cells.sparkSession.createDataFrame(centres or [(-1, -1, 0.0, 0.0, 0.0)], "q_cell int, cell int, dot double, n_q double, n_c double")
            most = F.col("dot") + F.col("r_q") * F.col("n_c") + F.col("r_c") * F.col("n_q") + F.col("r_q") * F.col("r_c")
            slack = F.lit(_SLACK) * (F.abs(most) + F.col("n_q") * F.col("n_c")) + 1
            return groups.join(F.broadcast(table), "q_cell").join(F.broadcast(radii), "cell").where(most + slack >= F.col("kth"))

        return V.search(some, pivots, every, k, scratch, name, _index, _index_queries, bound, partial(_within, k=k), "long", ascending=False, worthwhile=worthwhile)

    found = V.by_width(clean, one_width)
    fits = F.when(F.col("score") > _BELOW, F.col("score")).otherwise(F.raise_error(F.lit("an inner product fits no long")).cast("long"))
    return found.withColumn("score", fits)


def op3_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50, k=5)


#: Doubles are exact while the products stay under 2**53, as all of these do.
OP3_SQL = r"""
WITH clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
one AS (SELECT vec_id, min(v) v FROM clean GROUP BY vec_id),
scored AS (
  SELECT q.vec_id query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) score
  FROM one q JOIN one c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""
