"""What the two vector searches share: clean vectors, pivots, cells, and the meeting of blocks and query groups.

Candidates are dealt to the cell of their nearest pivot and, inside a cell, by hash into blocks of bounded
size, so a vector that occurs very often fills many blocks rather than one. Every block is indexed once and
becomes one row. Queries are dealt likewise into bounded groups, each indexed to one row too. Every block meets
every query group that it can still improve; a task holds one row of each. It returns the best ``k`` of its block
for each query, and those are ranked once more.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: Candidates in a block and queries in a group, on average.
BLOCK, QUERY_GROUP = 8192, 4096
#: Pivots, and vectors that they are chosen from.
PIVOTS, PIVOT_SAMPLE = 32, 2048


def clean_vectors(vectors: DataFrame, scaled: bool = False, drop_zero: bool = False) -> DataFrame:
    """vec_id, v (array<double>) of the vectors without null or non-finite components.

    ``scaled`` turns every component x into floor(256 * x), which is exact in doubles: multiplying by 256 moves
    the exponent only, and from 2**52 on every double is whole.
    """
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    sound = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(sound, F.lit(False)))
    if drop_zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    if scaled:
        whole = F.lit(float(1 << 52))
        rows = rows.select("vec_id", F.transform("v", lambda x: F.when(F.abs(x * 256) >= whole, x * 256).otherwise(F.floor(x * 256).cast("double"))).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))  # a repeated vec_id counts once


def matrix(column: pd.Series) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    return np.array([np.asarray(x, dtype=np.float64) for x in column], dtype=np.float64).reshape(len(column), len(column.iloc[0]))


def bounded_sample(vectors: DataFrame, sample: int = PIVOT_SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows whose hashed vec_id is smallest."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas().sort_values("vec_id")
    return rows["vec_id"].to_numpy(np.int64), matrix(rows["v"])


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """Positions of up to ``n`` rows, each farthest from those chosen before."""
    chosen, near = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def dealt(vectors: DataFrame, pivots: np.ndarray, bound: Callable | None = None) -> DataFrame:
    """vec_id, v, the cell of the nearest pivot, the distance from it, and ``bound`` (ids and vectors to a number each)."""

    def near(batches):
        squares = (pivots**2).sum(axis=1)
        for batch in batches:
            if len(batch):
                ids, x = batch["vec_id"].to_numpy(np.int64), matrix(batch["v"])
                cell = (squares[None, :] - 2 * x @ pivots.T).argmin(axis=1)
                far = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
                out = pd.DataFrame({"vec_id": ids, "v": batch["v"].to_numpy(), "cell": cell.astype("int32"), "far": far})
                yield out.assign(bound=bound(ids, x)) if bound else out

    return vectors.mapInPandas(near, "vec_id long, v array<double>, cell int, far double" + (", bound double" if bound else ""))


def _indexed(rows: pd.DataFrame, *, keys: list[str], build: Callable) -> pd.DataFrame:
    rows = rows.sort_values("vec_id")
    more = (rows["bound"].to_numpy(np.float64),) if "bound" in rows else ()
    made = build(rows["vec_id"].to_numpy(np.int64), matrix(rows["v"]), *more)
    return rows[keys].iloc[:1].assign(made=[pickle.dumps(made, protocol=5)])


def _meet(left: pd.DataFrame, right: pd.DataFrame, *, within: Callable, score: type) -> pd.DataFrame:
    none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, score)})
    parts = [pd.DataFrame(within(pickle.loads(a), pickle.loads(b)), columns=none.columns) for a in left["made"] for b in right["made"]]
    return pd.concat(parts) if parts else none


def search(
    clean: DataFrame, pivots: np.ndarray, every: int, k: int, scratch: Scratch, name: str,
    index: Callable, index_queries: Callable, bound: Callable, within: Callable, score_type: str, ascending: bool, worthwhile: Callable | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: the best ``k`` of every query, ties to the smaller vec_id.

    Queries are the rows of ``clean`` whose vec_id is divisible by ``every``. They are dealt to as many of the
    first pivots as give groups of about QUERY_GROUP, so that candidates are sent no oftener than needed.
    ``index`` (ids, vectors) and ``index_queries`` (ids, vectors, bounds) make what a block and a query group are
    sent as, ``within`` takes one of each and returns query ids, vec ids and scores. ``bound`` gives each query a
    limit that its kth score is sure to reach. ``worthwhile`` turns (cells, query groups) into the pairs of
    both that may matter.
    """
    spark = clean.sparkSession
    cells = scratch.keep(dealt(clean, pivots), f"{name}_cells")
    n = {r["cell"]: r["count"] for r in cells.groupBy("cell").count().collect()}  # one row a pivot
    blocks = spark.createDataFrame([(c, -(-m // BLOCK)) for c, m in n.items()] or [(0, 1)], "cell int, n_blocks long")
    queries = clean.where(F.col("vec_id") % every == 0)
    q_pivots = pivots[: max(1, -(-queries.count() // QUERY_GROUP))]
    asked = dealt(queries, q_pivots, bound).withColumnRenamed("cell", "q_cell")
    q_blocks = asked.groupBy("q_cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_GROUP).alias("n_groups"))
    deal = lambda width: F.pmod(F.xxhash64("vec_id"), F.col(width)).cast("int")
    asked = asked.join(F.broadcast(q_blocks), "q_cell").withColumn("q_group", deal("n_groups"))
    asked = scratch.keep(asked.select("q_cell", "q_group", "vec_id", "v", "far", "bound"), f"{name}_asked")
    placed = cells.join(F.broadcast(blocks), "cell").withColumn("block", deal("n_blocks"))
    made = placed.select("cell", "block", "vec_id", "v").groupBy("cell", "block").applyInPandas(partial(_indexed, keys=["cell", "block"], build=index), "cell int, block int, made binary")
    made = scratch.keep(made, f"{name}_index")
    groups = asked.drop("far").groupBy("q_cell", "q_group").applyInPandas(partial(_indexed, keys=["q_cell", "q_group"], build=index_queries), "q_cell int, q_group int, made binary")
    groups = scratch.keep(groups, f"{name}_queries")

    every_cell = F.explode(F.array(*[F.lit(c) for c in sorted(n)] or [F.lit(0)]))
    pairs = worthwhile(cells, asked) if worthwhile else groups.select("q_cell", "q_group").withColumn("cell", every_cell)
    pairs = scratch.keep(pairs.select("cell", "q_cell", "q_group").join(made.select("cell", "block"), "cell"), f"{name}_pairs")
    keys = ["cell", "block", "q_cell", "q_group"]
    left = pairs.join(made, ["cell", "block"]).groupBy(*keys)
    right = pairs.join(groups, ["q_cell", "q_group"]).select(*[F.col(c).alias(c) for c in (*keys, "made")]).groupBy(*keys)
    meet = partial(_meet, within=within, score=np.int64 if score_type == "long" else np.float64)
    best = left.cogroup(right).applyInPandas(meet, f"query_id long, vec_id long, score {score_type}")
    order = F.col("score").asc() if ascending else F.col("score").desc()
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def by_width(clean: DataFrame, one: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``one`` over the vectors of each width in turn (vectors of different widths have no score); usually there is one width."""
    width: Column = F.size("v")
    widths = sorted(r[0] for r in clean.select(width).distinct().collect())
    if len(widths) == 1:
        return one(clean, "w")
    out = None
    for w in widths:
        found = one(clean.where(width == w), f"w{w}")
        out = found if out is None else out.unionByName(found)
    return one(clean, "w") if out is None else out
