import math
import os
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import exact_search, near_search
from tessera.llm import vectors as V

SF1 = os.path.join(os.environ.get("TEST_DATA", "/root/testdata"), "sf0.1")


@pytest.fixture(scope="module")
def make_vectors(spark):
    def make(rows):
        return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, cell int, rank int, score double")

    return make


def exact(ids, x, every, k):
    x = np.floor(256 * x.astype(np.float64))
    out = {}
    for q in ids[ids % every == 0]:
        s = x @ x[ids == q][0]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), int(s[j])) for j in order]
    return out


def near(ids, x, every, k):
    x, out = x.astype(np.float64), {}
    for q in ids[ids % every == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        out[int(q)] = [(int(ids[j]), d[j]) for j in np.lexsort((ids, d)) if ids[j] != q][:k]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def clustered(n, width=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (6, width))
    x = (centres[rng.integers(0, 6, n)] + rng.normal(0, 0.2, (n, width))).astype(np.float32)
    x[n // 2 : n // 2 + n // 4] = x[0]  # one very common vector: ties everywhere
    return np.arange(n) * 3, x


def test_exact_search_equals_brute_force(make_vectors, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 100)
    monkeypatch.setattr(V, "QUERY_GROUP", 8)
    ids, x = clustered(900)
    got = by_query(exact_search.top_inner_products(make_vectors(zip(ids.tolist(), x.tolist())), 50, 5).collect())
    assert got == exact(ids, x, 50, 5)


def test_cover_tree_invariants_and_pruning():
    rng = np.random.default_rng(3)
    x = np.floor(256 * np.concatenate([rng.normal(c, 0.1, (400, 4)) for c in (-20, 0, 20)]))
    tree = exact_search.CoverTree(x)
    gap = lambda a, b: np.sqrt(((x[a] - x[b]) ** 2).sum(axis=-1))
    assert sum(map(bool, tree.children)) > 3
    for node, kids in enumerate(tree.children):
        inside = gap(tree.rows[node], tree.centres[node])
        assert inside.max() <= tree.radii[node] and (not kids or inside.max() <= 2.0 ** tree.levels[node])
        if kids:
            heads, apart = [tree.centres[c] for c in kids], 2.0 ** (tree.levels[node] - 1)
            assert heads[0] == tree.centres[node]  # nesting
            assert all(gap(a, b) > apart for i, a in enumerate(heads) for b in heads[:i])  # separation
            assert all(gap(tree.rows[c], tree.centres[c]).max() <= apart for c in kids)  # covering
            assert sorted(np.concatenate([tree.rows[c] for c in kids])) == sorted(tree.rows[node])
    queries, seen, original = exact_search.CoverTree(x[:50]), [], exact_search.products
    exact_search.products = lambda a, b, same: (seen.append(same.size), original(a, b, same))[1]
    try:
        best, found = exact_search.dual_search(tree, np.arange(len(x)), queries, np.arange(50), 3)
    finally:
        exact_search.products = original
    assert sum(seen) < 50 * len(x) / 2
    s = x[:50] @ x.T
    s[np.arange(50), np.arange(50)] = -np.inf
    assert (best == -np.sort(-s, axis=1)[:, :3]).all()


def whole_scores(rows, every, k):
    scaled = {i: [math.floor(256 * Fraction(float(np.float32(c)))) for c in v] for i, v in rows}
    out = {}
    for q in (i for i in scaled if i % every == 0):
        s = {i: sum(a * b for a, b in zip(scaled[q], v)) for i, v in scaled.items() if i != q and len(v) == len(scaled[q])}
        out[q] = sorted(((i, x) for i, x in s.items()), key=lambda r: (-r[1], r[0]))[:k]
    return {q: r for q, r in out.items() if r}


@pytest.mark.parametrize("size", [1.0, 3e5, 4e6, 6e6])
def test_large_scores_are_exact(make_vectors, size):
    rng = np.random.default_rng(int(size))
    rows = [(i, [float(np.float32(c * size)) for c in rng.uniform(-1, 1, 3)]) for i in range(120)]
    got = by_query(exact_search.top_inner_products(make_vectors(rows), 20, 5).collect())
    assert got == whole_scores(rows, 20, 5)


def test_scores_that_fit_no_long(make_vectors):
    huge = [(0, [1e20, 0.0]), (1, [1e20, 1.0]), (2, [1.0, 1.0])]
    with pytest.raises(Exception, match="fits no long"):
        exact_search.top_inner_products(make_vectors(huge), 50, 1).collect()
    # Far below: out of the best it does no harm, among them it raises.
    low = [(0, [1e20, 0.0]), (1, [-1e20, 1.0]), (2, [0.0, 1.0]), (3, [0.0, 2.0])]
    got = by_query(exact_search.top_inner_products(make_vectors(low), 50, 2).collect())
    assert got == {0: [(2, 0), (3, 0)]}
    with pytest.raises(Exception, match="fits no long"):
        exact_search.top_inner_products(make_vectors(low), 50, 3).collect()


def test_each_width_is_searched_by_itself(make_vectors):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 2 + i % 3).tolist()) for i in range(90)]
    assert by_query(exact_search.top_inner_products(make_vectors(rows), 10, 4).collect()) == whole_scores(rows, 10, 4)
    got = by_query(near_search.nearest(make_vectors(rows), 10, 3).collect())
    assert {q: len(r) for q, r in got.items()} == {q: 3 for q in range(0, 90, 10)}
    assert all(i % 3 == q % 3 for q, r in got.items() for i, _ in r)


def test_near_search_recall_and_distances(make_vectors, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 300)
    rng = np.random.default_rng(8)
    ids = np.arange(3000)
    x = rng.normal(0, 1, (3000, 32)).astype(np.float32)
    want = near(ids, x, 100, 10)
    got = by_query(near_search.nearest(make_vectors(zip(ids.tolist(), x.tolist())), 100, 10).collect())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert set(got) == set(want) and hits / (10 * len(want)) >= 0.9
    for q, found in got.items():
        for i, d in found:
            assert d == pytest.approx(np.sqrt(((x[i].astype(float) - x[q].astype(float)) ** 2).sum()), abs=1e-12)


def test_recall_on_the_embeddings_table(spark):
    rows = spark.read.parquet(SF1 + "/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, x = rows["vec_id"].to_numpy(), np.array(rows["embedding"].tolist())
    want, got = near(ids, x, 100, 10), by_query(near_search.op10_near_search(spark, SF1).collect())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9


def test_ties_and_repeats_in_near_search(make_vectors):
    ids, x = clustered(600, seed=4)
    got = by_query(near_search.nearest(make_vectors([*zip(ids.tolist(), x.tolist()), (0, x[0].tolist()), (3, x[1].tolist())]), 100, 10).collect())
    assert got[0] == [(i, 0.0) for i, _ in near(ids, x, 100, 10)[0]]


@pytest.mark.parametrize("search", [lambda v: exact_search.top_inner_products(v, 50, 5), lambda v: near_search.nearest(v, 50, 5)])
def test_odd_vectors(search, make_vectors):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 2]), (50, None), (100, [None, 1]), (150, [nan, 1]), (200, [inf, 1]), (None, [1, 1]), (7, [2, 1]), (8, [1, 2, 3]), (9, [3, 4])]
    got = by_query(search(make_vectors(rows)).collect())
    assert {q: sorted(i for i, _ in r) for q, r in got.items()} == {0: [7, 9]}
    assert search(make_vectors([])).collect() == []
    assert search(make_vectors([(0, [1.0, 1.0])])).collect() == []


def test_zero_vectors_take_no_part_in_near_search(make_vectors):
    got = near_search.nearest(make_vectors([(0, [1, 1]), (1, [0, 0]), (2, [1, 2]), (100, [0, 0])]), 50, 5).collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 2)]
