import pytest

from tessera.llm import mixing


def filled(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    """Targets by resharing the excess until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > cap * sizes[s]}
        if not over:
            target.update({s: left * weight[s] / total for s in open_})
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def rows_of(n, sources=("b", "a", "Z", "ä", None)):
    return [(i, "w " * (1 + i * 7 % 53), sources[i * i % len(sources)]) for i in range(n)]


def test_targets_and_words_taken(make_docs):
    rows = rows_of(600)
    got = mixing.mix(make_docs(rows)).collect()
    source = {i: s for i, _, s in rows}
    sizes = {}
    for i, text, s in rows:
        sizes[s] = sizes.get(s, 0) + len(text.split())
    want = filled(sizes)
    taken = {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] = taken.get(s, 0) + r["taken"]
    assert len(got) == 600
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 53


def test_reruns_agree_and_groups_form_a_tree(make_docs, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 20)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    docs = make_docs([(i, "w " * (1 + i % 9), "hot" if i % 3 else "cold") for i in range(400)])
    one = sorted(map(tuple, mixing.mix(docs).collect()))
    assert one == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    for s in (0, 1):
        mine = [r for r in one if (r[0] % 3 > 0) == bool(s)]
        assert abs(sum(r[4] for r in mine) - mine[0][3]) <= 9


def test_rounding_keeps_expectations():
    import numpy as np
    import pandas as pd

    base = pd.DataFrame({"doc_id": range(12), "source": "s", "size": [5, 1, 9, 3, 3, 8, 2, 2, 7, 4, 6, 1], "copies": 0, "fraction": 0.3, "part": 0})
    mean = np.zeros(12)
    for seed in range(800):
        done = mixing.round_group(base.copy(), seed=seed).sort_values("doc_id")
        whole = (done["copies"] + done["fraction"]) * done["size"]
        assert whole.sum() == pytest.approx((base["size"] * 0.3).sum())
        assert (done["fraction"] > 0).sum() <= 1
        mean += (done["copies"] + done["fraction"]).to_numpy()
    assert np.abs(mean / 800 - 0.3).max() < 0.07


def test_odd_documents_and_empty_table(odd_docs, make_docs):
    got = mixing.mix(odd_docs).collect()
    assert len(got) == 13 and all(r["taken"] == r["size"] * r["copies"] for r in got)
    assert mixing.mix(make_docs([])).collect() == []
    assert mixing.mix(make_docs([(1, None), (2, " ")])).select("taken").distinct().collect()[0][0] == 0


def test_repeated_documents(make_docs):
    docs = make_docs(rows_of(100))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    out = mixing.repeat_documents(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == {k: v for k, v in copies.items() if v}
