import random

import pytest

from tessera.llm import neardup


def brute(rows, width, percent=80):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, share):
    return " ".join(rng.choice(["qq", "zz", "vv", str(rng.random())]) if rng.random() < share else w for w in words)


@pytest.mark.parametrize("width", [4, 5])
def test_groups_match_brute_force(make_docs, width):
    rng = random.Random(width)
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice("abcdefghij") + str(rng.randrange(60)) for _ in range(rng.randrange(20, 150))]
        for share in (0, 0, 0.01, 0.02, 0.03, 0.05, 0.08, 0.15):
            rows.append((n, edited(rng, base, share)))
            n += 1
    rows += [(900, "Tiny"), (901, "tiny"), (902, "tiny two"), (903, None), (904, " ")]
    got = neardup.near_duplicates(make_docs(rows), shingle=width).collect()
    want = brute(rows, width)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_a_large_group_of_distant_copies(make_docs):
    """Every copy shares buckets with many others, few are linked; chunks are compared without forming pairs."""
    rng = random.Random(5)
    base = [f"b{k}" for k in range(150)]
    rows = [(i, edited(rng, base, rng.choice([0.005, 0.02, 0.04, 0.06]))) for i in range(160)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(make_docs(rows), shingle=4).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 4).items()}


def test_small_chunks_lose_no_link(make_docs, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 900)
    rng = random.Random(6)
    base = [f"b{k}" for k in range(120)]
    rows = [(i, edited(rng, base, rng.choice([0.005, 0.02, 0.04, 0.06]))) for i in range(120)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(make_docs(rows), shingle=4).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 4).items()}


def test_a_repeated_doc_id_with_other_texts(make_docs):
    """Rows link as their texts do; a component is named by the smallest doc_id in it."""
    x, y = ([f"{c}{k}" for k in range(60)] for c in "xy")
    rows = [(2, " ".join(x)), (2, " ".join(y)), (3, " ".join(y + ["end"])), (4, " ".join(x + ["end"])), (5, " ".join(f"z{k}" for k in range(60))), (3, " ".join(y + ["end"])), (6, "alone"), (2, "alone")]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(make_docs(rows), shingle=4).collect()]
    assert sorted(got) == sorted([(2, 57, 2), (2, 57, 2), (3, 58, 2), (3, 58, 2), (4, 58, 2), (5, 57, 5), (6, 1, 2), (2, 1, 2)])
    kept = neardup.deduplicated(make_docs([*rows, (2, "alone")]), shingle=4)
    assert sorted((r["doc_id"], len(r["text"].split())) for r in kept.collect()) == [(2, 1), (2, 60), (2, 60), (5, 60)]


def test_chain_of_links_is_one_component(make_docs, spark):
    from tessera.llm.common import Scratch

    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 105)], "a long, b long")
    got = {r["node"]: r["component"] for r in neardup.components(links, Scratch(spark, "t"), "c").collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 105: 100}


def test_odd_documents(odd_docs, make_docs):
    got = neardup.near_duplicates(odd_docs).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 13 and by[7]["component_id"] == 6 and not by[7]["kept"]
    assert by[1]["n_shingles"] == 0 and by[1]["kept"] and by[None]["component_id"] is None and by[None]["kept"]
    assert neardup.near_duplicates(make_docs([])).collect() == []
    kept = neardup.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6, 8, 9, 10, 11]
