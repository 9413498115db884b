import hashlib
import random

import numpy as np
import pytest

from tessera.llm import substrings


def brute(rows, window):
    """Words covered by a window that starts in a document of smaller id."""
    first, docs = {}, sorted(((i, (t or "").encode().split()) for i, t in rows), key=lambda r: r[0])
    for i, w in docs:
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, w in docs:
        covered = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                covered[k : k + window] = [True] * window
        kept = [x for x, c in zip(w, covered) if not c]
        out[i] = (len(w), sum(covered), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"{rng.choice('abcdef')}{rng.randrange(40)}"
    passages = [[word() for _ in range(rng.choice([49, 50, 51, 80, 130]))] for _ in range(6)]
    rows = []
    for i in range(70):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += [word() for _ in range(rng.randrange(0, 60))]
            p = rng.choice(passages)
            cut = rng.randrange(0, 12)
            parts += p[cut:] if rng.random() < 0.5 else p
        rows.append((i, "  ".join(parts[:20]) + "\n" + " ".join(parts[20:])))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, " ".join(["same"] * 200)), (203, " ".join(["same"] * 120)), (204, "short"), (205, None), (206, rows[3][1].upper())]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_removed_words_match_brute_force(make_docs, seed):
    rows = corpus(seed)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.duplicate_spans(make_docs(rows)).collect()}
    assert got == brute(rows, 50)


def test_spans_name_the_removed_words(make_docs):
    rows = corpus(4)
    for r in substrings.duplicate_spans(make_docs(rows)).collect():
        spans = [tuple(map(int, s.split(":"))) for s in r["spans"].split(",") if s]
        assert sum(b - a for a, b in spans) == r["n_removed"] and all(b - a >= 50 for a, b in spans)


def test_every_window_chooses_a_block_inside_it():
    blocks = np.random.default_rng(0).integers(0, 2**63, 400).astype(np.uint64)
    span = 50 - 12 + 1
    assert (substrings.window_anchors(blocks) == np.lib.stride_tricks.sliding_window_view(blocks, span).min(axis=1)).all()
    assert len(substrings.window_anchors(blocks[:38])) == 0


def test_factors_are_greedy_and_boundaries_are_checked():
    a, b = [b"a%d" % i for i in range(60)], [b"b%d" % i for i in range(60)]
    text = [b"x", *a[:40], *b[:30], b"y", *b[5:60], b"z"]
    factors, places = substrings.factorise(text, [a, b, a[30:40] + b[:50]], 50, 4)
    assert factors == [(1, 40, 0, 0), (41, 30, 1, 0), (72, 55, 1, 5)]  # of equal lengths the first
    assert list(places) == list(range(72, 78))
    factors, places = substrings.factorise(text, [a, b, a[:40] + b[:30]], 50, 4)
    assert factors == [(1, 70, 2, 0), (72, 55, 1, 5)] and list(places) == [*range(1, 22), *range(72, 78)]
    # No factor reaches 50 words, the window across two of them is in another block all the same.
    one, two, three = a[:45], a[30:60] + b[:45], [*a[:44], b"q"]
    factors, places = substrings.factorise([*a[:45], *a[45:60], *b[:10]], [one, two, three], 50, 4)
    assert factors == [(0, 45, 0, 0), (45, 25, 1, 15)] and list(places) == []
    factors, places = substrings.factorise([*a, *b[:10]], [one, [*a[20:60], *b[:30]]], 50, 4)
    assert factors == [(0, 45, 0, 0), (45, 25, 1, 25)] and list(places) == [20]
    assert substrings.covered(np.array([0, 1, 2, 60, 200]), 50) == [(0, 52), (60, 110), (200, 250)]
    assert substrings.covered(np.array([0, 50]), 50) == [(0, 100)]


def test_factors_name_their_words(make_docs):
    rows = corpus(5)
    words = {i: (t or "").split() for i, t in rows}
    n = 0
    for r in substrings.duplicate_spans(make_docs(rows), block=64).collect():
        for f in filter(None, r["factors"].split(",")):
            start, length, ref, offset = map(int, f.split(":"))
            assert ref < r["doc_id"] and length >= 50 and words[r["doc_id"]][start : start + length] == words[ref][offset : offset + length]
            n += 1
    assert n > 50


def test_a_repeated_doc_id_with_other_texts(make_docs):
    """Every row is judged by its own words; copies count from the smallest doc_id that holds the text."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (2, a + " tail"), (2, b), (3, b + " x"), (2, b), (3, b)]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.duplicate_spans(make_docs(rows)).collect())
    assert got == [(1, 60, 0), (2, 60, 0), (2, 60, 0), (2, 61, 60), (3, 60, 60), (3, 61, 60)]


def test_odd_documents(odd_docs, make_docs):
    got = substrings.duplicate_spans(odd_docs).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 13 and by[7]["n_removed"] == 30_000 and by[6]["n_removed"] == 0
    assert by[7]["kept_sha256"] == by[1]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[9]["n_words"] == 2 and by[None]["n_removed"] == 0
    assert substrings.duplicate_spans(make_docs([])).collect() == []
