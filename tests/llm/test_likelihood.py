import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tessera.llm import likelihood as L
from tessera.llm.common import Scratch


def test_windows_stay_inside_texts():
    around = L.windows(np.array([10, 11, 12, 20]), np.array([3, 0, 1]))
    pad = L.CLASSES
    assert around.tolist() == [[pad, pad, 11, 12], [pad, 10, 12, pad], [10, 11, pad, pad], [pad, pad, pad, pad]]


def test_probabilities_sum_to_one_and_ignore_the_token_itself():
    network = L.WindowNetwork()
    around = np.array([[1, 2, 3, 4]] * L.CLASSES)
    assert np.exp(network.log_probabilities(around, np.arange(L.CLASSES))).sum() == pytest.approx(1, abs=1e-4)


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    around, token = rng.integers(0, L.CLASSES + 1, (64, 4)), rng.integers(0, L.CLASSES, 64)
    loss = lambda n: -n.log_probabilities(around, token).mean()
    for name, place in (("inner", (3, 2)), ("group", (1, 4)), ("member", (5, 3)), ("inner_bias", (7,)), ("group_bias", (2,))):
        base, moved, trained = L.WindowNetwork(), L.WindowNetwork(), L.WindowNetwork()
        getattr(moved, name)[place] += 0.05
        low = L.WindowNetwork()
        getattr(low, name)[place] -= 0.05
        trained.train(around, token, 1.0)
        step = getattr(base, name)[place] - getattr(trained, name)[place]
        assert step == pytest.approx((loss(moved) - loss(low)) / 0.1, abs=2e-4)


def corpus(n):
    rng = np.random.default_rng(2)
    cycle = [f"word{k}" for k in range(12)]
    return [(i, " ".join(cycle[(s + k) % 12] for k in range(60))) for i, s in enumerate(rng.integers(0, 12, n))]


def test_training_learns_order_and_shuffled_texts_score_lower(make_docs):
    rows = corpus(3000)
    rng = np.random.default_rng(3)
    shuffled = [(1000 + i, " ".join(rng.permutation(t.split()))) for i, t in rows[:30]]
    got = {r["doc_id"]: r["per_token"] for r in L.pseudo_likelihood(make_docs(rows + shuffled)).collect()}
    assert np.mean([got[i] for i, _ in rows]) > np.mean([got[1000 + i] for i in range(30)]) + 0.8
    assert np.mean([got[i] for i, _ in rows]) > -1.0  # far above an even guess, -ln 12


def fitted(docs):
    texts = docs.selectExpr("doc_id", "coalesce(text, '') text")
    return L.fit(texts, Scratch(docs.sparkSession, "t"), L.bucket_counts(L.word_counts(texts.select("text"))))


def brute(rows, table, flat):
    """Scores token by token, from the parameters and the texts alone."""
    bucket = lambda w: int(pd.util.hash_array(np.array([w], dtype=object), categorize=False)[0]) >> 48
    at, shape = {}, 0
    for name, dims in L.WindowNetwork.SHAPES.items():
        at[name] = np.asarray(flat[shape : shape + math.prod(dims)], dtype=float).reshape(dims)
        shape += math.prod(dims)
    texts = {i: t.encode().lower().split() for i, t in rows}
    count, size = Counter(w for t in texts.values() for w in t), Counter()
    for w, n in count.items():
        size[int(table[bucket(w)])] += n
    softmax = lambda z: np.exp(z) / np.exp(z).sum()
    out = {}
    for i, t in texts.items():
        cls, total = [int(table[bucket(w)]) for w in t], 0.0
        for k, c in enumerate(cls):
            sides = [cls[j] if 0 <= j < len(t) else L.CLASSES for j in (k - 2, k - 1, k + 1, k + 2)]
            h = np.tanh(np.concatenate([at["embed"][x] for x in sides]) @ at["inner"] + at["inner_bias"])
            g, m = divmod(c, L.GROUPS)
            total += math.log(softmax(h @ at["group"] + at["group_bias"])[g]) + math.log(softmax(h @ at["member"] + at["member_bias"][g])[m]) + math.log(count[t[k]] / size[c])
        out[i] = total
    return out


def test_scores_equal_a_plain_sum_over_tokens(make_docs):
    rows = corpus(40) + [(500 + i, f"rare{i} word1 Rare{i % 3} word2") for i in range(30)] + [(600, "alone"), (601, "")]
    docs = make_docs(rows)
    want = brute(rows, *fitted(docs))
    got = {r["doc_id"]: r["pseudo_log_likelihood"] for r in L.pseudo_likelihood(docs).collect()}
    assert got == {i: pytest.approx(x, rel=1e-4, abs=1e-4) for i, x in want.items()}


def test_scores_do_not_depend_on_partitions(make_docs, monkeypatch):
    monkeypatch.setattr(L, "SHARD_TOKENS", 1500)
    monkeypatch.setattr(L, "FAN_IN", 2)
    rows = corpus(120)
    one, other = ({r["doc_id"]: r["pseudo_log_likelihood"] for r in L.pseudo_likelihood(make_docs(rows, parts)).collect()} for parts in (1, 7))
    assert one == other


def test_odd_documents_and_empty_table(odd_docs, make_docs):
    got = L.pseudo_likelihood(odd_docs).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 13 and by[1]["pseudo_log_likelihood"] == 0 and by[1]["n_tokens"] == 0 and by[6]["n_tokens"] == 30_000
    assert all(np.isfinite(r["pseudo_log_likelihood"]) and r["pseudo_log_likelihood"] <= 0 for r in got)
    assert L.pseudo_likelihood(make_docs([])).collect() == []


def test_words_of_one_shared_class_are_told_apart(make_docs):
    """Exact counts: a word's share of its class is in the score, so that a junk word scores below a frequent one in its place."""
    rows = corpus(300) + [(20000 + i, f"own{i % 2300} own{i % 2299} filler") for i in range(9200)]
    table, _ = fitted(make_docs(rows))
    bucket = lambda w: L.hashed_words([w])[0][0]
    shared = lambda w: table[bucket(w)] >= L.CLASSES - L.SHARED
    content = next(w for w in (f"content{i}" for i in range(1000)) if shared(w))
    junk = [w for w in (f"junk{i}" for i in range(4000)) if bucket(w) != bucket(content) and shared(w) and table[bucket(w)] == table[bucket(content)]][:1]
    assert junk
    # Two equal texts with the exchanged word, and one more text that makes the content word frequent.
    rows += [(9000, f"word1 word2 {content} word3"), (9001, f"word1 word2 {junk[0]} word3"), (9002, " ".join(["word5", content, "word7"] * 2))]
    got = {r["doc_id"]: r["pseudo_log_likelihood"] for r in L.pseudo_likelihood(make_docs(rows)).collect()}
    assert got[9000] - got[9001] == pytest.approx(np.log(3), abs=1e-4)


def test_rare_words_are_scored_like_common_ones(make_docs, monkeypatch):
    rows = corpus(60) + [(500 + i, f"rare{i} word1 rare{i // 2} rare{i} word2") for i in range(40)] + [(500, "rare0 word1 rare0 rare0 word2")]
    scores = lambda: sorted((r["doc_id"], r["n_tokens"], round(r["pseudo_log_likelihood"], 3)) for r in L.pseudo_likelihood(make_docs(rows)).collect())
    want = scores()
    monkeypatch.setattr(L, "COMMON", 1)  # nothing is common: every word is joined
    got = scores()
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-3)


def test_words_are_those_between_ascii_white_space_and_hashed_once_a_batch(monkeypatch):
    texts = ["", " \x0b\x0c ", "a\tB\x1cc\x85 d　e \n", " \x00 x\x7f  X ", "É é É", "x" * 100 + " " * 100, "\udcff z", "A b a b A"]
    hashed, real = [], pd.util.hash_array
    monkeypatch.setattr(pd.util, "hash_array", lambda words, **more: hashed.extend(words) or real(words, **more))
    got, counts = L.word_hashes(texts)
    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    flat = np.array([w for ws in words for w in ws], dtype=object)
    assert got.tolist() == real(flat, categorize=False).view(np.int64).tolist()
    assert sorted(hashed) == sorted(set(flat))
    assert [len(x) for x in L.word_hashes(["", " "])] == [0, 2] and [len(x) for x in L.word_hashes([])] == [0, 0]


def test_rare_words_stay_with_their_rows():
    texts = [" ".join(f"w{(i * 7 + k) % 90}" for k in range(i % 13)) + " the" * (i % 3) for i in range(600)]
    code = lambda w: int(L.word_hashes([w])[0][0])
    common = {"word": np.array([code("the")]), "log_n": np.array([1.5]), "log_class": np.zeros(L.CLASSES)}
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([None, *range(1, 600)], pa.int32()), "text": texts, "row": range(600)})
    parts = list(L._score(iter([batch.slice(0, 300), batch.slice(300)]), table=np.zeros(L.BUCKETS, np.int16), flat=L.WindowNetwork().flat, common=common))
    got = [r for part in parts for r in part.to_pylist()]
    assert [(r["row"], r["doc_id"], r["n_tokens"]) for r in got] == [(i, i or None, len(t.split())) for i, t in enumerate(texts)]
    assert [dict(zip(r["rare"], r["rare_n"])) for r in got] == [{code(w): n for w, n in Counter(t.split()).items() if w != "the"} for t in texts]
