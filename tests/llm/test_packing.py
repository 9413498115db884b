import os
import zlib
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing

SF01 = os.path.join(os.environ.get("TEST_DATA", "/root/testdata"), "sf0.01")


@cache
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    t = reference()
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")


@pytest.mark.parametrize("text", ["", "Hello  world\n\n done", "<|endoftext|> x", "naïve 漢字😀", " lead", "a b " * 50])
def test_ids_match_the_tokenizer_file(text):
    assert list(packing.token_ids(text)) == list(ids_of(text))


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_200_000, "a" * 400_000, "x y " * 300_000 + "\t" * 5000 + " z", "<|endoftext|>" + " " * 200_000 + "q", " \u2003" * 3000])
def test_ids_of_very_long_runs(text):
    assert np.array_equal(np.array(packing.token_ids(text)), ids_of(text))


def test_ids_of_all_documents(spark):
    for r in spark.read.parquet(SF01 + "/documents.parquet").select("text").toLocalIterator():
        assert np.array_equal(np.array(packing.token_ids(r["text"] or "")), ids_of(r["text"]))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.array_equal(np.array(packing.token_ids(text)), ids_of(text))


def test_slices_change_no_id(monkeypatch):
    text = "The quick brown  fox, 12 jumps.\n" * 40
    whole = list(packing.token_ids(text))
    monkeypatch.setattr(packing, "SLICE", 37)
    assert list(packing.token_ids(text)) == whole
    assert len(list(packing._slices(text))) > 10


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=12))
def test_patterns_hold_every_length_once(histogram):
    patterns = packing.packing_patterns(histogram, 64)
    held = {}
    for packs, pattern in patterns:
        assert packs > 0 and sum(k * v for k, v in pattern.items()) <= 64
        for k, v in pattern.items():
            held[k] = held.get(k, 0) + packs * v
    assert held == histogram


def check(rows, docs):
    texts = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect()))
    want = {}
    for missing, doc, text in texts:
        want.setdefault(None if missing else doc, []).append(ids_of(text))
    for doc, lists in want.items():
        mine = [r for r in rows if r["doc_id"] == doc]
        assert sum(r["length"] for r in mine) == sum(map(len, lists))
        if len(lists) == 1:
            ids = lists[0]
            for r in mine:
                piece = ids[r["start"] : r["start"] + r["length"]]
                assert zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
            assert sorted((r["start"], r["length"]) for r in mine)[0][0] == 0
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_odd_documents(odd_docs):
    check(packing.pack(odd_docs).collect(), odd_docs)


def test_one_hot_length_is_numbered_over_groups(make_docs, monkeypatch):
    monkeypatch.setattr(packing, "RANK_GROUP", 10)
    docs = make_docs([(i, "same text here") for i in range(300)] + [(1000 + i, "word " * i) for i in range(1, 40)])
    rows = packing.pack(docs).collect()
    check(rows, docs)
    assert len(rows) == 339


def test_empty_table(make_docs):
    assert packing.pack(make_docs([])).collect() == []
