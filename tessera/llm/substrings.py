"""Substring deduplication by relative Lempel-Ziv parsing against indexed reference blocks.

Anchors route documents to references: in each stretch of ``WINDOW`` words the run of ``ANCHOR`` words with the
smallest hash. Equal stretches choose equal anchors, and about one run in twenty is chosen. Where an anchor is
shared by different documents, whole windows are hashed and counted; the first document (smallest doc_id)
with a repeated window is its reference. References are cut into blocks of ``BLOCK`` starts (and the words of
a last window), and only blocks that hold the first occurrence of a repeated window are indexed.

Each document is then parsed against all blocks that it shares a window with (no other block can hold a window
of it): at every place the longest match with any of those blocks, compared word by word, becomes a factor
(start, length, reference document, offset); a word where no match of ``ANCHOR`` words starts stands for itself.
Factors of at least ``WINDOW`` words are duplicate spans. A window that crosses the boundary of factors may
still be a repeat as a whole, so windows there are looked up in the same blocks and compared too. As blocks
come from smaller doc_ids only, all that is found is a duplicate, and every duplicate window is found.

Texts that are equal word by word are one class: all but the rows of its smallest doc_id are wholly covered (if they
have a window at all) and take no further part. Classes are numbered, so rows that repeat a doc_id with another
text are judged by their own words. Windows are judged on the input only, and a window twice in one document
is no repeat; the smallest doc_id wins, so there are no ties. Null texts have no words. Very long texts are parsed
whole. Rows with a null doc_id lose nothing. Extra columns are ignored; an empty table gives no rows.
Candidate windows are told apart by 96 bits of hash, words in the parse by themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, documents, whole_text

WINDOW, ANCHOR, BLOCK = 50, 12, 256
_U64 = np.uint64
_EMPTY = hashlib.sha256(b"").hexdigest()


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (splitmix64 finaliser)."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def run_hash(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``width`` words, from their hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, _U64)
    total = np.full(n, _U64(width + 1000 * seed))
    for k in range(width):
        total = total * _U64(0x9E3779B97F4A7C15) + words[k : k + n]
        total ^= total >> _U64(32)
    return _mix(total)


def window_anchors(runs: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> np.ndarray:
    """The anchor's hash for every window of a document: the smallest in it."""
    span = window - anchor + 1
    if len(runs) < span:
        return np.empty(0, _U64)
    # The minimum over a span, from minima over lengths that double.
    low, length = runs, 1
    while 2 * length <= span:
        low, length = np.minimum(low[: len(low) - length], low[length:]), 2 * length
    rest = span - length
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _split(batches: Iterator[pd.DataFrame], size: int = 256) -> Iterator[tuple[pd.DataFrame, list[list[bytes]], list[np.ndarray]]]:
    """Small parts of the batches with each text's words and their hashes."""
    for batch in batches:
        for start in range(0, len(batch), size):
            part = batch.iloc[start : start + size]
            words = [t.encode("utf-8", "surrogatepass").split() for t in part["text"]]
            flat = np.empty(sum(map(len, words)), dtype=object)
            flat[:] = [w for ws in words for w in ws]
            hashes = pd.util.hash_array(flat, categorize=False).astype(_U64)
            yield part, words, np.split(hashes, np.cumsum([len(w) for w in words])[:-1]) if words else []


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _keys(h: np.ndarray) -> tuple[int, int]:
    """Two hashes of a word sequence."""
    at = np.arange(1, len(h) + 1, dtype=_U64)
    one = int(_signed(_mix(h + at * _U64(0x9E3779B97F4A7C15)).sum(dtype=_U64, keepdims=True))[0])
    return one, int(_signed(np.bitwise_xor.reduce(_mix(h * _U64(0xC2B2AE3D27D4EB4F) ^ at), keepdims=True))[0]) if len(h) else 0


def anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """doc_id, n_words, text keys, the digest of all words joined, and the distinct anchors."""

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, words, hashes in _split(batches):
            rows = []
            for ws, h in zip(words, hashes):
                chosen = np.unique(window_anchors(run_hash(h, anchor), window, anchor))
                rows.append((len(ws), *_keys(h), hashlib.sha256(b" ".join(ws)).hexdigest(), _signed(chosen)))
            frame = pd.DataFrame(rows, columns=["n_words", "key_a", "key_b", "full_sha256", "anchors"])
            yield frame.assign(doc_id=part["doc_id"].astype("Int64").to_numpy())[["doc_id", "n_words", "key_a", "key_b", "full_sha256", "anchors"]]

    return docs.select("doc_id", whole_text().alias("text")).mapInPandas(choose, "doc_id long, n_words long, key_a long, key_b long, full_sha256 string, anchors array<long>")


def candidate_windows(marked: DataFrame, window: int, anchor: int) -> DataFrame:
    """cls, doc_id and, for windows whose anchor is shared, their 96-bit hash and position; rows with another text than the class's are left out."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, _, hashes in _split(batches):
            rows = []
            for cls, doc_id, key_a, key_b, h, shared in zip(part["cls"], part["doc_id"], part["key_a"], part["key_b"], hashes, part["shared"]):
                if _keys(h) != (key_a, key_b):
                    continue
                chosen = window_anchors(run_hash(h, anchor), window, anchor)
                at = np.flatnonzero(np.isin(chosen, np.asarray(shared, dtype=np.int64).view(_U64)))
                rows.append((cls, doc_id, at.astype(np.int32), _signed(run_hash(h, window)[at]), (_mix(chosen[at]) >> _U64(33)).astype(np.int32)))
            yield pd.DataFrame(rows, columns=["cls", "doc_id", "place", "first", "second"])

    return marked.mapInPandas(look, "cls long, doc_id long, place array<int>, first array<long>, second array<int>")


def cut_blocks(marked: DataFrame, window: int, block: int) -> DataFrame:
    """source, number, ref_doc, words: the blocks of each row's ``numbers``, words joined by a space."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, words, hashes in _split(batches):
            rows = []
            for cls, doc_id, key_a, key_b, ws, h, numbers in zip(part["cls"], part["doc_id"], part["key_a"], part["key_b"], words, hashes, part["numbers"]):
                if _keys(h) == (key_a, key_b):
                    rows += [(cls, k, doc_id, b" ".join(ws[k * block : (k + 1) * block + window - 1])) for k in numbers]
            yield pd.DataFrame(rows, columns=["source", "number", "ref_doc", "words"])

    return marked.mapInPandas(cut, "source long, number int, ref_doc long, words binary")


def factorise(words: list[bytes], blocks: list[list[bytes]], window: int = WINDOW, least: int = ANCHOR) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """The greedy parse of ``words`` relative to ``blocks``: factors (start, length, block, offset) of ``least`` words or more;
    and the starts of all windows that occur in a block."""
    ids: dict[bytes, int] = {}
    reference = np.concatenate([np.array([*(ids.setdefault(w, len(ids) + 2) for w in b), 0], dtype=np.int64) for b in blocks])  # 0 ends a block
    ends = np.cumsum([len(b) + 1 for b in blocks])
    text, n = np.array([ids.get(w, 1) for w in words], dtype=np.int64), len(words)

    def index(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the reference by hash, and each place of the text with its range among them."""
        there, here = run_hash(reference.view(_U64), width), run_hash(text.view(_U64), width)
        order = np.argsort(there, kind="stable")
        return order, here, np.searchsorted(there[order], here, "left"), np.searchsorted(there[order], here, "right")

    order, _, low, high = index(least)
    factors, inside = [], np.zeros(n + 1, dtype=bool)
    begins = np.flatnonzero(high > low)
    at = 0
    while (j := np.searchsorted(begins, at)) < len(begins):
        i = int(begins[j])
        best, where = 0, -1
        for p in order[low[i] : high[i]]:
            longest = min(n - i, len(reference) - p)
            if best < longest and (text[i : i + best + 1] == reference[p : p + best + 1]).all():
                apart = text[i : i + longest] != reference[p : p + longest]
                length = int(apart.argmax()) if apart.any() else longest
                if length > best:
                    best, where = length, int(p)
        if best < least:  # equal hashes of different words
            at = i + 1
            continue
        block = int(np.searchsorted(ends, where, "right"))
        factors.append((i, best, block, where - int(ends[block] - len(blocks[block]) - 1)))
        inside[i : max(i, i + best - window + 1)] = True
        at = i + best

    # Windows across boundaries: those in no factor whose first and last words match the blocks.
    places = np.arange(max(n - window + 1, 0))
    across = places[~inside[: len(places)] & (high > low)[places] & (high > low)[places + window - least]] if len(places) else places
    if len(across):
        order, _, low, high = index(window)
        for i in across:
            inside[i] = any((text[i : i + window] == reference[p : p + window]).all() for p in order[low[i] : high[i]])
    return factors, np.flatnonzero(inside)


def covered(places: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """Runs (start, end) of overlapping or touching windows."""
    if not len(places):
        return []
    cuts = np.flatnonzero(np.diff(places) > window)
    return [(int(a), int(b) + window) for a, b in zip(places[np.r_[0, cuts + 1]], places[np.r_[cuts, len(places) - 1]])]


def parsed(found: DataFrame, window: int, block: int, least: int) -> DataFrame:
    """cls, n_removed, kept_sha256, spans, factors from the class's text and its reference blocks."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, words, hashes in _split(batches, 64):
            rows = []
            for cls, key_a, key_b, ws, h, blocks in zip(part["cls"], part["key_a"], part["key_b"], words, hashes, part["blocks"]):
                if _keys(h) != (key_a, key_b):
                    continue
                blocks = sorted(blocks, key=lambda b: (b["ref_doc"], b["source"], b["number"]))
                factors, places = factorise(ws, [bytes(b["words"]).split() for b in blocks], window, least)
                spans, kept, at = covered(places, window), [], 0
                for start, end in spans:
                    kept += ws[at:start]
                    at = end
                kept += ws[at:]
                named = [f"{i}:{n}:{blocks[b]['ref_doc']}:{blocks[b]['number'] * block + o}" for i, n, b, o in factors if n >= window]
                rows.append((cls, len(ws) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), ",".join(f"{a}:{b}" for a, b in spans), ",".join(named)))
            yield pd.DataFrame(rows, columns=["cls", "n_removed", "kept_sha256", "spans", "factors"])

    return found.mapInPandas(cut, "cls long, n_removed long, kept_sha256 string, spans string, factors string")


def duplicate_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (start:end in words, comma-joined) and factors
    (start:length:doc_id:offset of those that are long enough) of every row. Wholly covered copies name no factors."""
    scratch = Scratch(docs.sparkSession, "substrings")
    index = scratch.keep(anchors(docs, window, anchor), "index")
    long_enough = index.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    classes = long_enough.groupBy("key_a", "key_b").agg(F.min(F.struct("doc_id", "anchors")).alias("m"), F.max("doc_id").alias("last"))
    # Written, so the numbers hold.
    classes = scratch.keep(classes.select("key_a", "key_b", "m.*", "last").withColumn("cls", F.monotonically_increasing_id()), "classes")

    held = classes.select("cls", F.explode("anchors").alias("anchor"))
    shared = held.groupBy("anchor").agg(F.min("cls").alias("one"), F.max("cls").alias("two")).where("one < two").select("anchor")
    shared = scratch.keep(shared, "shared")
    marks = held.join(shared, "anchor").groupBy("cls").agg(F.collect_set("anchor").alias("shared"))
    marks = scratch.keep(marks.join(classes.select("cls", "doc_id", "key_a", "key_b"), "cls"), "marks")
    marked = scratch.keep(docs.select("doc_id", whole_text().alias("text")).join(marks, "doc_id"), "marked")
    windows = scratch.keep(candidate_windows(marked, window, anchor).where(F.size("place") > 0), "windows")

    each = windows.select("cls", "doc_id", F.inline(F.arrays_zip("place", "first", "second")))
    source = F.min(F.struct("doc_id", "cls", "place")).alias("source")
    repeats = each.groupBy("first", "second").agg(source, F.max("doc_id").alias("most")).where("source.doc_id < most")
    number = F.floor(F.col("source.place") / block).cast("int").alias("number")
    repeats = scratch.keep(repeats.select("first", "second", F.col("source.doc_id").alias("least"), F.col("source.cls").alias("source"), number), "repeats")
    pairs = scratch.keep(each.join(repeats, ["first", "second"]).where("doc_id > least").select("cls", "source", "number").distinct(), "parse")
    numbers = repeats.groupBy(F.col("source").alias("cls")).agg(F.collect_set("number").alias("numbers"))
    blocks = cut_blocks(marked.drop("shared").join(numbers, "cls"), window, block).dropDuplicates(["source", "number"])
    blocks = scratch.keep(blocks, "blocks")
    referred = pairs.join(blocks, ["source", "number"]).groupBy("cls").agg(F.collect_list(F.struct("ref_doc", "source", "number", "words")).alias("blocks"))
    removed = parsed(marked.drop("shared", "doc_id").join(referred, "cls"), window, block, anchor).dropDuplicates(["cls"])
    removed = scratch.keep(removed, "removed")

    decided = classes.select("key_a", "key_b", F.col("doc_id").alias("owner"), "last", "cls").join(removed, "cls", "left").where("owner < last or n_removed is not null")
    decided = scratch.keep(decided.drop("cls", "last"), "decided")
    scratch.keep_only("index", "decided")
    copy = F.coalesce(F.col("doc_id") > F.col("owner"), F.lit(False))
    return index.select("doc_id", "n_words", "full_sha256", "key_a", "key_b").join(decided, ["key_a", "key_b"], "left").select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(_EMPTY)).when(F.col("doc_id").isNull(), F.col("full_sha256")).otherwise(F.coalesce("kept_sha256", "full_sha256")).alias("kept_sha256"),
        F.when(copy, F.concat(F.lit("0:"), F.col("n_words").cast("string"))).when(F.col("doc_id").isNull(), "").otherwise(F.coalesce("spans", F.lit(""))).alias("spans"),
        F.when(copy | F.col("doc_id").isNull(), F.lit("")).otherwise(F.coalesce("factors", F.lit(""))).alias("factors"),
    )


def op8_duplicate_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_spans(documents(spark, sf_dir)).drop("spans", "factors")


OP8_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
starts AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 49), ' ')) h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) p FROM words WHERE len(w) >= 50)),
least AS (SELECT h, min(doc_id) m FROM starts GROUP BY h),
covered AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) i FROM starts JOIN least USING (h) WHERE m < doc_id),
kept AS (
  SELECT e.doc_id, count(*) n, string_agg(e.word, ' ' ORDER BY e.i) t
  FROM (SELECT doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) i FROM words) e ANTI JOIN covered c ON c.doc_id = e.doc_id AND c.i = e.i GROUP BY e.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) n_removed, sha256(coalesce(t, '')) kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
