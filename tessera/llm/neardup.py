"""Near-duplicate detection: MinHash with banding, signature and set verification, alternating star components.

Every distinct document (by its word sequence) gets the minima of many universal hash functions over its
set of word shingles. Minima are grouped in bands; documents that share a band are candidates. In each
bucket the members are first compared with one of them, and the links found are closed to components. Then
buckets that still hold several components are compared whole, in chunks - but for documents shown to
have no link, see able_to_link() - so that no link between two components is lost and no pairs become rows.
Both comparisons estimate the similarity from the signature (one byte of each minimum) and then count on the
full sets, so only links that hold exactly are used.

With 40 bands of 6 minima a pair of similarity 0.8 escapes all bands with probability 5e-6, and one of
similarity 0.2 meets in a band with probability 0.003.

Documents that are exact copies in words are one class. Classes are numbered, so rows that repeat a doc_id with
another text are classes of their own: they link as their texts do, and a component is named by the smallest
doc_id in any of its classes. Documents without words have an empty set and link with nothing. Null texts
count as empty. Very long texts are hashed whole; only their sets, bounded by their words, are held. Similarity of
exactly the threshold is a link, so there are no ties to settle. Extra columns are ignored; an empty table gives no
rows. Rows with a null doc_id take no part in links and keep a null component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, documents, whole_text

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 40, 6
#: Minima that leave a byte in the signature.
SIGNED = 128
#: Signature estimates under the threshold by so many standard deviations are not counted on the sets.
SLACK = 5.0
#: Shingles in a chunk of a component that is compared with another.
CHUNK = 500_000
_SEED = 977

_U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (murmur3 finaliser)."""
    x = (x ^ (x >> _U64(33))) * _U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U64(33))) * _U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U64(33))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, ASCII letters in lower case, and the number of words of each text."""
    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.empty(int(counts.sum()), dtype=object)
    flat[:] = [w for ws in words for w in ws]
    return pd.util.hash_array(flat, categorize=False).astype(_U64), counts


def sequence_hash(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words."""
    n = len(hashes) - width + 1
    total = np.full(n, _U64(width))
    for k in range(width):
        total = (total + hashes[k : k + n]) * _U64(0x9E3779B97F4A7C15)
        total ^= total >> _U64(29)
    return _mix(total)


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingles; a text with fewer words is one shingle."""
    if len(hashes) == 0:
        return np.empty(0, _U64)
    return np.unique(sequence_hash(hashes, min(width, len(hashes))))


def _families(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    return (rng.integers(0, 2**32, n, dtype=np.uint64) | _U64(1)).astype(np.uint32)[:, None], rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)[:, None]


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of every hash function ``a * x + b`` modulo 2**32."""
    low = np.full(len(a), np.uint32(0xFFFFFFFF))
    folded = (shingles ^ (shingles >> _U64(32))).astype(np.uint32)
    for start in range(0, len(folded), 2048):  # blocks that stay in cache
        np.minimum(low, (folded[None, start : start + 2048] * a + b).min(axis=1), out=low)
    return low


def _texts(batches: Iterator[pd.DataFrame], size: int = 256) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, len(batch), size):
            part = batch.iloc[start : start + size]
            hashes, counts = word_hashes(part["text"].tolist())
            yield part, hashes, np.concatenate([[0], np.cumsum(counts)])


def signatures(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, class_key (of the word sequence), band keys and the one-byte signature of every row."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _families(bands * rows)
        of_band = _mix(np.arange(1, bands + 1, dtype=_U64))
        for part, hashes, ends in _texts(batches):
            sizes, keys, keys2, buckets, signature = [], [], [], [], []
            for lo, hi in zip(ends[:-1], ends[1:]):
                words = hashes[lo:hi]
                found = shingle_set(words, shingle)
                sizes.append(len(found))
                if not len(found):
                    keys.append(0), keys2.append(0), buckets.append(None), signature.append(None)
                    continue
                one, two = class_keys(words)
                keys.append(one), keys2.append(two)
                low = minima(found, a, b).astype(_U64).reshape(bands, rows)
                key = of_band.copy()
                for r in range(rows):
                    key = _mix((key ^ low[:, r]) * _U64(0x9E3779B97F4A7C15) + _U64(r))
                buckets.append(key.view(np.int64))
                signature.append(_mix(low.ravel()[:SIGNED]).astype(np.uint8).tobytes())
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(), "n_shingles": sizes, "key_a": keys, "key_b": keys2, "bands": buckets, "signature": signature})

    schema = "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>, signature binary"
    return docs.select("doc_id", whole_text().alias("text")).mapInPandas(sign, schema)


def class_keys(words: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a word sequence."""
    at = np.arange(1, len(words) + 1, dtype=_U64)
    one = np.bitwise_xor.reduce(_mix(words + at * _U64(0x9E3779B97F4A7C15)))
    return int(one.view(np.int64)), int(_mix(words * _U64(0xC2B2AE3D27D4EB4F) + at).sum(dtype=_U64).view(np.int64))


def shingle_sets(docs: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """cls, shingles (sorted as unsigned numbers) of the classes (cls, doc_id, key_a, key_b), from a row of ``docs`` each."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, hashes, ends in _texts(batches):
            texts = [hashes[lo:hi] for lo, hi in zip(ends[:-1], ends[1:])]
            keys = [class_keys(w) if len(w) else (0, 0) for w in texts]
            sets = [shingle_set(w, shingle).view(np.int64) for w in texts]
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "key_a": [k[0] for k in keys], "key_b": [k[1] for k in keys], "shingles": sets})

    texts = docs.select("doc_id", whole_text().alias("text")).join(classes.select("doc_id").distinct(), "doc_id", "left_semi")
    found = texts.mapInPandas(find, "doc_id long, key_a long, key_b long, shingles array<long>")
    # Rows that repeat a doc_id and its text give one set.
    return found.join(classes.select("cls", "doc_id", "key_a", "key_b"), ["doc_id", "key_a", "key_b"]).groupBy("cls").agg(F.first("shingles").alias("shingles"))


def least_agreement(percent: int, minima_count: int) -> float:
    """Signature agreement under which a pair is not counted on the sets."""
    t = percent / 100
    return t - SLACK * (t * (1 - t) / minima_count) ** 0.5


@F.pandas_udf(T.DoubleType())
def _agreement(one: pd.Series, other: pd.Series) -> pd.Series:
    """The share of signature bytes that agree."""
    return pd.Series([np.mean(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)) for x, y in zip(one, other)], dtype=float)


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch, name: str, shingle: int, percent: int, minima_count: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    s = classes.select("cls", "n_shingles", "signature")
    side = lambda c: s.select(F.col("cls").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("signature").alias(f"s_{c}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    likely = scratch.keep(sized.where(_agreement("s_a", "s_b") >= least_agreement(percent, minima_count)).select("a", "b", "n_a", "n_b"), f"{name}_likely")
    ids = likely.select(F.col("a").alias("cls")).union(likely.select("b")).distinct()
    ids = scratch.keep(classes.select("cls", "doc_id", "key_a", "key_b").join(ids, "cls", "left_semi"), f"{name}_ids")
    sets = scratch.keep(shingle_sets(docs, ids, shingle), f"{name}_sets")
    both = likely.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    links = both.where(100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")
    links = scratch.keep(links, f"{name}_links")
    scratch.drop(f"{name}_sets")
    return links


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, component (the smallest id reachable) for every node with a link, by alternating large-star and small-star.

    Both steps take each node's least neighbour by a pre-aggregated minimum and join it back, so a node with
    very many links is split like any skewed join key. Every round writes its links; it ends when a round
    changes none.
    """
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(), f"{name}_e0")
    before, step = None, 0
    mark = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
    while True:
        now = mark(edges)
        if now == before or now[0] == 0:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        before = now
        # Large-star: every larger neighbour of a node is linked to the node's least neighbour (or itself).
        sides = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other")).union(edges.select("lo", "hi"))
        least = scratch.keep(sides.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("low")), f"{name}_l{step}")
        large = sides.where("other > node").join(least, "node").select(F.col("other").alias("hi"), F.col("low").alias("lo")).distinct()
        large = scratch.keep(large, f"{name}_g{step}")
        # Small-star: a node and its smaller neighbours are linked to the least of them.
        low = scratch.keep(large.groupBy("hi").agg(F.min("lo").alias("low")), f"{name}_m{step}")
        small = large.join(low, "hi").select(F.explode(F.array(F.struct(F.col("hi"), F.col("low").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("low").alias("lo")))).alias("e"))
        step += 1
        edges = scratch.keep(small.select("e.hi", "e.lo").where("hi <> lo").distinct(), f"{name}_e{step}")
        for old in (f"{name}_e{step - 1}", f"{name}_l{step - 1}", f"{name}_g{step - 1}", f"{name}_m{step - 1}"):
            scratch.drop(old)


def able_to_link(members: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """cls, n, reach of the members that can have a link to another member at all; and the sets of all members.

    Some of a member's n shingles are in no other member; let u be the number of the rest. The intersection with
    any member b is at most u, so a link needs (100 + percent) u >= percent (n + n_b), that is
    percent * n_b <= reach with reach = (100 + percent) u - percent * n, and the same for b. In a large group of
    distant copies this settles most members, and most pairs of the others.
    """
    ids = scratch.keep(classes.select("cls", "doc_id", "key_a", "key_b").join(members.select("cls").distinct(), "cls", "left_semi"), "open_ids")
    sets = scratch.keep(shingle_sets(docs, ids, shingle), "open_sets")
    holders = sets.select("cls", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("cls").alias("cls"), F.max("cls").alias("last"))
    own = holders.where("cls = last").groupBy("cls").agg(F.count(F.lit(1)).alias("own"))
    sized = sets.select("cls", F.size("shingles").cast("long").alias("n"))
    shared = F.col("n") - F.coalesce("own", F.lit(0))
    able = sized.join(own, "cls", "left").where(100 * shared >= percent * F.col("n"))
    able = scratch.keep(able.select("cls", "n", ((100 + percent) * shared - percent * F.col("n")).alias("reach")), "able_ids")
    return able, sets


def _compare(rows: pd.DataFrame, *, percent: int, least: float) -> pd.DataFrame:
    """Links between the components of two chunks of a bucket (or inside one): enough to join all that are linked.

    A pair is compared in the bucket of the smallest band that both have, and only while its components are not yet joined.
    """
    rows = rows.sort_values(["host", "cls"], ascending=[False, True])
    within = bool(rows["host"].all())
    n_hosts = int(rows["host"].sum())
    ids, band = rows["cls"].to_numpy(np.int64), int(rows["band"].iloc[0])
    root, reach = rows["component"].to_numpy(np.int64).copy(), rows["reach"].to_numpy(np.int64)
    bands = np.stack(rows["bands"].to_numpy())
    signatures = np.frombuffer(b"".join(rows["signature"]), np.uint8).reshape(len(rows), -1)
    sets = [np.sort(np.asarray(x, dtype=np.int64)) for x in rows["shingles"]]  # they come in the order of unsigned values
    sizes, found = np.array([len(x) for x in sets]), []
    for guest in range(1 if within else n_hosts, len(rows)):
        n = min(guest, n_hosts)
        may = (reach[guest] >= percent * sizes[:n]) & (reach[:n] >= percent * sizes[guest]) & (root[:n] != root[guest])
        may = np.flatnonzero(may)
        may = may[np.where(bands[may] == bands[guest], bands[may], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max) == band]
        may = may[(signatures[may] == signatures[guest]).mean(axis=1) >= least] if len(may) else may
        ordered = sets[guest]
        for host in may:
            if root[host] == root[guest]:
                continue
            at = np.minimum(np.searchsorted(ordered, sets[host]), len(ordered) - 1)
            common = int((ordered[at] == sets[host]).sum())
            if 100 * common >= percent * (sizes[host] + sizes[guest] - common):
                found.append((int(ids[host]), int(ids[guest])))
                root[root == root[guest]] = root[host]
    return pd.DataFrame({"a": [min(x) for x in found], "b": [max(x) for x in found]}, dtype="int64")


def links_across(members: DataFrame, classes: DataFrame, sets: DataFrame, scratch: Scratch, percent: int, minima_count: int) -> DataFrame:
    """Links (a, b) between classes of different components that meet in a bucket, enough to join all components that have any.

    ``members``: band, cls, component, n and reach; ``sets``: cls and shingles. Buckets with the same members count
    once, by their smallest band. Members are cut by hash into chunks of about CHUNK shingles, and a task compares
    one chunk with another or with itself, so that neither documents nor components are paired as rows.
    """
    mark = [F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("cls")).alias("h1"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("h2")]
    buckets = members.groupBy("band").agg(*mark, F.sum("n").alias("total"), F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2")
    buckets = buckets.groupBy("m", "h1", "h2").agg(F.min("band").alias("band"), F.first("total").alias("total"))
    buckets = scratch.keep(buckets.select("band", F.ceil(F.col("total") / CHUNK).cast("int").alias("chunks")), "mixed_buckets")
    own = F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int")
    met = members.join(buckets, "band").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("band", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), (F.col("own") <= F.col("other")).alias("host"), "cls", "component", "reach")
    rows = met.join(classes.select("cls", "bands", "signature"), "cls").join(sets, "cls")
    compare = partial(_compare, percent=percent, least=least_agreement(percent, minima_count))
    return scratch.keep(rows.groupBy("band", "one", "two").applyInPandas(compare, "a long, b long").distinct(), "across_links")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "neardup")
    signed = scratch.keep(signatures(docs, shingle, bands, rows), "signed")
    with_words = signed.where("n_shingles > 0 and doc_id is not null")
    # One class for each word sequence; its attributes ride along with its smallest id. Written, so its numbers hold.
    classes = with_words.groupBy("key_a", "key_b").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "signature")).alias("m"))
    classes = scratch.keep(classes.select("key_a", "key_b", "m.*").withColumn("cls", F.monotonically_increasing_id()), "classes")
    minima_count = min(SIGNED, bands * rows)
    banded = classes.select("cls", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("cls").alias("a"), F.max("cls").alias("last")).where("a < last").select("band", "a")
    buckets = scratch.keep(buckets, "buckets")
    members = scratch.keep(banded.join(buckets, "band"), "members")
    links = verified(members.where("a < cls").select("a", F.col("cls").alias("b")).distinct(), classes, docs, scratch, "star", shingle, percent, minima_count)
    found = components(links, scratch, "first")

    # Pairs in one bucket but in different components; copies inside a component need no comparison.
    placed = members.join(found.withColumnRenamed("node", "cls"), "cls", "left").select("band", "cls", F.coalesce("component", "cls").alias("component"))
    placed = scratch.keep(placed, "placed")
    mixed = placed.groupBy("band").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("band")
    mixed = scratch.keep(mixed, "mixed")
    open_members = scratch.keep(placed.join(mixed, "band"), "open")
    able, sets = able_to_link(open_members, classes, docs, scratch, shingle, percent)
    more = links_across(scratch.keep(open_members.join(able, "cls"), "able"), classes, sets, scratch, percent, minima_count)
    closed = components(links.unionByName(more), scratch, "all")

    # A component is named by the smallest doc_id of its classes.
    linked = closed.withColumnRenamed("node", "cls")
    of_class = classes.select("key_a", "key_b", "doc_id", "cls").join(linked, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    of_class = scratch.keep(of_class.select("key_a", "key_b", "doc_id", "component"), "of_class")
    names = scratch.keep(of_class.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"), "names")
    named = of_class.join(names, "component", "left").select("key_a", "key_b", F.coalesce("component_id", "doc_id").alias("component_id"))
    named = scratch.keep(named, "result")
    inside = with_words.select("doc_id", "n_shingles", "key_a", "key_b").join(named, ["key_a", "key_b"]).select("doc_id", "n_shingles", "component_id")
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    scratch.keep_only("signed", "result")
    return inside.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The documents that represent their group, each text once.

    Rows that repeat a doc_id with other texts stay if any of them does; rows that repeat doc_id and text leave one.
    """
    found = near_duplicates(docs, **options).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    found = Scratch(docs.sparkSession, "neardup").keep(found.where("not kept or n > 1"), "found")
    gone = found.where("not kept").select(F.col("doc_id").alias("_tessera_gone"))
    repeated = found.where("kept").select(F.col("doc_id").alias("_tessera_repeated"))
    stay = docs.join(gone, docs["doc_id"] == F.col("_tessera_gone"), "left_anti")
    once = stay.join(repeated, F.col("doc_id") == F.col("_tessera_repeated"), "left_anti")
    several = stay.join(repeated, F.col("doc_id") == F.col("_tessera_repeated"), "left_semi")
    several = several.withColumn("_tessera_text", F.sha2(whole_text(), 256)).dropDuplicates(["doc_id", "_tessera_text"])
    return once.select(*docs.columns).unionByName(several.select(*docs.columns))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle=4)


#: Sets of word sequences joined by a space, which no word holds; links are counted on an inverted index, components closed by recursion.
OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) END s FROM words),
sizes AS (SELECT doc_id, len(s) n FROM sets),
each AS (SELECT doc_id, hash(unnest(s)) h FROM sets),
common AS (SELECT x.doc_id a, y.doc_id b, count(*) c FROM each x JOIN each y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS r FROM sizes UNION SELECT reached.doc_id, b FROM reached JOIN both_ways ON a = r)
SELECT doc_id, CAST(n AS BIGINT) n_shingles, min(r) component_id, doc_id = min(r) AS kept FROM reached JOIN sizes USING (doc_id) GROUP BY doc_id, n
"""
