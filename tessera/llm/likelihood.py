"""Scoring documents by masked pseudo-likelihood.

A token is predicted from the tokens on both sides of it, never from itself. Words in lower case are hashed;
corpus-wide counts give the most frequent hashes a class of their own and spread the rest over shared
classes. A window network in numpy embeds two tokens on each side, passes them through one hidden layer and
predicts the token's class in two steps (group, then member given the group). Which word of its class a
token is does not depend on its sides: log P(word | class) comes from the counts of all words of the corpus,
a written table without a limit. A document's score is the sum over its tokens of both logarithms.

Training goes over all documents once, in ``ROUNDS`` rounds. Documents are dealt by hash of their doc_id to rounds and
shards; the number of shards follows from the tokens of the corpus. In a round every shard trains a copy of the
network, and the next round starts from the copies' average, weighted by tokens. Shards are trained in the order
of doc_id and added up in the order of their numbers, so the scores do not depend on how the table is cut into
partitions or on the cluster.

Null and empty texts have no tokens and score 0. Very long texts are trained on and scored whole. Rows that repeat
a doc_id are scored one by one; equal rows get equal scores, so ties are harmless. Extra columns are ignored; an
empty table gives no rows. The sums over rare words are taken over integers. Words are told apart by 64
bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, documents, whole_text

BUCKETS = 1 << 16
#: Classes: GROUPS x GROUPS; the last SHARED are shared by the hashes that are not frequent.
GROUPS, SHARED = 32, 32
CLASSES = GROUPS * GROUPS
EMBED, HIDDEN, SIDE = 16, 32, 2
BATCH, RATE = 1024, 0.7
#: Rounds of training and averaging; tokens of a shard, until there are SHARDS of them; copies added up in one task.
ROUNDS, SHARD_TOKENS, SHARDS, FAN_IN = 2, 2_000_000, 4096, 32
#: Sums over rare words are taken over integers of so many parts of one.
FIXED = 1 << 20
#: Words that make up at least one token in so many are sent to the tasks (there are no more than that); the rest are joined.
COMMON = 4096
#: Adds up the two halves of a row, groups and members; gives each half its own factor.
_HALVES = np.repeat(np.eye(2, dtype=np.float32), GROUPS, axis=0)
_SPREAD = np.ascontiguousarray(_HALVES.T)


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the different words of all texts, the place among them of every word, and the number of words of
    each text."""
    trimmed = pc.ascii_trim_whitespace(texts.cast(pa.large_string()))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(trimmed))
    counts = np.where(pc.binary_length(trimmed).to_numpy() > 0, pc.list_value_length(lists).to_numpy(), 0).astype(np.int64)
    flat = lists.flatten()
    if (counts == 0).any():  # the split of an empty text is one empty word
        flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
    coded = flat.dictionary_encode()
    words = coded.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False)
    return pd.util.hash_array(words, categorize=False).view(np.int64), coded.indices.to_numpy(), counts


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of all texts, and the number of words of each."""
    words, which, counts = coded_words(pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.large_binary()).view(pa.large_string()))
    return words[which], counts


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(48)).astype(np.int64)


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash bucket of every word of all texts, and the number of words of each."""
    hashes, counts = word_hashes(texts)
    return _buckets(hashes), counts


def _parts(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), size):
            yield batch.slice(start, size)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches, 2048):
        words, which, _ = coded_words(part["text"])
        yield pa.RecordBatch.from_pydict({"word": words, "n": np.bincount(which, minlength=len(words))})


def word_counts(texts: DataFrame) -> DataFrame:
    """word (its hash), n: every word of the corpus."""
    return texts.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def bucket_counts(words: DataFrame) -> np.ndarray:
    """Tokens in every hash bucket. The driver gets one row a bucket at most."""
    counts = words.groupBy(F.shiftrightunsigned("word", 48).alias("bucket")).agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(BUCKETS, np.int64)
    total[counts["bucket"].to_numpy(np.int64)] = counts["n"]
    return total


def class_table(total: np.ndarray) -> np.ndarray:
    """Class of every hash bucket, by its count over the whole corpus."""
    own = np.argsort(-total, kind="stable")[: CLASSES - SHARED]
    own = own[total[own] > 0]
    table = CLASSES - SHARED + np.arange(BUCKETS) % SHARED
    table[own] = np.arange(len(own))
    return table.astype(np.int16)


class WindowNetwork:
    """Parameters in one flat array, viewed by name."""

    SHAPES = {"embed": (CLASSES + 1, EMBED), "inner": (2 * SIDE * EMBED, HIDDEN), "inner_bias": (HIDDEN,), "group": (HIDDEN, GROUPS), "group_bias": (GROUPS,), "member": (HIDDEN, GROUPS), "member_bias": (GROUPS, GROUPS)}
    SIZE = sum(int(np.prod(s)) for s in SHAPES.values())

    def __init__(self, flat: np.ndarray | None = None):
        if flat is None:
            flat = np.random.default_rng(11).normal(0, 0.1, self.SIZE)
        self.flat = flat.astype(np.float32)
        at = 0
        for name, shape in self.SHAPES.items():
            size = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + size].reshape(shape))
            at += size

    def _heads(self, h: np.ndarray, token: np.ndarray):
        """The weights of groups and members side by side; group and member of each token; z and exp(z) of both, and
        the sums of the latter."""
        heads = np.concatenate([self.group, self.member], axis=1)
        biases = np.concatenate([np.tile(self.group_bias, (GROUPS, 1)), self.member_bias], axis=1)
        group, member = np.divmod(token, GROUPS)
        z = h @ heads
        z += biases.take(group, axis=0)
        np.clip(z, -60, 60, out=z)  # instead of taking off each row's maximum
        e = np.exp(z)
        return heads, group, GROUPS + member, z, e, e @ _HALVES

    def log_probabilities(self, around: np.ndarray, token: np.ndarray) -> np.ndarray:
        # What each class adds to the hidden layer in each place, so that tokens need no product of their own.
        adds = [self.embed @ self.inner[k * EMBED : (k + 1) * EMBED] for k in range(2 * SIDE)]
        adds[0] += self.inner_bias
        logs = np.empty(len(token))
        for start in range(0, len(token), BATCH):
            sides, own = around[start : start + BATCH], token[start : start + BATCH]
            h = adds[0].take(sides[:, 0], axis=0)
            for k in range(1, 2 * SIDE):
                h += adds[k].take(sides[:, k], axis=0)
            _, group, member, z, _, s = self._heads(np.tanh(h, out=h), own)
            at, s = np.arange(len(own)), np.log(s)
            logs[start : start + BATCH] = (z[at, group] - s[:, 0]).astype(np.float64) + (z[at, member] - s[:, 1])
        return logs

    def train(self, around: np.ndarray, token: np.ndarray, rate: float = RATE) -> None:
        """One step of gradient descent on the mean loss of a batch."""
        n, at = len(token), np.arange(len(token))
        x = self.embed.take(around, axis=0).reshape(n, -1)
        h = x @ self.inner
        h += self.inner_bias
        np.tanh(h, out=h)
        heads, group, member, _, p, s = self._heads(h, token)
        p *= (1 / (s * n)) @ _SPREAD
        p[at, group] -= 1 / n
        p[at, member] -= 1 / n
        dh = (p @ heads.T) * (1 - h * h)
        dx = (dh @ self.inner.T).reshape(-1, EMBED)
        ones, one_hot = np.ones(n, np.float32), np.zeros((GROUPS, n), np.float32)
        one_hot[group, at] = 1
        d_heads = h.T @ p
        self.group -= rate * d_heads[:, :GROUPS]
        self.member -= rate * d_heads[:, GROUPS:]
        self.group_bias -= rate * (ones @ p[:, :GROUPS])
        self.member_bias -= rate * GROUPS * (one_hot @ p[:, GROUPS:])
        self.inner -= rate * (x.T @ dh)
        self.inner_bias -= rate * (ones @ dh)
        # Rows of the embedding that a batch uses are few, so they move further.
        flat = around.ravel().astype(np.int16)  # for a radix sort
        order = np.argsort(flat, kind="stable")
        flat = flat.take(order)
        starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        self.embed[flat[starts]] -= 8 * rate * np.add.reduceat(dx.take(order, axis=0), starts, axis=0)


def windows(classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The SIDE tokens before and after every token of its own text; outside it, the padding class."""
    place = np.arange(len(classes)) + SIDE * np.repeat(np.arange(1, len(counts) + 1), counts)
    padded = np.full(len(classes) + SIDE * (len(counts) + 1), CLASSES, np.int16)
    padded[place] = classes
    return padded.take(place[:, None] + [*range(-SIDE, 0), *range(1, SIDE + 1)])


def _train(batches: Iterator[pd.DataFrame], *, table: np.ndarray, flat: np.ndarray) -> Iterator[pd.DataFrame]:
    """A trained copy of the network for every shard; rows come sorted by shard."""
    shard, network, total = None, None, 0

    def runs() -> Iterator[tuple[int, pd.DataFrame]]:
        """256 texts of a shard at a time, counted from its first, wherever the batches end."""
        held: dict[int, pd.DataFrame] = {}
        for batch in batches:
            for number, rows in batch.groupby("shard", sort=True):
                for other in [k for k in held if k != number]:
                    yield other, held.pop(other)
                rows = pd.concat([held.pop(number), rows]) if number in held else rows
                while len(rows) >= 256:
                    yield number, rows.iloc[:256]
                    rows = rows.iloc[256:]
                if len(rows):
                    held[number] = rows
        yield from held.items()

    done = lambda: pd.DataFrame({"shard": [shard], "tokens": [total], "weighted": [(network.flat.astype(np.float64) * total).tobytes()]})
    for number, rows in runs():
        if number != shard:
            if total:
                yield done()
            shard, network, total = number, WindowNetwork(flat), 0
        words, which, counts = coded_words(pa.array(rows["text"], pa.large_string()))
        token = table[_buckets(words)].take(which)
        around = windows(token, counts)
        order = np.random.default_rng(len(token)).permutation(len(token))
        for start in range(0, len(token), BATCH):
            at = order[start : start + BATCH]
            network.train(around.take(at, axis=0), token.take(at), RATE * len(at) / BATCH)
        total += len(token)
    if total:
        yield done()


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("shard")
    total = np.zeros(WindowNetwork.SIZE)
    for copy in rows["weighted"]:
        total += np.frombuffer(copy)
    return pd.DataFrame({"shard": [rows["shard"].iloc[0] // FAN_IN], "tokens": [rows["tokens"].sum()], "weighted": [total.tobytes()]})


def _score(batches: Iterator[pa.RecordBatch], *, table: np.ndarray, flat: np.ndarray, common: dict[str, np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """Scores of the classes. With ``common`` (word, log_n, log_class) also of the common words given their classes,
    and the rare words of each row with their numbers; what log P(word | class) takes from the class's size is in the
    score for rare words too, the logarithm of their own count is not."""
    network = WindowNetwork(flat)
    for part in _parts(batches):
        words, which, counts = coded_words(part["text"])
        token = table[_buckets(words)].take(which)
        logs, more = network.log_probabilities(windows(token, counts), token), {}
        if common is not None:
            known = common["word"]
            at = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
            found = known[at] == words if len(known) else np.zeros(len(words), bool)
            log_n = np.zeros(len(words))
            log_n[found] = common["log_n"][at[found]]
            logs += log_n.take(which) - common["log_class"].take(token)
            rare = ~found[which]
            row = np.repeat(np.arange(len(counts)), counts)[rare]
            pairs, n = np.unique(row * max(len(words), 1) + which[rare], return_counts=True)
            cuts = pa.array(np.searchsorted(pairs // max(len(words), 1), np.arange(len(counts) + 1)), pa.int32())
            more = {"row": part["row"], "rare": pa.ListArray.from_arrays(cuts, words[pairs % max(len(words), 1)]), "rare_n": pa.ListArray.from_arrays(cuts, n)}
        sums = np.concatenate([[0.0], np.cumsum(logs)])
        ends = np.cumsum(counts)
        yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"].cast(pa.int64()), "n_tokens": counts, "pseudo_log_likelihood": sums[ends] - sums[ends - counts]} | more)


def fit(docs: DataFrame, scratch: Scratch, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class table and network, from all texts. ``docs``: doc_id and text; ``total``: bucket_counts() of the texts."""
    table, flat = class_table(total), WindowNetwork().flat
    shards = min(max(-(-int(total.sum()) // SHARD_TOKENS), 1), SHARDS)
    dealt = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(ROUNDS)).alias("round"))
    schema = "shard long, tokens long, weighted binary"
    for k in range(ROUNDS):
        mine = dealt.where(F.col("round") == k).repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "doc_id", F.xxhash64("text"))
        copies = scratch.keep(mine.select("shard", "text").mapInPandas(partial(_train, table=table, flat=flat), schema), f"copies{k}_0")
        left, level = shards, 0
        while left > 1 or not level:
            level, left = level + 1, -(-left // FAN_IN)
            copies = scratch.keep(copies.groupBy(F.floor(F.col("shard") / FAN_IN)).applyInPandas(_add, schema), f"copies{k}_{level}")
        for row in copies.collect():  # one row, or none without tokens
            flat = np.frombuffer(bytes(row["weighted"])) / row["tokens"]
    return table, flat


def common_words(words: DataFrame, total: np.ndarray, table: np.ndarray) -> dict[str, np.ndarray]:
    """Logarithms of the counts of common words, by hash, and of all classes."""
    rows = words.where(F.col("n") * COMMON >= int(total.sum())).orderBy("word").collect()  # COMMON rows at most
    sizes = np.bincount(table, weights=total, minlength=CLASSES)
    return {"word": np.array([r["word"] for r in rows], np.int64), "log_n": np.log(np.array([r["n"] for r in rows], np.float64)), "log_class": np.log(np.maximum(sizes, 1))}


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, pseudo_log_likelihood (natural logarithm, summed) and its mean per token."""
    scratch = Scratch(docs.sparkSession, "likelihood")
    texts = docs.select("doc_id", whole_text().alias("text"))
    words = scratch.keep(word_counts(texts.select("text")), "words")
    total = bucket_counts(words)
    table, flat = fit(texts, scratch, total)
    scorer = partial(_score, table=table, flat=flat, common=common_words(words, total, table))
    # Numbers of rows hold once they are written.
    numbered = texts.withColumn("row", F.monotonically_increasing_id())
    scored = scratch.keep(numbered.mapInArrow(scorer, "doc_id long, n_tokens long, pseudo_log_likelihood double, row long, rare array<long>, rare_n array<long>"), "scored")
    held = scored.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("times"))
    # The logarithm of 1 adds nothing.
    logs = words.where("n > 1").select("word", F.round(F.log("n") * FIXED).cast("long").alias("log_n"))
    rare = held.join(logs, "word").groupBy("row").agg(F.sum(F.col("times") * F.col("log_n")).alias("rare_log"))
    scores = scored.drop("rare", "rare_n").join(rare, "row", "left")
    # A word alone in its class adds 0, up to rounding.
    score = F.least(F.col("pseudo_log_likelihood") + F.coalesce("rare_log", F.lit(0)) / FIXED, F.lit(0.0))
    scratch.keep_only("scored", "words")
    scores = scores.select("doc_id", "n_tokens", score.alias("pseudo_log_likelihood"))
    return scores.withColumn("per_token", F.when(F.col("n_tokens") > 0, F.col("pseudo_log_likelihood") / F.col("n_tokens")).otherwise(F.lit(0.0)))


def op6_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(documents(spark, sf_dir))
