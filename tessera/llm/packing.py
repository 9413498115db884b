"""Packing documents into fixed-length token sequences: shortest-pack-first over the length histogram.

Documents are tokenised once. Whole sequences' worth of tokens leave as pieces of their own; what is
left of each document (fewer tokens than a sequence) is packed. Only the histogram of those lengths -
at most one count for each length below the sequence length - reaches the driver, where lengths are
placed longest first, each into the pack that is shortest so far. The outcome is a list of packing
patterns with counts, whatever the number of documents. Documents are numbered within their length and
joined to the pattern slot that covers their number.

Ids are those of the tokenizer file. The same vocabulary is read by a library that takes a sixth of the time;
white space of 1,000 characters or more, which that library cannot take, goes through the tokenizer itself.

Null texts count as empty; an empty text is the end token alone. Very long texts are encoded whole, in slices
cut only where no token can cross. Repeated rows are packed as often as they occur; pieces of equal length tie
by doc_id and start, and those of equal rows may change places. Other columns of the input are ignored. An empty table gives no rows. A text holding the
vocabulary's special-token string gets that token's id, as the tokenizer file itself does.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, documents, whole_text

SEQUENCE = 2048
END_ID = 1
VOCABULARY, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
#: The faster library overflows its stack on very long white space; slices that hold some go to the tokenizer file.
LONG_BLANK = re.compile(r"\s{1000}")
SPECIAL = {"<|endoftext|>": 50256}
#: Rows numbered together; one length that holds many documents is dealt over several such groups.
RANK_GROUP = 2_000
#: Texts are encoded in slices of about so many characters, cut where the vocabulary always cuts.
SLICE = 1_000_000

_encoders: dict = {}


def encoder(vocabulary: str):
    """The byte-level vocabulary, loaded once a worker; a bare name is looked up among the public files."""
    if vocabulary not in _encoders:
        import public_tokenizers
        import tiktoken

        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encoders[vocabulary] = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _encoders[vocabulary]


def tokenizer():
    """The same vocabulary as its tokenizer file, loaded once a worker."""
    if TOKENIZER not in _encoders:
        import public_tokenizers
        from tokenizers import Tokenizer

        _encoders[TOKENIZER] = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    return _encoders[TOKENIZER]


def _slices(text: str) -> Iterator[str]:
    """Cuts before a single space between letters or digits, where a token always begins."""
    start = 0
    while len(text) - start > SLICE:
        at = start + SLICE
        while (at := text.find(" ", at)) > 0 and not (text[at - 1].isalnum() and text[at + 1 : at + 2].isalnum()):
            at += 1
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def token_ids(text: str, vocabulary: str = VOCABULARY) -> array:
    """The text's ids and the end token, as unsigned 32-bit integers."""
    enc, ids = encoder(vocabulary), array("I")
    special = any(s in text for s in SPECIAL)
    for part in [text] if special else _slices(text):
        if LONG_BLANK.search(part):
            ids.extend(tokenizer().encode(part, add_special_tokens=False).ids)
        else:
            ids.extend(enc.encode(part, allowed_special="all") if special else enc.encode_ordinary(part))
    ids.append(END_ID)
    return ids


def pieces(docs: DataFrame, sequence: int = SEQUENCE, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: full sequences, then the rest of each document."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = token_ids(text, vocabulary)
                raw, total = memoryview(ids).cast("B"), len(ids)
                for start in range(0, total, sequence):
                    length = min(sequence, total - start)
                    out.append((doc_id, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), total))
            frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield frame.astype({"doc_id": "Int64"} | {c: "int64" for c in frame.columns[1:]})

    return docs.select("doc_id", whole_text().alias("text")).mapInPandas(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def packing_patterns(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, dict[int, int]]]:
    """(count, {length: times}) of every pattern.

    Lengths are placed longest first, into the open packs with the most room ("shortest pack first").
    All packs of one pattern move together, so the work follows the number of lengths and patterns.
    """
    room: dict[int, list[tuple[int, dict[int, int]]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = max((s for s, packs in room.items() if packs and s >= length), default=0)
            if not space:
                fit = sequence // length
                for times in (fit, left % fit):
                    packs = left // fit if times == fit else 1
                    if times and packs:
                        room[sequence - times * length].append((packs, {length: times}))
                left = 0
                continue
            packs, pattern = room[space].pop()
            used = min(packs, left)
            if packs > used:
                room[space].append((packs - used, pattern))
            room[space - length].append((used, pattern | {length: pattern.get(length, 0) + 1}))
            left -= used
    return [pack for packs in room.values() for pack in packs]


def pattern_slots(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, times in a pack, offset) of every slot.

    A pattern has at most sqrt(2 * sequence) distinct lengths, so the list stays small for any corpus.
    """
    slots, ranks, sequence_id = [], defaultdict(int), 0
    for packs, pattern in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            times, first = pattern[length], ranks[length]
            ranks[length] = first + packs * times
            slots.append((length, first, ranks[length], sequence_id, times, offset))
            offset += times * length
        sequence_id += packs
    return slots


def pack(docs: DataFrame, sequence: int = SEQUENCE, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    cut = Scratch(spark, "packing").keep(pieces(docs, sequence, vocabulary), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `sequence` rows
    slots = pattern_slots(packing_patterns(histogram, sequence))
    slot_table = spark.createDataFrame(slots, "length long, lo long, hi long, first_sequence long, times long, slot_offset long")
    groups = spark.createDataFrame([(length, -(-n // RANK_GROUP)) for length, n in histogram.items()], "length long, n_groups long")

    dealt = cut.join(F.broadcast(groups), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), "n_groups")).drop("n_groups")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "start")
    ranked = dealt.withColumn("place", F.row_number().over(within) - 1).join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("place"))
    s = slot_table.withColumnRenamed("length", "slot_length")
    nth = F.col("rank") - F.col("lo")
    return ranked.join(F.broadcast(s), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + F.floor(nth / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("slot_offset") + nth % F.col("times") * F.col("length")).cast("long").alias("offset"),
    )


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
