"""The corpus pipeline: quality filter, near-duplicate removal, sanitisation, mixing and packing.

Every stage works on all that its predecessor kept. All but the last return the columns of ``documents``; the
last returns the packed pieces. Extra columns pass through all stages but the last. An empty table gives an empty
table at every stage. Nulls, empty and very long texts, ties and repeated rows are treated as each stage's function
says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, neardup, packing, private, quality
from tessera.llm.common import Scratch, documents


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores at 0.5 or more.

    A null text is scored as an empty one; very long texts are scored whole. Repeated rows get equal scores and stay
    or go together; a score of exactly 0.5 stays. Rows with a null doc_id are scored like others and never fitted on.
    """
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies (five-word shingles, similarity 0.8).

    Texts without words (null, empty) are in no group and stay, as do rows with a null doc_id. Rows that repeat doc_id
    and text leave one; rows that repeat a doc_id with other texts stay if any of them does. Very long texts are compared
    whole. A similarity of exactly 0.8 is a link.
    """
    return neardup.deduplicated(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and disclosing terms replaced.

    No row is dropped. A text without findings, null or empty, stays as it is. Spans that overlap are replaced once, by
    the first; repeated rows get equal texts. Very long texts are searched whole.
    """
    return private.sanitised(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Texts without words (null, empty) have size 0 and are taken no times. A null source is a source of its own.
    Rows that repeat a doc_id follow the largest number of copies decided for it. Draws follow from doc_ids, so reruns
    agree; documents of equal size tie by doc_id.
    """
    return mixing.repeat_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a sequence of 2048 tokens.

    A null or empty text is the end token alone; repeated rows are packed each; very long texts are cut at the
    sequence length. Pieces of equal length tie by doc_id and start.
    """
    return packing.pack(docs)


STAGES = [("quality", accept_quality), ("near_duplicates", drop_near_duplicates), ("private_data", sanitise), ("mixing", mix_to_targets), ("packing", pack_sequences)]

#: SQL can express neither the fitted classifier nor MinHash candidates; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    scratch, docs = Scratch(spark, "pipeline"), documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
