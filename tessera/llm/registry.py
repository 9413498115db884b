"""The subpackage's queries and their SQL."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm import exact_search, likelihood, mixing, near_search, neardup, packing, private, quality, substrings, warc


def queries() -> dict:
    return {"pipeline": corpus_pipeline.run, "mixing_targets": mixing.mixing_targets} | {f.__name__: f for f in (neardup.op1_near_duplicates, private.op2_private_data, exact_search.op3_exact_search, warc.op4_revisits, packing.op5_pack_sequences, likelihood.op6_pseudo_likelihood, mixing.op7_mix_sources, substrings.op8_duplicate_substrings, quality.op9_quality, near_search.op10_near_search)}


def oracle_sql() -> dict:
    return {"mixing_targets": mixing.MIXING_TARGETS_SQL, "op1_near_duplicates": neardup.OP1_SQL, "op3_exact_search": exact_search.OP3_SQL, "op4_revisits": warc.OP4_SQL, "op8_duplicate_substrings": substrings.OP8_SQL}
