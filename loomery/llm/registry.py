"""Queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from loomery.llm import decontaminate, license_scan, near_join, neighbours, pii, quality, repeats, source_mixing, token_store, toxicity

QUERIES = {
    "op1_token_store": token_store.op1_token_store,
    "op10_repeats": repeats.op10_repeats,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_pii": pii.op3_pii,
    "op4_ngram_jaccard": near_join.op4_ngram_jaccard,
    "op5_quality": quality.op5_quality,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op6_neighbours": neighbours.op6_neighbours,
    "op7_source_mixing": source_mixing.op7_source_mixing,
    "op8_license_scan": license_scan.op8_license_scan,
}
SQL = {"op4_ngram_jaccard": near_join.SQL, "op7_source_mixing": source_mixing.SQL, "op8_license_scan": license_scan.SQL, "op10_repeats": repeats.SQL}
