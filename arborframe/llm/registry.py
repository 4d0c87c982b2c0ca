"""Queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from . import ctph, host_quality, language_mixture, mixing, ngram_jaccard, packing, suffix_dedup, token_spans, toxicity, url_filter

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_ngram_jaccard": ngram_jaccard.op2_ngram_jaccard,
    "op3_packing": packing.op3_packing,
    "op4_ctph": ctph.op4_ctph,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_token_spans": token_spans.op6_token_spans,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_host_quality": host_quality.op8_host_quality,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_language_mixture": language_mixture.op10_language_mixture,
}
ORACLES = {
    "op2_ngram_jaccard": ngram_jaccard.ORACLE,
    "op5_url_filter": url_filter.ORACLE,
    "op8_host_quality": host_quality.ORACLE,
}
