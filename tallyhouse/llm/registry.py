"""Queries of this subpackage and their SQL, by key."""

from __future__ import annotations

import corpus_pipeline
from tallyhouse.llm import decontaminate, exact, html, language, manifest, minhash, ngrams, packing, phrases, quality, substrings, suffixes, urls

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_minhash_near_dedup": minhash.query,
    "op2_html_extraction": html.query,
    "op3_deleted_interpolation": ngrams.query,
    "op4_url_filter": urls.query,
    "op5_best_fit_packing": packing.query,
    "op10_suffix_array_dedup": suffixes.query,
    "op6_substring_dedup": substrings.query,
    "op7_quality_rules": quality.query,
    "op8_language_id": language.query,
    "op9_benchmark_decontamination": decontaminate.query,
    "op11_phrase_collocations": phrases.query,
    "op12_exact_dedup": exact.query,
    "op13_merkle_manifest": manifest.query,
}
ORACLES = {
    "op1_minhash_near_dedup": minhash.ORACLE,
    "op6_substring_dedup": substrings.ORACLE,
    "op9_benchmark_decontamination": decontaminate.ORACLE,
    "op11_phrase_collocations": phrases.ORACLE,
    "op12_exact_dedup": exact.ORACLE,
    "op13_merkle_manifest": manifest.ORACLE,
}
