"""The registered queries of this subpackage and their SQL forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftwell.llm import bpe, collocations, decontamination, html, jaccard, language, licenses, pseudo_likelihood, substrings, token_store, topk, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": licenses.query,
    "op2_lm_scoring": pseudo_likelihood.query,
    "op3_decontamination": decontamination.query,
    "op4_jaccard_join": jaccard.query,
    "op5_substring_dedup": substrings.query,
    "op6_language_id": language.query,
    "op7_exact_topk": topk.query,
    "op8_html_extraction": html.query,
    "op9_warc": warc.query,
    "op10_byte_bpe": bpe.query,
    "op11_whitening": whitening.query,
    "op12_token_store": token_store.query,
    "op13_collocations": collocations.query,
}
SQL: dict[str, str] = {
    "op1_license_scan": licenses.SQL,
    "op4_jaccard_join": jaccard.SQL,
    "op5_substring_dedup": substrings.SQL,
    "op7_exact_topk": topk.SQL,
    "op9_warc": warc.SQL,
    "op13_collocations": collocations.SQL,
}
