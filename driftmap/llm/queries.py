"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from driftmap.llm import bpe, html_extraction, lexical_search, license_scan, media_chunks, mixing, near_dedup, quality_rules, substring_dedup, url_filter, warc, weak_labels, whitening

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_source_mix": mixing.op2_source_mix,
    "op3_warc_derivatives": warc.op3_warc_derivatives,
    "op4_repeated_phrases": substring_dedup.op4_repeated_phrases,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_minhash_near_dedup": near_dedup.op6_minhash_near_dedup,
    "op7_forced_boundaries": bpe.op7_forced_boundaries,
    "op8_weak_labels": weak_labels.op8_weak_labels,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_chunked_media": media_chunks.op10_chunked_media,
    "op11_lanczos_whitening": whitening.op11_lanczos_whitening,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_main_text": html_extraction.op13_main_text,
}
ORACLES = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op3_warc_derivatives": warc.OP3_SQL,
    "op4_repeated_phrases": substring_dedup.OP4_SQL,
    "op5_quality_rules": quality_rules.OP5_SQL,
    "op6_minhash_near_dedup": near_dedup.OP6_SQL,
    "op9_license_scan": license_scan.OP9_SQL,
    "op12_lexical_search": lexical_search.OP12_SQL,
}
