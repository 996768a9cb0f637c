"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import backoff, decontaminate, jaccard, oracles, phrases, pieces, pii, quality, suffixes, urls, wavelet

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_substring_dedup": phrases.op3_substring_dedup,
    "op4_pii_pseudonyms": pii.op4_pii_pseudonyms,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_url_list_join": urls.op6_url_list_join,
    "op7_stupid_backoff": backoff.op7_stupid_backoff,
    "op8_token_files": wavelet.op8_token_files,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_suffix_dedup": suffixes.op10_suffix_dedup,
}
ORACLE_SQL: dict[str, str] = {"op3_substring_dedup": oracles.OP3, "op5_jaccard_join": oracles.OP5, "op6_url_list_join": urls.ORACLE, "op10_suffix_dedup": oracles.OP10}
