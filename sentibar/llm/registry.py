"""Queries of the training-data operators, and their SQL twins."""

from __future__ import annotations

from . import decontam, html_text, interp, langid, lexical, neighbours, periodic, pieces, quality, simhash, substring, suffixes, token_store

QUERIES = {
    "op1_suffix_dedup": suffixes.op1_suffix_dedup,
    "op2_simhash": simhash.op2_simhash,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_decontamination": decontam.op4_decontamination,
    "op5_token_files": token_store.op5_token_files,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_substring_dedup": substring.op7_substring_dedup,
    "op8_language_id": langid.op8_language_id,
    "op9_html_text": html_text.op9_html_text,
    "op10_interpolated_lm": interp.op10_interpolated_lm,
    "op11_nearest": neighbours.op11_nearest,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

SQL = {
    "op6_quality_rules": quality.SQL,
    "op7_substring_dedup": substring.SQL,
    "op12_lexical_search": lexical.SQL,
}
