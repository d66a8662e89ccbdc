"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import decontamination, fill_in_middle, html_text, language_id, line_rules, mixing, ngram_join, quality_bayes, sharding, source_divergence, substring_dedup, suffix_dedup, warc


def queries() -> dict:
    return {
        "op1_quality_bayes": quality_bayes.op1_quality_bayes,
        "op2_decontamination": decontamination.op2_decontamination,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_html_text": html_text.op4_html_text,
        "op5_sharding": sharding.op5_sharding,
        "op6_warc": warc.op6_warc,
        "op7_language_id": language_id.op7_language_id,
        "op8_line_rules": line_rules.op8_line_rules,
        "op9_mixing": mixing.op9_mixing,
        "op10_ngram_join": ngram_join.op10_ngram_join,
        "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
        "op12_source_divergence": source_divergence.op12_source_divergence,
        "op13_suffix_dedup": suffix_dedup.op13_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": decontamination.OP2_SQL,
        "op3_substring_dedup": substring_dedup.OP3_SQL,
        "op6_warc": warc.OP6_SQL,
        "op8_line_rules": line_rules.OP8_SQL,
        "op9_mixing": mixing.OP9_SQL,
        "op11_fill_in_middle": fill_in_middle.OP11_SQL,
        "op12_source_divergence": source_divergence.OP12_SQL,
        "op13_suffix_dedup": suffix_dedup.OP13_SQL,
    }
