"""The numbered operators as queries over a folder of tables, and their SQL."""

from __future__ import annotations

from . import conversations, exact_dedup, html_extract, language_id, line_dedup, lm_scoring, mixing, ngram_join, packing, quality_crf, quality_rules, ranked_search, token_count


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1,
        "op2_html_extract": html_extract.op2,
        "op3_mixing": mixing.op3,
        "op4_ngram_jaccard_join": ngram_join.op4,
        "op5_token_counts": token_count.op5,
        "op6_packing": packing.op6,
        "op7_language_id": language_id.op7,
        "op8_quality_rules": quality_rules.op8,
        "op9_quality_classifier": quality_crf.op9,
        "op10_lm_scoring": lm_scoring.op10,
        "op11_conversation_repair": conversations.op11,
        "op12_ranked_search": ranked_search.op12,
        "op13_line_dedup": line_dedup.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.SQL,
        "op3_mixing": mixing.SQL,
        "op4_ngram_jaccard_join": ngram_join.SQL,
        "op11_conversation_repair": conversations.SQL,
        "op12_ranked_search": ranked_search.SQL,
        "op13_line_dedup": line_dedup.SQL,
    }
