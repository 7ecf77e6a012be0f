"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from ravelin.llm import audit, bpe, exact, langid, licenses, lines, media, mixing, pages, phrases, quality, simhash, substring


def queries() -> dict:
    return {
        "op1_line_dedup": lines.op1_line_dedup,
        "op2_html": pages.op2_html,
        "op3_bpe": bpe.op3_bpe,
        "op4_media": media.op4_media,
        "op5_exact_dedup": exact.op5_exact_dedup,
        "op6_licenses": licenses.op6_licenses,
        "op7_substring": substring.op7_substring,
        "op8_simhash": simhash.op8_simhash,
        "op9_language": langid.op9_language,
        "op10_mixing": mixing.op10_mixing,
        "op11_quality": quality.op11_quality,
        "op12_phrases": phrases.op12_phrases,
        "op13_filter_audit": audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": lines.ORACLE,
        "op5_exact_dedup": exact.ORACLE,
        "op6_licenses": licenses.ORACLE,
        "op10_mixing": mixing.ORACLE,
        "op11_quality": quality.ORACLE,
        "op12_phrases": phrases.ORACLE,
        "op13_filter_audit": audit.ORACLE,
    }
