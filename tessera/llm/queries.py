"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm import decontamination, fingerprints, html, jaccard, language, licenses, lines, mixing, pitman_yor, quality


def queries() -> dict:
    return {
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_html_extraction": html.op2_html_extraction,
        "op3_source_mixing": mixing.op3_source_mixing,
        "op4_fingerprints": fingerprints.op4_fingerprints,
        "op5_language_id": language.op5_language_id,
        "op6_license_scan": licenses.op6_license_scan,
        "op7_line_dedup": lines.op7_line_dedup,
        "op8_ngram_jaccard_join": jaccard.op8_ngram_jaccard_join,
        "op9_pitman_yor": pitman_yor.op9_pitman_yor,
        "op10_quality": quality.op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mixing": mixing.OP3_SQL, "op8_ngram_jaccard_join": jaccard.OP8_SQL, "op6_license_scan": licenses.oracle()}
